"""Score a stream of finalized flows and write its alerts, once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlens.operators.alerts import build_alerts
from flowlens.sources.tables import FLOW_SCHEMA
from flowlens.streaming.common import stream_files


def flow_stream(
    spark: SparkSession, path: str, files_per_batch: int = 1, archive: str | None = None, form: str = "csv"
) -> DataFrame:
    """Replay of flow feature files; the pace is set by files per batch and by the trigger."""
    return stream_files(spark, path, FLOW_SCHEMA, form, files_per_batch, archive)


def score_and_alert(
    flows: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    alerts_path: str,
    checkpoint: str,
    every: str | None = None,
):
    """Start a query that scores each micro-batch and writes its non-benign alerts as JSON.

    Each batch has its own folder, overwritten if the batch is repeated after a failure, so every
    alert is kept exactly once. ``every`` paces the batches; without it everything available is
    processed and the query stops.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        alerts = build_alerts(score(batch))
        alerts.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{alerts_path}/batch={batch_id}")

    writer = flows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    timed = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return timed.start()
