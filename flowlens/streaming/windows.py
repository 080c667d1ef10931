"""Source behaviour, incidents and host sequences on streams, by state tables.

Rows wait until the clock has passed them; each batch answers those it passed, for all keys at once, by the batch
operators on them and the rows before them that they can still see. So a source that owns half of all rows is
spread like any other, and a rare one costs no call of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.config import DEFAULT, FEATURE_COLUMNS, INCIDENT_WINDOW_SECONDS, MICROS, SEQUENCE_LENGTH, FlowConfig
from flowlens.operators.alerts import incidents
from flowlens.operators.behaviour import OPENED, count_recent
from flowlens.operators.dataset import host_sequences
from flowlens.storage import written
from flowlens.streaming.sessions import run_batches
from flowlens.streaming.state import StateTables, interval_us


def answer_available(
    stream: DataFrame,
    folder: str,
    lateness: str,
    live: Column,
    answer: Callable[[DataFrame], DataFrame],
    keep: Callable[[DataFrame, int], DataFrame],
) -> DataFrame:
    """Run a stream with a column t_us over everything available; return what `answer` made of its rows.

    ``answer`` takes the rows that the clock passed in a batch (``due``) and the rows before them that were kept, and
    returns one table for the due ones. ``keep`` picks, from the same rows and the clock, those that later rows may see.
    Rows that are not ``live`` only move the clock. ``lateness`` must cover the disorder; later rows are dropped and
    counted (``state.StateTables.clock``).
    """
    spark = stream.sparkSession
    state, late_us = StateTables(spark, f"{folder}/state"), interval_us(spark, lateness)

    def handle(rows: DataFrame, batch: int) -> None:
        before, clock = state.tick(batch, rows, late_us)
        fresh = rows.where(live & (F.col("t_us") >= before))
        pool = state.read(batch - 1, "waiting", stream.schema).unionByName(fresh)
        state.write(pool.where(F.col("t_us") >= clock), batch, "waiting")
        kept = state.read(batch - 1, "kept", stream.schema).withColumn("due", F.lit(False))
        seen = kept.unionByName(pool.where(F.col("t_us") < clock).withColumn("due", F.lit(True)))
        seen = written(seen, "stream-seen")
        answer(seen).write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")
        state.write(keep(seen, clock).drop("due"), batch, "kept")
        state.forget(batch)

    run_batches(stream, handle, f"{folder}/checkpoint")
    none = answer(spark.createDataFrame([], stream.schema).withColumn("due", F.lit(True)))
    try:
        return spark.read.schema(none.schema).parquet(f"{folder}/out").drop("batch")
    except Exception as e:  # noqa: BLE001 - no batch has run yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return none


def behaviour_available(events: DataFrame, folder: str, lateness: str, cfg: FlowConfig = DEFAULT) -> DataFrame:
    """Source behaviour of each probe of a stream of ``sources.behaviour_events``."""

    def answer(seen: DataFrame) -> DataFrame:
        opened = seen.where("NOT is_probe").select(*[F.col({"start_us": "t_us"}.get(c, c)).alias(c) for c in OPENED])
        probes = seen.where("is_probe AND due").select("a_ip", F.col("t_us").alias("at"), F.struct("flow_id").alias("row"))
        made = count_recent(probes, opened, cfg.source_window_us)
        return made.select("row.flow_id", *made.columns[1:])

    def keep(seen: DataFrame, clock: int) -> DataFrame:
        return seen.where(~F.col("is_probe") & (F.col("t_us") >= clock - cfg.source_window_us))

    return answer_available(events, folder, lateness, F.col("a_ip").isNotNull(), answer, keep)


def incidents_available(
    alerts: DataFrame, folder: str, lateness: str, window_s: int = INCIDENT_WINDOW_SECONDS
) -> DataFrame:
    """Incidents of an alert stream (alert_id, src_ip, t_us, threat_class, risk_score)."""
    live = F.coalesce(F.col("threat_class") != "benign", F.lit(False)) & F.col("src_ip").isNotNull()

    def answer(seen: DataFrame) -> DataFrame:
        due = seen.where("due").select("alert_id")
        made = incidents(seen.drop("due"), window_s).drop("incident_id").join(due, "alert_id", "left_semi")
        return made.withColumn("threat_classes", F.array_join("threat_classes", ","))

    def keep(seen: DataFrame, clock: int) -> DataFrame:
        return seen.where(F.col("t_us") >= clock - window_s * MICROS)

    return answer_available(alerts, folder, lateness, live, answer, keep)


def sequences_available(
    flows: DataFrame,
    host: str,
    tie: str,
    folder: str,
    lateness: str,
    columns: Sequence[str] = tuple(FEATURE_COLUMNS),
    length: int = SEQUENCE_LENGTH,
    ttl_s: int = 86_400,
) -> DataFrame:
    """(flow_id, sequence) of every flow of a stream, in order of (t_us, tie); a host idle for ``ttl_s`` is forgotten."""
    order = ["t_us", tie]

    def answer(seen: DataFrame) -> DataFrame:
        return host_sequences(seen, host, order, columns, length).where("due").select("flow_id", "sequence")

    def keep(seen: DataFrame, clock: int) -> DataFrame:
        # Spark limits row_number on the map side, so a host with half of all rows sends few
        newest = Window.partitionBy(host).orderBy(*[F.desc(c) for c in order])
        last = seen.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") < length).drop("_n")
        live = seen.where(F.col("t_us") >= clock - ttl_s * MICROS).select(host).distinct()
        return last.join(live, host, "left_semi")

    return answer_available(flows, folder, lateness, F.col(host).isNotNull(), answer, keep)
