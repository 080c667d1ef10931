"""Packets to alerts in one stream: sessions, source behaviour, host history, models, alert files.

Each micro-batch runs the batch jobs on what became final, with the rest of the past in state tables:

* open flows and waiting packets (``sessions``);
* flows that sources opened lately, ended or not, for the counts of the source window;
* ended flows that wait until no flow that ended before them can still appear, which is one timeout later;
* the last flows of each host, for its sequence.

So flows are scored in the order in which they end, each once, with the same result as ``score_flows`` on the whole
table in that order. Scored flows and alerts are written per batch; a repeated batch overwrites its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.config import DEFAULT, MICROS, FlowConfig
from flowlens.operators.alerts import build_alerts
from flowlens.operators.behaviour import behaviour_among
from flowlens.operators.features import RAW_SUMS, contract_columns, with_measures
from flowlens.plans.flows import clean_packets
from flowlens.plans.scoring import Artifacts, history_schema, host_history, score_flows
from flowlens.storage import written
from flowlens.streaming.sessions import Sessions, last_version, run_batches

ORDER = ["last_us", "start_seq"]
OPENING = ["flow_id", "a_ip", "b_ip", "b_port", "start_us", "start_seq"]


class Detection:
    """The state of a detection stream and its step from packets to alerts."""

    def __init__(self, packets: DataFrame, folder: str, lateness: str, art: Artifacts, cfg: FlowConfig = DEFAULT):
        self.sessions = Sessions(packets, folder, lateness, cfg)
        self.state, self.folder, self.art, self.cfg = self.sessions.state, folder, art, cfg
        self.slack_us = int(max(cfg.tcp_timeout_s, cfg.udp_timeout_s, cfg.other_timeout_s) * MICROS)
        none = self.sessions.open_flows(-1)
        self.opening_schema = none.select(*OPENING).schema
        finished = self._finished(none, none.select(*OPENING))
        self.finished_schema = finished.schema
        self.history_schema = history_schema(finished, ORDER)

    def _finished(self, flows: DataFrame, openings: DataFrame) -> DataFrame:
        """Contract rows of ended flows."""
        measured = with_measures(flows).drop(*RAW_SUMS)
        return contract_columns(behaviour_among(measured, openings, self.cfg), ORDER)

    def handle(self, packets: DataFrame, batch: int) -> None:
        flows, clock = self.sessions.step(clean_clock(packets), batch)
        flows = self.state.write(flows, batch, "flows")
        before = self.state.read(batch - 1, "openings", self.opening_schema)
        openings = written(before.unionByName(flows.select(*OPENING)).dropDuplicates(["flow_id"]), "openings")
        # an open flow ends at clock - slack at the earliest and looks one window back from there
        recent = F.col("start_us") >= clock - self.slack_us - self.cfg.source_window_us
        self.state.write(openings.where(recent), batch, "openings")
        ended = self._finished(flows.where("NOT open").drop("open", "finalize_reason"), openings)
        ended = self.state.read(batch - 1, "ended", self.finished_schema).unionByName(ended)
        self._settle(written(ended, "ended"), batch, clock - self.slack_us)
        self.state.forget(batch)

    def _settle(self, ended: DataFrame, batch: int, until: int | None) -> None:
        """Score the ended flows that no other can precede any more (all, without `until`); keep the rest.

        A flow that ended at `until` itself may still be open, so those of that time wait for it.
        """
        ready = ended if until is None else ended.where(F.col("last_us") < until)
        history = self.state.read(batch - 1, "history", self.history_schema)
        scored = score_flows(ready, self.art, ORDER, history=history)
        name = "batch=end" if until is None else f"batch={batch}"
        scored.write.mode("overwrite").parquet(f"{self.folder}/scored/{name}")
        scored = scored.sparkSession.read.schema(scored.schema).parquet(f"{self.folder}/scored/{name}")
        no_evidence = F.array().cast("array<struct<feature:string,value:double,evidence_source:string>>")
        alerts = build_alerts(scored.withColumn("shap_evidence", no_evidence))
        alerts.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{self.folder}/alerts/{name}")
        if until is not None:
            self.state.write(ended.where(F.col("last_us") >= until), batch, "ended")
            self.state.write(host_history(ready, ORDER, history), batch, "history")

    def flush(self, last: int) -> None:
        """End open flows, and score all that wait, as the batch job does at the end of its table."""
        flows = self.sessions.open_flows(last)
        openings = self.state.read(last, "openings", self.opening_schema)
        ended = self._finished(flows.drop("finalize_reason"), openings)
        ended = self.state.read(last, "ended", self.finished_schema).unionByName(ended)
        self._settle(written(ended, "ended"), last + 1, None)


def clean_clock(packets: DataFrame) -> DataFrame:
    """Packets with normalized names, and the rows that only carry a time."""
    kept = clean_packets(packets)
    return kept.unionByName(packets.where("src_ip IS NULL OR dst_ip IS NULL"))


def detect_available(
    packets: DataFrame, folder: str, lateness: str, art: Artifacts, cfg: FlowConfig = DEFAULT, flush: bool = True
) -> None:
    """Run a packet stream over everything available into `folder`/scored and `folder`/alerts.

    Without ``flush`` open and waiting flows stay in the state, and a later run on the folder continues them.
    """
    job = Detection(packets, folder, lateness, art, cfg)
    last = run_batches(packets, job.handle, f"{folder}/checkpoint")
    if flush:
        job.flush(last if last >= 0 else last_version(job.state))
