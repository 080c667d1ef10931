"""Flow sessions on a packet stream: open flows as sums that add up, closed by event time.

Packets wait until the clock has passed them, so they extend flows in order of time whatever batch they come in.
State: the waiting packets, and per open flow and packet size the same sums that batch flows are made of
(``sessionize.add_up``): sizes, gaps and entropy are exact, whatever a flow's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.config import DEFAULT, FlowConfig
from flowlens.functions.network import timeout_us
from flowlens.operators.sessionize import (
    FLOW_KEYS,
    add_up,
    flows_of_sizes,
    number_pieces,
    packet_parts,
)
from flowlens.streaming.state import NEVER, StateTables, interval_us

RESULT = "flows"


class Sessions:
    """The flow sessions of a packet stream, one micro-batch after the other."""

    def __init__(self, packets: DataFrame, folder: str, lateness: str, cfg: FlowConfig = DEFAULT):
        if cfg.history_cap is not None:
            raise ValueError("a stream keeps sums of all packets of a flow; a history cap needs the batch job")
        spark = packets.sparkSession
        self.state = StateTables(spark, f"{folder}/state")
        self.folder, self.cfg, self.late_us = folder, cfg, interval_us(spark, lateness)
        self.packet_schema = packets.schema
        empty = add_up(number_pieces(self._parts(spark.createDataFrame([], packets.schema)), cfg), [*FLOW_KEYS, "packet_length"])
        self.sizes_schema = empty.schema

    def _parts(self, packets: DataFrame) -> DataFrame:
        return packet_parts(packets, self.cfg)

    def step(self, packets: DataFrame, batch: int) -> tuple[DataFrame, int]:
        """All flows that are open or ended in this batch, with ``open``; and the clock."""
        before, clock = self.state.tick(batch, packets, self.late_us)
        addressed = F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull()
        fresh = packets.where(addressed & (F.col("t_us") >= before))
        pool = self.state.read(batch - 1, "waiting", self.packet_schema).unionByName(fresh)
        self.state.write(pool.where(F.col("t_us") >= clock), batch, "waiting")
        held = self.state.read(batch - 1, "open", self.sizes_schema).drop("flow_no")
        held = held.withColumns({"cell": F.lit(NEVER).cast("long"), "piece": F.lit(0).cast("long")})
        parts = self._parts(pool.where(F.col("t_us") < clock)).unionByName(held)
        sizes = add_up(number_pieces(parts, self.cfg), [*FLOW_KEYS, "packet_length"])
        sizes = self.state.write(sizes, batch, "sizes")
        # only a key's last flow can go on, until its timeout has passed
        last = sizes.groupBy("flow_key").agg(F.max("flow_no").alias("flow_no"), F.max("tail").alias("tail"), F.first("protocol").alias("protocol"))
        goes_on = ~F.col("tail.close") & (F.col("tail.t_us") + timeout_us(F.col("protocol"), self.cfg) >= clock)
        going = self.state.write(last.where(goes_on).select("flow_key", "flow_no"), batch, "going")
        self.state.write(sizes.join(going, ["flow_key", "flow_no"], "left_semi"), batch, "open")
        flows = flows_of_sizes(sizes, self.cfg).join(going.withColumn("open", F.lit(True)), ["flow_key", "flow_no"], "left")
        flows = flows.withColumn("open", F.coalesce("open", F.lit(False)))
        return flows.withColumn("finalize_reason", F.when(F.col("closed"), "tcp_close").otherwise("timeout")), clock

    def open_flows(self, batch: int) -> DataFrame:
        """The flows that are open after a batch: the final flush."""
        held = flows_of_sizes(self.state.read(batch, "open", self.sizes_schema), self.cfg)
        return held.withColumn("finalize_reason", F.lit("flush"))

    def handle(self, packets: DataFrame, batch: int) -> None:
        flows, _ = self.step(packets, batch)
        ended = flows.where("NOT open").drop("open")
        ended.write.mode("overwrite").parquet(f"{self.folder}/{RESULT}/batch={batch}")
        self.state.forget(batch)


def run_batches(stream: DataFrame, handle, checkpoint: str) -> int:
    """Run a micro-batch job over everything available; returns the number of its last batch, -1 for none ever."""
    last = []

    def called(rows: DataFrame, batch: int) -> None:
        handle(rows, batch)
        last.append(batch)

    job = stream.writeStream.foreachBatch(called).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()
    return last[-1] if last else -1


def last_version(state: StateTables) -> int:
    """The last batch whose state is there, -1 for none; asked when a run found nothing new."""
    try:
        return state.spark.read.option("basePath", state.folder).parquet(f"{state.folder}/version=*/clock").agg(F.max("version")).first()[0]
    except Exception as e:  # noqa: BLE001 - the folder is missing before the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return -1


def sessionize_available(
    packets: DataFrame, folder: str, lateness: str, cfg: FlowConfig = DEFAULT, flush: bool = True
) -> DataFrame:
    """Run a packet stream over everything available; return its flows so far, open ones flushed.

    ``lateness`` must cover how far packets come out of order; later ones are dropped and counted
    (``state.StateTables.clock``). A row without addresses only moves the clock: end the input with one, or packets
    that the clock has not passed stay in the state. Without ``flush`` the open flows stay there too; a later run on
    the same folder continues them.
    """
    job = Sessions(packets, folder, lateness, cfg)
    last = run_batches(packets, job.handle, f"{folder}/checkpoint")
    last = last if last >= 0 else last_version(job.state)
    open_now = job.open_flows(last)
    if last < 0:
        return open_now
    done = packets.sparkSession.read.schema(open_now.schema).parquet(f"{folder}/{RESULT}").drop("batch")
    return done.unionByName(open_now) if flush else done
