"""Shared settings of the streaming jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.storage import written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keep state in RocksDB: it spills to disk and checkpoints incrementally."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    form: str = "parquet",
    files_per_batch: int = 1,
    archive: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """Folder intake: each new file is picked up once, oldest first; done files may be archived."""
    reader = spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", files_per_batch)
    if form == "csv":
        reader = reader.option("header", True)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def event_time(df: DataFrame, t_us: str, lateness: str) -> DataFrame:
    """Add the watermarked event-time column ``ts``."""
    return df.withColumn("ts", F.timestamp_micros(F.col(t_us))).withWatermark("ts", lateness)


def beyond_clock(timed: DataFrame, condition: Column) -> DataFrame:
    """The rows that fulfil `condition`, filtered after the watermark has seen them all.

    The condition is tied to ``ts``: a filter without it would be moved below the watermark, and rows that
    only move the clock would never reach it.
    """
    return timed.filter(F.when(F.col("ts").isNotNull(), condition).otherwise(False))


def as_files(
    df: DataFrame, folder: str, t_us: str, tie: str, block_s: int = 300, end: bool = True, tick_us: int = 1000,
    file_rows: int = 1_000_000,
) -> str:
    """A table as files to replay, a block of time after the other, each row up to one block away from its own.

    A block has as many files as its rows ask for, in no order, and within a file rows are in no order either.
    ``end`` adds a last row without anything but a time, which moves the clock to the first multiple of ``tick_us``
    (a watermark counts milliseconds) after the table's end. Returns the lateness
    that covers the disorder. An empty table becomes one file without rows.
    """
    width = block_s * 1_000_000
    late = 2 * width + 1_000_000
    shift = F.pmod(F.xxhash64(tie), F.lit(width))
    block = F.floor((F.col(t_us) + shift) / width).cast("long")
    held = written(df.withColumn("_block", block), "replay")
    counts = held.groupBy("_block").agg(F.count(F.lit(1)).alias("n"), F.max(t_us).alias("last")).orderBy("_block").collect()
    if not counts:
        df.limit(0).coalesce(1).write.mode("append").parquet(folder)
    for row in counts:  # a block after the other: a stream takes the oldest files first
        part = held.where(F.col("_block") == row["_block"]).drop("_block").repartition(-(-row["n"] // file_rows))
        part.sortWithinPartitions(F.xxhash64(tie, F.lit(1))).write.mode("append").parquet(folder)
    if end and counts:
        last = max(row["last"] for row in counts)
        clock = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name != t_us]
        row = df.sparkSession.range(1).select(*clock, F.lit((last // tick_us + 1) * tick_us + late).cast("long").alias(t_us))
        row.select(*df.columns).coalesce(1).write.mode("append").parquet(folder)
    return f"{late // 1_000_000} seconds"


def late_rows(job) -> int:
    """Rows that a query dropped because they came behind the watermark."""
    states = [op for p in job.recentProgress for op in p["stateOperators"]]
    return sum(op["numRowsDroppedByWatermark"] for op in states)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Process everything that is there into a Parquet folder, then stop."""
    job = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return job
