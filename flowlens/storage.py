"""Intermediate tables in the folder the cluster shares, and dense numbers for their rows."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting (4.1, default false) to delete the shuffle files of a query once it has ended.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master without it, one below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "shared")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables, wherever it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder.

    Later reads, also after a lost executor, see the same rows, and Spark knows the table's size. The shuffle files of
    the write go as it ends; else they stay until the driver happens to collect garbage.
    """
    spark, path = df.sparkSession, work_folder(df.sparkSession, name)
    before = spark.conf.get(SWEEP, "false")
    spark.conf.set(SWEEP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SWEEP, before)
    return spark.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, name: str, part: str = "_part", row: str = "_row") -> DataFrame:
    """`df` written, with the number of each row's file, in the order of partitions, and its row in the file."""
    number = F.regexp_extract("_metadata.file_path", r"part-([0-9]+)-", 1).cast("bigint") * 100_000
    number = number + F.regexp_extract("_metadata.file_path", r"-c([0-9]+)", 1).cast("bigint")
    return written(df, name).withColumns({part: number, row: F.col("_metadata.row_index")})


def numbered(df: DataFrame, name: str, number: str, within: str | None = None, ordered: bool = False) -> DataFrame:
    """Adds `number`: 0, 1, 2 ... over all rows, or over the rows of each value of `within`.

    Rows are written once, in their order; a row's number is the count of rows before its file plus its
    place in the file. No row is shuffled and no group meets in one task: only row counts per file are
    gathered. `within` must not hold nulls; `ordered` says that each partition is sorted by it already.
    """
    if within and not ordered:
        df = df.sortWithinPartitions(within)
    keys = [within] if within else []
    table = placed(df, name)
    counts = table.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    running = f"sum(_n) OVER ({'PARTITION BY ' + within if within else ''} ORDER BY _part)"
    base = written(counts.select("_part", *keys, F.expr(f"{running} - _n - _first").alias("_base")), f"{name}-counts")
    joined = table.join(base, ["_part", *keys])
    return joined.withColumn(number, (F.col("_base") + F.col("_row")).cast("bigint")).drop("_part", "_row", "_base")
