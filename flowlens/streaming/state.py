"""State of a micro-batch job as tables, one version a batch.

A batch reads the tables that the batch before it left and writes its own version; what it returns lies in a folder
named by the batch. A batch that is repeated after a failure therefore reads the same state and overwrites its own
results: each row counts once. State is keyed rows that add up, so every update is a join or an aggregation over all
keys at once, not a call for each key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.storage import removed

CLOCK = T.StructType([T.StructField("clock_us", T.LongType()), T.StructField("late_rows", T.LongType())])
NEVER = -(1 << 62)


@dataclass
class StateTables:
    spark: SparkSession
    folder: str

    def path(self, batch: int, name: str) -> str:
        return f"{self.folder}/version={batch:012d}/{name}"

    def read(self, batch: int, name: str, schema: T.StructType) -> DataFrame:
        """A table as batch number `batch` left it; empty before the first one."""
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(batch, name))

    def write(self, df: DataFrame, batch: int, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(batch, name))
        return self.spark.read.schema(df.schema).parquet(self.path(batch, name))

    def forget(self, batch: int) -> None:
        """Delete the version before the last one that a repeated batch may still need."""
        if batch >= 2:
            removed(self.spark, f"{self.folder}/version={batch - 2:012d}")

    def clock(self, batch: int) -> tuple[int, int]:
        """(time that all later rows have reached, rows that came behind it) after a batch."""
        row = self.read(batch, "clock", CLOCK).first()
        return (row["clock_us"], row["late_rows"]) if row else (NEVER, 0)

    def tick(self, batch: int, rows: DataFrame, late_us: int) -> tuple[int, int]:
        """Move the clock to the newest row less the lateness; count rows behind the old clock."""
        before, late = self.clock(batch - 1)
        newest, behind = rows.agg(F.max("t_us"), F.count_if(F.col("t_us") < before)).first()
        after = before if newest is None else max(before, newest - late_us)
        made = self.spark.createDataFrame([(after, late + behind)], CLOCK)
        self.write(made.coalesce(1), batch, "clock")
        return before, after


def interval_us(spark: SparkSession, text: str) -> int:
    """An interval such as "301 seconds" in microseconds."""
    end = F.expr(f"unix_micros(timestamp_seconds(0) + INTERVAL {text})")
    return spark.range(1).select(end.alias("us")).first()["us"]
