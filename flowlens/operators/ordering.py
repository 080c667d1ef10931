"""Windows over any order and any key, one plan for every size.

A table is dealt into ranges of a total order and written (`ranged`). Spark picks the ranges from the data, so
each has about the same number of rows, however many of them share a key; a key that owns half of the table
simply spans many ranges. Every window is then a window per range ("cell"), and what a range needs from those
before it is a carry: one row per range, or per range and key that spans ranges. Nothing is measured first, no
key is named in a plan and no number of ranges or keys is limited.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.storage import numbered, placed, written


def ranged(df: DataFrame, order: Sequence[Column | str], name: str, cells: int | None = None) -> DataFrame:
    """`df` in the total order `order`: adds `cell`, which ascends in that order, and `place` in the cell.

    `cells` sets the number of ranges; by default it follows the session's shuffle settings.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(cells, *keys) if cells else df.repartitionByRange(*keys)
    return placed(dealt.sortWithinPartitions(*keys), name, "cell", "place")


def global_rank(df: DataFrame, order: Sequence[Column | str], out: str = "rank", cells: int | None = None) -> DataFrame:
    """1-based position in the total order `order`."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(cells, *keys) if cells else df.repartitionByRange(*keys)
    made = numbered(dealt.sortWithinPartitions(*keys), "rank", out)
    return made.withColumn(out, F.col(out) + 1)


def ranked(table: DataFrame, out: str = "rank") -> DataFrame:
    """Adds the 1-based position in the order of a ranged table, from the row counts of its cells."""
    chain = Window.partitionBy(F.lit(0)).orderBy("cell")  # one row per cell
    counts = table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    before = written(counts.select("cell", (F.sum("n").over(chain) - F.col("n")).alias("before")), "rank-cells")
    return table.join(before, "cell").withColumn(out, F.col("before") + F.col("place") + 1).drop("before")


def neighbour(table: DataFrame, columns: Sequence[str], out: str, step: int) -> DataFrame:
    """Adds struct `out`: `columns` of the row before (step -1) or after (step 1) in a ranged table."""
    value = F.struct(*columns)
    shift = F.lag if step < 0 else F.lead
    edge = F.max_by(value, F.col("place")) if step < 0 else F.min_by(value, F.col("place"))
    ends = table.groupBy("cell").agg(edge.alias("edge"))
    chain = Window.partitionBy(F.lit(0)).orderBy("cell")  # one row per cell
    carry = written(ends.select("cell", shift("edge").over(chain).alias("carry")), "neighbour-cells")
    inside = Window.partitionBy("cell").orderBy("place")
    near = table.withColumn("near", shift(value).over(inside))
    return near.join(carry, "cell").withColumn(out, F.coalesce("near", "carry")).drop("near", "carry")


def spanning(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that lie in more than one cell of a table ranged by them; at most one per cell."""
    key = F.struct(*keys)
    ends = table.groupBy("cell").agg(F.min_by(key, F.col("place")).alias("low"), F.max_by(key, F.col("place")).alias("high"))
    chain = Window.partitionBy(F.lit(0)).orderBy("cell")
    met = ends.withColumn("before", F.lag("high").over(chain)).where("low = before")
    return written(met.select("low.*").distinct(), "spanning-keys")


MERGE = {
    "sum": (F.sum, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))),
    "max": (F.max, F.greatest),
    "or": (F.bit_or, lambda x, y: F.coalesce(x, F.lit(0)).bitwiseOR(F.coalesce(y, F.lit(0)))),
}


def running_on(
    table: DataFrame, keys: Sequence[str], aggs: dict[str, tuple[str, str]], source: DataFrame | None = None
) -> DataFrame:
    """Running aggregates per key of a table ranged by (keys, ...), in its order.

    `aggs`: output column -> ("sum" | "max" | "or", input column). `source` is the written table that `table`
    was made from, if its cells and keys can be read more cheaply there.
    """
    keys = list(keys)
    frame = Window.partitionBy("cell", *keys).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    out = table.withColumns({o: MERGE[kind][0](c).over(frame) for o, (kind, c) in aggs.items()})
    wide = spanning(source if source is not None else table, keys)
    parts = table.join(wide, keys, "left_semi").groupBy(*keys, "cell")
    parts = parts.agg(*[MERGE[kind][0](c).alias(o) for o, (kind, c) in aggs.items()])
    before = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = [MERGE[kind][0](o).over(before).alias(f"{o}_carry") for o, (kind, _) in aggs.items()]
    carry = written(parts.select(*keys, "cell", *carried), "running-carry")
    joined = out.join(carry, [*keys, "cell"], "left")
    merged = {o: MERGE[kind][1](F.col(o), F.col(f"{o}_carry")) for o, (kind, _) in aggs.items()}
    return joined.withColumns(merged).drop(*[f"{o}_carry" for o in aggs])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    aggs: dict[str, tuple[str, str]],
    cells: int | None = None,
) -> DataFrame:
    """Running aggregates per key, over all rows up to and including each one in `order`."""
    return running_on(ranged(df, [*keys, *order], "running", cells), keys, aggs).drop("cell", "place")


def rows_at_ranks(
    df: DataFrame, order: Sequence[str], wanted: DataFrame, by: str | None = None, cells: int | None = None
) -> DataFrame:
    """The rows at given 1-based ranks, of the table or of each group `by` (not null).

    `wanted` holds (by, rank) and is a parameter-sized table.
    """
    keys = [by] if by else []
    columns = [*keys, *order]
    dealt = df.repartitionByRange(cells, *columns) if cells else df.repartitionByRange(*columns)
    made = numbered(dealt.sortWithinPartitions(*columns), "ranks", "rank", by, ordered=True)
    return made.withColumn("rank", F.col("rank") + 1).join(F.broadcast(wanted), [*keys, "rank"])


def count_before(
    probes: DataFrame, at: str, points: DataFrame, time: str, out: str, cells: int | None = None
) -> DataFrame:
    """For each probe, the number of points whose time is strictly below `at` (an as-of rank)."""
    steps = points.groupBy(time).agg(F.count(F.lit(1)).alias("n"))
    kind = probes.schema
    seen = steps.select(F.col(time).alias("x"), F.lit(0).alias("side"), "n", F.lit(None).cast(kind).alias("row"))
    asked = probes.select(
        (F.col(at) - 1).alias("x"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("n"), F.struct(*kind.names).alias("row")
    )
    table = ranged(seen.unionByName(asked), ["x", "side"], "count-before", cells)
    chain = Window.partitionBy(F.lit(0)).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = table.groupBy("cell").agg(F.sum("n").alias("n"))  # one row per cell
    base = written(totals.select("cell", F.coalesce(F.sum("n").over(chain), F.lit(0)).alias("base")), "count-cells")
    inside = Window.partitionBy("cell").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    counted = table.withColumn("inside", F.sum("n").over(inside)).where("side = 1").join(base, "cell")
    return counted.withColumn(out, F.col("base") + F.col("inside")).select("row.*", out)


def exact_flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")
