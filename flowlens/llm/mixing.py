"""Mixing sources to target weights by cube-method balanced sampling.

Sources, in code point order with null last, weigh 3, 1, 2, 3, 1, 2 ... and share `percent` of all words. A
source's target stops at `repeats` times its size; the excess is shared again by weight until no target is
above. A document is then taken target / source_size times: whole passes, and a fraction in [0, 1) that is an
inclusion probability for one more pass. The cube method rounds these fractions:

* flight: within cells of about CELL documents of one source, the vector of fractions walks through the null
  space of two constraints, words and documents, so both totals stay exactly as they are; each step settles
  at least one document, and at most three of a cell stay open;
* the open documents of many cells meet in a next, smaller flight, until one cell per source is left;
* landing: of the last open documents of a source, three at most, `mix_table` takes their fraction of their words;
  `mix_documents` takes whole documents, the choice of them that is nearest to these words.

Rows that agree in (doc_id, source, size) are one unit of several copies, so no group of repeated rows is
held together. Null texts have size 0 and are never taken; a table without words takes nothing; null is a
source of its own. The walk's random numbers are seeded by cell, and a cell's rows are ordered, so reruns
agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.work import numbered, written
from flowlens.shipping import ship

ship(__name__)

WEIGHTS = (3, 1, 2)
PERCENT = 150
REPEATS = 2
CELL = 512
SEED = 20240607
EPSILON = 1e-9
COPY_BLOCK = 100_000

# pandas turns a column of integers with a null into doubles, so a null id travels as 0 and a flag
UNIT = "doc_id: bigint, nameless: boolean, size: bigint, source_no: bigint, cell: bigint, copies: bigint, whole: bigint, part: double, part_words: bigint"


def word_count(text: Column) -> Column:
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(words, F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_no, source_size, units and target of each source of (source, size) rows."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    ordered = sums.repartitionByRange(F.col("source").asc_nulls_last())
    ordered = ordered.sortWithinPartitions(F.col("source").asc_nulls_last())
    table = numbered(ordered, "mix-sources", "source_no")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_no") % len(WEIGHTS) + 1).cast("int"))
    table = table.withColumn("weight", weight)
    # Raise the level of words per weight until no source below its stop is above it; scalars only are gathered.
    level, total = -1.0, None
    while True:
        stopped = F.col("weight") * F.lit(level) >= REPEATS * F.col("source_size")
        got = table.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(stopped, REPEATS * F.col("source_size"))).alias("fixed"),
            F.sum(F.when(~stopped, F.col("weight"))).alias("open"),
        ).first()
        total = got["all"] or 0
        if not got["open"]:
            break
        raised = (PERCENT * total / 100 - (got["fixed"] or 0)) / got["open"]
        if raised <= level:
            break
        level = raised
    target = F.least(F.col("weight") * F.lit(level), (REPEATS * F.col("source_size")).cast("double"))
    return table.withColumn("target", F.greatest(target, F.lit(0.0))).drop("weight")


def walk(size: np.ndarray, part: np.ndarray, seed: list[int]) -> np.ndarray:
    """The flight phase: rounds fractions while sum(part) and sum(part * size) stay; three at most stay open."""
    part = part.copy()
    draws = np.random.RandomState(np.array(seed, np.uint32)).random_sample(len(part) + 3)
    waiting = list(np.flatnonzero((part > EPSILON) & (part < 1 - EPSILON))[::-1])
    active: list[int] = []
    step = 0
    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) < 3:
            break
        a, b, c = active
        direction = [float(size[b] - size[c]), float(size[c] - size[a]), float(size[a] - size[b])]
        if not any(direction):
            direction = [1.0, -1.0, 0.0]
        up = min((1 - part[k]) / d if d > 0 else -part[k] / d for k, d in zip(active, direction) if d)
        down = min(part[k] / d if d > 0 else (part[k] - 1) / d for k, d in zip(active, direction) if d)
        move = up if draws[step] * (up + down) < down else -down
        step += 1
        for k, d in zip(active, direction):
            part[k] += move * d
            if part[k] < EPSILON or part[k] > 1 - EPSILON:
                part[k] = round(part[k])
        active = [k for k in active if 0 < part[k] < 1]
    if len(active) == 2 and size[active[0]] == size[active[1]]:
        a, b = active  # equal sizes: one direction is left
        total = part[a] + part[b]
        high, low = (1.0, total - 1) if total > 1 else (total, 0.0)
        first = draws[step] * (high - low) < (part[a] - low)
        part[a], part[b] = (high, low) if first else (low, high)
    return part


def _flight(last: bool):
    def fly(cell: pd.DataFrame) -> pd.DataFrame:
        order = pd.util.hash_array(cell["doc_id"].mask(cell["nameless"], -1).to_numpy(np.int64))
        cell = cell.assign(order=order).sort_values(["order", "nameless", "doc_id", "size"], kind="stable").drop(columns="order")
        seed = [SEED, int(cell["source_no"].iloc[0]) & 0xFFFFFFFF, int(cell["cell"].iloc[0]) & 0xFFFFFFFF, len(cell)]
        part = walk(cell["size"].to_numpy(np.int64), cell["part"].to_numpy(float), seed)
        whole = cell["whole"].to_numpy(np.int64) + (part >= 1)
        part = np.where(part >= 1, 0.0, part)
        words = np.zeros(len(cell), np.int64)
        if last:
            size = cell["size"].to_numpy(np.int64)
            edges = np.rint(np.cumsum(part * size)).astype(np.int64)
            words = np.minimum(np.diff(edges, prepend=0), size)
            part = np.zeros(len(cell))
        return cell.assign(whole=whole, part=part, part_words=words)

    return fly


def mix_units(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, targets) of (doc_id, source, size) rows.

    A unit has copies, the passes over all its copies together (whole) and the words of a last, partial pass.
    """
    targets = written(source_targets(sized.select("source", "size")), "mix-targets")
    same = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
    known = targets.select(F.col("source").alias("_source"), "source_no", "source_size", "rows", "target")
    units = same.join(known, F.col("source").eqNullSafe(F.col("_source")))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    times = F.when(F.col("size") > 0, times).otherwise(0.0) * F.col("copies")
    whole = F.floor(times + EPSILON)
    part = F.greatest(times - whole, F.lit(0.0))
    place = F.pmod(F.xxhash64("doc_id", "size", "source"), F.ceil(F.col("rows") / CELL))
    units = units.select(
        F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("doc_id"),
        F.col("doc_id").isNull().alias("nameless"),
        "size",
        "source_no",
        place.cast("bigint").alias("cell"),
        "copies",
        whole.cast("bigint").alias("whole"),
        F.when(part < EPSILON, 0.0).otherwise(part).alias("part"),
        F.lit(0).cast("bigint").alias("part_words"),
    )
    cells = targets.agg(F.max(F.ceil(F.col("rows") / CELL))).first()[0] or 1
    settled = []
    while True:
        last = cells <= 1
        flown = written(units.groupBy("source_no", "cell").applyInPandas(_flight(last), UNIT), "mix-flight")
        settled.append(flown.where("part = 0"))
        if last:
            break
        units = flown.where("part > 0").withColumn("cell", F.expr(f"cell div {CELL // 4}"))
        cells = -(-cells // (CELL // 4))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    out = out.withColumn("doc_id", F.when(~F.col("nameless"), F.col("doc_id"))).drop("nameless")
    return out, targets


def passes(row: Column) -> tuple[Column, Column]:
    """(whole passes, words of a partial pass) of the `row`-th copy, from 1, of a unit."""
    base, rest = F.expr("whole div copies"), F.expr("whole % copies")
    whole = base + F.when(row <= rest, 1).otherwise(0)
    return whole, F.when(row == rest + 1, F.col("part_words")).otherwise(0)


def mix_table(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken words for every document."""
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    units, targets = mix_units(sized)
    units = units.join(targets.select("source_no", "source_size", "target"), "source_no")
    single = units.where("copies = 1").withColumn("row", F.lit(1).cast("bigint"))
    blocks = units.where("copies > 1").withColumn("block", F.expr(f"explode(sequence(0L, (copies - 1) div {COPY_BLOCK}))"))
    rows = f"explode(sequence(block * {COPY_BLOCK} + 1, least(copies, (block + 1) * {COPY_BLOCK})))"
    several = blocks.repartition("doc_id", "source_no", "size", "block").withColumn("row", F.expr(rows)).drop("block")
    whole, words = passes(F.col("row"))
    taken = (whole * F.col("size") + words).cast("bigint").alias("taken")
    return single.unionByName(several).select("doc_id", "size", "source_size", "target", taken)


def landed(opened: DataFrame) -> DataFrame:
    """Units taken in part, each a whole document more or not: of a source, the choice nearest to the words of its parts.

    A source has three such units at most, so there are eight choices; of equally near ones, the first.
    """
    unit = F.struct("id", "words", "copies", "whole", "part_words", "unit")
    listed = opened.groupBy("of").agg(F.sort_array(F.collect_list(unit)).alias("units"))
    taken = "aggregate(sequence(0, size(units) - 1), 0L, (a, i) -> a + shiftright(m, i) % 2 * units[i].words)"
    parts = "aggregate(units, 0L, (a, u) -> a + CAST(u.part_words AS BIGINT))"
    choices = f"transform(sequence(0, shiftleft(1, size(units)) - 1), m -> struct(abs({parts} - {taken}) AS off, m AS m))"
    best = listed.select("of", "units", F.expr(f"array_min({choices}).m").alias("m"))
    each = best.select("of", "m", F.posexplode("units").alias("i", "u"))
    whole = F.expr("u.whole + shiftright(m, i) % 2").alias("whole")
    return each.select("u.id", "of", "u.words", "u.copies", whole, "u.unit")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: repeated or left out, always whole; same columns, whatever their names.

    Each source's words are within half the size of its largest document of what op7's table takes.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), word_count(F.col("text")).alias("size"))
    keyed = keyed.select("doc", F.col("doc.doc_id").cast("bigint").alias("doc_id"), "doc.source", "size")
    sized = written(keyed.select("doc_id", "source", "size"), "mix-sizes")
    units, targets = mix_units(sized)
    named = units.join(targets.select("source_no", "source"), "source_no").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("of"),
        F.col("size").alias("words"),
        "copies",
        "whole",
        "part_words",
        F.xxhash64("doc_id", "source", "size").alias("unit"),
    )
    named = written(named.where("whole > 0 OR part_words > 0"), "mix-units")
    closed = named.where("part_words = 0").drop("part_words")
    taken = written(closed.unionByName(landed(named.where("part_words > 0"))).where("whole > 0"), "mix-taken")
    same = (
        (F.xxhash64("d.doc_id", "d.source", "d.size") == F.col("u.unit"))
        & F.col("d.doc_id").eqNullSafe(F.col("u.id"))
        & F.col("d.source").eqNullSafe(F.col("u.of"))
        & (F.col("d.size") == F.col("u.words"))
    )
    joined = keyed.alias("d").join(taken.alias("u"), same).select("d.*", "u.copies", "u.whole", "u.unit")
    place = "row_number() OVER (PARTITION BY unit, doc_id, source, size ORDER BY doc.text)"
    several = joined.where("copies > 1").withColumn("row", F.expr(place))
    rows = joined.where("copies = 1").withColumn("row", F.lit(1)).unionByName(several)
    passed = rows.withColumn("pass", F.expr("whole div copies + IF(row <= whole % copies, 1, 0)")).where("pass > 0")
    return passed.select("doc", F.explode(F.expr("sequence(1L, pass)"))).select("doc.*")
