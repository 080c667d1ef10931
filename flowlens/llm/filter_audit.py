"""How filters interact: what each removes, in every order, and what it costs in labelled documents.

Filters over whole texts (words are runs of characters other than ASCII white space, case-sensitive):

* A: fewer than `min_words` words;
* B: distinct words are fewer than `distinct_percent` of the words;
* C: A-Z are more than `capital_percent` of the code points;
* D: holds one of `SYMBOLS`;
* E: the text equals that of a smaller doc_id, anywhere in the table.

Each filter has a relation of failing ids: (node, part, good, toxic), stored apart. What an order of filters does
follows from joins of these alone; rows that fail nothing are never joined. With S the filters before a step:

* an id that no other filter fails (left-anti join with the ids that several fail) is removed after any S;
* the others stand once for each S without their own filter; a left-anti join with the ids that fail a filter of
  S leaves those removed at this step, a left-semi join those that were removed before (redundant);
* survivors of a prefix are the documents less the removed ones of each of its steps.

The table of the joins has a row for each part, filter and S (80 a part); orders are read off it.

A null text is empty; a null language is the part named ''. Rows are counted, so repeated rows count each; a null
id is not smaller than any and never fails E. A document counts as good (toxic) if a label row of its id has
quality (toxic) = 1. An empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import tokens as K
from flowlens.llm.work import numbered, spread_join, work_folder, written
from flowlens.shipping import ship

ship(__name__)

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("removed", "redundant", "good_lost", "toxic_lost")


@dataclass(frozen=True)
class Filters:
    min_words: int = 200
    distinct_percent: int = 50
    capital_percent: int = 3


def prefixes(name: str) -> list[str]:
    """All sets of filters that can come before `name`, as sorted letters."""
    others = [f for f in FILTERS if f != name]
    return ["".join(c) for n in range(len(others) + 1) for c in combinations(others, n)]


def text_failures(docs: DataFrame, rules: Filters) -> DataFrame:
    """doc_id, part, body (16 bytes that stand for the text) and the letters of A-D that each row fails."""

    def failing(raw: bytes) -> str:
        words = raw.split()  # for bytes: at ASCII white space only
        points = len(raw.decode())
        capitals = len(raw) - len(raw.translate(None, CAPITALS))
        tests = (
            len(words) < rules.min_words,
            100 * len(set(words)) < rules.distinct_percent * len(words),
            100 * capitals > rules.capital_percent * points,
            len(raw.translate(None, SYMBOLS)) < len(raw),
        )
        return "".join(f for f, failed in zip(FILTERS, tests) if failed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            bodies, found = [], []
            for i, j in zip(offsets.tolist(), offsets[1:].tolist()):
                raw = data[i:j].tobytes()
                bodies.append(hashlib.blake2b(raw, digest_size=16).digest())
                found.append(failing(raw))
            columns = [batch.column("doc_id"), batch.column("part"), pa.array(bodies, pa.binary()), pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "body", "failed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, part string, body binary, failed string")


def copies(base: DataFrame) -> DataFrame:
    """(node, doc_id, part) of the rows of which a smaller id has the same text."""
    named = base.where("doc_id IS NOT NULL")
    least = named.groupBy("body").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    several = spread_join(named, least.where("least < most").drop("most"), "body", "node")
    return several.where("doc_id > least").select("node", "doc_id", "part")


def failing_ids(base: DataFrame, labels: DataFrame) -> DataFrame:
    """The relations of failing ids, one folder a filter: filter, node, part, good, toxic."""
    flags = labels.groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    own = base.select("node", "doc_id", "part", F.expr("explode(filter(split(failed, ''), f -> f <> ''))").alias("filter"))
    same = copies(base).withColumn("filter", F.lit("E"))
    rows = spread_join(written(own.unionByName(same), "audit-failures"), flags, "doc_id", "node", "left")
    rows = rows.select("node", "part", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")], "filter")
    folder = work_folder(base.sparkSession, "audit-failing")
    rows.write.option("compression", "zstd").partitionBy("filter").parquet(folder)
    return base.sparkSession.read.schema(rows.schema).parquet(folder)


def steps_of(failing: DataFrame) -> DataFrame:
    """part, filter, before (the set of earlier filters), removed, redundant, good_lost, toxic_lost; zeros left out."""
    several = written(failing.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node"), "audit-several")
    single = failing.join(several, "node", "left_anti")
    shared = written(failing.join(several, "node", "left_semi"), "audit-shared")

    def sets(pairs: list[tuple[str, str]]) -> DataFrame:
        return failing.sparkSession.createDataFrame(pairs, "filter string, before string")

    # 16 sets a filter, a table of 80 rows: those without it, and those with it
    without = F.broadcast(sets([(f, s) for f in FILTERS for s in prefixes(f)]))
    holding = F.broadcast(sets([(f, "".join(sorted(s + f))) for f in FILTERS for s in prefixes(f)]))
    stands = shared.join(without, "filter")
    gone = shared.join(holding, "filter").select("node", "before")
    first = stands.join(gone, ["node", "before"], "left_anti")
    again = stands.join(gone, ["node", "before"], "left_semi")

    def counted(rows: DataFrame, removed: bool) -> DataFrame:
        n = F.count(F.lit(1))
        lost = [F.count_if(F.col(c) & F.lit(removed)).alias(f"{c}_lost") for c in ("good", "toxic")]
        zero = F.lit(0).cast("bigint")
        named = (n, zero) if removed else (zero, n)
        return rows.groupBy("part", "filter", "before").agg(named[0].alias("removed"), named[1].alias("redundant"), *lost)

    alone = counted(single.withColumn("before", F.lit("")), True).drop("before").join(without, "filter")
    parts = alone.unionByName(counted(first, True)).unionByName(counted(again, False))
    return parts.groupBy("part", "filter", "before").agg(*[F.sum(c).alias(c) for c in COUNTS])


def all_steps(totals: DataFrame) -> DataFrame:
    """The 600 steps of all orders for each row of `totals`: filter_order, step, filter, before."""
    every = F.split(F.lit(" ".join("".join(p) for p in permutations(FILTERS))), " ")
    rows = totals.withColumn("filter_order", F.explode(every))
    rows = rows.withColumn("letters", F.expr("filter(split(filter_order, ''), f -> f <> '')"))
    rows = rows.select("*", F.posexplode("letters").alias("at", "filter"))
    before = F.expr("array_join(array_sort(slice(letters, 1, at)), '')").alias("before")
    return rows.select(*totals.columns, "filter_order", (F.col("at") + 1).alias("step"), "filter", before)


def audit_filters(docs: DataFrame, labels: DataFrame, rules: Filters = Filters()) -> DataFrame:
    """One row for each part, order of the filters and step, with what the step removes."""
    base = numbered(text_failures(docs, rules), "audit-rows", "node")
    totals = written(base.groupBy("part").agg(F.count(F.lit(1)).alias("total")), "audit-totals")
    found = written(steps_of(failing_ids(base, labels)), "audit-steps")
    last = found.where(F.length("before") == len(FILTERS) - 1)
    unique = last.select("part", "filter", F.col("removed").alias("unique_fails"))
    rows = all_steps(totals).join(found, ["part", "filter", "before"], "left").join(unique, ["part", "filter"], "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in (*COUNTS, "unique_fails")]
    rows = rows.select("part", "filter_order", "step", "filter", "total", *counts)
    so_far = F.expr("sum(removed) OVER (PARTITION BY part, filter_order ORDER BY step)")
    rows = rows.withColumn("kept", F.col("total") - so_far)
    rows = rows.withColumn("shapley", F.expr("sum(removed) OVER (PARTITION BY part, filter)"))
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return rows.select("part", "filter_order", "step", *columns)
