"""Importance resampling of documents towards the distribution of target texts.

Words are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased. Features are
all runs of 1 to `longest` words, joined by one space, hashed into `buckets` (CRC-32). A bucket's gain is
floor(1000 * ln) of its share among the targets over its share among the documents, both with one added. A document
weighs the sum of the gains of its features; its score is the weight plus 1000 times a Gumbel number from a hash of
its id, so the highest scores are a sample without replacement in proportion to exp(weight / 1000).

* Gains are one array of `buckets` numbers, whatever the corpus holds; each task sums its features in such an array.
* The cutoff: a quantile sketch of the scores gives a bracket, exact counts of the rows above and inside it say
  whether the cutoff lies there; if not, the bracket is widened. Only the rows in the bracket are sorted.
* Drawn rows are sorted by ranges for their ranks.

Of the N documents with `min_words` words or more the percent * N / 100 (rounded down) highest scores are drawn; ties
go to the smaller id, null last, then to the place in the table, so repeated rows are drawn one by one. A null text
has no words and weighs 0, as has a text without words; a null id is hashed as an empty one. Without targets all
gains follow from the added ones. An empty table gives an empty result. Further columns of documents are not looked
at; `resampled` returns them as they are, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm import tokens as K
from flowlens.llm.work import numbered, placed
from flowlens.shipping import ship

ship(__name__)

# bytes of words, A-Z as a-z; all others become a blank
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
HELD = 500_000  # features whose gain a task remembers at once
MEASURES = "n_words: bigint, n_features: bigint, weight: bigint"


@dataclass(frozen=True)
class Resampling:
    buckets: int = 10_000
    longest: int = 1
    seed: int = 2024
    min_words: int = 20
    percent: int = 10
    accuracy: int = 10_000  # of the quantile sketch: the relative error of a rank is 1 / accuracy


def features(raw: bytes, longest: int) -> tuple[int, list[bytes]]:
    """The number of words of a text, and its features."""
    words = raw.translate(FOLD).split()
    found = list(words)
    for size in range(2, longest + 1):
        found += [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    return len(words), found


def texts(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a column as bytes, in lists of about a chunk; nulls are empty."""
    data, offsets = K.utf8(column)
    for a, b in K.chunks(offsets):
        whole = data[offsets[a] : offsets[b]].tobytes()
        cuts = (offsets[a : b + 1] - offsets[a]).tolist()
        yield [whole[i:j] for i, j in zip(cuts, cuts[1:])]


def bucket_counts(rows: DataFrame, rules: Resampling) -> list[int]:
    """Features per bucket over all texts; a task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(rules.buckets, np.int64)
        for batch in batches:
            for part in texts(batch.column(0)):
                seen: Counter[bytes] = Counter()
                for raw in part:
                    seen.update(features(raw, rules.longest)[1])
                at = np.fromiter((zlib.crc32(f) % rules.buckets for f in seen), np.int64, len(seen))
                np.add.at(counts, at, np.fromiter(seen.values(), np.int64, len(seen)))
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bucket", "n"])

    found = rows.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = [0] * rules.buckets
    for row in found.collect():  # `buckets` rows at most
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(docs: DataFrame, targets: DataFrame, rules: Resampling) -> list[int]:
    """The gain of each bucket."""
    source, target = bucket_counts(docs, rules), bucket_counts(targets, rules)
    all_source, all_target = float(sum(source) + rules.buckets), float(sum(target) + rules.buckets)
    pairs = zip(source, target)
    return [math.floor(1000 * math.log(((t + 1) * all_source) / ((s + 1) * all_target))) for s, t in pairs]


class Gains(dict):
    """Feature -> gain, filled as features come up."""

    def __init__(self, gains: list[int]):
        self.gains = gains

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= HELD:
            self.clear()
        got = self[feature] = self.gains[zlib.crc32(feature) % len(self.gains)]
        return got


def measures(text: Column, gains: list[int], rules: Resampling) -> Column:
    """n_words, n_features and weight of each text."""

    def weigh(column: pa.Array) -> pa.Array:
        gain, rows = Gains(gains), []
        for part in texts(column):
            for raw in part:
                n_words, found = features(raw, rules.longest)
                rows.append((n_words, len(found), sum(map(gain.__getitem__, found))))
        columns = np.array(rows, np.int64).reshape(-1, 3).T
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], ["n_words", "n_features", "weight"])

    return F.arrow_udf(weigh, MEASURES)(text)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Floor of 1000 times a Gumbel number, from the first 32 bits of the id's SHA-256."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def scored(docs: DataFrame, targets: DataFrame, rules: Resampling, *carried: Column) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and `carried`, written, with the place of each row."""
    got = measures(F.col("text"), bucket_gains(docs, targets, rules), rules).alias("got")
    table = docs.select("doc_id", got, *carried).select("doc_id", "got.*", *[c for c in ("document",) if carried])
    table = table.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), rules.seed))
    return placed(table, "resample-scores", "file", "line")


def order() -> list[Column]:
    """The order in which rows are drawn; no two rows are equal in it."""
    return [(-F.col("score")).alias("s"), F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.col("file"), F.col("line")]


def cutoff(eligible: DataFrame, wanted: int, total: int, rules: Resampling) -> Column:
    """The order() of the last of the `wanted` rows to be drawn, 1 <= wanted <= total."""
    margin = 2.0 / rules.accuracy
    while True:
        middle = 1 - wanted / total
        low, high = max(middle - margin, 0.0), min(middle + margin, 1.0)
        sketch = F.percentile_approx("score", [low, high], rules.accuracy)
        low_score, high_score = eligible.agg(sketch).first()[0]
        low_score = None if low == 0 else low_score
        high_score = None if high == 1 else high_score
        above = F.lit(False) if high_score is None else F.col("score") > high_score
        inside = ~above & (F.lit(True) if low_score is None else F.col("score") >= low_score)
        n_above, n_inside = eligible.agg(F.count_if(above), F.count_if(inside)).first()
        if n_above < wanted <= n_above + n_inside:
            break
        margin *= 4
    ranked = numbered(eligible.where(inside).select(*eligible.columns).orderBy(*order()), "resample-bracket", "number")
    last = ranked.where(F.col("number") == wanted - n_above - 1).select(F.struct(*order()).alias("at")).first()["at"]
    kinds = eligible.select(*order()).schema.fields
    return F.struct(*[F.lit(last[k.name]).cast(k.dataType).alias(k.name) for k in kinds])


def drawn(table: DataFrame, rules: Resampling) -> Column:
    """Is a row of the table of scores drawn?"""
    able = F.col("n_words") >= rules.min_words
    eligible = table.where(able).select("doc_id", "score", "file", "line")
    total = eligible.count()
    wanted = rules.percent * total // 100
    if not wanted:
        return F.lit(False)
    return able & (F.struct(*order()) <= cutoff(eligible, wanted, total, rules))


def resample_table(docs: DataFrame, targets: DataFrame, rules: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document."""
    table = scored(docs, targets, rules)
    chosen = drawn(table, rules)
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = numbered(table.where(chosen).orderBy(*order()), "resample-ranks", "rank").withColumn("rank", F.col("rank") + 1)
    rest = table.where(~chosen).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.select(*columns, "rank").unionByName(rest.select(*columns, "rank"))


def resampled(docs: DataFrame, targets: DataFrame, rules: Resampling = Resampling()) -> DataFrame:
    """The drawn documents, whole; same columns."""
    table = scored(docs, targets, rules, F.struct(*docs.columns).alias("document"))
    return table.where(drawn(table, rules)).select("document.*")
