"""What training and scoring keep, write and evaluate."""

import math
from collections import Counter

from pyspark.sql import functions as F

from flowlens.config import FEATURE_COLUMNS
from flowlens.functions.measures import text_entropy
from flowlens.operators import models as M
from flowlens.operators import ordering
from flowlens.operators.dataset import host_sequences
from flowlens.operators.sessionize import packet_parts
from helpers import GOLDEN, packets


def test_verifier_keeps_its_rows_once(spark):
    rows = spark.range(300).select(
        *[((F.col("id") * (i + 3)) % 17 / 17.0).alias(c) for i, c in enumerate(FEATURE_COLUMNS)],
        (F.col("id") % 7).cast("int").alias("label_idx"),
    )
    kept = []
    fit = M.MultilayerPerceptronClassifier.fit

    def seen(self, given, *more):
        level = given.storageLevel
        kept.append(level.useMemory or level.useDisk)
        assert given.rdd.getNumPartitions() % spark.sparkContext.defaultParallelism == 0
        return fit(self, given, *more)

    M.MultilayerPerceptronClassifier.fit = seen
    try:
        M.train_light(rows, max_iter=2)
    finally:
        M.MultilayerPerceptronClassifier.fit = fit
    assert kept == [False]  # the optimizer keeps its own blocks


def test_name_entropy_is_taken_once_and_below_the_sums(spark):
    plan = packet_parts(packets(spark, GOLDEN))._jdf.queryExecution().optimizedPlan().toString()
    sums, below = plan.split("Window", 1)
    assert "array_distinct" in below and "array_distinct" not in sums


def test_entropy_of_names_with_signs_of_several_bytes(spark):
    names = ["", "a", "aab.example.com", "q12x3.example.com", "äöü-日本語-😀😀x", "ée"]
    got = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = dict(got.select("i", text_entropy(F.col("n"))).collect())
    for i, name in enumerate(names):
        n = len(name)
        want = -sum(c / n * math.log2(c / n) for c in Counter(name).values()) if n else 0.0
        assert abs(got[i] - want) < 1e-12, name


def test_slim_sequences_hold_the_same_steps_once(spark, monkeypatch):
    rows = spark.range(400).select(
        F.concat(F.lit("h"), F.col("id") % 3).alias("src_ip"), F.col("id").alias("seq"), *[(F.col("id") * (i + 3) % 17 / 17.0).alias(c) for i, c in enumerate(FEATURE_COLUMNS)]
    )
    dealt, placed = [], ordering.placed
    monkeypatch.setattr(ordering, "placed", lambda df, *rest: dealt.append(df.columns) or placed(df, *rest))
    got = host_sequences(rows, "src_ip", ["seq"], slim=True)
    assert not set(FEATURE_COLUMNS) & {*got.columns, *dealt[0]}
    want = host_sequences(rows, "src_ip", ["seq"])
    assert sorted(got.select("seq", "sequence").collect()) == sorted(want.select("seq", "sequence").collect())
