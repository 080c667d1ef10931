"""Labels, splits, weights and sequences of a training set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.config import (
    ATTACK_LABELS,
    CLASSES,
    FEATURE_COLUMNS,
    SEED,
    SEQUENCE_LENGTH,
    TRAIN_FRACTION,
    VALIDATION_FRACTION,
)
from flowlens.operators.joins import spread_join
from flowlens.operators.ordering import ranged, rows_at_ranks, running, spanning
from flowlens.storage import written

HASH_RANGE = 1 << 31


# --- Labels ------------------------------------------------------------------------------------


def classes_table(spark: SparkSession) -> DataFrame:
    rows = [(i, name, i != 0) for i, name in enumerate(CLASSES)]
    return spark.createDataFrame(rows, "class_idx int, label string, malicious boolean")


def label_index(label: Column) -> Column:
    """Class index of a label; null for an unknown one."""
    pairs = F.create_map(*[x for i, c in enumerate(CLASSES) for x in (F.lit(c), F.lit(i))])
    return F.try_element_at(pairs, label)


def class_name(index: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(c) for c in CLASSES]), index.cast("int") + 1)


def unknown_labels(df: DataFrame) -> DataFrame:
    """Labels outside the class list, with their row counts."""
    known = classes_table(df.sparkSession).select("label")
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    return counts.join(F.broadcast(known), "label", "left_anti")


def require_known_labels(df: DataFrame) -> DataFrame:
    bad = [r["label"] for r in unknown_labels(df).orderBy("label").limit(20).collect()]
    if bad:
        raise ValueError(f"labels outside the class list: {bad}")
    return df


def known_label(label: Column) -> Column:
    """The label; one outside the class list is an error where it is read."""
    wrong = F.raise_error(F.concat(F.lit("label outside the class list: "), label)).cast("string")
    return F.when(label.isNull() | label_index(label).isNotNull(), label).otherwise(wrong)


def encode_labels(df: DataFrame) -> DataFrame:
    return df.withColumn("label_idx", label_index(F.col("label")))


def class_distribution(df: DataFrame) -> DataFrame:
    """Count and share of every class, absent ones included."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    every = classes_table(df.sparkSession).select("class_idx", "label")
    full = F.broadcast(every).join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # seven rows
    return full.select(
        "class_idx",
        "label",
        F.col("n").cast("long").alias("count"),
        (F.col("n") / F.greatest(total, F.lit(1))).alias("fraction"),
    )


def class_weights(train: DataFrame) -> DataFrame:
    """Balanced weights: rows / (classes present * rows of the class)."""
    counts = train.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))  # at most seven rows
    return counts.select(
        "label",
        F.col("n").alias("count"),
        (F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))).alias("weight"),
    )


def with_class_weights(df: DataFrame, weights: DataFrame) -> DataFrame:
    return df.join(F.broadcast(weights.select("label", "weight")), "label")


def join_labels(flows: DataFrame, labels: DataFrame) -> DataFrame:
    """Attach a label file by flow id; flows without a label keep null."""
    return flows.join(labels.select("flow_id", "label"), "flow_id", "left")


def _dyadic(start: str, stop: str) -> str:
    """The aligned blocks of 2^level microseconds that make up [start, stop): at most two a level.

    An array of (level, block); a point t lies in one block a level, t >> level.
    """
    low, high = f"-shiftright(-{start}, l)", f"shiftright({stop}, l)"
    left = f"IF({low} < {high} AND ({low}) & 1 = 1, named_struct('level', l, 'block', {low}), NULL)"
    right = f"IF({low} + (({low}) & 1) < {high} AND {high} & 1 = 1, named_struct('level', l, 'block', {high} - 1), NULL)"
    levels = f"sequence(0, CAST(ceil(log2({stop} - {start} + 1)) AS INT))"
    return f"array_compact(flatten(transform({levels}, l -> array({left}, {right}))))"


def winning_spans(log: DataFrame) -> DataFrame:
    """(ip_lo, ip_hi, at, hit): from `at` to the pair's next row, which entry of a log holds; null where none does.

    ``log``: ip_lo, ip_hi, start_us, end_us (closed), experiment_id, attack_type. Of several entries the latest started
    holds, then the lowest id. The answer changes at starts and after ends only. Each entry is cut into aligned blocks,
    of which only the winner is kept, and each such point looks up its own block at every level.
    """
    pair = ["ip_lo", "ip_hi"]
    cut = log.select(
        *pair,
        F.expr(f"explode({_dyadic('start_us', '(end_us + 1)')})").alias("b"),
        F.struct("start_us", (-F.col("experiment_id")).alias("id"), "attack_type").alias("hit"),
    )
    best = cut.groupBy(*pair, F.col("b.level").alias("level"), F.col("b.block").alias("block"))
    best = written(best.agg(F.max("hit").alias("hit")), "log-blocks")
    levels = [r["level"] for r in best.select("level").distinct().collect()]  # 64 at most
    points = log.select(*pair, F.explode(F.array("start_us", F.col("end_us") + 1)).alias("at")).distinct()
    asked = points.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    asked = asked.withColumn("block", F.expr("shiftright(at, level)"))
    met = spread_join(asked, best, [*pair, "level", "block"], "at", "left")
    return met.groupBy(*pair, "at").agg(F.max("hit").alias("hit"))


def label_by_experiment(flows: DataFrame, experiments: DataFrame) -> DataFrame:
    """Label flows from an experiment log.

    A flow takes the attack of the experiment between the same two hosts whose closed time window
    contains the flow's start; of several the latest started, then the lowest id; else benign.

    The log is cut into spans with one winner each. Flows of its host pairs and spans then meet in ranges of
    (pair, time), where the last span before a flow is a running maximum; no flow is paired with entries.
    """
    pair = [F.least("x", "y").alias("ip_lo"), F.greatest("x", "y").alias("ip_hi")]
    log = experiments.where("start_us <= end_us").select(
        F.col("src_ip").alias("x"), F.col("dst_ip").alias("y"), "start_us", "end_us", "experiment_id", "attack_type"
    )
    log = log.select(*pair, "start_us", "end_us", F.col("experiment_id").cast("long").alias("experiment_id"), "attack_type")
    spans = written(winning_spans(written(log, "log")), "log-spans")
    asked = flows.select(F.col("a_ip").alias("x"), F.col("b_ip").alias("y"), "flow_id", F.col("start_us").alias("at"))
    asked = asked.select(*pair, "at", "flow_id").join(spans.select("ip_lo", "ip_hi").distinct(), ["ip_lo", "ip_hi"], "left_semi")
    asked = written(asked, "log-asked")  # flows of the log's hosts alone; ranges are found by sampling, so it is read again
    both = spans.withColumn("seen", F.struct("at", "hit")).drop("hit").unionByName(asked, allowMissingColumns=True)
    latest = running(both, ["ip_lo", "ip_hi"], ["at", F.col("flow_id").isNotNull(), "flow_id"], {"latest": ("max", "seen")})
    attack = F.create_map(*[F.lit(x) for item in ATTACK_LABELS.items() for x in item])
    labels = latest.where("flow_id IS NOT NULL AND latest.hit IS NOT NULL").select(
        "flow_id",
        (-F.col("latest.hit.id")).alias("experiment_id"),
        F.try_element_at(attack, F.col("latest.hit.attack_type")).alias("label"),
    )
    joined = flows.join(written(labels, "log-labels"), "flow_id", "left")
    return joined.withColumn("label", F.coalesce("label", F.lit("benign")))


# --- Splits ------------------------------------------------------------------------------------


def chronological_split(
    df: DataFrame,
    order: Sequence[str],
    train: float = TRAIN_FRACTION,
    validation: float = VALIDATION_FRACTION,
) -> DataFrame:
    """Add ``part``: train, val or test, by position in time.

    The two boundary rows are looked up by rank among the order columns; the table itself is not
    shuffled.
    """
    n = df.agg(F.count(F.lit(1)).alias("n"))
    wanted = n.select(
        F.explode(
            F.array(
                F.struct(F.lit("train_end").alias("name"), F.floor(F.col("n") * train).alias("rank")),
                F.struct(
                    F.lit("val_end").alias("name"), F.floor(F.col("n") * (train + validation)).alias("rank")
                ),
            )
        ).alias("w")
    ).select("w.name", "w.rank")
    found = rows_at_ranks(df.select(*order), order, wanted)
    edges = found.agg(
        *[F.max(F.when(F.col("name") == e, F.struct(*order))).alias(e) for e in ("train_end", "val_end")]
    )
    place = F.struct(*order)
    part = (
        F.when(place <= F.col("train_end"), "train").when(place <= F.col("val_end"), "val").otherwise("test")
    )
    return df.crossJoin(F.broadcast(edges)).withColumn("part", part).drop("train_end", "val_end")


def row_hash(column: str, seed: int = SEED) -> Column:
    """A reproducible number in [0, HASH_RANGE) per row, the same in any engine that has MD5."""
    digest = F.md5(F.concat_ws("#", F.lit(str(seed)), F.col(column).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % HASH_RANGE


def stratified_split(
    df: DataFrame,
    id_column: str,
    train: float = 0.60,
    validation: float = 0.20,
    seed: int = SEED,
) -> DataFrame:
    """Add ``part`` with the same shares inside every label, to the row.

    Rows are ordered by hash inside their label and only the boundary rows are looked up; a label with
    most of the table spans as many ranges as it needs.
    """
    hashed = df.withColumn("h", row_hash(id_column, seed))
    order = ["h", id_column]
    wanted = (
        df.groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "label",
            F.explode(
                F.array(
                    F.struct(F.lit("train_end").alias("name"), F.floor(F.col("n") * train).alias("rank")),
                    F.struct(
                        F.lit("val_end").alias("name"),
                        F.floor(F.col("n") * (train + validation)).alias("rank"),
                    ),
                )
            ).alias("w"),
        )
        .select("label", "w.name", "w.rank")
    )
    found = rows_at_ranks(hashed.where("label IS NOT NULL").select("label", *order), order, wanted, "label")
    edges = found.groupBy("label").agg(
        *[F.max(F.when(F.col("name") == e, F.struct(*order))).alias(e) for e in ("train_end", "val_end")]
    )
    place = F.struct(*order)
    part = (
        F.when(place <= F.col("train_end"), "train").when(place <= F.col("val_end"), "val").otherwise("test")
    )
    return (
        hashed.join(F.broadcast(edges), "label", "left")
        .withColumn("part", part)
        .drop("h", "train_end", "val_end")
    )


def group_split(df: DataFrame, group: str, test_percent: int = 20, seed: int = SEED) -> DataFrame:
    """Add ``part``: whole groups go to train or test."""
    return df.withColumn("part", F.when(row_hash(group, seed) % 100 < test_percent, "test").otherwise("train"))


# --- Sequences ---------------------------------------------------------------------------------


def host_sequences(
    df: DataFrame,
    host: str,
    order: Sequence[str],
    columns: Sequence[str] = tuple(FEATURE_COLUMNS),
    length: int = SEQUENCE_LENGTH,
    cells: int | None = None,
    slim: bool = False,
) -> DataFrame:
    """Add ``sequence``: the host's last ``length`` rows up to this one, oldest first.

    Shorter histories repeat their earliest row at the front. Apply to each part of a split by
    itself, so that no part sees another. Rows are dealt into ranges of (host, order); a host that
    spans ranges gets the last rows of its earlier ranges in front. With ``slim`` the columns themselves, which
    the sequence holds, are left out, and are not dealt and written twice.
    """
    features = F.array(*[F.col(c).cast("double") for c in columns])
    stepped = df.withColumn("x", features).drop(*(columns if slim else []))
    table = ranged(stepped, [host, *order], "host-rows", cells)
    keys = [host, "cell"]
    w = Window.partitionBy("cell", host).orderBy("place").rowsBetween(-(length - 1), 0)
    rows = table.withColumn("seen", F.collect_list("x").over(w))
    newest = Window.partitionBy("cell", host).orderBy(F.desc("place"))
    last = (
        table.join(spanning(table, [host]), host, "left_semi")
        .withColumn("from_end", F.row_number().over(newest))
        .filter(F.col("from_end") < length)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("tail"))
    )
    before = Window.partitionBy(host).orderBy("cell").rowsBetween(-(length - 1), -1)
    carry = last.select(
        *keys, F.transform(F.flatten(F.collect_list("tail").over(before)), lambda e: e.x).alias("carry")
    )
    rows = rows.join(written(carry, "host-carry"), keys, "left").withColumn(
        "seen", F.concat(F.coalesce("carry", F.array().cast("array<array<double>>")), "seen")
    )
    size = F.size("seen")
    rows = rows.withColumn("seen", F.slice("seen", F.greatest(size - length + 1, F.lit(1)), length)).drop("carry")
    padding = F.array_repeat(F.element_at("seen", 1), F.lit(length) - F.size("seen"))
    return rows.withColumn("sequence", F.concat(padding, "seen")).drop("x", "seen", "cell", "place")
