"""Confidence routing between the light and the heavy verifier, and its threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.config import (
    BENIGN,
    DEFAULT_THETA,
    LIGHT_FLOOR,
    MAX_HEAVY_FRACTION,
    THETA_GRID,
    TRIAGE_ONLY_FLOOR,
)
from flowlens.operators.evaluate import class_report, macro_average


def route(confidence: Column, theta: float | Column = DEFAULT_THETA) -> Column:
    """light at or above the threshold, else heavy."""
    return F.when(confidence >= theta, "light").otherwise("heavy")


def route_three_tier(confidence: Column, high: float = TRIAGE_ONLY_FLOOR, low: float = LIGHT_FLOOR) -> Column:
    return F.when(confidence >= high, "xgb_only").when(confidence >= low, "light").otherwise("heavy")


def routing_stats(df: DataFrame, confidence: str, theta: float = DEFAULT_THETA) -> DataFrame:
    """How many rows go to each verifier at one threshold."""
    n, light = F.count(F.lit(1)), F.count_if(F.col(confidence) >= theta)
    stats = df.agg(n.alias("n"), light.alias("n_light"))
    return stats.select(
        F.lit(float(theta)).alias("theta"),
        "n",
        "n_light",
        (F.col("n") - F.col("n_light")).alias("n_heavy"),
        *[
            F.when(F.col("n") > 0, share / F.col("n")).otherwise(F.lit(0.0)).alias(name)
            for name, share in (("pct_light", F.col("n_light")), ("pct_heavy", F.col("n") - F.col("n_light")))
        ],
    )


def threshold_sweep(
    df: DataFrame,
    truth: str,
    triage: str,
    light: str,
    heavy: str,
    confidence: str,
    thetas: Sequence[float] = tuple(THETA_GRID),
) -> DataFrame:
    """Routing share and accuracies at every threshold, from one pass over the rows.

    Rows are first counted by how many thresholds they reach; each threshold then adds up at most
    len(thetas) + 1 of those counts. Nothing is multiplied by the number of thresholds.
    """
    thetas = sorted(thetas)
    level = F.lit(0)
    for theta in thetas:
        level = level + (F.col(confidence) >= theta).cast("int")

    def right(column: str) -> Column:
        return F.count_if(F.col(column) == F.col(truth))

    steps = df.groupBy(level.alias("level")).agg(
        F.count(F.lit(1)).alias("n"),
        right(light).alias("light_ok"),
        right(heavy).alias("heavy_ok"),
        right(triage).alias("triage_ok"),
    )
    grid = df.sparkSession.createDataFrame(
        [(i + 1, float(t)) for i, t in enumerate(thetas)], "position int, theta double"
    )
    is_light = F.col("level") >= F.col("position")

    def total(column: str, condition: Column | None = None) -> Column:
        value = F.col(column) if condition is None else F.when(condition, F.col(column)).otherwise(0)
        return F.sum(value)

    sums = (
        steps.crossJoin(F.broadcast(grid))
        .groupBy("theta")
        .agg(
            total("n").alias("n"),
            total("n", is_light).alias("n_light"),
            total("light_ok", is_light).alias("light_ok"),
            total("heavy_ok", ~is_light).alias("heavy_ok"),
            total("triage_ok", ~is_light).alias("triage_ok"),
            total("light_ok").alias("all_light_ok"),
            total("heavy_ok").alias("all_heavy_ok"),
        )
    )
    n_heavy = F.col("n") - F.col("n_light")

    def over(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b)

    return sums.select(
        "theta",
        (F.col("n_light") / F.col("n")).alias("pct_light"),
        (n_heavy / F.col("n")).alias("pct_heavy"),
        ((F.col("light_ok") + F.col("heavy_ok")) / F.col("n")).alias("overall_dl_accuracy"),
        over(F.col("light_ok"), F.col("n_light")).alias("light_branch_accuracy"),
        over(F.col("heavy_ok"), n_heavy).alias("heavy_branch_accuracy"),
        over(F.col("triage_ok"), n_heavy).alias("heavy_branch_xgb_only_accuracy"),
        (F.col("all_light_ok") / F.col("n")).alias("fixed_100pct_light_accuracy"),
        (F.col("all_heavy_ok") / F.col("n")).alias("fixed_100pct_heavy_accuracy"),
    )


def select_theta(sweep: DataFrame, max_heavy: float = MAX_HEAVY_FRACTION) -> DataFrame:
    """Most accurate threshold within the heavy-share limit (or of all, if none is), lowest first."""
    within = F.col("pct_heavy") <= max_heavy
    best = Window.partitionBy(F.lit(0)).orderBy(  # one row per threshold
        within.desc(), F.desc("overall_dl_accuracy"), "theta"
    )
    return (
        sweep.withColumn("place", F.row_number().over(best))
        .filter(F.col("place") == 1)
        .select(
            F.col("theta").alias("selected_theta"),
            F.col("overall_dl_accuracy").alias("validation_overall_dl_accuracy"),
            F.col("pct_light").alias("light_routing_fraction"),
            F.col("pct_heavy").alias("heavy_routing_fraction"),
            "light_branch_accuracy",
            "heavy_branch_accuracy",
            "fixed_100pct_light_accuracy",
            "fixed_100pct_heavy_accuracy",
            within.alias("within_limit"),
        )
    )


def compare_strategies(
    df: DataFrame,
    truth: str,
    triage: str,
    light: str,
    heavy: str,
    confidence: str,
    theta: float = DEFAULT_THETA,
) -> DataFrame:
    """Triage only, always light, always heavy and adaptive routing, side by side.

    One pass counts the distinct (truth, predictions, branch) combinations, of which there are at
    most 7^4 * 2; the four strategies are read off those counts.
    """
    combos = df.groupBy(
        F.col(truth).alias("y"),
        F.col(triage).alias("p_triage"),
        F.col(light).alias("p_light"),
        F.col(heavy).alias("p_heavy"),
        (F.col(confidence) >= theta).alias("is_light"),
    ).agg(F.count(F.lit(1)).alias("n"))
    adaptive = F.when(F.col("is_light"), F.col("p_light")).otherwise(F.col("p_heavy"))
    named = [
        ("xgboost_only", F.col("p_triage"), 0),
        ("always_light", F.col("p_light"), 1),
        ("always_heavy", F.col("p_heavy"), 1),
        ("risk_adaptive", adaptive, 1),
    ]
    long = combos.select(
        "y",
        "n",
        "is_light",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(s).alias("strategy"), p.cast("int").alias("pred"), F.lit(c).alias("calls"))
                    for s, p, c in named
                ]
            )
        ).alias("s"),
    ).select("s.strategy", "s.pred", "s.calls", "y", "n", "is_light")
    by_class = _macro_f1(long, "strategy")
    hostile = F.col("y") != BENIGN
    missed = F.sum(F.when(hostile & (F.col("pred") == BENIGN), F.col("n")).otherwise(0))
    n_hostile = F.sum(F.when(hostile, F.col("n")).otherwise(0))
    n_light = F.sum(F.when(F.col("is_light"), F.col("n")).otherwise(0))
    total = F.sum("n")
    is_adaptive = F.col("strategy") == "risk_adaptive"
    return (
        long.groupBy("strategy")
        .agg(
            (F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)) / total).alias("accuracy"),
            F.when(n_hostile > 0, 1 - missed / n_hostile).alias("malicious_recall"),
            F.when(n_hostile > 0, missed / n_hostile).alias("malicious_to_benign_rate"),
            F.sum(F.col("n") * F.col("calls")).alias("n_dl_calls"),
            (n_light / total).alias("share_light"),
        )
        .join(by_class, "strategy")
        .select(
            "strategy",
            "accuracy",
            "macro_f1",
            "malicious_recall",
            "malicious_to_benign_rate",
            "n_dl_calls",
            F.when(is_adaptive, F.col("share_light")).alias("pct_light"),
            F.when(is_adaptive, 1 - F.col("share_light")).alias("pct_heavy"),
        )
    )


def _macro_f1(counts: DataFrame, by: str) -> DataFrame:
    return macro_average(class_report(counts, "y", "pred", "n", [by]), [by])
