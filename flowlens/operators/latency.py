"""Latency, throughput and backlog tables from recorded timings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.config import RATE_WINDOW_SECONDS, TARGET_RATES
from flowlens.operators.ordering import rows_at_ranks

QUANTILES = (0.50, 0.95, 0.99)


def _with_overall(df: DataFrame, branch: str, value: str, tie: str) -> DataFrame:
    """Every row under its branch and under 'overall'."""
    return df.select(
        F.explode(F.array(F.lit("overall"), F.col(branch))).alias("scope"),
        F.col(value).cast("double").alias("x"),
        F.col(tie).alias("tie"),
    )


def _ranks(scoped: DataFrame, wanted) -> DataFrame:
    counts = scoped.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("scope", F.explode(F.array(*wanted(F.col("n")))).alias("w")).select("scope", "w.*")


def latency_summary(df: DataFrame, branch: str, value: str, tie: str) -> DataFrame:
    """Mean, p50, p95, p99 and max, overall and per branch; quantiles interpolate linearly.

    Exact: the neighbours of each quantile are looked up by rank in ranges of (scope, value, tie), so no
    group is gathered in one task.
    """
    scoped = _with_overall(df, branch, value, tie)

    def wanted(n):
        entries = []
        for q in QUANTILES:
            place = (n - 1) * q
            for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
                entries.append(
                    F.struct(
                        F.lit(q).alias("q"),
                        F.lit(side).alias("side"),
                        (rank + 1).cast("long").alias("rank"),
                        (place - F.floor(place)).alias("share"),
                    )
                )
        return entries

    found = rows_at_ranks(scoped, ["x", "tie"], _ranks(scoped, wanted), "scope")
    low, high = F.max(F.when(F.col("side") == "lo", F.col("x"))), F.max(F.when(F.col("side") == "hi", F.col("x")))
    points = found.groupBy("scope", "q").agg((low + (high - low) * F.max("share")).alias("v"))
    wide = points.groupBy("scope").agg(
        *[F.max(F.when(F.col("q") == q, F.col("v"))).alias(f"p{round(q * 100)}_ms") for q in QUANTILES]
    )
    basics = scoped.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_ms"), F.max("x").alias("max_ms")
    )
    return basics.join(F.broadcast(wide), "scope").select(
        "scope", "n", "mean_ms", "p50_ms", "p95_ms", "p99_ms", "max_ms"
    )


def latency_nearest_rank(df: DataFrame, branch: str, value: str, tie: str) -> DataFrame:
    """Median, and p95/p99 as the sorted value at position int(q * n); share of heavy rows."""
    scoped = df.select(
        F.lit("overall").alias("scope"), F.col(value).cast("double").alias("x"), F.col(tie).alias("tie")
    )

    def wanted(n):
        middle = [("p50", F.floor((n - 1) / 2)), ("p50", F.ceil((n - 1) / 2))]
        tails = [("p95", F.floor(n * 0.95)), ("p99", F.floor(n * 0.99))]
        return [
            F.struct(F.lit(name).alias("name"), F.lit(i).alias("part"), (rank + 1).cast("long").alias("rank"))
            for i, (name, rank) in enumerate(middle + tails)
        ]

    found = rows_at_ranks(scoped, ["x", "tie"], _ranks(scoped, wanted), "scope")
    points = found.agg(
        *[F.avg(F.when(F.col("name") == p, F.col("x"))).alias(f"{p}_ms") for p in ("p50", "p95", "p99")]
    )
    share = df.agg(
        F.count(F.lit(1)).alias("n"),
        (100.0 * F.count_if(F.col(branch) == "heavy") / F.count(F.lit(1))).alias("heavy_percent"),
    )
    return share.crossJoin(F.broadcast(points))


def throughput_table(
    df: DataFrame, value: str, branch: str, summary: DataFrame, rates: Sequence[int] = tuple(TARGET_RATES)
) -> DataFrame:
    """What happens at each offered rate over a ten-second window, given the measured latencies."""
    capacity = df.agg(
        (F.count(F.lit(1)) / (F.sum(value) / 1000.0)).alias("max_rate"),
        (F.count_if(F.col(branch) == "light") / F.count(F.lit(1))).alias("pct_light"),
        (F.count_if(F.col(branch) == "heavy") / F.count(F.lit(1))).alias("pct_heavy"),
    )
    overall = summary.filter(F.col("scope") == "overall").select("mean_ms", "p95_ms", "p99_ms")
    table = df.sparkSession.createDataFrame([(r,) for r in rates], "rate long")
    offered = F.col("rate") * F.lit(RATE_WINDOW_SECONDS)
    able = F.col("max_rate") * RATE_WINDOW_SECONDS
    return (
        capacity.crossJoin(F.broadcast(overall))
        .crossJoin(F.broadcast(table))
        .select(
            F.col("rate").alias("target_rate_flows_per_sec"),
            offered.alias("offered_flows_in_10s_window"),
            F.least(offered, able).alias("processed_flows"),
            F.greatest(offered - able, F.lit(0.0)).alias("dropped_flows"),
            (F.col("max_rate") >= F.col("rate")).alias("sustainable"),
            F.col("mean_ms").alias("mean_latency_ms"),
            F.col("p95_ms").alias("p95_latency_ms"),
            F.col("p99_ms").alias("p99_latency_ms"),
            "pct_light",
            "pct_heavy",
        )
    )


def compute_saving(df: DataFrame, triage_ms: str, light_ms: str, heavy_ms: str, branch: str) -> DataFrame:
    """Mean cost per flow of adaptive routing against always using the heavy verifier."""
    sums = df.agg(
        F.avg(triage_ms).alias("triage"),
        F.avg(light_ms).alias("light"),
        F.avg(heavy_ms).alias("heavy"),
        F.avg((F.col(branch) == "light").cast("double")).alias("share_light"),
        F.avg((F.col(branch) == "heavy").cast("double")).alias("share_heavy"),
    )
    always = F.col("triage") + F.col("heavy")
    adaptive = (
        F.col("triage") + F.col("share_light") * F.col("light") + F.col("share_heavy") * F.col("heavy")
    )
    return sums.select(
        always.alias("always_heavy_ms_per_flow"),
        adaptive.alias("adaptive_ms_per_flow"),
        (1 - F.col("share_heavy")).alias("heavy_call_reduction"),
        F.when(always != 0, 1 - adaptive / always).alias("latency_reduction"),
    )


def backlog(df: DataFrame, position: str, finished_s: str, rate: float) -> DataFrame:
    """Rows that finished after the moment a steady feed of ``rate`` rows per second offered them."""
    late = F.col(finished_s) > F.col(position) / F.lit(float(rate))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(late).alias("backlogged_flows"))
