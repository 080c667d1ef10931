"""Flow features: contract columns, model indicators, scaling and the contract check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.config import (
    CATEGORICAL_COLUMNS,
    FEATURE_COLUMNS,
    FLOW_COLUMNS,
    MICROS,
    NUMERIC_COLUMNS,
)
from flowlens.functions.measures import (
    entropy_from_counts,
    periodicity,
    periodicity_exponential,
    population_std,
    ratio_or_zero,
)


RAW_SUMS = ["n_gap", "gap_sum", "gap_sq", "n_hist", "hist_clogc", "n_dns", "dns_len", "dns_ent"]


def with_gap_stats(flows: DataFrame) -> DataFrame:
    """Add iat_mean and iat_std in seconds, from exact sums of microseconds."""
    n, total, squares = F.col("n_gap"), F.col("gap_sum"), F.col("gap_sq")
    return flows.withColumns(
        {
            "iat_mean": F.when(n > 0, total / n / MICROS).otherwise(F.lit(0.0)),
            "iat_std": F.when(n > 1, population_std(n, total, squares) / MICROS).otherwise(F.lit(0.0)),
            "duration": F.greatest(F.col("last_us") - F.col("start_us"), F.lit(0)) / MICROS,
        }
    )


def with_measures(flows: DataFrame) -> DataFrame:
    """Add the numeric features that come from a flow's own packets."""
    packets, octets, duration = F.col("packet_count"), F.col("byte_count"), F.col("duration")
    return with_gap_stats(flows).withColumns(
        {
            "packet_rate": ratio_or_zero(packets, duration),
            "byte_rate": ratio_or_zero(octets, duration),
            "avg_packet_size": ratio_or_zero(octets, packets),
            "byte_ratio": F.col("fwd_bytes") / F.greatest(F.col("rev_bytes"), F.lit(1)),
            "packet_ratio": F.col("fwd_packets") / F.greatest(F.col("rev_packets"), F.lit(1)),
            "entropy": entropy_from_counts(F.col("n_hist"), F.col("hist_clogc")),
            "dns_query_length": ratio_or_zero(F.col("dns_len"), F.col("n_dns")),
            "dns_entropy": ratio_or_zero(F.col("dns_ent"), F.col("n_dns")),
            "periodicity_score": periodicity(F.col("iat_mean"), F.col("iat_std")),
        }
    )


def with_variants(flows: DataFrame) -> DataFrame:
    """Add the design-document forms of the ratios and of periodicity."""
    return with_gap_stats(flows).withColumns(
        {
            "byte_ratio_open": F.col("fwd_bytes") / (F.col("rev_bytes") + 1),
            "packet_ratio_open": F.col("fwd_packets") / (F.col("rev_packets") + 1),
            "periodicity_exp": periodicity_exponential(F.col("iat_mean"), F.col("iat_std")),
        }
    )


def contract_columns(seen: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The 28 contract columns, in contract order, from measured flows with source behaviour."""
    rows = seen.withColumns(
        {
            "tls_ja3": F.when(F.col("n_tls") > 0, "observed").otherwise(""),
            "tls_ja3s": F.lit(""),
            "tls_ja4": F.lit(""),
            "protocol": F.lower("protocol"),
        }
    )
    renamed = {"src_ip": "a_ip", "dst_ip": "b_ip", "src_port": "a_port", "dst_port": "b_port"}
    return rows.select(*[F.col(renamed.get(c, c)).alias(c) for c in FLOW_COLUMNS], *keep)


def add_indicators(df: DataFrame) -> DataFrame:
    """Numeric DNS and TLS indicators; a missing source column counts as absent."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")

    dns, ja3, sni = text("dns_record_type"), text("tls_ja3"), text("tls_sni")
    new = {"has_dns": (dns != "").cast("double")}
    for kind in ("A", "AAAA", "TXT", "NS"):
        new[f"dns_is_{kind}"] = (dns == kind).cast("double")
    new["has_tls"] = (ja3 != "").cast("double")
    new["tls_sni_length"] = F.char_length(sni).cast("double")
    return df.withColumns(new)


def complete_features(df: DataFrame) -> DataFrame:
    """All 24 model columns as doubles: indicators added, absent columns and nulls set to 0."""
    rows = add_indicators(df)
    filled = {
        c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in rows.columns else F.lit(0.0)
        for c in FEATURE_COLUMNS
    }
    return rows.withColumns(filled)


def fit_scaler(train: DataFrame, columns: Sequence[str] = tuple(FEATURE_COLUMNS)) -> DataFrame:
    """One row of means and population deviations; a constant column is divided by 1."""
    stats = []
    for c in columns:
        std = F.stddev_pop(c)
        stats += [
            F.avg(c).alias(f"{c}__mean"),
            F.when(std > 0, std).otherwise(F.lit(1.0)).alias(f"{c}__std"),
        ]
    return train.agg(*stats)


def apply_scaler(
    df: DataFrame, scaler: DataFrame, columns: Sequence[str] = tuple(FEATURE_COLUMNS)
) -> DataFrame:
    """Standardize columns with a fitted one-row scaler."""
    scaled = {c: (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std") for c in columns}
    return df.crossJoin(F.broadcast(scaler)).withColumns(scaled).drop(*scaler.columns)


def contract_check(df: DataFrame, require_label: bool = False) -> DataFrame:
    """One row per violated rule group of the flow contract, counted in a single pass."""
    required = FLOW_COLUMNS + (["label"] if require_label else [])
    missing = [c for c in required if c not in df.columns]
    types = dict(df.dtypes)
    not_text = [c for c in CATEGORICAL_COLUMNS if types.get(c, "string") != "string"]

    def bad(c: str) -> Column:
        x = F.col(c).cast("double")
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    present = [c for c in NUMERIC_COLUMNS if c in df.columns]
    any_bad = F.lit(False)
    for c in present:
        any_bad = any_bad | bad(c)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(any_bad).alias("rows_not_finite"),
    ).withColumns(
        {
            "missing_columns": F.lit(len(missing)).cast("long"),
            "columns_not_text": F.lit(len(not_text)).cast("long"),
            "ok": (F.col("rows_not_finite") == 0) & F.lit(not missing and not not_text),
        }
    )
