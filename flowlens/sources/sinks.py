"""Record, alert and report writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.alerts import alert_columns, build_alerts, iso_utc


def replay_records(scored: DataFrame) -> DataFrame:
    """One record per flow: flat fields, evidence, and the nested alert, null for benign flows."""
    alert = F.when(F.col("dl_verdict") != "benign", F.struct(*alert_columns(scored)))
    return scored.select(
        "flow_id",
        iso_utc(F.col("last_us")).alias("timestamp"),
        F.col("src_ip").alias("source_ip"),
        F.col("dst_ip").alias("destination_ip"),
        F.col("src_port").alias("source_port"),
        F.col("dst_port").alias("destination_port"),
        F.upper("protocol").alias("protocol"),
        F.col("ml_verdict").alias("xgboost_class"),
        F.col("ml_confidence").alias("xgboost_confidence"),
        "model_used",
        F.col("dl_verdict").alias("dl_class"),
        "dl_confidence",
        "shap_evidence",
        alert.alias("alert"),
    )


def write_records(scored: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; absent values are written as null."""
    replay_records(scored).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_alerts(scored: DataFrame, path: str, mode: str = "errorifexists") -> None:
    build_alerts(scored).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_report(report: DataFrame, path: str, form: str = "csv", mode: str = "overwrite") -> None:
    """A report table (a few rows) as one CSV or JSON file."""
    out = report.coalesce(1).write.mode(mode)
    if form == "csv":
        out.option("header", True).csv(path)
    elif form == "json":
        out.option("ignoreNullFields", "false").json(path)
    else:
        raise ValueError(f"unknown report form {form!r}")
