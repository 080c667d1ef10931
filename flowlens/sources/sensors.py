"""Exports of other sensors, renamed to the packet or flow columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.config import MICROS
from flowlens.functions.network import protocol_of_number
from flowlens.operators.ordering import global_rank

# Field dump columns (one row per packet) -> packet columns.
FIELD_DUMP = {
    "ip.src": "src_ip",
    "ip.dst": "dst_ip",
    "tcp.srcport": "src_port",
    "tcp.dstport": "dst_port",
    "ip.proto": "protocol",
    "frame.time_epoch": "t_us",
    "frame.len": "packet_length",
}


def _micros(seconds: Column) -> Column:
    return F.round(seconds.cast("decimal(20,6)") * MICROS).cast("long")


def read_field_dump(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Packets from a per-packet field dump with a header row."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    return packets_of_field_dump(raw)


def packets_of_field_dump(raw: DataFrame) -> DataFrame:
    named = raw.select(*[F.col(f"`{old}`").alias(new) for old, new in FIELD_DUMP.items()])
    typed = named.select(
        "src_ip",
        "dst_ip",
        F.col("src_port").cast("int"),
        F.col("dst_port").cast("int"),
        protocol_of_number(F.col("protocol").cast("int")).alias("protocol"),
        _micros(F.col("t_us")).alias("t_us"),
        F.col("packet_length").cast("int"),
    )
    # The rank in time, then by all fields: unique, and the same whatever file a packet came from.
    return global_rank(typed, ["t_us", *[c for c in typed.columns if c != "t_us"]], "seq")


def read_connection_log(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Ready flows from a per-connection log with a header row.

    Columns: src_ip, dst_ip, src_port, dst_port, protocol, start_time, end_time, packet_count,
    byte_count, and optionally dns_query, dns_type and tls_sni.
    """
    return flows_of_connection_log(spark.read.option("header", True).option("sep", sep).csv(path))


def flows_of_connection_log(raw: DataFrame) -> DataFrame:
    def optional(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in raw.columns else F.lit("")

    start, end = _micros(F.col("start_time")), _micros(F.col("end_time"))
    return raw.select(
        F.md5(F.concat_ws("#", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "start_time")).alias("flow_id"),
        "src_ip",
        "dst_ip",
        F.col("src_port").cast("int"),
        F.col("dst_port").cast("int"),
        F.lower("protocol").alias("protocol"),
        start.alias("start_us"),
        end.alias("last_us"),
        (F.greatest(end - start, F.lit(0)) / MICROS).alias("duration"),
        F.col("packet_count").cast("long"),
        F.col("byte_count").cast("long"),
        F.char_length(optional("dns_query")).cast("double").alias("dns_query_length"),
        optional("dns_type").alias("dns_record_type"),
        optional("tls_sni").alias("tls_sni"),
    )
