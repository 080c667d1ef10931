"""Packet tables, flow tables and label files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.config import CATEGORICAL_COLUMNS
from flowlens.functions.network import dns_name, tls_seen
from flowlens.operators.dataset import known_label
from flowlens.operators.features import complete_features
from flowlens.operators.ordering import global_rank

PACKET_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("t_us", T.LongType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("packet_length", T.IntegerType()),
        T.StructField("tcp_flags", T.StringType()),
        T.StructField("payload_length", T.IntegerType()),
        T.StructField("dns_query_name", T.StringType()),
        T.StructField("dns_query_length", T.IntegerType()),
        T.StructField("dns_record_type", T.StringType()),
        T.StructField("tls_handshake", T.BooleanType()),
        T.StructField("tls_sni", T.StringType()),
    ]
)

FLOW_SCHEMA = T.StructType(
    [
        T.StructField("flow_id", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("packet_count", T.LongType()),
        T.StructField("byte_count", T.LongType()),
        T.StructField("packet_rate", T.DoubleType()),
        T.StructField("byte_rate", T.DoubleType()),
        T.StructField("avg_packet_size", T.DoubleType()),
        T.StructField("byte_ratio", T.DoubleType()),
        T.StructField("packet_ratio", T.DoubleType()),
        T.StructField("dest_fanout", T.LongType()),
        T.StructField("port_fanout", T.LongType()),
        T.StructField("flow_count", T.LongType()),
        T.StructField("entropy", T.DoubleType()),
        T.StructField("dns_query_length", T.DoubleType()),
        T.StructField("dns_entropy", T.DoubleType()),
        T.StructField("iat_mean", T.DoubleType()),
        T.StructField("iat_std", T.DoubleType()),
        T.StructField("periodicity_score", T.DoubleType()),
        T.StructField("dns_record_type", T.StringType()),
        T.StructField("tls_ja3", T.StringType()),
        T.StructField("tls_ja3s", T.StringType()),
        T.StructField("tls_ja4", T.StringType()),
        T.StructField("tls_sni", T.StringType()),
    ]
)


def _csv_headers(spark: SparkSession, path: str, names: set[str]) -> dict[tuple[str, ...], list[str]]:
    """Header -> files of a CSV folder. The first line of each file must hold two known names, or be one."""
    lines = spark.read.text(path).where("_metadata.file_block_start = 0")
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    first = lines.groupBy("file").agg(F.min_by("value", "at").alias("value"))
    fields = F.transform(F.split(F.regexp_replace("value", '["\\r\ufeff]', ""), ","), F.trim)
    known = F.size(F.array_intersect("fields", F.array(*map(F.lit, sorted(names)))))
    heads = first.select("file", fields.alias("fields"))
    heads = heads.withColumn("known", known >= F.least(F.lit(2), F.size("fields")))
    groups = heads.groupBy("fields", "known").agg(F.sort_array(F.collect_list("file")).alias("files"))
    out: dict[tuple[str, ...], list[str]] = {}
    for row in groups.collect():  # a header each; readers need the names of their files
        if not row["known"]:
            raise ValueError(f"no known header in {row['files'][0]}: {','.join(row['fields'])!r}")
        out[tuple(row["fields"])] = row["files"]
    return dict(sorted(out.items(), key=lambda item: item[1]))


def _load(spark: SparkSession, path: str, form: str, schema: T.StructType) -> DataFrame:
    if form == "csv":
        # Files may order or omit columns: each is read by its own header, then they meet by name.
        types = {f.name: f.dataType for f in schema}
        made = None
        for names, files in _csv_headers(spark, path, set(types)).items():
            own = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
            part = spark.read.option("header", True).option("enforceSchema", False).schema(own).csv(files)
            part = part.select("*", *_line_order())
            made = part if made is None else made.unionByName(part, allowMissingColumns=True)
        return made if made is not None else spark.createDataFrame([], schema).select("*", *_line_order(False))
    if form == "json":
        return spark.read.schema(schema).json(path).select("*", *_line_order())
    if form == "parquet":
        return spark.read.parquet(path).select("*", *_line_order())
    raise ValueError(f"unknown format {form!r}")


LINE_ORDER = ["_file", "_block", "_line"]


def _line_order(files: bool = True) -> list:
    """File, start of the block and place in it of each row: the order of rows in the files."""
    file, block = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start")) if files else (F.lit(""), F.lit(0))
    return [file.alias("_file"), block.alias("_block"), F.monotonically_increasing_id().alias("_line")]


def normalize_packets(packets: DataFrame) -> DataFrame:
    """The packet schema from a table that may lack the derived or optional columns."""

    def column(field: T.StructField):
        if field.name in packets.columns:
            return F.col(field.name).cast(field.dataType)
        return F.lit(None).cast(field.dataType)

    rows = packets.select(*[column(f).alias(f.name) for f in PACKET_SCHEMA])
    rows = rows.filter(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())
    rows = rows.withColumn("dns_query_name", dns_name(F.col("dns_query_name")))
    return rows.withColumns(
        {
            "payload_length": F.coalesce("payload_length", F.lit(0)),
            "dns_query_length": F.char_length("dns_query_name"),
            "tls_handshake": tls_seen(F.col("tls_sni")),
        }
    )


def read_packets(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return normalize_packets(_load(spark, path, form, PACKET_SCHEMA).drop(*LINE_ORDER))


def read_flows(spark: SparkSession, path: str, form: str = "csv", labelled: bool = True) -> DataFrame:
    """A flow feature file with all model columns filled, and ``row_order`` from 1.

    The order is that of ``timestamp`` where there is one, then that of the files and their lines. With
    ``labelled`` an unknown label is an error when the label is read.
    """
    extra = [T.StructField("label", T.StringType()), T.StructField("timestamp", T.DoubleType())]
    rows = _load(spark, path, form, T.StructType(FLOW_SCHEMA.fields + extra))
    order = (["timestamp"] if "timestamp" in rows.columns else []) + LINE_ORDER
    rows = global_rank(rows, order, "row_order").drop(*LINE_ORDER)
    texts = [c for c in CATEGORICAL_COLUMNS if c in rows.columns]
    rows = complete_features(rows.fillna("", subset=texts))
    return rows.withColumn("label", known_label(F.col("label"))) if labelled else rows


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("flow_id string, label string").csv(path)
