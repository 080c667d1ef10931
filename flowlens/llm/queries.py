"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm.decontam import leak_table
from flowlens.llm.filter_audit import audit_filters
from flowlens.llm.langid import predict_documents
from flowlens.llm.licenses import scan_licenses, with_paths
from flowlens.llm.mixing import mix_table
from flowlens.llm.neardup import Near, near_table
from flowlens.llm.oracles import build
from flowlens.llm.pii import personal_table
from flowlens.llm.quality import judge_documents
from flowlens.llm.resample import resample_table
from flowlens.llm.secrets import fresh_ledger, secret_table
from flowlens.llm.sharding import shard_table
from flowlens.llm.training_order import training_order
from flowlens.llm.vecdup import vector_table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_table(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_documents(documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_table(documents(spark, sf_dir))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_table(documents(spark, sf_dir), fresh_ledger(spark))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_table(documents(spark, sf_dir))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_table(documents(spark, sf_dir), Near(words=3, percent=85))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(with_paths(documents(spark, sf_dir)))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_table(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_table(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_language": op2_language,
    "op3_pii": op3_pii,
    "op4_secrets": op4_secrets,
    "op5_quality_rules": op5_quality_rules,
    "op6_sharding": op6_sharding,
    "op7_mixing": op7_mixing,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_licenses": op9_licenses,
    "op10_training_order": op10_training_order,
    "op11_filter_audit": op11_filter_audit,
    "op12_vector_duplicates": op12_vector_duplicates,
    "op13_resampling": op13_resampling,
}
ORACLES: dict[str, str] = build()
