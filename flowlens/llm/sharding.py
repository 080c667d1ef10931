"""Sharding by jump consistent hashing.

A document's key is 60 bits of the MD5 of its id as text (a null id counts as the empty text), so id and
shard count alone decide its shard, and one more shard takes rows only into itself. There is no ring table.

Slots are gapless from 0 within a shard, in the order of (doc_id, crc, size), nulls first. Rows that agree in
all three are interchangeable. Sizes are UTF-8 bytes plus 8; a null text has no bytes. An empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.work import numbered, written
from flowlens.shipping import ship

ship(__name__)

SHARDS = 24
# Fixed value: the multiplier of the published jump hash's linear congruential generator.
JUMP_FACTOR = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The bucket of each 64-bit key among `shards`: follow the key's jumps until one passes the last bucket."""
    key = keys.astype(np.uint64, copy=True)
    bucket = np.zeros(len(key), np.int64)
    target = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        bucket[live] = target[live]
        key[live] = key[live] * np.uint64(JUMP_FACTOR) + np.uint64(1)
        draw = ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        target[live] = ((bucket[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[target[live] < shards]
    return bucket


def stable_key(doc_id: Column) -> Column:
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def jump_shard(doc_id: Column, shards: int = SHARDS) -> Column:
    """The shard of a document id, 0 to `shards` - 1."""

    def place(keys: pa.Array) -> pa.Array:
        return pa.array(jump(keys.to_numpy(zero_copy_only=False), shards).astype(np.int32))

    return F.arrow_udf(place, "int")(stable_key(doc_id))


def shard_table(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard under one more shard, for every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    placed = slim.withColumns(
        {"shard": jump_shard(F.col("doc_id"), shards), "grown_shard": jump_shard(F.col("doc_id"), shards + 1)}
    )
    order = ["doc_id", "text_crc32", "size", "_tie"]
    ranged = written(placed, "shard-rows").repartitionByRange(*order).sortWithinPartitions("shard", *order)
    return numbered(ranged, "shard-slots", "slot", within="shard", ordered=True).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The documents with `shard` and a gapless `slot` in it; columns of these names are replaced."""
    base = docs.drop("shard", "slot")
    return numbered(
        base.withColumn("shard", jump_shard(F.col("doc_id"), shards)), "sharded", "slot", within="shard"
    )
