"""Token sequences in training order.

Texts become token ids; each document ends with an end-of-text id. Ids of the documents of one input partition
are packed end to end into sequences of `length` ids, the last of a partition padded. Sequences are numbered
densely, and a keyed Feistel permutation with cycle-walking gives each number its global slot: a bijection of
0 to n - 1 that needs no shuffle table and can be computed, and inverted, for any sequence by itself.

Slots are cut into ranges of `per_shard`; one task gets a whole shard and orders it by slot. All records have
the same stride, so record r of a shard file starts at r * stride and a reader resumes at any slot.

Default ids are bytes (0 to 255), 256 ends a text and 257 pads; `tokenizer` names a file for the tokenizers
library instead, whose next two free ids end and pad. Null texts give no ids; empty ones only the end. A null
doc_id is carried as null; repeated rows are separate documents; an empty table gives no sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm import tokens as K
from flowlens.llm.work import numbered
from flowlens.shipping import ship

ship(__name__)

ROUNDS = 6
RESULT = (
    "doc_ids: array<bigint>, doc_at: array<bigint>, at: array<int>, n_ids: array<int>, n_tokens: int, tokens: binary"
)


@dataclass(frozen=True)
class Order:
    length: int = 1024
    per_shard: int = 2048
    key: int = 0x5EED
    tokenizer: str | None = None


class Coder:
    """Texts of a chunk to one stream of ids with their documents' bounds."""

    def __init__(self, order: Order):
        self.tokenizer = None
        self.end, self.pad, self.kind = 256, 257, np.dtype("<u2")
        if order.tokenizer:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(order.tokenizer)
            self.tokenizer.encode_special_tokens = True
            self.end = self.tokenizer.get_vocab_size()
            self.pad = self.end + 1
            self.kind = np.dtype("<u2" if self.pad < 1 << 16 else "<u4")

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(offsets)
        if self.tokenizer is None:
            ids = np.full(len(data) + len(size), self.end, self.kind)
            ids[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data
            return ids, offsets + np.arange(len(offsets))
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])]
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        parts = [np.array([*e.ids, self.end], self.kind) for e in found]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


class Packer:
    """Cuts a stream of documents' ids into records of a fixed length."""

    def __init__(self, order: Order, coder: Coder):
        self.length, self.coder = order.length, coder
        self.rest = np.zeros(0, coder.kind)
        self.pieces: list[tuple] = []  # (doc_id, first id of the document, place in the record, ids)
        self.rows: list[tuple] = []

    def add(self, ids: np.ndarray, bounds: np.ndarray, names: list) -> None:
        base = len(self.rest)
        stream = np.concatenate((self.rest, ids))
        full = len(stream) // self.length
        for name, start, stop in zip(names, (bounds[:-1] + base).tolist(), (bounds[1:] + base).tolist()):
            first = start
            while start < stop:
                upto = min(stop, (start // self.length + 1) * self.length)
                self.pieces.append((name, start - first, start % self.length, upto - start))
                if upto % self.length == 0:
                    record = upto // self.length - 1
                    self._emit(stream[record * self.length : upto], self.length)
                start = upto
        self.rest = stream[full * self.length :]

    def _emit(self, ids: np.ndarray, n: int) -> None:
        self.rows.append((*map(list, zip(*self.pieces)), n, ids.tobytes()))
        self.pieces = []

    def close(self) -> None:
        if len(self.rest):
            ids = np.full(self.length, self.coder.pad, self.coder.kind)
            ids[: len(self.rest)] = self.rest
            self._emit(ids, len(self.rest))
            self.rest = self.rest[:0]

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [[]] * 6
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        kinds = [longs, longs, ints, ints, pa.int32(), pa.binary()]
        self.rows = []
        names = ["doc_ids", "doc_at", "at", "n_ids", "n_tokens", "tokens"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def pack(docs: DataFrame, order: Order = Order()) -> DataFrame:
    """RESULT: the packed sequences of (doc_id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(order)
        packer = Packer(order, coder)
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            for a, b in K.chunks(offsets):
                ids, bounds = coder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                packer.add(ids, bounds, names[a:b])
                yield packer.take()
        packer.close()
        yield packer.take()

    return docs.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(run, RESULT)


def feistel(numbers: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of 0 to n - 1 at `numbers`; values outside are walked on until they are inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = K.mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key) * np.uint64(ROUNDS + 1))
    out = numbers.astype(np.uint64, copy=True)
    live = np.arange(len(out))
    while len(live):
        left, right = out[live] >> np.uint64(half), out[live] & low
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (K.mix(left ^ k) & low), left
            else:
                left, right = right, left ^ (K.mix(right ^ k) & low)
        out[live] = (left << np.uint64(half)) | right
        live = live[out[live] >= n]
    return out.astype(np.int64)


def slot_of(number: Column, n: int, key: int) -> Column:
    def permute(numbers: pa.Array) -> pa.Array:
        return pa.array(feistel(numbers.to_numpy(zero_copy_only=False), n, key))

    return F.arrow_udf(permute, "bigint")(number)


def training_order(docs: DataFrame, order: Order = Order()) -> DataFrame:
    """slot, shard, record, number and the packed sequence, each shard in one task, by slot."""
    table = numbered(pack(docs, order), "sequences", "number")
    n = table.count()
    placed = table.withColumn("slot", slot_of(F.col("number"), n, order.key))
    placed = placed.withColumn("shard", F.expr(f"slot div {order.per_shard}"))
    shards = max(1, -(-n // order.per_shard))
    dealt = placed.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("slot")
    record = (F.col("slot") % order.per_shard).cast("int").alias("record")
    return dealt.select("slot", F.col("shard").cast("int").alias("shard"), record, "number", *_columns())


def _columns() -> list[str]:
    return ["doc_ids", "doc_at", "at", "n_ids", "n_tokens", "tokens"]


def write_shards(sequences: DataFrame, uri: str) -> DataFrame:
    """Writes shard-<k>.bin files of fixed-stride records; returns (shard, records, stride, path).

    `uri` is a folder that all executors reach (file, hdfs, s3 ...). A file is written under another name and
    moved when whole, so a task that is run again replaces it by the same bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(uri)
        store.create_dir(folder, recursive=True)
        shard, out, name, done, records, stride = None, None, "", [], 0, 0

        def close() -> None:
            out.close()
            store.move(name, f"{folder}/shard-{shard:06d}.bin")
            done.append((shard, records, stride, f"{folder}/shard-{shard:06d}.bin"))

        for batch in batches:
            for number, ids in zip(batch.column("shard").to_pylist(), batch.column("tokens")):
                if number != shard:
                    if out is not None:
                        close()
                    shard, records = number, 0
                    name = f"{folder}/.{uuid.uuid4().hex}"
                    out = store.open_output_stream(name)
                raw = ids.as_py()
                out.write(raw)
                records, stride = records + 1, len(raw)
        if out is not None:
            close()
        columns = list(zip(*done)) if done else [[]] * 4
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string()]
        names = ["shard", "records", "stride", "path"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return sequences.select("shard", "tokens").mapInArrow(run, "shard: int, records: bigint, stride: bigint, path: string")


def read_record(store_file, record: int, length: int, kind: str = "<u2") -> np.ndarray:
    """The ids of one record of an open shard file."""
    stride = length * np.dtype(kind).itemsize
    store_file.seek(record * stride)
    return np.frombuffer(store_file.read(stride), kind)
