import collections
import hashlib
import zlib

import numpy as np
from edge import edge_documents, no_documents
from flowlens.llm.sharding import SHARDS, jump, shard_documents, shard_table


def slow_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def key_of(doc_id):
    return int(hashlib.md5(str("" if doc_id is None else doc_id).encode()).hexdigest()[:15], 16)


def test_jump_equals_the_loop_and_moves_little():
    keys = np.array([key_of(i) for i in range(4000)])
    for n in (1, 2, 24, 25):
        assert jump(keys, n).tolist() == [slow_jump(int(k), n) for k in keys]
    small, large = jump(keys, 24), jump(keys, 25)
    moved = small != large
    assert (large[moved] == 24).all() and 0.02 < moved.mean() < 0.06
    assert len(jump(keys[:0], 24)) == 0


def test_table_equals_brute_force(spark):
    docs = edge_documents(spark)
    rows, got = docs.collect(), shard_table(docs).collect()
    want = collections.Counter()
    for r in rows:
        raw = (r.text or "").encode()
        key = key_of(r.doc_id)
        want[r.doc_id, len(raw) + 8, zlib.crc32(raw), "key", slow_jump(key, SHARDS), slow_jump(key, SHARDS + 1)] += 1
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard].append((r.slot, r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"]))
    for found in shards.values():
        found.sort()
        assert [f[0] for f in found] == list(range(len(found)))
        assert [f[1:] for f in found] == sorted(f[1:] for f in found)


def test_documents_keep_their_columns(spark):
    docs = edge_documents(spark)
    got = shard_documents(docs)
    assert set(got.columns) == set(docs.columns)
    assert got.select("shard", "slot").distinct().count() == docs.count()
    assert shard_documents(no_documents(spark)).count() == shard_table(no_documents(spark)).count() == 0
