import collections
import os
import uuid

import numpy as np
import pytest
from edge import edge_documents, no_documents
from flowlens.llm.training_order import Order, feistel, read_record, training_order, write_shards
from flowlens.llm.work import shared_folder

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def test_feistel_is_a_bijection_with_an_inverse():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        got = feistel(np.arange(n), n, 11)
        assert sorted(got.tolist()) == list(range(n))
        assert (feistel(got, n, 11, inverse=True) == np.arange(n)).all()
    assert (feistel(np.arange(1000), 1000, 11) != feistel(np.arange(1000), 1000, 12)).any()
    near = np.abs(np.diff(feistel(np.arange(4097), 4097, 11)))
    assert np.median(near) > 400  # neighbours are far apart


def texts_of(rows, decode):
    """Documents from their pieces in the sequences."""
    pieces = collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.tokens, "<u2")
        for doc, first, at, n in zip(r.doc_ids, r.doc_at, r.at, r.n_ids):
            pieces[doc].append((first, ids[at : at + n]))
    return {doc: decode(np.concatenate([ids for _, ids in sorted(found, key=lambda p: p[0])])[:-1]) for doc, found in pieces.items()}


def test_round_trip_through_shards(spark):
    docs = edge_documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    order = Order(length=64, per_shard=50)
    sequences = training_order(docs, order)
    rows = sequences.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all(r.shard == r.slot // 50 and r.record == r.slot % 50 for r in rows)
    want = {r.doc_id: r.text for r in docs.collect() if r.text is not None}
    assert texts_of(rows, lambda ids: ids.astype(np.uint8).tobytes().decode()) == want

    folder = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    told = {r.shard: r for r in write_shards(sequences, f"file://{folder}").collect()}
    assert sum(r.records for r in told.values()) == len(rows) and {r.stride for r in told.values()} == {128}
    assert sorted(os.listdir(folder)) == [f"shard-{k:06d}.bin" for k in range(len(told))]
    for r in rows:
        with open(told[r.shard].path, "rb") as file:
            assert read_record(file, r.record, order.length).tobytes() == r.tokens


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no public tokenizer here")
def test_round_trip_with_a_public_tokenizer(spark):
    from tokenizers import Tokenizer

    docs = edge_documents(spark).where("doc_id IN (1, 3, 5, 7, 10, 13)")
    rows = training_order(docs, Order(length=32, per_shard=7, tokenizer=TOKENIZER)).collect()
    coder = Tokenizer.from_file(TOKENIZER)
    got = texts_of(rows, lambda ids: coder.decode(ids.tolist(), skip_special_tokens=False))
    assert got == {r.doc_id: r.text for r in docs.collect()}


def test_edge_documents(spark):
    docs = edge_documents(spark)
    order = Order(length=100)
    rows = training_order(docs, order).collect()
    ids = sum(len(r.text.encode()) + 1 for r in docs.collect() if r.text is not None)
    assert sum(r.n_tokens for r in rows) == ids and all(len(r.tokens) == 200 for r in rows)
    assert all(sum(r.n_ids) == r.n_tokens for r in rows)
    assert training_order(no_documents(spark)).count() == 0
    folder = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    assert write_shards(training_order(no_documents(spark)), f"file://{folder}").count() == 0
