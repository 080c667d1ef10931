import collections
import os

import pytest
from edge import SCHEMA, edge_documents, words
from test_neardup import brute
from test_quality import base

import corpus_pipeline as P
from flowlens.llm.neardup import Near

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def held_stages(spark, docs, sf_dir, folder):
    out = {}
    for name, stage in P.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs
    return list(out.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = held_stages(spark, docs, SF, str(tmp_path))
    assert [sorted(s.columns) for s in stages[:-1]] == [sorted(COLUMNS)] * 4
    assert set(stages[-1].columns) == {*COLUMNS, "shard", "slot"}
    first, second, third, fourth, fifth = [[r.asDict() for r in s.collect()] for s in stages]

    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(not base(texts[r["doc_id"]])[-1] for r in first)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in first}
    for doc_id, quality in labels.items():
        assert (doc_id in kept) == (quality == 1 and not base(texts[doc_id])[-1])

    groups = {i for i, _, i_least in brute([(r["doc_id"], r["text"]) for r in first], Near()) if i == i_least}
    assert {r["doc_id"] for r in second} == groups and len(second) == len(groups)

    items = [" ".join(words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaking = {r["doc_id"] for r in second if any(item in " ".join(words(r["text"])) for item in items)}
    assert {r["doc_id"] for r in second} - {r["doc_id"] for r in third} >= leaking
    assert len(third) >= len(second) - len(leaking) - 1

    assert {r["doc_id"] for r in fourth} <= {r["doc_id"] for r in third}
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in third:
        sizes[r["source"]] += len(words(r["text"]))
        largest[r["source"]] = max(largest[r["source"]], len(words(r["text"])))
    for r in fourth:
        taken[r["source"]] += len(words(r["text"]))
    assert {str(r) for r in fourth} <= {str(r) for r in third}
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= sum(largest.values()) / 2 + len(sizes) + 1
    assert all(taken[s] <= 2 * sizes[s] for s in taken)

    assert sorted(map(str, fourth)) == sorted(str({c: r[c] for c in fourth[0]}) for r in fifth)
    slots = collections.defaultdict(list)
    for r in fifth:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_edge_documents_pass_through(spark, tmp_path):
    docs = edge_documents(spark).drop("shard", "slot")
    docs.limit(0).selectExpr("doc_id AS item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = held_stages(spark, docs, str(tmp_path), f"{tmp_path}/out")
    assert all(set(s.columns) == set(docs.columns) for s in stages[:-1])
    first = [(r.doc_id, r.text) for r in stages[0].collect()]
    groups = {least for _, _, least in brute(first, Near())}
    assert len(first) == 6 and {r.doc_id for r in stages[1].collect()} == groups == {1}
    none = held_stages(spark, spark.createDataFrame([], SCHEMA), str(tmp_path), f"{tmp_path}/none")
    assert [s.count() for s in none] == [0] * 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_all_document_queries_run_on_the_smallest_tables(spark):
    import __spark_entry__ as entry

    found = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {name.split("_")[0] + "_" for name in found if name.startswith("op")}
    assert "pipeline" in found
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op2_language", "op5_quality_rules", "op6_sharding", "op9_licenses"):
        assert found[name](spark, SF).count() == n
