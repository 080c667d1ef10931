import os
import random

import numpy as np
from edge import edge_documents, no_documents
from flowlens.llm.neardup import Near, buckets, components, keep_one_each, near_table, tables
from flowlens.llm.work import written


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, size):
    found = fold(text or "").encode().split()
    if len(found) >= size:
        return frozenset(tuple(found[i : i + size]) for i in range(len(found) - size + 1))
    return frozenset([tuple(found)] if found else [])


def brute(rows, near):
    """(doc_id, set size, component) by comparing all pairs."""
    sets = [shingles(text, near.words) for _, text in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= near.percent * len(a | b) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc_id, _), g in zip(rows, group):
        if doc_id is not None:
            least[g] = min(doc_id, least.get(g, doc_id))
    out = []
    for (doc_id, _), found, g in zip(rows, sets, group):
        out.append((doc_id, len(found), least.get(g) if found else doc_id))
    return out


def same(got, want):
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(want, key=key)


def chained(seed, groups, size):
    """Groups whose members differ from the next one by few words and from far ones by many."""
    rng, rows, number = random.Random(seed), [], 0
    for _ in range(groups):
        text = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 120))]
        for _ in range(size):
            rows.append((number, " ".join(text)))
            number += rng.randrange(1, 4)
            text[rng.randrange(len(text))] = f"w{rng.randrange(10**6)}"
    rng.shuffle(rows)
    return rows


def test_edge_documents(spark):
    docs = edge_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for near in (Near(), Near(words=3, percent=85)):
        got = near_table(docs, near).collect()
        assert same(got, brute(rows, near))
        assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)
    assert near_table(no_documents(spark)).count() == keep_one_each(no_documents(spark)).count() == 0


def test_chains_and_large_buckets(spark):
    rows = chained(1, 6, 12) + [(5000 + i, f"alone {i} here we go again {i * i} yes") for i in range(60)]
    shared = " ".join(f"shared{k}" for k in range(40))
    rows += [(6000 + i, shared + " " + " ".join(f"own{i}x{k}" for k in range(60))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id: bigint, text: string")
    for small in (64, 4):  # with 4, most buckets go through the finer tables
        near = Near(words=3, percent=85, small=small)
        assert same(near_table(docs, near).collect(), brute(rows, near))


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(9)
    text = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(150):
        copy = list(text)
        copy[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id: bigint, text: string")
    got = near_table(docs, Near(words=3, percent=85, small=8)).collect()
    assert {r.component_id for r in got} == {0}


def test_texts_put_together_from_shared_passages(spark):
    rng = random.Random(3)
    passages = [" ".join(f"p{i}w{k}" for k in range(16)) for i in range(26)]
    rows = []
    for i in range(300):
        chosen = sorted(rng.sample(range(26), 20))
        rows.append((i, " ".join(passages[c] for c in chosen) + f" own{i} " + " ".join(f"own{i}x{k}" for k in range(5))))
    docs = spark.createDataFrame(rows, "doc_id: bigint, text: string")
    want = brute(rows, Near(words=3, percent=85))
    assert len({c for _, _, c in want}) < 290
    assert same(near_table(docs, Near(words=3, percent=85, block=50)).collect(), want)


def test_keep_one_each_keeps_whole_rows(spark):
    docs = edge_documents(spark)
    kept = keep_one_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is not None, r.doc_id or 0, r.text is None) for r in kept.collect())
    want = {r[2] for r in brute([(r.doc_id, r.text) for r in docs.collect()], Near())} - {None}
    assert {i for known, i, _ in ids if known} == want and len([i for known, i, _ in ids if known]) == len(want)
    # of the rows without an id: the one that is in nobody's group, and the null text once
    assert sum(not known for known, _, _ in ids) in (1, 2)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (3, 10), (20, 21), (21, 22), (22, 23), (23, 24), (24, 20)]
    frame = spark.createDataFrame(edges, "x: bigint, y: bigint")
    got = {r.node: r.root for r in components(frame).collect()}
    assert got == {2: 1, 3: 1, 10: 1, 9: 8, 21: 20, 22: 20, 23: 20, 24: 20}
    assert components(frame.limit(0)).count() == 0


def test_parities_rule_out_no_similar_pair(spark):
    """Parities differ in at most as many bits as the sets differ in elements."""
    from flowlens.llm.neardup import parities

    rng = np.random.RandomState(4)
    rows = []
    for i in range(60):
        base = rng.randint(0, 2**63, rng.randint(1, 3000), dtype=np.uint64)
        other = np.concatenate((base[rng.randint(0, max(1, len(base) // 5)) :], rng.randint(0, 2**63, i * 3, dtype=np.uint64)))
        rows += [(2 * i, np.unique(base)), (2 * i + 1, np.unique(other))]
    df = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in rows], "i: int, set: binary")
    got = {r.i: np.frombuffer(r.p, np.uint8) for r in df.select("i", parities(df["set"]).alias("p")).collect()}
    for (i, a), (j, b) in zip(rows[::2], rows[1::2]):
        apart = int(np.bitwise_count(got[i] ^ got[j]).sum())
        assert apart <= len(np.setxor1d(a, b)) and (apart - len(np.setxor1d(a, b))) % 2 == 0


def test_extra_columns_keep_their_values(spark):
    docs = edge_documents(spark).selectExpr("*", "7 AS _row", "'n' AS node_", "doc_id AS keeper")
    kept = keep_one_each(docs)
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}


def test_pairs_grow_with_the_group_not_with_the_tables(spark, monkeypatch):
    """Classes already joined are not compared again: a group of near copies makes a few pairs a class."""
    from flowlens.llm import neardup

    rng = random.Random(5)
    text, rows = [f"w{k}" for k in range(200)], []
    for i in range(300):
        copy = list(text)
        copy[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + r, t) for r, t in chained(2, 5, 6)]
    docs, made = spark.createDataFrame(rows, "doc_id: bigint, text: string"), []
    real = neardup.written

    def counting(df, name):
        out = real(df, name)
        if name in ("near-pairs", "near-texts"):
            made.append((name, out.count()))
        return out

    monkeypatch.setattr(neardup, "written", counting)
    near = Near(words=3, percent=85, block=16)
    assert same(near_table(docs, near).collect(), brute(rows, near))
    assert sum(n for name, n in made if name == "near-pairs") <= near.side * len(rows)
    assert [n <= len(rows) for name, n in made if name == "near-texts"] == [True]


def test_among_keeps_all_that_are_sought(spark):
    from flowlens.llm.neardup import among

    rows = spark.range(20000).selectExpr("id", "unhex(md5(CAST(id AS STRING))) AS keeper")
    few = rows.where("id % 40 = 3").select("keeper")
    got = {r.id for r in among(rows, "keeper", few).collect()}
    assert got >= set(range(3, 20000, 40)) and len(got) < 4000
    assert among(rows, "keeper", few.limit(0)).count() == 0


def test_pairs_far_from_the_threshold_are_ruled_out_before_their_texts_are_read(spark, monkeypatch):
    import flowlens.llm.neardup as module

    rng, rows = random.Random(5), []
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    for n in range(120):  # about 0.7 alike with one another: bands are shared, links are not
        text = list(base)
        for at in rng.sample(range(400), 14):
            text[at] = f"x{rng.randrange(10**6)}"
        rows.append((n, " ".join(text)))
    rows += [(200 + n, rows[n][1] + " more") for n in range(10)]
    near, counts = Near(words=3, percent=85), {"near-pairs": 0, "near-places": 0}

    def counted(df, name, *folder):
        out = written(df, name, *folder)
        if name in counts:
            counts[name] += out.count()
        return out

    written = module.written
    monkeypatch.setattr(module, "written", counted)
    got = near_table(spark.createDataFrame(rows, "doc_id bigint, text string"), near).collect()
    assert same(got, brute(rows, near))
    assert counts["near-pairs"] > 200
    assert counts["near-places"] < 50


def test_rounds_of_components_are_deleted(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    edges = spark.createDataFrame([(n, n + 1) for n in range(40)], "x bigint, y bigint")
    assert {r.root for r in components(edges).collect()} == {0}
    assert len(set(os.listdir(folder)) - before) == 1


def test_exploded_rows_are_not_broadcast(spark):
    """144 rows a class, sized by Spark as a part of one: no side of their joins goes to the driver."""
    rows = [(i, 9, i % 7, [i // 2] * 24, list(range(12)), list(range(12, 24))) for i in range(40)]
    live = spark.createDataFrame(rows, "node bigint, n_shingles bigint, label bigint, bands array<bigint>, low array<int>, high array<int>")
    live = written(live, "live")
    met = buckets(tables(live))
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 40 * 144
