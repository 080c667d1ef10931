import collections

import numpy as np
from edge import edge_documents, no_documents, words
from flowlens.llm.mixing import landed, mix_documents, mix_table, walk


def targets(sizes):
    """Targets of sources (code point order, null last) by the stated rule, with plain loops."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total = 1.5 * sum(sizes.values())
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        share = sum(weight[s] for s in free)
        level = (total - sum(fixed.values())) / share if share else 0
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def held(rows, got):
    sizes, taken = collections.Counter(), collections.Counter()
    source = collections.defaultdict(set)
    for r in rows:
        sizes[r.source] += len(words(r.text))
        source[r.doc_id, len(words(r.text))].add(r.source)
    want = targets(sizes)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        (name,) = source[r.doc_id, r["size"]]
        assert r.source_size == sizes[name] and abs(r.target - want[name]) < 1e-6 * max(1, want[name])
        taken[name] += r.taken
    for name in sizes:
        assert abs(taken[name] - want[name]) <= 1.01
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((r.doc_id or -1, len(words(r.text))) for r in rows)


def test_walk_keeps_both_totals_and_leaves_little():
    rng = np.random.RandomState(5)
    for n in (0, 1, 2, 3, 50, 600):
        size, part = rng.randint(0, 900, n), rng.random_sample(n)
        out = walk(size, part, [1, 2, 3])
        assert ((out >= 0) & (out <= 1)).all()
        assert ((out > 0) & (out < 1)).sum() <= 3
        assert abs(out.sum() - part.sum()) < 1e-6 and abs((out * size).sum() - (part * size).sum()) < 1e-3
        assert (walk(size, part, [1, 2, 3]) == out).all()


def test_walk_keeps_inclusion_probabilities():
    size, part = np.array([5, 9, 2, 7, 7, 1]), np.array([0.3, 0.7, 0.5, 0.2, 0.9, 0.4])
    mean = np.mean([walk(size, part, [k, 0, 0]) for k in range(4000)], axis=0)
    assert np.abs(mean - part).max() < 0.04


def test_edge_documents(spark):
    docs = edge_documents(spark).where("doc_id IS NOT NULL OR text IS NULL")
    held(docs.collect(), mix_table(docs).collect())
    assert mix_table(no_documents(spark)).count() == mix_documents(no_documents(spark)).count() == 0


def test_many_cells_and_repeated_rows(spark):
    rng = np.random.RandomState(3)
    rows = [(i, f"s{i % 3 if i % 4 else 9}", "w " * int(rng.randint(0, 60))) for i in range(3000)]
    rows += [(7, "hot", "same words here")] * 700
    docs = spark.createDataFrame(rows, "doc_id: bigint, source: string, text: string")
    first = mix_table(docs).collect()
    held(docs.collect(), first)
    again = mix_table(docs.repartition(5)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_documents_are_repeated_and_whole(spark):
    """Whole documents, at most twice, and each source as near its target as whole documents allow."""
    rng = np.random.RandomState(8)
    extra = [(100 + i, f"w{i} " * int(rng.randint(1, 90)), f"s{i % 5}") for i in range(400)]
    docs = edge_documents(spark).select("doc_id", "text", "source", "size")
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id: bigint, text: string, source: string"), True)
    docs = docs.selectExpr("*", "7 AS _row", "'x' AS _unit", "doc_id AS _size", "1 AS unit")
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns
    rows, sizes, largest = docs.collect(), collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r.source] += len(words(r.text))
        largest[r.source] = max(largest[r.source], len(words(r.text)))
    want, got, times = targets(sizes), collections.Counter(), collections.Counter()
    for r in mixed.collect():
        got[r.source] += len(words(r.text))
        times[tuple(r)] += 1
    assert all(abs(got[s] - want[s]) <= largest[s] / 2 + 1.01 for s in sizes)
    assert all(n <= 2 * rows.count(r) for r, n in times.items())


def test_landing_is_the_nearest_choice(spark):
    units = [(i, "a", w, 1, 0, p, i) for i, w, p in ((1, 10, 4), (2, 7, 5), (3, 4, 1))] + [(4, None, 9, 2, 3, 5, 4)]
    opened = spark.createDataFrame(units, "id: bigint, of: string, words: bigint, copies: bigint, whole: bigint, part_words: bigint, unit: bigint")
    got = {r.id: r.whole for r in landed(opened).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 4}
    assert landed(opened.limit(0)).count() == 0


def test_large_ids_beside_a_null_id(spark):
    """Ids beyond 2^53 stay what they are in a cell that also holds a null id."""
    rows = [(2**60 + i if i else None, f"w{i} " * (i % 7 + 1), "a") for i in range(0, 40)]
    docs = spark.createDataFrame(rows, "doc_id: bigint, text: string, source: string")
    got = mix_table(docs).collect()
    assert sorted(r.doc_id or 0 for r in got) == sorted(r[0] or 0 for r in rows)
    assert all(r["size"] == (r.doc_id or 2**60) % 2**60 % 7 + 1 for r in got)
