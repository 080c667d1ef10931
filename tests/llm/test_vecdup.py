import collections
import math
import pathlib

import numpy as np
from flowlens.llm import vecdup
from flowlens.llm.vecdup import Vectors, keep_one_vector_each, vector_table

SCHEMA = "vec_id: bigint, embedding: array<double>, label: int, node: string, class: int, key: string, unit: string, kept: int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "n", 2, "k", "u", 3) for i, v in rows], SCHEMA)


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, cosine):
    """(id, links, component, kept) of all rows, by all pairs."""
    units = [np.array(v) / np.abs(v).max() if usable(v) else None for _, v in rows]
    units = [u / np.linalg.norm(u) if u is not None else None for u in units]
    by_size = collections.defaultdict(list)
    for i, u in enumerate(units):
        if u is not None:
            by_size[len(u)].append(i)
    links, group = [0] * len(rows), list(range(len(rows)))
    for at in by_size.values():
        m = np.array([units[i] for i in at])
        near = m @ m.T >= cosine
        for a, i in enumerate(at):
            for b in np.flatnonzero(near[a]):
                if at[b] != i:
                    links[i] += 1
                    old, new = max(group[i], group[at[b]]), min(group[i], group[at[b]])
                    if old != new:
                        group = [new if g == old else g for g in group]
    least = {}
    for (name, _), g in zip(rows, group):
        if name is not None:
            least[g] = min(name, least.get(g, name))
    return collections.Counter(
        (name, n, least.get(g), name is not None and name == least.get(g)) for (name, _), n, g in zip(rows, links, group)
    )


def same(spark, rows, rules=Vectors()):
    got = collections.Counter(tuple(r) for r in vector_table(table(spark, rows), rules).collect())
    return got == brute(rows, rules.cosine)


def around(rng, centre, n, spread):
    return [[float(x) for x in centre + spread * rng.standard_normal(len(centre))] for _ in range(n)]


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0]),
        (2, [2.0, 0.0]),
        (2, [2.0, 0.0]),
        (3, [0.0, 0.0]),
        (4, None),
        (5, []),
        (6, [1.0, None]),
        (7, [float("nan"), 1.0]),
        (8, [float("inf"), 1.0]),
        (9, [1.0, 0.0, 0.0]),
        (10, [1e300, 1e299]),
        (11, [1e-300, 1e-301]),
        (12, [-1.0, 0.0]),
        (None, [0.0, 5.0]),
        (None, [0.0, 6.0]),
        (None, [1.0, 0.01]),
    ]
    assert same(spark, rows)
    assert vector_table(table(spark, [])).count() == 0
    assert [r[0] for r in keep_one_vector_each(table(spark, rows[:3])).collect()] == [1]


def test_crowds_chains_and_blocks(spark):
    """A tight crowd, loose ones with chains of links, copies; blocks smaller than buckets."""
    rng = np.random.RandomState(5)
    v = around(rng, np.zeros(24), 150, 1.0)
    v += around(rng, rng.standard_normal(24), 260, 0.13)
    v += around(rng, rng.standard_normal(24), 160, 0.3)
    v += [v[200]] * 40
    for spread in (0.05, 0.2, 0.33) * 3:
        v += around(rng, rng.standard_normal(24), 7, spread)
    rng.shuffle(v)
    rows = list(enumerate(v))
    want = brute(rows, 0.9)
    assert max(r[1] for r in want) > 250 and len({r[2] for r in want}) > 150
    assert same(spark, rows, Vectors(mates=20, block=64))


def test_recall_at_the_threshold(spark):
    """Pairs with a cosine just above 0.9 among unrelated vectors are found, those just below are not."""
    rng = np.random.RandomState(9)
    rows = []
    for i in range(600):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.901 if i % 2 else 0.899
        rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + math.sqrt(1 - c * c) * b).tolist())]
    got = {r.vec_id: r for r in vector_table(table(spark, rows), Vectors(mates=32)).collect()}
    found = [got[2 * i].n_links for i in range(600)]
    assert not any(found[::2]) and sum(found[1::2]) >= 299


def test_shape_grows_slowly():
    rules = Vectors()
    shapes = [rules.shape(n) for n in (0, 1, 500, 10**5, 10**9)]
    assert shapes[0][0] == 1 and all(a <= b for a, b in zip(shapes, shapes[1:])) and shapes[-1][1] < 1000


def test_rounds_and_few_candidates(spark, monkeypatch):
    """Rounds of single tables and few pairs change nothing; unrelated vectors are not held against every crowd."""
    rng = np.random.RandomState(17)
    v = around(rng, np.zeros(64), 1200, 1.0)
    for _ in range(20):
        v += around(rng, rng.standard_normal(64), 40, 0.02)
    rows = list(enumerate(v))
    asked, cosines = [], vecdup.cosines
    monkeypatch.setattr(vecdup, "cosines", lambda pairs, *rest: asked.append(pairs.count()) or cosines(pairs, *rest))
    rules = Vectors(mates=64, round_mb=0)
    assert len(vecdup.rounds(rules.shape(2000)[1], rules, 2000, 2000 * 512)) > 2
    assert same(spark, rows, rules)
    assert sum(asked) < 20_000  # 20 crowds and 1,200 others: 24,000 pairs and more
    left = [p for kind in ("units", "members", "keys", "dealt") for p in pathlib.Path(vecdup.shared_folder(spark)).glob(f"vector-round*/*{kind}*")]
    assert not left
