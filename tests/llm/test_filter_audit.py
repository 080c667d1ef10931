import collections
import re
from itertools import permutations

from edge import PROSE, edge_documents, no_documents, words
from flowlens.llm.filter_audit import Filters, audit_filters

LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, 1, 1), (5, None, 1), (9, 1, None), (None, 1, 1), (77, 1, 1)]
NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id: bigint, quality: int, toxic: int")


def brute(rows, marks, rules):
    """The whole result by running every order over every document."""
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    parts = collections.defaultdict(list)
    for doc_id, text, lang in rows:
        t, found = text or "", words(text)
        failed = {
            "A": len(found) < rules.min_words,
            "B": 100 * len(set(found)) < rules.distinct_percent * len(found),
            "C": 100 * len(re.findall("[A-Z]", t)) > rules.capital_percent * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": doc_id is not None and doc_id > least[t],
        }
        mine = [x for x in marks if x[0] is not None and x[0] == doc_id]
        parts[lang or ""].append(({f for f in failed if failed[f]}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part, docs in parts.items():
        total = collections.Counter()
        for p in permutations("ABCDE"):
            left = list(docs)
            for step, f in enumerate(p, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                fails = sum(f in d[0] for d in docs)
                total[f] += len(gone)
                unique = sum(d[0] == {f} for d in docs)
                lost = [sum(d[1] for d in gone), sum(d[2] for d in gone)]
                out[part, "".join(p), step] = [len(left), len(gone), fails - len(gone), unique, *lost]
        for (name, p, step), row in out.items():
            if name == part:
                row.append(total[p[step - 1]])
    return out


def held(docs, found_labels, rules):
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    got = audit_filters(docs, found_labels, rules).collect()
    want = brute(rows, [tuple(r) for r in found_labels.collect()], rules)
    return len(got) == len(want) and {(r.part, r.filter_order, r.step): [r[n] for n in NAMES] for r in got} == want


def test_edge_documents(spark):
    docs = edge_documents(spark)
    for rules in (Filters(), Filters(min_words=20, distinct_percent=90, capital_percent=1)):
        assert held(docs, labels(spark), rules)
    assert held(docs, labels(spark).limit(0), Filters())
    assert audit_filters(no_documents(spark), labels(spark)).count() == 0


def test_one_text_owns_most_rows(spark):
    rows = [(i, PROSE * 4 if i % 3 else PROSE + f" # {i}", "en" if i % 4 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id: bigint, text: string, lang: string").repartition(7)
    assert held(docs, labels(spark), Filters())


def test_nothing_fails(spark):
    docs = spark.createDataFrame([(1, "a b c", "xx"), (2, "d e f", "xx")], "doc_id: bigint, text: string, lang: string")
    rows = audit_filters(docs, labels(spark), Filters(min_words=1)).collect()
    assert len(rows) == 600 and all(r.kept == 2 and not any(r[n] for n in NAMES[1:]) for r in rows)
