import collections
import hashlib
import math
import re
import zlib

from edge import PROSE, edge_documents, no_documents
from flowlens.llm.resample import Resampling, resample_table, resampled

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TARGETS = [(1, "The miller counts sacks of grain."), (2, None), (3, ""), (4, PROSE[:80])]


def targets(spark):
    return spark.createDataFrame(TARGETS, "item_id: bigint, text: string")


def features(text, longest):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(folded)
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, rules):
    """(id, features, weight, score, rank) and the drawn (id, text) by one pass in memory."""
    bucket = lambda f: zlib.crc32(f.encode()) % rules.buckets
    s = collections.Counter(bucket(f) for _, t in rows for f in features(t, rules.longest)[1])
    t = collections.Counter(bucket(f) for _, x in target for f in features(x, rules.longest)[1])
    all_s, all_t = sum(s.values()) + rules.buckets, sum(t.values()) + rules.buckets
    out = []
    for doc_id, text in rows:
        n, found = features(text, rules.longest)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"{rules.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None, n, text])
    able = sorted((r for r in out if r[5] >= rules.min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: rules.percent * len(able) // 100], 1):
        row[4] = rank
    return collections.Counter(tuple(r[:5]) for r in out), collections.Counter((r[0], r[6]) for r in out if r[4])


def held(spark, docs, rules):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    table, chosen = brute(rows, TARGETS, rules)
    got = collections.Counter(tuple(r) for r in resample_table(docs, targets(spark), rules).collect())
    kept = resampled(docs, targets(spark), rules)
    assert kept.columns == docs.columns
    return got == table and collections.Counter((r.doc_id, r.text) for r in kept.collect()) == chosen


def test_edge_documents(spark):
    docs = edge_documents(spark)
    for rules in (Resampling(), Resampling(buckets=7, longest=3, min_words=1, percent=55), Resampling(min_words=0, percent=100)):
        assert held(spark, docs, rules)
    assert resample_table(no_documents(spark), targets(spark)).count() == 0
    assert resampled(no_documents(spark), targets(spark)).count() == 0
    assert resample_table(docs, targets(spark).limit(0)).count() == docs.count()


def test_ties_and_wide_brackets(spark):
    """A coarse sketch over scores of which most are equal: the bracket has to widen, ties go by id."""
    rows = [(None, "same words here")] * 400 + [(i, f"word{i % 3} " * (i % 5 + 1)) for i in range(300)] + [(7, "word1 word1 word1")] * 90
    docs = spark.createDataFrame(rows, "doc_id: bigint, text: string").repartition(5)
    for percent in (1, 10, 42, 99):
        assert held(spark, docs, Resampling(min_words=1, percent=percent, accuracy=10))
