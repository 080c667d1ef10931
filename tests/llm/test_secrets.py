import hashlib
import random
import re
import uuid

from edge import edge_documents, no_documents
from flowlens.llm import secrets as S

# The given patterns, the group whose length counts and its least length.
GIVEN = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}


def brute(text):
    out = []
    for place, (kind, (pattern, group, least)) in enumerate(GIVEN.items()):
        out += [(m.start(), place, m.end(), kind) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(out)


def joined(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)


def samples():
    rng = random.Random(8)
    pieces = ["token", "API_KEY", "Passwd", " = ", ":", '"', "'", "abc123", "0123456789abcdef", "AKIA", "ABCDEFGHIJ0123456789", " ", "é", "\n", "f"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for _ in range(400)]


def test_table_equals_brute_force(spark):
    extra = spark.createDataFrame(list(enumerate(samples(), 100)), "doc_id: bigint, text: string")
    docs = edge_documents(spark).unionByName(extra, allowMissingColumns=True)
    got = S.secret_table(docs, S.fresh_ledger(spark)).collect()
    want = []
    for r in docs.collect():
        base = brute(r.text)
        counts = [sum(k == kind for *_, k in base) for kind in GIVEN]
        want.append((r.doc_id or 0, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base)))
    assert sorted((r.doc_id or 0, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in got) == sorted(want)
    assert any(r.n_assign for r in got) and any(r.n_hex for r in got)


def test_further_rules(spark):
    jwt = "eyJ" + "a" * 20 + ".eyJ" + "b" * 20 + "." + "c" * 20
    text = f"x {jwt} -----BEGIN RSA PRIVATE KEY----- ghp_{'A1' * 20}"
    docs = spark.createDataFrame([(1, text)], "doc_id: bigint, text: string")
    (row,) = S.secret_table(docs, S.fresh_ledger(spark)).collect()
    assert [s.split(":")[0] for s in row.spans.split(",")] == ["jwt", "pem", "github"]


def test_only_unseen_pairs_are_scanned(spark, monkeypatch):
    ledger = S.fresh_ledger(spark)
    first = [(1, "token = abcdef1"), (2, "token = abcdef1"), (3, "nothing"), (4, None)]
    second = [*first, (5, "password: hunter22")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id: bigint, text: string")
    rules = len(S.RULES)
    one = S.secret_table(frame(first), ledger).collect()
    assert ledger.scanned().count() == 3 * rules
    assert sorted((r.doc_id, r.spans) for r in one) == [(1, "assign:0:15"), (2, "assign:0:15"), (3, ""), (4, "")]
    two = S.secret_table(frame(second), ledger).collect()
    assert ledger.scanned().count() == 4 * rules
    assert {r.doc_id: r.n_assign for r in two} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 1}
    again = S.secret_table(frame(second), ledger)
    assert sorted(again.collect()) == sorted(two) and ledger.scanned().count() == 4 * rules
    # a new version of one rule is scanned alone, and old findings of the rule no longer count
    newer = {**S.RULES, "assign": (2, *S.RULES["assign"][1:3], 8)}
    monkeypatch.setattr(S, "RULES", newer)
    three = S.secret_table(frame(second), ledger).collect()
    assert ledger.scanned().count() == 4 * rules + 4
    assert {r.doc_id: r.n_assign for r in three} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}


def test_nothing_to_scan(spark):
    ledger = S.Ledger(spark, f"{S.shared_folder(spark)}/none-{uuid.uuid4().hex}")
    assert S.secret_table(no_documents(spark), ledger).count() == 0
    assert ledger.findings().count() == 0
