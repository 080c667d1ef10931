import hashlib
import random
import re

from edge import edge_documents, no_documents
from flowlens.llm.pii import KINDS, Field, added_spans, base_spans, luhn, personal_table, phrase_samples, train

# The given patterns.
GIVEN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute(text):
    out = []
    for kind, pattern in enumerate(GIVEN):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    pieces = ["a.b@c.de", "@", "x@y", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (743) 555-3824", "+", "12-34", ".", " "]
    pieces += ["é", "zz", "\n", "5", "00", "-", "(", "%", "a+b@c-d.e.f", "1.2.3.4.5.6.7.8", "0001.2.3.004"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9)))
        assert base_spans(text) == brute(text), text
    assert base_spans("") == []


def test_long_runs_take_no_long(spark):
    for text in ("1" * 100_000, "1." * 50_000, "a" * 100_000 + "@", "@a" * 50_000, "+1" + "(" * 100_000, "1 " * 50_000):
        base_spans(text)


def test_field_learns_forms_that_patterns_miss():
    field = Field().learn(phrase_samples() * 3)

    def found(text):
        return [(KINDS[k], text[a:b]) for a, k, b in added_spans(text, base_spans(text), field)]

    assert found("my number is (415) 555-2671 ok") == [("phone", "(415) 555-2671")]
    assert found("mail bob [at] corp.example.com now") == [("email", "bob [at] corp.example.com")]
    for clean in ("on 2024-05-06 12:30 we met", "version 10.2.33.4567", "order 123456789 of 12", "12 34 56 78", "plain words"):
        assert found(clean) == []


def test_decoding_is_the_best_segmentation():
    """Against all segmentations of a short region."""
    from flowlens.llm.pii import analyse

    field = Field().learn(phrase_samples())
    text = "call (555) 123-4567 now"
    region = analyse(text, 0, len(text))
    spans = {(i, j): max(field.scores(f)) for i, j, f in region.spans}

    def best(i):
        if i == len(region.kinds):
            return 0.0
        options = [field.other.get(region.kinds[i], 0.0) + best(i + 1)]
        options += [s + best(b) for (a, b), s in spans.items() if a == i]
        return max(options)

    chosen = field.decode(region)
    covered = {t for i, _, j in chosen for t in range(i, j)}
    total = sum(spans[i, j] for i, _, j in chosen)
    total += sum(field.other.get(c, 0.0) for t, c in enumerate(region.kinds) if t not in covered)
    assert abs(total - best(0)) < 1e-9 and chosen


def test_table_equals_brute_force(spark):
    docs = edge_documents(spark).unionByName(
        spark.createDataFrame(
            [(50, "é mail a.b@c.de, ip 10.0.0.1 card 4111 1111 1111 1111 tel +1 (743) 555-3824"), (51, "call (555) 123-4567 now")],
            "doc_id: bigint, text: string",
        ),
        allowMissingColumns=True,
    )
    got = personal_table(docs).collect()
    want = sorted((r.doc_id or 0, ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in brute(r.text))) for r in docs.collect())
    assert sorted((r.doc_id or 0, r.base_sha256) for r in got) == sorted(
        (i, hashlib.sha256(s.encode()).hexdigest()) for i, s in want
    )
    rows = {r.doc_id: r for r in got}
    assert (rows[50].n_email, rows[50].n_ip, rows[50].n_card, rows[50].n_phone) == (1, 1, 1, 1)
    assert rows[51].spans == "phone:5:19" and rows[51].n_added == 1
    assert personal_table(no_documents(spark)).count() == 0
    assert train(no_documents(spark)).weights
