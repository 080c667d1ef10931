import random
import zlib

import numpy as np
from edge import edge_documents, no_documents
from flowlens.llm.langid import Model, automaton, normalise, predict_documents

ALPHABETS = {"aa": "abcdefgh ", "bb": "efghijkl ", "cc": "ijklmnéü "}


def made_up(lang, seed, size):
    rng = random.Random(f"{lang}{seed}")
    parts = ["".join(rng.choice(ALPHABETS[lang][:-1]) for _ in range(rng.randrange(1, 4))) for _ in range(30)]
    return " ".join(rng.choice(parts) + rng.choice(parts) for _ in range(size))


def phrases(text, sample):
    """Greedy longest phrases that occur in the sample; single characters otherwise."""
    count = at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) + 1 and text[at : at + n] in sample and at + n <= len(text):
            n += 1
        at += max(1, n - 1)
        count += 1
    return count


def test_automaton_accepts_all_factors_and_nothing_else():
    text = np.array([0, 1, 1, 0, 2, 1, 0, 1, 1, 2])
    moves = automaton(text)
    factors = {tuple(text[i:j]) for i in range(10) for j in range(i + 1, 11)}

    def accepts(word):
        state = 0
        for c in word:
            state = moves[state].get(c)
            if state is None:
                return False
        return True

    rng = random.Random(1)
    words = [tuple(rng.randrange(3) for _ in range(rng.randrange(1, 6))) for _ in range(500)]
    assert all(accepts(w) == (w in factors) for w in [*words, *factors])


def test_phrases_equal_the_greedy_parse():
    samples = {"aa": made_up("aa", 1, 40), "bb": made_up("bb", 1, 40)}
    model = Model(samples)
    texts = ["", "abc", made_up("aa", 2, 20), made_up("bb", 3, 25), "zzz abc zzz", "hgf"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    got = model.phrases(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for k, name in enumerate(model.names):
        plain = normalise(np.frombuffer(samples[name].encode(), np.uint8), np.array([0, len(samples[name])]))[0]
        sample = plain.tobytes().decode()
        want = []
        for t in texts:
            blocks = [t[i : i + 256] for i in range(0, len(t), 256)]
            want.append(sum(phrases(b, sample) for b in blocks))
        assert got[:, k].tolist() == want


def test_normalise():
    raw = "Ab, ÉÇ--9 ü×".encode()
    data, offsets = normalise(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert data.tobytes().decode() == "ab éç ü×" and offsets.tolist() == [0, len(data)]


def test_held_out_accuracy(spark):
    rows = [(i, made_up(lang, i % 7, 20 + i % 30), lang) for i, lang in enumerate(list(ALPHABETS) * 60)]
    rows += [(1000, None, "aa"), (1001, "12 ; 34", "bb"), (1002, "", None), (1003, "你好", None)]
    docs = spark.createDataFrame(rows, "doc_id: bigint, text: string, lang: string")
    got = {r.doc_id: r for r in predict_documents(docs).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred in ALPHABETS
    held = [(got[i].lang_pred, lang) for i, _, lang in rows[:180] if got[i].held_out]
    assert sum(a == b for a, b in held) > 0.97 * len(held)


def test_edge_documents(spark):
    docs = edge_documents(spark)
    got = predict_documents(docs).collect()
    assert len(got) == docs.count()
    assert all(r.lang_pred in ("en", "de", "und") for r in got)
    assert predict_documents(no_documents(spark)).count() == 0
    unlabelled = docs.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in predict_documents(unlabelled).collect()} == {"und"}
