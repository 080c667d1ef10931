import collections
import re

import numpy as np
from edge import edge_documents, no_documents, words
from flowlens.llm import quality as Q
from flowlens.llm import tokens as K
from flowlens.llm.quality import Rules, judge_documents, keep_clean


def base(text):
    """The base counts of a text, word by word and line by line."""
    text = text or ""
    found = words(text)
    windows = collections.Counter(zip(found, found[1:], found[2:]))
    covered = {k + j for k in range(len(found) - 2) if windows[tuple(found[k : k + 3])] > 1 for j in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    n = len(found)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), failed


def columns(row):
    return row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed


def test_base_counts_equal_brute_force(spark):
    docs = edge_documents(spark)
    texts = [r.text for r in docs.collect()]
    got = judge_documents(docs).collect()
    assert sorted(map(columns, got)) == sorted(map(base, texts))
    assert not any(r.kept and r.base_failed for r in got)


def test_line_rules(spark):
    body = "\n".join(" ".join(f"word{k}x{i}" for i in range(9)) + f", end{k}." for k in range(10))
    texts = [
        body,
        body + "\nHome | About | Contact | Help",
        "\n".join(f"Home{k} | About{k} | Contact{k} | Help{k}" for k in range(20)),
        "\n".join(f"WORD{k}!! LOUD{k}!! SHOUT{k}!!" for k in range(20)),
        "\n".join(f"word{k}*** other{k}### thing{k}$$$ more{k}." for k in range(20)),
        body + "\nThis site uses cookies, and all rights reserved.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id: bigint, text: string")
    got = {r.doc_id: r for r in judge_documents(docs).collect()}
    assert [got[i].n_bad_lines for i in range(6)] == [0, 1, 20, 20, 20, 1]
    assert [got[i].kept for i in range(6)] == [True, True, False, False, False, True]
    kept = {r.doc_id: r.text for r in keep_clean(docs).collect()}
    assert kept == {0: body, 1: body, 5: body}


def test_lost_text_limit_is_a_parameter(spark):
    good = " ".join(f"word{k}," for k in range(60))
    docs = spark.createDataFrame([(1, good + "\n" + "| nav | " * 20)], "doc_id: bigint, text: string")
    assert [r.kept for r in judge_documents(docs, Rules(lost_percent=1)).collect()] == [False]


def test_clean_table_keeps_columns_and_handles_nothing(spark):
    docs = edge_documents(spark)
    kept = keep_clean(docs)
    assert kept.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in kept.collect())
    assert keep_clean(no_documents(spark)).count() == judge_documents(no_documents(spark)).count() == 0


def test_sentence_marks_of_other_scripts_and_quotes(spark):
    line = {
        "zh": "河水 流过 老 磨坊，工人 数着 粮袋 。",
        "zh in one": "河水流过老磨坊，工人数着粮袋。再见",
        "hi": "नदी पुरानी चक्की के पास बहती है।",
        "ar": "هل يمر النهر قرب الطاحونة؟",
        "th": "แม่น้ำ ไหล ผ่าน โรงสี เก่า",
        "curly": "“The river rises in the spring.”",
        "nested": "(he said: 'the river rises!')”]",
        "none": "the river “rises” in the spring \U0001f600",
        "closers alone": "the river rises '\"') in the spring",
        "mark inside": "the file.name of a v1.2x release",
    }
    docs = spark.createDataFrame([(k, "\n".join([v] * 20)) for k, v in line.items()], "doc_id: string, text: string")
    got = {r.doc_id: r.n_bad_lines for r in judge_documents(docs).collect()}
    bad = {"none", "closers alone", "mark inside"}
    assert got == {k: 20 * (k in bad) for k in line}


def test_sentence_ends_equal_a_pattern():
    rng = np.random.RandomState(5)
    signs = [*"ab .,!\"')", " ", " ", "”", "。", "।", "é", "ก", "\U0001f600", "…"]
    marks, wide, closers = (f"[{re.escape(c)}]" for c in (Q.MARKS + Q.WIDE_MARKS, Q.WIDE_MARKS, Q.CLOSERS))
    pattern = re.compile(rf"{marks}{closers}*(?=[\x20\x09-\x0D]|$)|{wide}|[ก-໿]")
    texts = ["".join(rng.choice(signs, rng.randint(0, 9))) for _ in range(4000)] + ["", "”", "."]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    found = Q.sentence_ends(K.Words(np.frombuffer(b"".join(raw), np.uint8), offsets))
    got = [bool(found[a:b].any()) for a, b in zip(offsets, offsets[1:])]
    assert got == [bool(pattern.search(t)) for t in texts]
