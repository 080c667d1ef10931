"""Quality rules, line first: bad lines are removed, then documents that lose too much text are rejected.

A line (text split at `\\n`) with a word fails when
* punctuation: no word of it ends in a sentence mark (closing quotes and brackets after the mark aside), it holds
  no mark of a script written without blanks, and no letter of a script without marks (Thai, Lao); or more than
  `symbol_percent` of its characters are symbols, or it shouts (three or more `!` and mostly capitals);
* navigation: two or more of its words are lone separators;
* boilerplate: it holds a phrase of `BOILERPLATE`.

A document is rejected when it fails the base rules (fewer than `min_words` words, or over half of its words
lie in 3-word windows that occur again in it) or when failing lines hold more than `lost_percent` of its
characters. Null and empty texts have no words, so they are rejected. Lines without a word never fail and
hold nothing. Repeated rows get equal answers; no row depends on another one, so ties do not arise. An empty table
gives an empty one. `judge_documents` reads doc_id and text alone; `keep_clean` hands on extra columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm import tokens as K
from flowlens.shipping import ship

ship(__name__)

# Characters counted as symbols; sentence marks at the end of a word; those of scripts without blanks,
# which may stand anywhere in it; closing quotes and brackets; first and last letter of scripts without marks (Thai
# and Lao); lone separators and boilerplate phrases.
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?\u00b7\u0387\u037e\u0589\u060c\u061b\u061f\u06d4\u0964\u0965\u104a\u104b\u1362\u17d4\u17d5\u2026"
WIDE_MARKS = "\u0f0d\u0f0e\u3001\u3002\uff01\uff0c\uff0e\uff1a\uff1b\uff1f\uff61\uff64"
CLOSERS = "\"')]}\u00bb\u2018\u2019\u201c\u201d\u203a\u300b\u300d\u300f\u3011\uff09"
UNMARKED = ("\u0e01", "\u0eff")
SEPARATORS = "|><"
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "enable javascript",
    "privacy policy",
    "skip to content",
    "subscribe to our newsletter",
    "terms of use",
    "this site uses cookies",
)

FIELDS = (
    ("n_words", "bigint"),
    ("word_chars", "bigint"),
    ("n_symbols", "bigint"),
    ("n_dup_lines", "bigint"),
    ("n_repeat_words", "bigint"),
    ("n_lines", "bigint"),
    ("n_bad_lines", "bigint"),
    ("lost_chars", "bigint"),
    ("base_failed", "boolean"),
    ("kept", "boolean"),
)
RESULT = ", ".join(f"{name}: {kind}" for name, kind in FIELDS)


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    repeat_percent: int = 50
    symbol_percent: int = 5
    lost_percent: int = 30


def _lut(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


SYMBOL, SEPARATOR = _lut(SYMBOLS), _lut(SEPARATORS)
CAPITAL = _lut("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
SMALL = _lut("abcdefghijklmnopqrstuvwxyz")


class Ends:
    """Of each byte: whether a character of one of the sets ends there."""

    def __init__(self, data: np.ndarray):
        self.data, self.wide = data, np.flatnonzero(data >= 0xC2)
        self.wide = self.wide[data[self.wide] < 0xF0]
        long = data[self.wide] >= 0xE0
        self.last = self.wide + 1 + long
        at = [data[np.minimum(self.wide + k, len(data) - 1)].astype(np.int32) & 0x3F for k in (0, 1, 2)]
        lead = np.where(long, at[0] & 0x0F, at[0] & 0x1F)
        self.code = np.where(long, (lead << 12) | (at[1] << 6) | at[2], (lead << 6) | at[1])

    def of(self, chars: str) -> np.ndarray:
        """Where characters of `chars` end."""
        found = _lut("".join(c for c in chars if c < "\x80"))[self.data]
        found[self.last[np.isin(self.code, [ord(c) for c in chars if c >= "\x80"])]] = True
        return found

    def between(self, first: str, last: str) -> np.ndarray:
        found = np.zeros(len(self.data), bool)
        found[self.last[(self.code >= ord(first)) & (self.code <= ord(last))]] = True
        return found


def sentence_ends(words: K.Words) -> np.ndarray:
    """True at bytes that show a line to be running text: marks, or letters of scripts without marks."""
    data, ends = words.data, Ends(words.data)
    mark, closer = ends.of(MARKS + WIDE_MARKS), ends.of(CLOSERS)
    last = words.ends - 1
    tail = closer[last]
    if tail.any():
        whole = np.ones(len(data), bool)
        whole[:-1] = (data[1:] & 0xC0) != 0x80
        core = np.flatnonzero(whole & ~closer)
        place = np.searchsorted(core, words.ends[tail]) - 1
        stop = core[np.maximum(place, 0)] if len(core) else np.zeros(len(place), np.int64)
        inside = (place >= 0) & (stop >= words.starts[tail])
        last[tail] = np.where(inside, stop, last[tail])
    out = ends.of(WIDE_MARKS) | ends.between(*UNMARKED)
    out[last[mark[last]]] = True
    return out


class Lines:
    """Bounds of the lines of a chunk of documents and the failing ones."""

    def __init__(self, words: K.Words, rules: Rules):
        data, offsets = words.data, words.offsets
        breaks = np.flatnonzero(data == 10)
        self.starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
        self.ends = np.sort(np.concatenate((breaks, offsets[1:])), kind="stable")
        per_doc = 1 + np.diff(np.searchsorted(breaks, offsets))
        self.bounds = np.concatenate(([0], np.cumsum(per_doc)))
        self.doc = np.repeat(np.arange(len(per_doc)), per_doc)
        marks = self._count(sentence_ends(words))
        at = np.zeros(len(data), bool)
        lone = words.starts[(words.ends - words.starts == 1) & SEPARATOR[data[words.starts]]]
        at[lone] = True
        separators = self._count(at)
        self.words = np.searchsorted(words.starts, self.ends) - np.searchsorted(words.starts, self.starts)
        self.chars = self._count(words.solid & ((data & 0xC0) != 0x80))
        symbols = self._count(SYMBOL[data])
        shouts = self._count(data == ord("!"))
        capitals, smalls = self._count(CAPITAL[data]), self._count(SMALL[data])
        punctuation = (marks == 0) | (100 * symbols > rules.symbol_percent * self.chars)
        punctuation |= (shouts >= 3) & (capitals > smalls)
        self.bad = (self.words > 0) & (punctuation | (separators >= 2) | self._boilerplate(data))

    def _count(self, mask: np.ndarray) -> np.ndarray:
        running = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return running[self.ends] - running[self.starts]

    def _boilerplate(self, data: np.ndarray) -> np.ndarray:
        found = np.zeros(len(self.starts), bool)
        lower = K.LOWER[data].tobytes()
        for phrase in BOILERPLATE:
            phrase = phrase.encode()
            at = lower.find(phrase)
            while at >= 0:
                line = int(np.searchsorted(self.ends, at, "right"))
                if at + len(phrase) <= self.ends[line]:
                    found[line] = True
                at = lower.find(phrase, at + len(phrase))
        return found


def measure(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> tuple[dict[str, np.ndarray], Lines]:
    """The columns of FIELDS for the documents of a chunk, and its lines."""
    words = K.Words(data, offsets)
    lines = Lines(words, rules)
    salt = np.uint64(0x9E3779B97F4A7C15)
    with_word = np.flatnonzero(lines.words > 0)
    key = K.span_hashes(data, lines.starts, lines.ends)[with_word]
    _, later = K.repeated(K.mix(key + lines.doc[with_word].astype(np.uint64) * salt))
    duplicate = np.zeros(len(lines.starts), bool)
    duplicate[with_word] = later

    key, first, doc = K.shingles(words, words.hashes(False), 3)
    often, _ = K.repeated(K.mix(key + doc.astype(np.uint64) * salt))
    covered = np.zeros(len(words.starts), bool)
    for j in range(3):
        covered[first[often] + j] = True

    out = {"n_words": words.counts}
    out["word_chars"] = K.sums(words.solid & ((data & 0xC0) != 0x80), offsets)
    out["n_symbols"] = K.sums(SYMBOL[data], offsets)
    out["n_dup_lines"] = K.sums(duplicate, lines.bounds)
    out["n_repeat_words"] = K.sums(covered, words.bounds)
    out["n_lines"] = K.sums(lines.words > 0, lines.bounds)
    out["n_bad_lines"] = K.sums(lines.bad, lines.bounds)
    out["lost_chars"] = K.sums(np.where(lines.bad, lines.chars, 0), lines.bounds)
    failed = (out["n_words"] < rules.min_words) | (
        100 * out["n_repeat_words"] > rules.repeat_percent * out["n_words"]
    )
    out["base_failed"] = failed
    out["kept"] = ~failed & (100 * out["lost_chars"] <= rules.lost_percent * out["word_chars"])
    return out, lines


def _empty() -> dict[str, list]:
    return {name: [] for name, _ in FIELDS}


def line_rules(text: Column, rules: Rules = Rules()) -> Column:
    """A struct of FIELDS for each text: what the rules count in it and whether it is kept."""

    def judge(texts: pa.Array) -> pa.Array:
        data, offsets = K.utf8(texts)
        columns = _empty()
        for a, b in K.chunks(offsets):
            part = slice(offsets[a], offsets[b])
            got, _ = measure(data[part], offsets[a : b + 1] - offsets[a], rules)
            for name in columns:
                columns[name].append(got[name])
        arrays = []
        for name, kind in FIELDS:
            values = np.concatenate(columns[name]) if columns[name] else np.zeros(0)
            arrays.append(pa.array(values, pa.bool_() if kind == "boolean" else pa.int64()))
        return pa.StructArray.from_arrays(arrays, [name for name, _ in FIELDS])

    return F.arrow_udf(judge, RESULT)(text)


def judge_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id and FIELDS of every document."""
    judged = docs.select("doc_id", line_rules(F.col("text"), rules).alias("rules"))
    return judged.select("doc_id", "rules.*")


def clean_texts(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> tuple[np.ndarray, list[bytes]]:
    """Which documents of a chunk are kept, and the kept ones' texts without their failing lines."""
    got, lines = measure(data, offsets, rules)
    raw, out = data.tobytes(), []
    for i in np.flatnonzero(got["kept"]):
        first, last = lines.bounds[i], lines.bounds[i + 1]
        keep = first + np.flatnonzero(~lines.bad[first:last])
        if len(keep) == last - first:
            out.append(raw[lines.starts[first] : lines.ends[last - 1]])
        else:
            out.append(b"\n".join(raw[lines.starts[k] : lines.ends[k]] for k in keep))
    return got["kept"], out


def keep_clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with their failing lines removed; columns as before, `n_chars` follows the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            data, offsets = K.utf8(batch.column(at))
            for a, b in K.chunks(offsets):
                kept, texts = clean_texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], rules)
                part = batch.slice(a, b - a).filter(pa.array(kept))
                columns = part.columns
                columns[at] = pa.array(texts, pa.binary()).cast(batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    kept = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept
