"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text is built. A text is parsed greedily
into the longest phrases that occur in the sample; every break costs one phrase. With n the sample's length
and m the text's, phrases * log2(n) / m estimates the cross entropy, and the language with the least wins
(ties: the smaller name).

Texts are parsed whole, in blocks of BLOCK bytes so that many blocks advance at once; each block starts a new
phrase, in every language alike. Before that, letters are lower-cased and runs of other ASCII characters
become one space. The automaton has a transition for each byte class; a missing one emits a phrase and goes on
from the initial state, so a parse is a walk through one table.

The sample: `sample_chars` characters a language (less where there are many: `total_chars` in all), as pieces
of at most PIECE characters from documents picked by a hash of their id, each at a hashed place. Rows with a
null language or id are not learned from. Null texts and texts without a letter get `und` and score 0, as
does every text when nothing could be learned. Repeated rows get equal answers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm import tokens as K
from flowlens.llm.work import unit, written
from flowlens.shipping import ship

ship(__name__)

UNKNOWN = "und"
BLOCK = 256
PIECE = 400
OVERSAMPLE = 8
RESULT = "lang_pred: string, score: double, phrases: bigint, entropy: double"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass(frozen=True)
class Sample:
    sample_chars: int = 16_000
    total_chars: int = 256_000


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters with one space for every run of other ASCII characters, and the new offsets."""
    out = np.where(_LETTER[data], K.LOWER[data], np.uint8(32))
    if len(data) > 1:  # capitals of the Latin-1 supplement: C3 80-9E but 97
        tail = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][tail] += 32
    gap = out == 32
    keep = np.ones(len(out), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    kept = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], kept[offsets]


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of a sequence of byte classes; state 0 is initial."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


def parse_table(text: np.ndarray, classes: int) -> np.ndarray:
    """table[state * classes + c] = 2 * classes * next + (1 where a phrase starts with c).

    A phrase counts where it starts: at every step from the initial state and at every missing transition.
    """
    moves = automaton(text)
    table = np.zeros((len(moves), classes), np.int32)
    start = np.zeros(classes, np.int64)
    for c, state in moves[0].items():
        start[c] = state
    table[:] = 2 * classes * start + 1
    for state, row in enumerate(moves):
        for c, to in row.items():
            table[state, c] = 2 * classes * to
    table[0] |= 1
    return table.ravel()


class Model:
    """Byte classes and parse tables; built once in each Python worker from the sample texts."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        texts = []
        for name in self.names:
            raw = np.frombuffer(samples[name].encode(), np.uint8)
            texts.append(normalise(raw, np.array([0, len(raw)]))[0])
        used = np.flatnonzero(np.bincount(np.concatenate([*texts, [32]]), minlength=256))
        self.classes = len(used) + 1  # one for bytes that no sample has
        self.of_byte = np.full(256, len(used), np.int32)
        self.of_byte[used] = np.arange(len(used))
        self.tables = [parse_table(self.of_byte[t], self.classes) for t in texts]
        self.cost = np.log2(np.array([max(2, len(t)) for t in texts], float))

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each document in each language."""
        blocks = -(-np.diff(offsets) // BLOCK)
        bounds = np.concatenate(([0], np.cumsum(blocks)))
        doc = np.repeat(np.arange(len(blocks)), blocks)
        begin = offsets[doc] + (np.arange(bounds[-1]) - bounds[doc]) * BLOCK
        length = np.minimum(offsets[doc + 1] - begin, BLOCK)
        out = np.zeros((len(blocks), len(self.names)), np.int64)
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        coded = self.of_byte[data]
        live = len(length) - np.searchsorted(length[::-1], np.arange(BLOCK), "right")
        columns = [coded[begin[: live[t]] + t] for t in range(BLOCK) if live[t]]
        for k, table in enumerate(self.tables):
            state = np.zeros(len(begin), np.int32)
            count = np.zeros(len(begin), np.int32)
            for column in columns:
                n = len(column)
                got = table[state[:n] + column]
                count[:n] += got & 1
                state[:n] = got >> 1
            out[:, k] = np.bincount(doc[order], weights=count, minlength=len(blocks)).astype(np.int64)
        return out


def has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def judge(model: Model | None, texts: pa.Array) -> pa.Array:
    data, offsets = K.utf8(texts)
    names, scores, counts, rates = [], [], [], []
    for a, b in K.chunks(offsets):
        chunk, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        ascii_letters = K.sums(_LETTER[chunk] & (chunk < 128), bounds)
        plain, inner = normalise(chunk, bounds)
        size = np.diff(inner)
        found = model.phrases(plain, inner) if model else np.zeros((b - a, 0), np.int64)
        for i in range(b - a):
            wordy = ascii_letters[i] or has_letter(chunk[bounds[i] : bounds[i + 1]].tobytes())
            if not wordy or not model:
                names.append(UNKNOWN)
                scores.append(0.0)
                counts.append(0)
                rates.append(0.0)
                continue
            rate = np.maximum(found[i] * model.cost / size[i], 1e-9)
            best = int(np.argmin(rate))
            names.append(model.names[best])
            scores.append(float((1 / rate[best]) / (1 / rate).sum()))
            counts.append(int(found[i, best]))
            rates.append(float(rate[best]))
    arrays = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(counts, pa.int64())]
    return pa.StructArray.from_arrays(
        [*arrays, pa.array(rates, pa.float64())], ["lang_pred", "score", "phrases", "entropy"]
    )


def gather_samples(rows: DataFrame, sample: Sample = Sample()) -> dict[str, str]:
    """Language -> sample text from (doc_id, text, lang) rows; at most `total_chars` characters reach the driver.

    Counts cover all rows; the rate at which rows are picked follows from them, so about OVERSAMPLE times the
    pieces needed are looked at, however many rows there are.
    """
    usable = rows.where("lang IS NOT NULL AND doc_id IS NOT NULL")
    # written, so that Spark knows its size and no text is shuffled by language
    counts = written(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "language-rows")
    languages = counts.count()
    if not languages:
        return {}
    pieces = max(1, min(sample.sample_chars, sample.total_chars // languages) // PIECE)
    seen = usable.join(counts, "lang").withColumn("at", F.xxhash64("doc_id", F.lit("sample")))
    picked = seen.where(unit(F.col("at")) * F.col("rows") < OVERSAMPLE * pieces).where("text RLIKE '\\\\p{L}'")
    start = f"1 + CAST(pmod(at, greatest(length(text) - {PIECE}, 0) + 1) AS INT)"
    distinct = picked.select("lang", F.expr(f"substr(text, {start}, {PIECE})").alias("piece"), "at").groupBy("lang", "piece").agg(F.min("at").alias("at"))
    ranked = distinct.withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang ORDER BY at, piece)"))
    out: dict[str, list[str]] = {}
    for row in ranked.where(F.col("rank") <= pieces).orderBy("lang", "rank").collect():
        out.setdefault(row["lang"], []).append(row["piece"])
    return {lang: " ".join(found) for lang, found in out.items()}


def language(text: Column, samples: dict[str, str], spark) -> Column:
    """lang_pred, score, phrases and entropy of each text."""
    shared = spark.sparkContext.broadcast({"samples": samples})  # bounded by Sample.total_chars

    def predict(texts: pa.Array) -> pa.Array:
        held = shared.value
        if "model" not in held:
            held["model"] = Model(held["samples"]) if held["samples"] else None
        return judge(held["model"], texts)

    return F.arrow_udf(predict, RESULT)(text)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict_documents(docs: DataFrame, sample: Sample = Sample()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, phrases and entropy of every document."""
    learned = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    samples = gather_samples(learned, sample)
    got = language(F.col("text"), samples, docs.sparkSession).alias("got")
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), got)
    return out.select("doc_id", "held_out", "got.*")
