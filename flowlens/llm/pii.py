"""Personal data by a semi-Markov conditional random field.

Base spans (email, ip, card, phone) are matched by given patterns, each kind by itself. The field adds spans
that these patterns miss: around every place with digits or a mail sign the text is cut into tokens, and a
segmentation into whole spans of up to MAX_TOKENS tokens and single other tokens is chosen jointly with the
spans' kinds. Each candidate span is scored as a whole: digit groups, separators, checksum, octets, shape, what
stands beside it and which cue words stand before it. Weights maximise the conditional likelihood (forward and
backward sums over all segmentations), trained on a bounded sample of documents in which base spans are the
labels, and on a few labelled phrases for the forms that base patterns miss. Decoding is the best segmentation;
added spans that touch a base span are left out, so base spans stay as they are.

Whole texts are searched. Spans are in code points, end exclusive. Null texts count as empty; repeated rows get
equal answers; with no document to learn from, the phrases alone are learned.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm import tokens as K
from flowlens.llm.work import unit
from flowlens.shipping import ship

ship(__name__)

# The kinds in the order in which they are listed and their given patterns. Possessive quantifiers
# and look-behinds only keep long runs from being tried again and again; the matches are the same.
KINDS = ("email", "ip", "card", "phone")
MAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Labelled phrases, spans in brackets: {kind:text}.
PHRASES = (
    "call {phone:(555) 123-4567} today",
    "phone: {phone:555-867-5309} or fax",
    "tel. {phone:(743) 555-3824} from nine to five",
    "reach me at {phone:212-555-0147}.",
    "mobile {phone:+44 20 7946 0958} please",
    "write to {email:jane.doe [at] example.com} soon",
    "mail {email:info(at)example.org} for more",
    "contact {email:a.smith@example.net} now",
    "card number {card:4111 1111 1111 1111} expires soon",
    "visa {card:5500-0000-0000-0004} was charged",
    "host {ip:192.168.1.10} is down",
    "from ip {ip:10.0.0.1} at noon",
    "on 2024-01-31 at 10:30 there were 1234567 rows",
    "version 1.2.3 of 12 and 2.0.1 came out",
    "version 10.2.33.4567 of the tool and 4.18.300.1022 before",
    "address 256.1.1.1 and 1.2.3.999 are none",
    "host {ip:172.16.0.9} and {ip:8.8.4.4} answer",
    "card number 4111 1111 1111 1112 is wrong",
    "the order 20240131-4471 of 1000000 parts",
    "between 1990-1999 and 2000-2009 it rose by 12.5",
    "isbn 978-3-16-148410-0 has 320 pages",
    "pi is 3.14159265358979 and e is 2.71828182845905",
    "serial 00012345678901234567890 was found",
    "values 12 34 56 78 90 11 22 in a row",
)

TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\W\d_]+|.", re.DOTALL)
ANCHOR = re.compile(r"[0-9][0-9 ().\-]{4,}[0-9]|@|[\[(]at[\])]")
CUES = re.compile(r"\b(phone|tel|call|mobile|fax|reach|mail|email|write|contact|card|visa|ip|host|isbn|order|version|serial)\b")
MAX_TOKENS = 24
SIDE = 24  # characters beside an anchor that belong to its region
RESULT = "n_email: bigint, n_ip: bigint, n_card: bigint, n_phone: bigint, base: string, spans: string, n_added: bigint"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From each mail sign to the left as far as its class goes, to the right by the pattern."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        tail = MAIL_TAIL.match(text, at)
        if tail:
            start = at
            while start > free and text[start - 1] in _HEAD:
                start -= 1
            if start < at:
                out.append((start, tail.end()))
                free = tail.end()
                at = text.find("@", free)
                continue
        at = text.find("@", at + 1)
    return out


_HEAD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base spans, by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 40:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def regions(text: str) -> list[tuple[int, int]]:
    """Places around anchors, merged where they meet, cut at blanks where there are any near."""
    out: list[list[int]] = []
    for m in ANCHOR.finditer(text):
        start, stop = max(0, m.start() - SIDE), min(len(text), m.end() + SIDE)
        if out and start <= out[-1][1]:
            out[-1][1] = stop
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


@dataclass
class Region:
    """Tokens of a region and its candidate spans: (first token, token after) -> features."""

    starts: list[int]
    stops: list[int]
    kinds: list[str]  # class of each token
    spans: list[tuple[int, int, list[str]]]


def _features(text: str, start: int, stop: int, left: str) -> list[str] | None:
    """Whole-span features, or None where a span can be no personal data at all."""
    span = text[start:stop]
    digits = sum(c.isdigit() and c.isascii() for c in span)
    letters = sum(c.isalpha() for c in span)
    mail = "@" in span or "[at]" in span or "(at)" in span
    if not (mail and letters >= 3) and not (digits >= 7 and letters == 0):
        return None
    before = text[start - 1] if start else " "
    after = text[stop] if stop < len(text) else " "
    beside = lambda c: "digit" if c.isdigit() else "letter" if c.isalpha() else "blank" if c.isspace() else c
    out = ["bias", f"left={beside(before)}", f"right={beside(after)}"]
    cue = CUES.findall(left)
    out.append(f"cue={cue[-1] if cue else ''}")
    if mail:
        whole = re.fullmatch(r"[A-Za-z0-9._%+-]+ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", span)
        out += [f"mail={bool(whole)}", "blank" if " " in span else "solid", f"tail={span[-1].isalpha()}"]
        if whole:
            out += [f"wordleft={before.isalnum() or before in '._%+-'}", f"wordright={after.isalnum() or after in '-'}"]
        return out
    groups = re.findall(r"[0-9]+", span)
    marks = "".join(sorted(set(re.sub(r"[0-9]", "", span))))
    out += [
        f"digits={digits}",
        f"groups={'-'.join(str(min(len(g), 9)) for g in groups[:7])}",
        f"marks={marks}",
        f"plus={span[0] == '+'}",
        f"paren={span.count('(')}{span.count(')')}{span[0] == '('}",
        f"pure={re.sub(r'[0-9]', '', span)[:8]}",
    ]
    if len(groups) == 4 and marks == ".":
        out.append(f"octets={all(int(g[:9]) <= 255 for g in groups)}")
    if 12 <= digits <= 19 and not set(marks) - {" ", "-"}:
        out.append(f"luhn={luhn(''.join(groups))}")
    return out


def analyse(text: str, a: int, b: int) -> Region:
    found = list(TOKEN.finditer(text, a, b))
    region = Region([m.start() for m in found], [m.end() for m in found], [], [])
    heads, tails = [], []
    for m in found:
        c = m.group()[0]
        ascii_word = c.isascii() and c.isalnum()
        region.kinds.append("digit" if ascii_word and c.isdigit() else "letter" if c.isalpha() else "blank" if c.isspace() else c)
        heads.append(ascii_word or c in "+(")
        tails.append(ascii_word or c == ")")
    for i, head in enumerate(heads):
        wordy = any(c in "@[(" for c in region.kinds[i : i + 8])
        if not head or (region.kinds[i] == "letter" and not wordy):
            continue
        start = region.starts[i]
        left = text[max(0, start - SIDE) : start].lower()
        for j in range(i, min(len(found), i + MAX_TOKENS)):
            kind = region.kinds[j]
            if kind == "letter" and not wordy or kind == "blank" and text[region.starts[j]] != " ":
                break
            if tails[j]:
                features = _features(text, start, region.stops[j], left)
                if features:
                    region.spans.append((i, j + 1, features))
    return region


class Field:
    """Weights: feature -> one weight a kind; other tokens have a weight per class."""

    def __init__(self, weights: dict[str, list[float]] | None = None, other: dict[str, float] | None = None):
        self.weights, self.other = weights or {}, other or {}

    def scores(self, features: list[str]) -> list[float]:
        total = [0.0] * len(KINDS)
        for f in features:
            for k, w in enumerate(self.weights.get(f, ())):
                total[k] += w
        return total

    def decode(self, region: Region) -> list[tuple[int, int, int]]:
        """The best segmentation's spans, as (first token, kind, token after)."""
        n = len(region.kinds)
        best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
        at: dict[int, list] = {}
        for i, j, features in region.spans:
            scores = self.scores(features)
            k = max(range(len(KINDS)), key=scores.__getitem__)
            at.setdefault(i, []).append((j, k, scores[k]))
        for i in range(n):
            plain = best[i] + self.other.get(region.kinds[i], 0.0)
            if plain > best[i + 1]:
                best[i + 1], back[i + 1] = plain, (i, None)
            for j, k, score in at.get(i, ()):
                if best[i] + score > best[j]:
                    best[j], back[j] = best[i] + score, (i, k)
        out, j = [], n
        while j:
            i, k = back[j]
            if k is not None:
                out.append((i, k, j))
            j = i
        return out[::-1]

    def learn(self, samples: list[tuple[Region, dict[tuple[int, int], int]]], rounds: int = 12) -> Field:
        """Gradient ascent on the conditional log-likelihood; samples carry their true spans."""
        for t in range(rounds):
            rate = 0.5 / (1 + t / 3)
            for region, truth in samples:
                self._step(region, truth, rate)
        return self

    def _step(self, region: Region, truth: dict[tuple[int, int], int], rate: float) -> None:
        n = len(region.kinds)
        scored = [(i, j, f, self.scores(f)) for i, j, f in region.spans]
        arrive: list[list] = [[] for _ in range(n + 1)]
        leave: list[list] = [[] for _ in range(n + 1)]
        for i, j, _, scores in scored:
            total = _logsum(scores)
            arrive[j].append((i, total))
            leave[i].append((j, total))
        plain = [self.other.get(c, 0.0) for c in region.kinds]
        ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            ahead[j] = _logsum([ahead[j - 1] + plain[j - 1]] + [ahead[i] + s for i, s in arrive[j]])
        for i in range(n - 1, -1, -1):
            behind[i] = _logsum([behind[i + 1] + plain[i]] + [behind[j] + s for j, s in leave[i]])
        whole = ahead[n]
        for i, j, features, scores in scored:
            for k, score in enumerate(scores):
                share = math.exp(min(0.0, ahead[i] + score + behind[j] - whole))
                change = rate * ((truth.get((i, j)) == k) - share)
                if abs(change) > 1e-6:
                    for f in features:
                        self.weights.setdefault(f, [0.0] * len(KINDS))[k] += change
        covered = {t for i, j in truth for t in range(i, j)}
        for i, c in enumerate(region.kinds):
            share = math.exp(min(0.0, ahead[i] + plain[i] + behind[i + 1] - whole))
            self.other[c] = self.other.get(c, 0.0) + 0.1 * rate * ((i not in covered) - share)


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def labelled(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[Region, dict[tuple[int, int], int]]]:
    """Regions of a text with the spans that fall on their candidates; of spans that overlap, the first counts."""
    out = []
    for a, b in regions(text):
        region = analyse(text, a, b)
        first = {s: i for i, s in enumerate(region.starts)}
        last = {s: i + 1 for i, s in enumerate(region.stops)}
        known = {(i, j) for i, j, _ in region.spans}
        truth, free = {}, 0
        for start, kind, stop in spans:
            key = (first.get(start), last.get(stop))
            if key in known and start >= free:
                truth[key], free = kind, stop
        out.append((region, truth))
    return out


def phrase_samples() -> list[tuple[Region, dict[tuple[int, int], int]]]:
    out = []
    for phrase in PHRASES:
        plain, spans, at = "", [], 0
        for m in re.finditer(r"\{(\w+):([^}]*)\}", phrase):
            plain += phrase[at : m.start()]
            spans.append((len(plain), KINDS.index(m.group(1)), len(plain) + len(m.group(2))))
            plain += m.group(2)
            at = m.end()
        out += labelled(plain + phrase[at:], spans)
    return out


@dataclass(frozen=True)
class Training:
    documents: int = 300  # at most so many documents with an anchor are learned from
    piece: int = 1500  # characters of each


def train(docs: DataFrame, training: Training = Training()) -> Field:
    """The field learned from a bounded sample: documents are picked by a hash of id and text."""
    usable = docs.where(r"text RLIKE '[0-9][0-9 ().\\-]{4,}[0-9]|@'").select("text", F.xxhash64("doc_id", "text").alias("at"))
    total = usable.count()
    picked = usable.where(unit(F.col("at")) * total < 2 * training.documents) if total else usable
    start = F.greatest(F.expr(r"regexp_instr(text, '[0-9][0-9 ().\\-]{4,}[0-9]|@')") - 100, F.lit(1))
    pieces = picked.select(F.substring(F.col("text"), start, F.lit(training.piece)).alias("piece"), "at")
    rows = pieces.orderBy("at", "piece").limit(training.documents).collect()
    samples = phrase_samples() * 3
    for row in rows:
        samples += labelled(row["piece"], base_spans(row["piece"]))
    return Field().learn(samples)


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    out = []
    for a, b in regions(text):
        region = analyse(text, a, b)
        if not region.spans:
            continue
        for i, kind, j in field.decode(region):
            start, stop = region.starts[i], region.stops[j - 1]
            if all(stop <= s or start >= e for s, _, e in base if s < b and e > a):
                out.append((start, kind, stop))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def personal_data(text: Column, field: Field) -> Column:
    """RESULT for each text."""
    weights, other = field.weights, field.other

    def search(texts: pa.Array) -> pa.Array:
        model = Field(weights, other)
        data, offsets = K.utf8(texts)
        sign = np.zeros(256, bool)
        sign[[*range(48, 58), 64]] = True
        rows = []
        for a, b in K.chunks(offsets):
            chunk = data[offsets[a] : offsets[b]]
            hits = K.sums(sign[chunk], offsets[a : b + 1] - offsets[a])
            for i in range(a, b):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                if not hits[i - a] and b"at]" not in raw and b"at)" not in raw:
                    rows.append((0, 0, 0, 0, "", "", 0))
                    continue
                value = raw.decode()
                base = base_spans(value)
                more = added_spans(value, base, model)
                counts = [sum(k == n for _, k, _ in base) for n in range(len(KINDS))]
                rows.append((*counts, _joined(base), _joined(sorted(base + more)), len(more)))
        columns = list(zip(*rows)) if rows else [[]] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        names = [*(f"n_{k}" for k in KINDS), "base", "spans", "n_added"]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return F.arrow_udf(search, RESULT)(text)


def personal_table(docs: DataFrame, training: Training = Training()) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans and n_added of every document."""
    field = train(docs, training)
    found = docs.select("doc_id", personal_data(F.col("text"), field).alias("found"))
    base = F.sha2(F.col("found.base").cast("binary"), 256).alias("base_sha256")
    counts = [F.col(f"found.n_{k}").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, base, F.col("found.spans").alias("spans"), F.col("found.n_added").alias("n_added"))
