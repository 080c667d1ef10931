"""Benchmark decontamination by template canonicalisation; DataFrame functions only.

Numbers, units after a number and names become typed placeholders; the rest is lower-cased and cut into tokens.
Each text has three templates, with its white space collapsed: names are the capitalised words inside a sentence,
all capitalised words, or none (the lower-cased text). Templates of one kind are compared; an item leaks when any
of its templates does. With all capitalised words as names it must keep half of its plain windows as evidence, so
that titles and capitals do not match by a window or two. A benchmark item is compared by its windows of `window`
template tokens. A document leaks an item when `percent` or more of the item's distinct windows are found in it with
consistent slots: along one alignment of document and item, a value of the item always stands for one value of
the document. So copies are found as well as questions with other numbers, names and units.

1. Each text is searched for numbers and units once, for names twice, and cut into tokens once per template. Hashes
   of all its windows meet those of the benchmark, and the windows that meet are written with their places. Their
   counts give all (document, item) pairs that reach the share before slots are looked at. The benchmark's windows
   are a written table: Spark knows its size and broadcasts or shuffles.
2. Only for these pairs, and only where their windows have slots, texts are read again: slots get their values,
   windows with a slot in conflict are dropped, and the share is taken once more.

Windows with fewer than two literal tokens are no evidence. An item with fewer tokens than a window is one window of
its own length. One of three or more words without a slot is found anywhere in a document ("Who wrote Hamlet?"); with
slots ("Is 7 prime?"), or of two words, which prove nothing inside a text, only in a document that is no longer. Items
without a window of two literals, null and empty texts never match. Documents are told apart by 128 bits of their id and text; repeated documents get equal answers;
repeated item ids are items of their own text; an empty table on either side gives an empty result. Ties between
templates of an item that leak alike go to the plainer in the order above. Extra columns of documents are kept as
they are, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.work import row_key, written

# The placeholders (private-use characters) and the units they recognise.
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
MARKS = f"{NUMBER}{NAME}{UNIT}"
UNITS = (
    "%|percent|mm|cm|m|km|in|inch|inches|ft|feet|foot|yards?|miles?|mg|g|kg|tons?|oz|lbs?|pounds?|ml|l|liters?|"
    "litres?|gallons?|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|mph|kmh|dollars?|cents?|"
    "euros?|usd|eur|°c|°f|degrees?|watts?|kw|volts?|hz|mb|gb"
)
# runs that are not one plain blank already, which most are; one class is tried at a place, so others are passed quickly
BLANK = rf"[ \t\n\x0B\f\r\u00a0{NUMBER}-{UNIT}]"
BLANKS = rf"{BLANK}(?:{BLANK}++|(?<! ))"
APART = rf"[^\p{{L}}\p{{M}}{NUMBER}-{UNIT}]"
BETWEEN = rf"{APART}(?:{APART}++|(?<! ))"
NUMBERS = r"\p{Nd}++(?:[.,:]\p{Nd}++)*+"
MEASURES = rf"{NUMBERS} ?((?i:{UNITS}))(?![\p{{L}}\p{{Nd}}])"
# capitalised words inside a sentence, and anywhere; numbers have become placeholders between blanks
INSIDE = rf"(?=\p{{Lu}})(?<=[\p{{Ll}},;] |[{MARKS}] {{1,2}})\p{{Lu}}[\p{{L}}\p{{M}}'-]*+"
ANYWHERE = r"(?=\p{Lu})(?<![\p{L}\p{M}'-])\p{Lu}[\p{L}\p{M}'-]*+"
SENTENCE, CAPITALS, PLAIN = 0, 1, 2


@dataclass(frozen=True)
class Leak:
    window: int = 5
    percent: int = 80


def collapsed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def measured(text: Column) -> Column:
    """A collapsed text with its numbers and units as placeholders."""
    return F.regexp_replace(F.regexp_replace(text, MEASURES, f" {NUMBER} {UNIT} "), NUMBERS, f" {NUMBER} ")


def template_tokens(text: Column) -> Column:
    """The tokens of a text whose placeholders are set: lower-case words and placeholders."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), BETWEEN, " ")), " ")


def templated(rows: DataFrame, key: str, *also: str) -> DataFrame:
    """(key, kind, tokens, *also) of the three templates of each of rows (key, text)."""
    base = rows.select(key, collapsed(F.col("text")).alias("text"))
    base = base.select(key, "text", measured(F.col("text")).alias("marked"))
    named = [F.regexp_replace("marked", pattern, NAME) for pattern in (INSIDE, ANYWHERE)]
    kinds = F.array(*(template_tokens(text) for text in (*named, F.col("marked"))))
    return base.select(key, *also, F.posexplode(kinds).alias("kind", "tokens"))


def windows_of(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(key, kind, at, t1 ... t`size`) for each token of rows (key, kind, tokens) and those after it, then nulls."""
    later = [F.slice("tokens", n, F.size("tokens")) for n in range(2, size + 1)]
    both = rows.select(key, "kind", F.posexplode(F.arrays_zip("tokens", *later)).alias("at", "w"))
    names = both.schema["w"].dataType.fieldNames()
    return both.select(key, "kind", "at", *(F.col("w")[name].alias(f"t{n}") for n, name in enumerate(names, 1)))


def window_key(length: int) -> Column:
    """A hash of the first `length` tokens of a window; missing ones count as none."""
    return F.xxhash64("kind", *(f"t{n}" for n in range(1, length + 1)))


def whole(size: int) -> Column:
    """Windows with all their tokens, and the one of a text that has fewer."""
    return F.col(f"t{size}").isNotNull() | (F.col("at") == 0)


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """(item, kind, at, key, slots, length, head) of benchmark windows that are evidence; items has item and text."""
    tokens = [F.col(f"t{n}") for n in range(1, size + 1)]
    marked = [F.coalesce((F.length(t) > 0) & F.lit(MARKS).contains(t), F.lit(False)).cast("int") for t in tokens]
    slots = reduce(lambda a, b: a + b, marked)
    length = reduce(lambda a, b: a + b, [(t.isNotNull() & (t != "")).cast("int") for t in tokens])
    placed = windows_of(templated(items, "item"), "item", size).where(whole(size))
    placed = placed.select(
        "item", "kind", "at", window_key(size).alias("key"), slots.alias("slots"), length.alias("length"),
        window_key(2).alias("head"),
    )
    return placed.where("length - slots >= 2")


def document_windows(rows: DataFrame, short: DataFrame, size: int) -> DataFrame:
    """(row, kind, doc_at, key) of all windows of rows (row, text).

    short has the first two tokens (head) of items shorter than a window, and a flag for each of their lengths; only
    where a document has such a beginning it forms windows of these lengths.
    """
    placed = windows_of(templated(rows, "row"), "row", size)
    placed = placed.withColumn("head", F.when(F.col("kind") == PLAIN, window_key(2)))
    placed = placed.join(short, "head", "left")
    shorter = [F.when(F.col(f"has{n}") & F.col(f"t{n}").isNotNull(), window_key(n)) for n in range(3, size)]
    keys = F.array(F.when(whole(size), window_key(size)), *shorter)
    placed = placed.select("row", "kind", F.col("at").alias("doc_at"), F.explode(keys).alias("key"))
    return placed.where("key IS NOT NULL")


def _slots(mark: str, values: Column) -> Column:
    """The places of a placeholder in the column tokens with the values found, in order."""
    places = F.array_compact(F.transform("tokens", lambda t, i: F.when(t == mark, i)))
    pairs = F.arrays_zip(places.alias("at"), values.alias("value"))
    slot = lambda s: F.struct(s["at"].alias("at"), F.lit(mark).alias("mark"), s["value"].alias("value"))
    return F.transform(pairs, slot)


def slots_of(rows: DataFrame, key: str) -> DataFrame:
    """(key, kind, at, mark, value) of each slot of the templates of rows (key, text)."""
    tokens = templated(rows, key, "text", "marked")
    names = [F.regexp_extract_all("marked", F.lit(pattern), F.lit(0)) for pattern in (INSIDE, ANYWHERE)]
    values = {
        NUMBER: F.regexp_extract_all("text", F.lit(NUMBERS), F.lit(0)),
        NAME: F.when(F.col("kind") == SENTENCE, names[0]).when(F.col("kind") == CAPITALS, names[1]).otherwise(F.array()),
        UNIT: F.transform(F.regexp_extract_all("text", F.lit(MEASURES), F.lit(1)), F.lower),
    }
    slots = [_slots(mark, found) for mark, found in values.items()]
    return tokens.select(key, "kind", F.inline(F.concat(*slots)))


def _share(found: DataFrame, totals: DataFrame, percent: int) -> DataFrame:
    counts = found.groupBy("row", "kind", "item").agg(F.count_distinct("key").alias("n_windows"))
    return counts.join(totals, ["item", "kind"]).where(F.col("n_windows") * 100 >= percent * F.col("item_windows"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, leak: Leak = Leak()) -> DataFrame:
    """(row, item_id, n_windows, item_windows) of leaked items; row is `row_key` of the document."""
    size = leak.window
    items = benchmark.select("item_id", "text", F.xxhash64("item_id", "text").alias("item")).dropDuplicates(["item"])
    items = written(items, "leak-items")
    windows = written(item_windows(items, size), "leak-windows")
    totals = windows.groupBy("item", "kind").agg(F.count_distinct("key").alias("item_windows"))
    plain = totals.where(F.col("kind") == PLAIN).select("item", F.col("item_windows").alias("plain"))
    totals = totals.join(plain, "item", "left").where((F.col("kind") != CAPITALS) | F.expr("2 * item_windows >= coalesce(plain, 0)"))
    totals = written(totals.drop("plain"), "leak-totals")
    flags = [F.max(F.col("length") == n).alias(f"has{n}") for n in range(3, size)]
    short = windows.where((F.col("kind") == PLAIN) & F.col("length").between(3, size - 1) & (F.col("slots") == 0))
    short = written(short.groupBy("head").agg(*flags), "leak-short")
    sought = written(windows.select("key", "item").distinct(), "leak-keys")

    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "text")
    met = written(document_windows(keyed, short, size).join(sought, "key"), "leak-met")
    likely = written(_share(met, totals, leak.percent).select("row", "kind", "item"), "leak-likely")
    pair = ["row", "kind", "item"]
    met = met.join(likely, pair).join(windows.select("item", "kind", "key", "slots", F.col("at").alias("item_at")), ["item", "kind", "key"])
    met = written(met.withColumn("line", F.col("doc_at") - F.col("item_at")), "leak-lines")

    slotted = met.where("slots > 0")
    picked = written(slotted.select("row").distinct(), "leak-rows")
    texts = keyed.join(picked, "row").dropDuplicates(["row"])
    theirs = slots_of(texts, "row").withColumnsRenamed({"at": "d", "value": "doc_value"})
    ours = slots_of(items.select("item", "text"), "item").withColumnsRenamed({"at": "i", "value": "item_value"})
    ours = written(ours, "leak-item-slots")
    spread = slotted.select(*pair, "line", "doc_at", "item_at", F.expr(f"explode(sequence(0, {size - 1}))").alias("step"))
    spread = spread.withColumns({"d": F.col("doc_at") + F.col("step"), "i": F.col("item_at") + F.col("step")})
    filled = spread.join(ours, ["item", "kind", "i"]).join(theirs, ["row", "kind", "d", "mark"])
    filled = written(filled.select(*pair, "line", "doc_at", "mark", "item_value", "doc_value"), "leak-slots")
    alike = [*pair, "line", "mark", "item_value"]
    torn = filled.groupBy(*alike).agg(F.count_distinct("doc_value").alias("values")).where("values > 1")
    wrong = filled.join(torn, alike, "left_semi").select(*pair, "line", "doc_at").distinct()
    sound = met.join(wrong, [*pair, "line", "doc_at"], "left_anti")
    leaks = _share(sound, totals, leak.percent)
    order = F.struct((F.col("n_windows") / F.col("item_windows")).alias("share"), (-F.col("kind")).alias("kind"), "n_windows", "item_windows")
    best = leaks.groupBy("row", "item").agg(F.max(order).alias("best"))
    return best.join(items.select("item", "item_id"), "item").select("row", "item_id", "best.n_windows", "best.item_windows")


def leak_table(docs: DataFrame, benchmark: DataFrame, leak: Leak = Leak()) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows and share of every leaked item of every document."""
    leaks = written(find_leaks(docs, benchmark, leak), "leaks")
    rows = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row"))
    share = (F.col("n_windows") / F.col("item_windows")).alias("share")
    return rows.join(leaks, "row").select("doc_id", "item_id", "n_windows", "item_windows", share)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, leak: Leak = Leak()) -> DataFrame:
    """The documents that leak no item; same columns."""
    bad = written(find_leaks(docs, benchmark, leak).select("row").distinct(), "leaking")
    same = row_key(F.col("d.doc_id"), F.col("d.text")) == F.col("b.row")
    return docs.alias("d").join(bad.alias("b"), same, "left_anti")
