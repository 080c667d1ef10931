"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = (
    "The river runs past the old mill, and the miller counts his sacks. Every spring the water rises, so the "
    "lower fields turn to mud. Nobody minds, because the soil is richer for it. In summer the children swim "
    "near the wheel, while their parents mend the fences and talk about the price of grain in town."
)
EXTRA = "kept: boolean, shard: string, slot: int, size: string, row: int, node: int, key: string, copies: int"
SCHEMA = f"doc_id: bigint, text: string, lang: string, source: string, n_chars: bigint, {EXTRA}"


def rows():
    near = PROSE.replace("children", "kids")
    texts = [
        (1, PROSE, "en", "a"),
        (2, PROSE, "en", "a"),
        (2, PROSE, "en", "a"),
        (3, near, "en", "b"),
        (4, None, "en", "a"),
        (5, "", "de", None),
        (6, " \t\n\r\x0b\x0c ", None, "b"),
        (7, "one", "en", "b"),
        (8, "one two", "en", "c"),
        (9, "a b c " * 30, "en", "c"),
        (10, (PROSE + "\n") * 60, "en", "c"),
        (11, "x" * 30_000, "en", None),
        (12, "| a | b | c |\n" + PROSE, "en", "a"),
        (13, "Größe  \U0001f600 naïve é 12.\n\n", "de", "é"),
        (14, "9" * 30_000, None, "a"),
        (None, PROSE + " And more.", "en", "a"),
        (None, None, None, None),
        (None, None, None, None),
    ]
    return [(i, t, lang, s, len(t or ""), True, "x", 1, "s", 2, 3, "k", 4) for i, t, lang, s in texts]


def edge_documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORDS.findall(text or "")
