import re

from edge import edge_documents, no_documents
from flowlens.llm.decontam import drop_leaks, leak_table

ITEMS = [
    (1, "On Monday the farmer Alice sold 12 apples and 30 kg of pears to Bob, so how much did Alice earn in 12 hours?"),
    (2, "a b"),
    (3, None),
    (4, "7 + 5"),
    (5, "What is the name of the long river that flows past the old mill in the song?"),
    (5, "What is the name of the long river that flows past the old mill in the song?"),
]
CAROL = "On Monday the farmer Carol sold 15 apples and 41 lb of pears to Dave, so how much did Carol earn in 15 hours?"
TORN = "On Monday the farmer Carol sold 15 apples and 41 lb of pears to Dave, so how much did Erin earn in 19 hours?"


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id: bigint, text: string")


def texts():
    return [
        (1, f"Some words first. {CAROL} More follows here."),
        (1, f"Some words first. {CAROL} More follows here."),
        (2, f"Some words first. {TORN} More follows here."),
        (3, f"Some words first. {ITEMS[0][1]} More follows here."),
        (4, "Before it, " + ITEMS[4][1].replace("song", "poem") + " After it."),
        (5, "On Monday the farmer went to town and sold nothing at all."),
        (6, "A,  b."),
        (7, "we know a b and c"),
        (8, "9 + 3"),
        (9, None),
        (10, ""),
        (None, CAROL),
    ]


def test_copies_and_new_parameters_are_found(spark):
    docs = spark.createDataFrame(texts(), "doc_id: bigint, text: string")
    got = sorted((r.doc_id or 0, r.item_id) for r in leak_table(docs, bench(spark)).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (3, 1), (4, 5), (6, 2)]
    kept = {r.doc_id for r in drop_leaks(docs, bench(spark)).collect()}
    assert kept == {2, 5, 7, 8, 9, 10}


def test_join_without_broadcast_gives_the_same(spark):
    docs = spark.createDataFrame(texts(), "doc_id: bigint, text: string")
    key = lambda r: (r.doc_id or 0, r.item_id, r.n_windows)
    one = sorted(map(key, leak_table(docs, bench(spark)).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        two = sorted(map(key, leak_table(docs, bench(spark)).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert one == two


def test_names_anywhere_and_other_case(spark):
    items = [
        (1, "Tom has 3 apples. Tom buys 4 more. How many apples does Tom have now?"),
        (2, "Every week Mr. Smith drives 40 km to the market, where Smith sells 12 baskets of fresh plums."),
        ITEMS[0],
    ]
    items[2] = (3, items[2][1])
    docs = [
        (1, "It said: " + items[0][1].replace("Tom", "Anna").replace("3", "5") + " She thought."),
        (2, "We read that " + items[1][1].replace("Smith", "Jones").replace("Every", "every") + " So it goes."),
        (3, "so " + items[2][1].lower()),
        (4, "SO " + items[2][1].upper()),
        (5, "So " + items[2][1].replace(" Alice", "\nAlice").replace(" Bob", "\n  Bob")),
        (6, "Anna has 5 apples. Anna buys 4 more. How many apples does Berta have now?"),
        (7, "Nobody has any apples. Somebody buys more plums from the market."),
    ]
    frame = spark.createDataFrame(docs, "doc_id: bigint, text: string")
    got = sorted((r.doc_id, r.item_id) for r in leak_table(frame, bench(spark, items)).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 3), (5, 3)]


def test_short_items_inside_documents(spark):
    items = [(1, "Who wrote Hamlet?"), (2, "Is 7 prime?"), (3, "Name two cold seas"), (4, "Hamlet")]
    docs = [
        (1, "Then the teacher asked: who wrote Hamlet? Nobody knew."),
        (2, "Is 9 prime?"),
        (3, "She said that nobody asked whether it is 9 prime numbers or ten."),
        (4, "First name two cold seas."),
        (5, "Who wrote Dune? Who wrote it, and who has read Hamlet?"),
        (6, "name two cold lakes, or two cold seas"),
    ]
    frame = spark.createDataFrame(docs, "doc_id: bigint, text: string")
    got = sorted((r.doc_id, r.item_id) for r in leak_table(frame, bench(spark, items)).collect())
    assert got == [(1, 1), (2, 2), (4, 3)]


def test_columns_of_any_name_are_kept(spark):
    docs = spark.createDataFrame([(1, "x y", 7, 8), (2, CAROL, 7, 8)], "doc_id: bigint, text: string, _row: int, row: int")
    left = drop_leaks(docs, bench(spark))
    assert left.columns == docs.columns and left.collect() == [(1, "x y", 7, 8)]


def test_plain_passages_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru") for b in ("na", "te", "so", "vi", "be")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(12))) for i in range(20)]
    docs = []
    for i in range(120):
        body = [rng.choice(vocabulary) for _ in range(40)]
        if i % 3 == 0:
            item = items[rng.randrange(20)][1].split()
            for _ in range(i % 2):
                item[rng.randrange(12)] = "zz"
            body[20:20] = item
        docs.append((i, " ".join(body)))
    want = set()
    for d, text in docs:
        tokens = re.findall(r"[a-z]+", text)
        have = {tuple(tokens[k : k + 5]) for k in range(len(tokens) - 4)}
        for i, item in items:
            words = item.split()
            need = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
            if len(need & have) * 100 >= 80 * len(need):
                want.add((d, i))
    frame = spark.createDataFrame(docs, "doc_id: bigint, text: string")
    assert {(r.doc_id, r.item_id) for r in leak_table(frame, bench(spark, items)).collect()} == want


def test_edge_documents(spark):
    docs = edge_documents(spark)
    kept = drop_leaks(docs, bench(spark))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert leak_table(no_documents(spark), bench(spark)).count() == 0
    assert drop_leaks(docs, bench(spark).limit(0)).count() == docs.count()
    hit = docs.limit(1).selectExpr("CAST(1 AS BIGINT) AS item_id", "text")
    assert {r.doc_id for r in leak_table(docs, hit).collect()} >= {1, 2}


def test_main_path_runs_no_python(spark):
    docs = spark.createDataFrame(texts(), "doc_id: bigint, text: string")
    plan = drop_leaks(docs, bench(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_blanks_and_separators_are_passed_by_one_class(spark):
    """The patterns replace what those with two alternatives replaced, and try one class of characters at a place."""
    import random

    from flowlens.llm.decontam import BETWEEN, BLANKS, MARKS
    from pyspark.sql import functions as F

    blanks = rf" *[\s {MARKS}&&[^ ]][\s {MARKS}]*+| {{2,}}"
    between = rf" *[^\p{{L}}\p{{M}}{MARKS} ][^\p{{L}}\p{{M}}{MARKS}]*+| {{2,}}"
    rng = random.Random(3)
    letters = "aBé中́ \t\n\x0b\x85 .,-7   \U0001f600"
    rows = [("".join(rng.choice(letters) for _ in range(30)),) for _ in range(2000)]
    df = spark.createDataFrame(rows, "text: string")
    for old, new in ((blanks, BLANKS), (between, BETWEEN)):
        assert df.where(F.regexp_replace("text", old, " ") != F.regexp_replace("text", new, " ")).isEmpty()
        assert new.startswith("[") and "|" not in new.split("(?:")[0]
