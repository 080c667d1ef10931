"""Near-duplicate groups by MinHash with tensored banding, confirmed on whole shingle sets.

A text, A-Z lower-cased, has the set of its distinct `words`-word shingles (a shorter text: its whole word
sequence as one shingle; without words: nothing, and no link). Two texts are linked when their sets have a
Jaccard similarity of `percent` or more; groups are the connected components of these links.

* Equal sets are one class from the start, so copies never meet in a bucket.
* Tensored banding: two small collections of `side` bands each, `rows` minhashes a band, give side * side
  tables keyed by a pair of bands (one of either collection) from only 2 * side * rows minhashes. A pair of
  similarity s is found in some table with probability (1 - (1 - s^rows)^side)^2: 0.99998 at 0.85 and 0.9996
  at 0.8, but 0.008 at 0.2, as between texts that share a passage.
* Pair keys are formed of bands that a class shares with another class, so most classes form few or none.
* Links only have to join groups. So the `side` tables of bands of equal number come first: all classes of a bucket
  are compared with one, the least of a bucket of up to `small` classes, else one picked by a hash that differs by
  table. The components of these links are labels, and all tables are then formed of bands that classes of different
  labels share: only classes of different labels are compared from there on.
* There a bucket of up to `small` classes compares those with one another whose set sizes allow the similarity. In a
  larger one all are compared with one class, picked by a hash that differs by table, so each class that is not yet
  in the group meets dozens of others.
* The classes of large buckets that still hold several groups are looked at again, exactly: similar sets share
  one of their first shingles, rare ones first (`prefixes`), so these are compared across groups where they share
  one. Where more than `small` classes share a shingle, they are dealt into blocks of about `block`, and every two
  blocks are compared in a task: all classes outside the largest group there with one another and with that group.
* Candidates first compare the parities of their whole sets, which rule out most pairs and no similar one, and, but for
  those of blocks, eight bits of all their minhashes, which do the same where sets are too large for parities; the rest
  is confirmed by the exact intersection of whole sets (as 64-bit hashes). Texts of
  classes that share bands are written once; pairs are dealt into places of about `block`, by their first class (and
  by their second, where a first one has more than that), and a place gets each text it needs once.

Components: minimum labels along alternating large-star and small-star rounds, written each round. The tables
of a round are deleted once the next one is written.

Rows with a null id take part, but never give a component its name; a group without any id has a null
component and nothing kept. Repeated rows share their component. An empty table gives an empty result.
`keep_one_each` hands on extra columns, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm import tokens as K
from flowlens.llm.work import removed, row_key, shared_folder, written
from flowlens.shipping import ship

ship(__name__)


@dataclass(frozen=True)
class Near:
    words: int = 5
    percent: int = 80
    side: int = 12
    rows: int = 3
    small: int = 8
    block: int = 512
    agree: int = 40  # of 2 * side * rows; a pair at 0.8 has fewer with a probability of about 1e-6

    @property
    def hashes(self) -> int:
        return 2 * self.side * self.rows


PARITY_BITS = 2048
FEW = 50_000  # pairs whose ids may go to all tasks
SKETCHED = ["n_shingles", "node", "minima", "brief", "bands"]
SKETCH = "n_shingles bigint, node bigint, minima binary, brief binary, bands array<bigint>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a chunk."""
    words = K.Words(data, offsets)
    hashes = words.hashes(True)
    keys, _, doc = K.shingles(words, hashes, size)
    bounds = np.searchsorted(doc, np.arange(len(offsets)))
    out: list[np.ndarray] = []
    for i, n in enumerate(words.counts):
        if n >= size:
            out.append(np.unique(keys[bounds[i] : bounds[i + 1]]))
        else:
            part = hashes[words.bounds[i] : words.bounds[i + 1]]
            whole = (part * K.SLOT_CODE[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))
            out.append(K.mix(np.array([whole], np.uint64)) if n else np.zeros(0, np.uint64))
    return out


def _by_chunk(batches: Iterator[pa.RecordBatch], near: Near) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Small slices of the batches with the shingle sets of their texts."""
    for batch in batches:
        data, offsets = K.utf8(batch.column("text"))
        for a, b in K.chunks(offsets):
            part = data[offsets[a] : offsets[b]]
            yield batch.slice(a, b - a), shingle_sets(part, offsets[a : b + 1] - offsets[a], near.words)


def parity(hashes: np.ndarray) -> bytes:
    """PARITY_BITS bits of a set: whether an odd number of its hashes fall on a bit.

    Two sets differ in at least as many elements as these bits differ, so a pair with too many of them is not similar.
    """
    at = (hashes % np.uint64(PARITY_BITS)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=PARITY_BITS) % 2 == 1).tobytes()


def parities(sets: Column) -> Column:
    """The `parity` of each set (its hashes as bytes)."""

    def fold(rows: pa.Array) -> pa.Array:
        return pa.array([parity(np.frombuffer(v.as_py(), np.uint64)) for v in rows], pa.binary())

    return F.arrow_udf(fold, "binary")(sets)


def _sketched(near: Near, sets: list[np.ndarray]) -> list[pa.Array]:
    """Set size, class id (null: empty set), minhashes (8 bits each), parities and band hashes of each set."""
    seeds = np.random.RandomState(97).randint(0, 2**63, (2, near.hashes), dtype=np.uint64)
    factors = seeds[1] * np.uint64(2) + np.uint64(1)
    count = np.array([len(s) for s in sets], np.int64)
    filled = np.flatnonzero(count)
    minima = np.zeros((len(sets), near.hashes), np.uint64)
    if len(filled):
        values = np.concatenate([sets[i] for i in filled])
        first = np.concatenate(([0], np.cumsum(count[filled])[:-1]))
        for k in range(near.hashes):
            minima[filled, k] = np.minimum.reduceat((values ^ seeds[0, k]) * factors[k], first)
    node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
    bands = np.zeros((len(sets), 2 * near.side), np.uint64)
    for j in range(near.rows):
        bands = K.mix(bands + minima[:, j :: near.rows] * K.SLOT_CODE[j])
    small = K.mix(minima).astype(np.uint8)
    step = np.arange(len(sets) + 1, dtype=np.int32) * (2 * near.side)
    return [
        pa.array(count),
        pa.array(node, mask=count == 0),
        pa.array([row.tobytes() for row in small], pa.binary()),
        pa.array([parity(s) for s in sets], pa.binary()),
        pa.ListArray.from_arrays(pa.array(step), pa.array(bands.view(np.int64).ravel())),
    ]


def sketches(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, _row and SKETCH of each row of docs (doc_id, _row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _by_chunk(batches, near):
            columns = [part.column("doc_id"), part.column("_row"), *_sketched(near, sets)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_row", *SKETCHED])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "_row", "text").mapInArrow(run, f"doc_id {kind}, _row binary, {SKETCH}")


def whole_sets(texts: DataFrame, near: Near) -> DataFrame:
    """(node, set): the shingle hashes of (node, text) rows, sorted, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _by_chunk(batches, near):
            bodies = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("node"), bodies], ["node", "set"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, set binary")


def may_be_similar(near: Near, apart: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Pairs that may be similar: their parities differ on `apart` bits, their sets have `size` elements together.

    Of sets at the threshold at most size * (100 - percent) / (100 + percent) elements differ.
    """
    return (100 + near.percent) * apart.astype(np.int64) <= (100 - near.percent) * size


def likely(near: Near) -> Column:
    """May a pair (nx, mx, bx; ny, my, by: sizes, minhashes, parities) be similar? Said no to no similar one, as by Near.agree."""

    def bits(column: pa.Array, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)

    def test(nx: pa.Array, ny: pa.Array, mx: pa.Array, my: pa.Array, bx: pa.Array, by: pa.Array) -> pa.Array:
        if not len(nx):
            return pa.array([], pa.bool_())
        apart = np.bitwise_count(bits(bx, np.uint64) ^ bits(by, np.uint64)).sum(axis=1, dtype=np.int64)
        near_enough = may_be_similar(near, apart, nx.to_numpy() + ny.to_numpy())
        return pa.array(near_enough & ((bits(mx, np.uint8) == bits(my, np.uint8)).sum(axis=1) >= near.agree))

    return F.arrow_udf(test, "boolean")("nx", "ny", "mx", "my", "bx", "by")


def similar(near: Near, a: np.ndarray, b: np.ndarray) -> bool:
    """Are two sorted sets of 64-bit hashes similar enough?"""
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= near.percent * (len(a) + len(b) - both)


def shared(rows: DataFrame, least: int = 0) -> DataFrame:
    """(key, count, pick) of the keys with nodes of two labels or more; without labels each node is its own.

    pick is a node picked by a hash, of up to `least` nodes the least one.
    """
    salt = F.xxhash64("key")
    pick = F.min(F.col("node").bitwiseXOR(salt)).bitwiseXOR(salt)
    pick = F.when(F.count(F.lit(1)) <= least, F.min("node")).otherwise(pick) if least else pick
    sums = [F.count(F.lit(1)).alias("count"), pick.alias("pick")]
    if "label" not in rows.columns:
        return rows.groupBy("key").agg(*sums).where("count > 1")
    found = rows.groupBy("key").agg(*sums, F.min("label").alias("low"), F.max("label").alias("high"))
    return found.where("low < high").drop("low", "high")


def met_on(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """`rows` joined with `table`, neither of them broadcast.

    Spark sizes rows after an explode, or of a well packed file, by a fraction of what they take in the driver.
    """
    return rows.hint("merge").join(table, key)


def buckets(keyed: DataFrame, least: int = 0) -> DataFrame:
    """The rows of `keyed` in buckets of two labels or more, with the bucket's count and pick."""
    return met_on(keyed, shared(keyed, least), "key")


def fits(near: Near, x: str, y: str) -> str:
    """Do the set sizes allow the similarity?"""
    return f"100 * least({x}, {y}) >= {near.percent} * greatest({x}, {y})"


def pairs_of(members: DataFrame, near: Near, apart: str = "true") -> DataFrame:
    """(x, y), x < y, of the members of small buckets: each bucket lists at most `small` nodes."""
    columns = [c for c in ("node", "n_shingles", "label") if c in members.columns]
    listed = members.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("nodes"))
    first = listed.select("nodes", F.posexplode("nodes").alias("at", "x"))
    later = f"filter(slice(nodes, at + 2, size(nodes)), y -> {fits(near, 'x.n_shingles', 'y.n_shingles')} AND {apart})"
    return first.select("x.node", F.expr(f"explode({later})").alias("y")).selectExpr("node AS x", "y.node AS y")


def ordered_pairs(one: str, two: str) -> list[Column]:
    return [F.least(one, two).alias("x"), F.greatest(one, two).alias("y")]


def tables(live: DataFrame, also: str = "true") -> DataFrame:
    """A row for each pair of a shared band of the one collection (i) and one of the other (j): key, node, n_shingles, label."""
    columns = ["node", "n_shingles", *(c for c in live.columns if c == "label")]
    keyed = live.select(*columns, "bands", F.explode("low").alias("i"), "high")
    keyed = keyed.select(*columns, "bands", "i", F.explode("high").alias("j")).where(also)
    return keyed.select(F.expr("xxhash64(i, j, bands[i], bands[j])").alias("key"), *columns)


def shared_bands(classes: DataFrame, near: Near) -> DataFrame:
    """Classes that share a band of either collection with one of another label, and which bands they share (low, high)."""
    columns = ["node", *(c for c in classes.columns if c == "label")]
    banded = classes.select(*columns, F.posexplode("bands").alias("at", "band"))
    banded = banded.select(*columns, "at", F.xxhash64("at", "band").alias("key"))
    met = met_on(banded, shared(banded).select("key"), "key").groupBy("node").agg(F.sort_array(F.collect_list("at")).alias("at"))
    met = met.select("node", F.expr(f"filter(at, a -> a < {near.side})").alias("low"), F.expr(f"filter(at, a -> a >= {near.side})").alias("high"))
    met = met.where("size(low) > 0 AND size(high) > 0")
    return classes.join(met, "node")


def among(rows: DataFrame, column: str, few: DataFrame) -> DataFrame:
    """The rows that may have a value of `few` in `column`: all that do, and some others.

    One bit for each value, at most 2^23, goes to all tasks, so few other rows are shuffled for an exact join.
    """
    size = 1 << min(23, max(16, (8 * few.count()).bit_length()))
    at = F.pmod(F.xxhash64(column), F.lit(size))
    word, bit = F.shiftright(at, 6).alias("_word"), at.bitwiseAND(F.lit(63)).cast("int").alias("_bit")
    bits = few.select(word, bit).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    held = rows.select("*", word, bit).join(F.broadcast(written(bits, "near-bits")), "_word")
    return held.where("getbit(_bits, _bit) = 1").drop("_word", "_bit", "_bits")


def texts_of(live: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the given classes, written; docs has _row and text."""
    keepers = live.select("node", "keeper")
    texts = among(docs.select("text", F.col("_row").alias("keeper")), "keeper", keepers).join(keepers, "keeper")
    return written(texts.dropDuplicates(["keeper", "node"]).select("node", "text"), "near-texts")


def confirmed(pairs: DataFrame, live: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """(x, y) of the pairs of live classes whose whole sets are similar enough."""
    pairs = written(pairs, "near-pairs")  # Spark knows its size: the sketches are shuffled for many pairs only
    one, two = (live.selectExpr(f"node AS {c}", f"n_shingles AS n{c}", f"minima AS m{c}", f"brief AS b{c}") for c in "xy")
    sized = pairs.join(one, "x").join(two, "y").where(fits(near, "nx", "ny"))
    left = written(sized.where(likely(near)).select("x", "y", "nx", "ny"), "near-likely")
    count, size = left.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("nx") + F.col("ny")), F.lit(0))).first()
    places = 1 + max(count // near.block, size >> 21)
    crowds = left.groupBy("x").agg(F.expr(f"CAST(ceil(count(1) / {near.block}) AS INT)").alias("parts"))
    crowds = written(crowds.where("parts > 1"), "near-crowds")  # few first classes have more pairs than a place
    place = f"CAST(pmod(xxhash64(x, pmod(xxhash64(y), coalesce(parts, 1))), {places}) AS INT) AS place"
    dealt = written(left.join(crowds, "x", "left").selectExpr("x", "y", place), "near-places")
    needed = dealt.select("place", F.explode(F.array("x", "y")).alias("node")).distinct()
    # texts are packed too well to be sized by their file; of few pairs the ids are sent
    needed = F.broadcast(needed).join(texts, "node") if count <= FEW else met_on(needed, texts, "node")
    needed = needed.select(F.col("place").alias("at"), "node", "text")

    def alike(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        held: dict[int, np.ndarray] = {}
        for part, sets in _by_chunk(iter(texts.combine_chunks().to_batches()), near):
            held |= zip(part.column("node").to_pylist(), sets)
        both = zip(pairs.column("x").to_pylist(), pairs.column("y").to_pylist())
        keep = [similar(near, held[x], held[y]) for x, y in both]
        return pairs.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    grouped = dealt.groupBy("place").cogroup(needed.groupBy("at"))
    return written(grouped.applyInArrow(alike, "x bigint, y bigint"), "near-links")


def prefixes(sets: DataFrame, near: Near) -> DataFrame:
    """(key, node, n_shingles): the shingles of which similar sets must share one.

    With shingles in one order, two sets of that similarity share one of their first n - ceil(n * percent / 100)
    + 1. Rare shingles come first, so texts that share a passage and little else do not meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, body in zip(batch.column("node").to_pylist(), batch.column("set")):
                key = np.frombuffer(body.as_py(), np.int64)
                same = [pa.array(np.full(len(key), v, np.int64)) for v in (node, len(key))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(key)], ["node", "n_shingles", "key"])

    held = written(sets.mapInArrow(run, "node bigint, n_shingles bigint, key bigint"), "near-shingles")
    counts = held.groupBy("key").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    ranked = held.join(counts, "key", "left").groupBy("node", "n_shingles")
    ranked = ranked.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(1)).alias("count"), "key"))).alias("all"))
    first = f"slice(all, 1, n_shingles - (n_shingles * {near.percent} + 99) div 100 + 1)"
    out = ranked.select("node", "n_shingles", F.expr(f"explode({first})").alias("e")).where("e.count > 1")
    return out.select("e.key", "node", "n_shingles")


def wide_pairs(wide: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """(x, y) of different labels, likely similar, of wide keys; every such pair is looked at.

    Keys with the same classes are one key. Those outside the most frequent label of a key are dealt into `outs`
    blocks, the others into `ins` more; each two blocks of which one is outside meet in a task, which compares sizes
    and parities. No similar pair is lost.
    """
    same = ["one", "two", "count"]
    codes = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(c) for i, c in enumerate(same[:2])]
    per_label = wide.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), *codes)
    keys = per_label.groupBy("key").agg(
        F.sum("n").alias("count"), F.max(F.struct("n", "label")).alias("most"), *[F.bit_xor(c).alias(c) for c in same[:2]]
    )
    keys = keys.where("most.n < count").groupBy(*same).agg(F.min(F.struct("key", "most")).alias("k"))
    blocks = [f"CAST(ceil({n} / {near.block}) AS INT) AS {c}" for n, c in (("(count - k.most.n)", "outs"), ("k.most.n", "ins"))]
    keys = written(keys.selectExpr("k.key", "k.most.label AS main", *blocks), "near-wide-keys")
    briefs = written(sets.select("node", parities(F.col("set")).alias("brief")), "near-parities")
    rows = met_on(wide.select("key", "node", "n_shingles", "label"), keys, "key").join(briefs, "node")
    own = "IF(label = main, outs + pmod(xxhash64(node, 7), ins), pmod(xxhash64(node, 7), outs))"
    rows = rows.withColumn("own", F.expr(f"CAST({own} AS INT)"))
    rows = rows.withColumn("other", F.expr("explode(sequence(0, IF(label = main, outs, outs + ins) - 1))"))
    rows = rows.select("key", F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v"), "own", "node", "n_shingles", "label", "brief")
    rows = rows.repartition("key", "u", "v").sortWithinPartitions("key", "u", "v")

    def close(part: pa.Table) -> pa.RecordBatch:
        own, node, size, label = (part.column(c).to_numpy() for c in ("own", "node", "n_shingles", "label"))
        brief = np.frombuffer(b"".join(part.column("brief").to_pylist()), np.uint64).reshape(len(own), -1)
        a = np.flatnonzero(own == part.column("u")[0].as_py())
        b = np.flatnonzero(own == part.column("v")[0].as_py())
        apart = np.zeros((len(a), len(b)), np.uint16)
        for one, two in zip(np.ascontiguousarray(brief[a].T), np.ascontiguousarray(brief[b].T)):
            apart += np.bitwise_count(one[:, None] ^ two)
        near_enough = may_be_similar(near, apart, size[a][:, None] + size[b])
        small, big = np.minimum(size[a][:, None], size[b]), np.maximum(size[a][:, None], size[b])
        i, j = np.nonzero(near_enough & (label[a][:, None] != label[b]) & (100 * small >= near.percent * big))
        x, y = node[a[i]], node[b[j]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            ids = np.stack([table.column(c).to_numpy() for c in ("key", "u", "v")])
            starts = np.concatenate(([0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1))
            for start, end in zip(starts[:-1], starts[1:]):
                yield close(table.slice(start, end - start))
            held = table.slice(starts[-1])
        if held is not None and held.num_rows:
            yield close(held)

    return written(rows.mapInArrow(run, "x bigint, y bigint").distinct(), "near-wide-pairs")


def confirmed_in_blocks(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """(x, y) of the pairs whose sets are similar enough; each set goes to a task once for all its pairs there."""
    nodes, size = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("set")), F.lit(0))).first()
    n = 1 + max(nodes // near.block, size >> 24)
    of = lambda c: f"CAST(pmod(xxhash64({c}, 11), {n}) AS INT)"
    placed = pairs.selectExpr("x", "y", f"{of('x')} AS u", f"{of('y')} AS v")
    needed = placed.select("u", "v", F.explode(F.array("x", "y")).alias("node")).distinct()
    needed = needed.join(sets, "node").select(F.col("u").alias("p"), F.col("v").alias("q"), "node", "set")

    def alike(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        bodies = zip(sets.column("node").to_pylist(), sets.column("set").to_pylist())
        held = {node: np.frombuffer(body, np.uint64) for node, body in bodies}
        x, y = pairs.column("x").to_pylist(), pairs.column("y").to_pylist()
        keep = np.zeros(len(x), bool)
        for i, (one, two) in enumerate(zip(x, y)):
            keep[i] = similar(near, held[one], held[two])
        return pairs.select(["x", "y"]).filter(pa.array(keep))

    grouped = placed.groupBy("u", "v").cogroup(needed.groupBy("p", "q"))
    return written(grouped.applyInArrow(alike, "x bigint, y bigint"), "near-wide-links")


def links(docs: DataFrame, classes: DataFrame, near: Near) -> DataFrame:
    """(x, y) of similar classes, enough of them to join every group; docs has _row and text."""
    live = written(shared_bands(classes.drop("least_id"), near), "near-live")
    texts = texts_of(live, docs)
    found = buckets(tables(live, f"j = i + {near.side}"), near.small)
    found = found.where("node <> pick").select(*ordered_pairs("node", "pick"))
    first = confirmed(found.distinct(), live, texts, near)

    def labels(edges: DataFrame) -> DataFrame:
        roots = components(edges)
        return written(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "near-roots")

    def labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")

    roots = labels(first)
    slim = labelled(live.select("node", "n_shingles", "bands"), roots)
    met = written(buckets(tables(written(shared_bands(slim, near), "near-apart"))), "near-buckets")
    if met.isEmpty():
        return first
    found = pairs_of(met.where(F.col("count") <= near.small), near, "x.label <> y.label")
    large = met.where(F.col("count") > near.small)
    picks = labelled(large.select(F.col("pick").alias("node")).distinct(), roots)
    picks = picks.select(F.col("node").alias("pick"), F.col("label").alias("other"))
    found = found.unionByName(met_on(large, picks, "pick").where("label <> other").select(*ordered_pairs("node", "pick")))
    first = first.unionByName(confirmed(found.distinct(), live, texts, near))
    if large.isEmpty():
        return first
    roots = labels(first)
    mixed = labelled(large.select("key", "node"), roots).groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = mixed.where("low < high").select("key")
    nodes = written(met_on(large, mixed, "key").select("node").distinct(), "near-open")
    if nodes.isEmpty():
        return first
    sets = written(whole_sets(texts.join(nodes, "node"), near), "near-sets")
    again = written(labelled(buckets(prefixes(sets, near)), roots), "near-prefixes")
    more = pairs_of(again.where(F.col("count") <= near.small), near, "x.label <> y.label")
    second = confirmed(more.distinct(), live, texts, near)
    wide = wide_pairs(again.where(F.col("count") > near.small), sets, near)
    return first.unionByName(second).unionByName(confirmed_in_blocks(wide, sets, near))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for the nodes that have a link."""
    spark, state, done = edges.sparkSession, None, None
    edges = edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct()
    while True:
        folder = f"near-round-{uuid.uuid4().hex}"
        edges = written(edges, f"{folder}/edges")
        if done:
            removed(spark, f"{shared_folder(spark)}/{done}")
        done = folder
        got = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if got == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = got
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        large = written(large, f"{folder}/large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        edges = small.where("u <> v").distinct()


def grouped(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """(doc_id, _row, n_shingles, root, component_id) for every document; root is null for an empty set."""
    keyed = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("_row"))
    signed = written(sketches(keyed, near), "near-sketches")
    full = signed.where("node IS NOT NULL")
    # one row stands for its class; the sketch may be any row's, as all have the same set
    sketch = [F.first(c).alias(c) for c in SKETCHED if c != "node"]
    classes = full.groupBy("node").agg(F.min("_row").alias("keeper"), F.min("doc_id").alias("least_id"), *sketch)
    classes = written(classes, "near-classes")
    roots = components(links(keyed, classes, near))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    named = classes.select("node", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = written(named.select("node", "root").join(ids, "root"), "near-labels")
    columns = ["doc_id", "_row", "n_shingles", "root", "component_id"]
    out = full.join(labels, "node").select(*columns)
    empty = signed.where("node IS NULL")
    empty = empty.withColumns({"root": F.lit(None).cast("bigint"), "component_id": F.col("doc_id")})
    return out.unionByName(empty.select(*columns))


def near_table(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return grouped(docs, near).select("doc_id", "n_shingles", "component_id", kept)


def keep_one_each(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """One document of each group, whole; same columns.

    It is the one with the least id (null last). A document with an empty set is a group of its own; a repeated
    row stays once.
    """
    named = grouped(docs, near)
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_row")
    kept = named.where("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("first")).select("first._row")
    kept = written(kept.unionByName(named.where("root IS NULL").select("_row").distinct()), "near-kept")
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), row_key(F.col("doc_id"), F.col("text")).alias("_row"))
    return keyed.join(kept, "_row").dropDuplicates(["_row"]).select("doc.*")
