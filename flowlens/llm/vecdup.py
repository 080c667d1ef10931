"""Near-duplicate vectors by Euclidean p-stable hashing, confirmed by exact cosines.

Vectors are scaled to length 1, so a cosine of `cosine` is a distance, and an angle theta. A table has a key of
`wide` quantised projections floor((a . v + b) / width), with Gaussian a. `wide` is chosen for about `mates` unrelated
vectors a bucket, and the number of tables so that a pair at the threshold shares a bucket in at least one with
probability `recall`; closer pairs are found more often. Both follow from the count of rows.

1. Crowds. Keys of two tables' worth of projections find crowds of near copies: each bucket proposes one of its
   vectors as leader, chosen by a hash of the vector alone; a vector follows the first proposed leader within theta / 2,
   and then that one's leader, if it is as near. Leaders with `crowd` followers or more make a class; all others are
   classes of one. Members of a class are all linked: no two of them are farther apart than theta.
2. Candidates. In each bucket two classes meet if the random-hyperplane sketches of their leaders allow an angle of
   theta and both radii (a pair at this bound fails with a probability under 1e-8). A bucket with more than `block`
   rows is dealt into blocks, and each two blocks meet in a task.
3. Exact checks, in double precision. Candidates of one vector each are compared. For larger classes the angle
   between leaders and the radii say whether all links exist, none, or some; in the last case each member is held
   against the other leader, and only members still undecided are compared with members, in blocks, which yield counts.

No pair inside a crowd is listed, yet every link counts. Components are those of the classes.

Disk: vectors are kept once, as wide as they came, and meet in rounds of some tables, or of some pairs, whose shuffled
rows take about as much as the vectors (`round_mb` at least). A round leaves ids only; its tables are deleted.

Links: vectors that are null, empty, zero, or hold null or non-finite numbers have none, nor have vectors of
different lengths. Repeated rows are vectors of their own. Rows with a null id take part but give no component its
name; a component without any id has a null name and nothing kept. An empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm import tokens as K
from flowlens.llm.neardup import components
from flowlens.llm.work import numbered, removed, shared_folder, spread_join, written
from flowlens.shipping import ship

ship(__name__)

SLACK = 1e-7  # angles nearer to a bound than this are settled by exact comparison


@dataclass(frozen=True)
class Vectors:
    cosine: float = 0.9
    recall: float = 0.9999
    width: float = 2.5
    mates: int = 256
    crowd: int = 16
    crowd_tables: int = 16
    jumps: int = 3
    block: int = 1024
    bits: int = 512
    seed: int = 31
    round_mb: int = 64
    stored: str = "f8"  # floats in the bytes of a unit

    @property
    def theta(self) -> float:
        return math.acos(self.cosine)

    def differing(self, angle: float | np.ndarray, bits: int) -> np.ndarray:
        """Sketch bits, of so many, in which vectors at this angle may differ: six deviations above the mean."""
        share = np.minimum(angle / math.pi, 1.0)
        return np.ceil(bits * share + 6 * np.sqrt(bits * share * (1 - share)))

    def same_cell(self, distance: float) -> float:
        """Probability that two vectors so far apart agree in one quantised projection."""
        t = self.width / distance
        tail = math.erfc(t / math.sqrt(2))
        return 1 - tail - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))

    def shape(self, rows: int) -> tuple[int, int]:
        """(projections a key, tables) for so many rows."""
        wide = max(1, round(math.log(max(rows / self.mates, 1)) / -math.log(self.same_cell(math.sqrt(2)))))
        found = self.same_cell(math.sqrt(2 - 2 * self.cosine)) ** wide
        return wide, max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - found)))


def usable(column: pa.Array, stored: str) -> list[bytes | None]:
    """Per row the bytes of its vector (None: without links)."""
    rows: list[bytes | None] = []
    for cell in column:
        v = np.array(cell.as_py() or [], stored) if cell.is_valid and cell.values.null_count == 0 else np.zeros(0)
        rows.append(v.tobytes() if np.isfinite(v).all() and v.any() else None)
    return rows


def packed(vectors: DataFrame, rules: Vectors) -> DataFrame:
    """doc of each row: vec_id and its vector as `unit`, the bytes of its floats (null: takes no part)."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = pa.array(usable(batch.column("embedding"), rules.stored), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), units], ["vec_id", "unit"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, unit binary")


def scaled(cells: list[bytes], stored: str) -> np.ndarray:
    """Vectors of one length, scaled to 1, in double precision."""
    m = np.frombuffer(b"".join(cells), stored).reshape(len(cells), -1).astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)  # else squares may overflow or vanish
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def by_length(column: pa.Array, stored: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix) for each length of vectors among the units of a column."""
    cells = column.to_pylist()
    size = np.array([len(c) for c in cells], np.int64)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, scaled([cells[i] for i in at], stored)


def keys_of(m: np.ndarray, wide: int, tables: int, width: float, seed: int, part: range) -> np.ndarray:
    """A 64-bit key for each row and each table of `part`, of so many tables."""
    rng = np.random.RandomState([seed, m.shape[1], wide])
    a, b = rng.standard_normal((m.shape[1], wide * tables)), rng.random_sample(wide * tables) * width
    own = slice(part.start * wide, part.stop * wide)
    a, b, names = np.ascontiguousarray(a[:, own]), b[own], np.arange(part.start, part.stop, dtype=np.uint64)
    out = np.empty((len(m), len(part)), np.uint64)
    for i in range(0, len(m), 2048):  # bounds the matrix of projections
        cells = np.floor((m[i : i + 2048] @ a + b) / width).astype(np.int64).view(np.uint64).reshape(-1, len(part), wide)
        key = names * K.BASE + np.uint64(m.shape[1])
        for j in range(wide):
            key = K.mix(key + cells[:, :, j] * K.SLOT_CODE[j % 15] + np.uint64(j))
        out[i : i + 2048] = key
    return out


def sketch_of(m: np.ndarray, bits: int, seed: int) -> np.ndarray:
    planes = np.random.RandomState([seed, m.shape[1], 7]).standard_normal((m.shape[1], bits))
    return np.packbits(m @ planes > 0, axis=1)


def hashed(units: DataFrame, rules: Vectors, shape: tuple[int, int], part: range, seed: int, carried: list[str], sketched: bool = True) -> DataFrame:
    """key, sketch and the `carried` columns for each row of `units` and table of `part`."""
    kinds = "".join(f", {c} {units.schema[c].dataType.simpleString()}" for c in carried)
    extra = ["sketch"] if sketched else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, m in by_length(batch.column("unit"), rules.stored):
                keys = keys_of(m, *shape, rules.width, seed, part)
                rows = [batch.column(c).take(pa.array(at)) for c in carried]
                if sketched:
                    rows.insert(0, pa.array([s.tobytes() for s in sketch_of(m, rules.bits, rules.seed)], pa.binary()))
                step = max(1, (1 << 18) // len(at))
                for first in range(0, len(part), step):
                    some = keys[:, first : first + step]
                    again = pa.array(np.tile(np.arange(len(at)), some.shape[1]))
                    columns = [pa.array(some.T.ravel().view(np.int64)), *[r.take(again) for r in rows]]
                    yield pa.RecordBatch.from_arrays(columns, ["key", *extra, *carried])

    return units.select("unit", *carried).mapInArrow(run, "key bigint" + ", sketch binary" * sketched + kinds)


def rounds(tables: int, rules: Vectors, rows: int, size: int) -> list[range]:
    """The tables in rounds, whose rows (with sketches) take about as much as the vectors."""
    step = max(1, int(max(size, rules.round_mb << 20) // max(1, rows * (rules.bits // 8 + 32))))
    return [range(i, min(tables, i + step)) for i in range(0, tables, step)]


class Round:
    """A folder for tables that are deleted when the round ends."""

    def __init__(self, df: DataFrame) -> None:
        self.spark, self.folder = df.sparkSession, f"vector-round-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, f"{self.folder}/{name}")

    def end(self) -> None:
        removed(self.spark, f"{shared_folder(self.spark)}/{self.folder}")

    def __enter__(self) -> Callable[[DataFrame, str], DataFrame]:
        return self.table

    def __exit__(self, *_: object) -> None:
        self.end()


def gathered(parts: Iterator[DataFrame], name: str) -> DataFrame:
    """The distinct rows of all parts, written after each; the table of the parts before is deleted."""
    found, before = None, None
    for part in parts:
        now = Round(part)
        found = now.table((part if found is None else found.unionByName(part)).distinct(), name)
        if before:
            before.end()
        before = now
    return found


def differing_bits(x: Column, y: Column) -> Column:
    def count(xs: pa.Array, ys: pa.Array) -> pa.Array:
        a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), -1) for c in (xs, ys))
        return pa.array(np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) if len(xs) else [], pa.int64())

    return F.arrow_udf(count, "bigint")(x, y)


def cosines(pairs: DataFrame, units: DataFrame, rules: Vectors, rows: int, size: int) -> DataFrame:
    """x, y (vectors of the same length) and their cosine, of distinct written pairs.

    Pairs are dealt into places of about 8 * `block`, by their first vector (and by their second, where a first one has
    more than that); a place gets each vector it needs once. Rounds of places bound what is shuffled.
    """
    count, heap, per = pairs.count(), 8 * rules.block, size // max(1, rows)
    if not count:
        return pairs.withColumn("cosine", F.lit(0.0))
    n = max(1, math.ceil(2 * count * (per + 32) / max(size, rules.round_mb << 20)))
    places = n * max(1, math.ceil(count / n / heap))
    many = pairs.groupBy("x").agg(F.expr(f"CAST(ceil(count(1) / {heap}) AS INT)").alias("parts")).where("parts > 1")
    many = written(many, "vector-many")
    place = f"CAST(pmod(xxhash64(x, pmod(xxhash64(y), coalesce(parts, 1))), {places}) AS INT) AS place"

    def compare(pairs: pa.Table, units: pa.Table) -> pa.Table:
        at = {node: i for i, node in enumerate(units.column("node").to_pylist())}
        x, y = (np.array([at[v] for v in pairs.column(c).to_pylist()], np.int64) for c in "xy")
        out = np.zeros(len(x))
        for rows, m in by_length(units.column("unit"), rules.stored):
            own = np.full(len(at), -1)
            own[rows] = np.arange(len(rows))
            for i in range(0, len(x), 4096):
                some = i + np.flatnonzero((own[x[i : i + 4096]] >= 0) & (own[y[i : i + 4096]] >= 0))
                out[some] = np.einsum("ij,ij->i", m[own[x[some]]], m[own[y[some]]])
        return pa.table([pairs.column("x"), pairs.column("y"), pa.array(out)], ["x", "y", "cosine"])

    found = None
    for i in range(n):
        with Round(pairs) as table:
            dealt = pairs.join(many, "x", "left").selectExpr("x", "y", place)
            dealt = table(dealt.where(F.col("place") % n == i), "dealt")
            needed = dealt.select("place", F.explode(F.array("x", "y")).alias("node")).distinct()
            needed = needed.join(units.select("node", "unit"), "node").select(F.col("place").alias("at"), "node", "unit")
            grouped = dealt.groupBy("place").cogroup(needed.groupBy("at"))
            part = written(grouped.applyInArrow(compare, "x bigint, y bigint, cosine double"), "vector-cosines")
        found = part if found is None else found.unionByName(part)
    return found


def angle(cosine: str) -> Column:
    return F.acos(F.least(F.greatest(F.col(cosine), F.lit(-1.0)), F.lit(1.0)))


def crowds(units: DataFrame, rules: Vectors, rows: int, size: int) -> DataFrame:
    """(node, leader, radius) of the vectors in crowds."""
    shape = 2 * rules.shape(rows)[0], rules.crowd_tables
    near = float(rules.differing(rules.theta / 2, rules.bits))
    first = F.min_by(F.struct(F.col("node").alias("leader"), F.col("sketch").alias("theirs")), F.struct(F.xxhash64("node"), "node"))

    def proposals() -> Iterator[DataFrame]:
        for part in rounds(shape[1], rules, rows, size):
            with Round(units) as table:
                keyed = table(hashed(units, rules, shape, part, rules.seed + 1, ["node"]), "keys")
                picks = keyed.groupBy("key").agg(first.alias("pick"), F.count(F.lit(1)).alias("n"))
                picks = table(picks.where("n > 1").select("key", "pick.*"), "picks")
                met = spread_join(keyed, picks, "key", "node").where(F.col("node") != F.col("leader"))
                met = met.where(differing_bits(F.col("sketch"), F.col("theirs")) <= near)
                yield met.select("node", "leader")

    def followed(pairs: DataFrame, name: str, known: DataFrame | None = None) -> DataFrame:
        """(node, leader, radius): each node's first leader among the pairs within theta / 2."""
        both = cosines(pairs.select(F.col("node").alias("x"), F.col("leader").alias("y")), units, rules, rows, size)
        both = both.select(F.col("x").alias("node"), F.col("y").alias("leader"), angle("cosine").alias("radius"))
        both = both.where(F.col("radius") <= rules.theta / 2 - SLACK)
        both = both.unionByName(known) if known else both
        best = F.min_by(F.struct("leader", "radius"), F.struct(F.xxhash64("leader"), "leader"))
        return written(both.groupBy("node").agg(best.alias("best")).select("node", "best.*"), name)

    held = followed(gathered(proposals(), "proposals"), "vector-leaders")
    for _ in range(rules.jumps):
        onward = held.select(F.col("node").alias("leader"), F.col("leader").alias("next"))
        jumped = spread_join(held.select("node", "leader"), onward, "leader", "node")
        jumped = jumped.where("node <> next").select("node", F.col("next").alias("leader"))
        held = followed(written(jumped.distinct(), "vector-jumps"), "vector-leaders", held)
    sizes = held.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rules.crowd).select("leader")
    return written(spread_join(held, written(sizes, "vector-sizes"), "leader", "node"), "vector-crowds")


def by_group(rows: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`work` on the rows of some groups and their bounds; groups are of a bounded size, those of a batch are held at a time."""
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            ids = np.stack([table.column(c).to_numpy() for c in keys])
            starts = np.concatenate(([0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1))
            if len(starts) > 1:
                yield from work(table.slice(0, starts[-1]), starts)
            held = table.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from work(held, np.array([0, held.num_rows]))

    return dealt.mapInArrow(run, schema)


def class_pairs(members: DataFrame, crowded: DataFrame, rules: Vectors, rows: int, size: int) -> DataFrame:
    """(x, y), x < y, of classes that may have links; members has class, single and unit, crowded those of leaders."""
    shape = rules.shape(rows)
    short = min(rules.bits, 128)
    alone = members.where("single").select("class", F.lit(0.0).alias("radius"), "unit")
    many = members.where("NOT single").select("class", "unit")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, m in by_length(batch.column("unit"), rules.stored):
                bits = pa.array([s.tobytes() for s in sketch_of(m, rules.bits, rules.seed)], pa.binary())
                columns = [batch.column(c).take(pa.array(at)) for c in ("class", "radius")]
                yield pa.RecordBatch.from_arrays([*columns, bits], ["class", "radius", "sketch"])

    sketched = crowded.select("class", "radius", "unit").mapInArrow(sketch, "class bigint, radius double, sketch binary")
    sketched = written(sketched, "vector-sketches")

    # bits that may differ, by the radii of a pair in sixteenths of theta (rounded up)
    angles = rules.theta + SLACK + np.arange(35) * rules.theta / 16
    few, all_bits = (rules.differing(angles, n).astype(np.uint16) for n in (short, rules.bits))

    def likely(part: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        us, vs, own, name, radius = (part.column(c).to_numpy() for c in ("u", "v", "own", "class", "radius"))
        bits = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint64).reshape(len(own), -1)
        wide = np.minimum(np.ceil(radius * 16 / rules.theta), 17).astype(np.uint8)

        def close(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            near = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= all_bits[wide[x] + wide[y]]
            x, y = name[x[near]], name[y[near]]
            pairs = np.stack([np.minimum(x, y), np.maximum(x, y)])[:, x != y]
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["x", "y"])

        start, size = bounds[:-1], np.diff(bounds)
        small = (size <= 64) & (us[start] == vs[start])
        # the pairs of small groups: each row with the later ones of its group
        later = np.where(np.repeat(small, size), np.repeat(bounds[1:], size) - np.arange(len(own)) - 1, 0)
        for k in range(0, len(own), 4096):
            n = later[k : k + 4096]
            x = k + np.repeat(np.arange(len(n)), n)
            if len(x):
                yield close(x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n))
        for first, end in zip(start[~small], bounds[1:][~small]):
            u, v = us[first], vs[first]
            a, b = first + np.flatnonzero(own[first:end] == u), first + np.flatnonzero(own[first:end] == v)
            words, xs, ys = [np.ascontiguousarray(w) for w in bits[b, : short // 64].T], [], []
            for k in range(0, len(a), 64):  # small matrices stay in the cache
                some = a[k : k + 64]
                after = k if u == v else 0
                apart = np.zeros((len(some), len(b) - after), np.uint8)
                for one, two in zip(bits[some].T, words):
                    apart += np.bitwise_count(one[:, None] ^ two[after:])
                i, j = np.nonzero(apart <= (few[wide[some][:, None] + wide[b[after:]]] if wide[first:end].any() else few[0]))
                xs.append(some[i])
                ys.append(b[after:][j])
            if len(a):
                yield close(np.concatenate(xs), np.concatenate(ys))

    def met() -> Iterator[DataFrame]:
        for part in rounds(shape[1], rules, rows, size):
            with Round(members) as table:
                # a class has one row a bucket, whatever the number of its members there
                met = table(hashed(many, rules, shape, part, rules.seed, ["class"], sketched=False).distinct(), "crowd-keys")
                counts = hashed(alone, rules, shape, part, rules.seed, [], sketched=False).unionByName(met.select("key"))
                counts = counts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rules.block)
                counts = table(counts.selectExpr("key", f"CAST(ceil(n / {rules.block}) AS INT) AS blocks"), "counts")
                met = spread_join(met, sketched, "class", "key").select("key", "sketch", "class", "radius")
                met = hashed(alone, rules, shape, part, rules.seed, ["class", "radius"]).unionByName(met)
                met = met.join(counts, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
                met = met.withColumn("own", F.expr("CAST(pmod(xxhash64(class, 3), blocks) AS INT)"))
                met = met.withColumn("other", F.expr("explode(sequence(0, blocks - 1))"))
                met = met.select("key", F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v"), "own", "class", "radius", "sketch")
                yield by_group(met, ["key", "u", "v"], likely, "x bigint, y bigint")

    return gathered(met(), "pairs")


def member_links(open_pairs: DataFrame, members: DataFrame, crowded: DataFrame, rules: Vectors, rows: int, size: int) -> DataFrame:
    """(node, class, to, n): links of each member of a class with the members of class `to`, for (class, to) pairs."""
    mine = members.select("node", "class")
    pairs = spread_join(mine, open_pairs, "class", "node").select(F.col("node").alias("x"), F.col("to").alias("y"))
    met = cosines(written(pairs, "vector-open"), either(members, crowded), rules, rows, size)
    met = met.select(F.col("x").alias("node"), F.col("y").alias("to"), angle("cosine").alias("apart")).join(mine, "node")
    theirs = crowded.select(F.col("class").alias("to"), F.col("radius").alias("r"), "size")
    met = spread_join(met, theirs, "to", "node", "left").withColumns({"r": F.coalesce("r", F.lit(0.0)), "size": F.coalesce("size", F.lit(1))})
    met = met.where(F.col("apart") - F.col("r") <= rules.theta + SLACK)
    met = written(met.select("node", "class", "to", "r", "size", "apart"), "vector-met")
    sure = F.col("apart") + F.col("r") <= rules.theta - SLACK
    settled = met.where(sure).select("node", "class", "to", F.col("size").alias("n"))
    asked = met.where(~sure)
    block = 4 * rules.block
    counts = asked.groupBy("to").agg(F.count(F.lit(1)).alias("asking"), F.first("size").alias("size"))
    blocks = f"CAST(ceil(asking / {block}) AS INT) AS us", f"CAST(ceil(size / {block}) AS INT) AS vs"
    counts = written(counts.selectExpr("*", *blocks), "vector-asking")
    left = spread_join(asked.select("node", "class", "to"), counts, "to", "node")
    left = left.select("to", F.expr("CAST(pmod(xxhash64(node, class, 5), us) AS INT)").alias("u"), F.expr("explode(sequence(0, vs - 1))").alias("v"), F.lit(True).alias("asks"), "node", "class")
    right = spread_join(mine.withColumnRenamed("class", "to"), counts, "to", "node")
    right = right.select("to", F.expr("explode(sequence(0, us - 1))").alias("u"), F.expr("CAST(pmod(xxhash64(node, 5), vs) AS INT)").alias("v"), F.lit(False).alias("asks"), "node", F.col("to").alias("class"))

    def compare(part: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start, end in zip(bounds[:-1], bounds[1:]):
            group = part.slice(start, end - start)
            asks = group.column("asks").to_numpy()
            m = scaled(group.column("unit").to_pylist(), rules.stored)
            some, other = m[asks], m[~asks].T
            n = [(some[i : i + 512] @ other >= rules.cosine).sum(axis=1, dtype=np.int64) for i in range(0, len(some), 512)]
            n = np.concatenate([np.zeros(0, np.int64), *n])
            columns = [*[group.filter(pa.array(asks)).column(c).combine_chunks() for c in ("node", "class", "to")], pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "class", "to", "n"]).filter(pa.array(n > 0))

    meetings = counts.agg(F.sum(F.expr("asking * vs + size * us"))).first()[0] or 0
    n = max(1, math.ceil(meetings * (size // max(1, rows) + 32) / max(size, rules.round_mb << 20)))
    out = settled
    for i in range(n if meetings else 0):
        now = left.unionByName(right).where(F.pmod(F.xxhash64("to", "u"), F.lit(n)) == i)
        now = by_group(now.join(members.select("node", "unit"), "node"), ["to", "u", "v"], compare, "node bigint, class bigint, to bigint, n bigint")
        out = out.unionByName(written(now, "vector-compared"))
    return out


def either(members: DataFrame, crowded: DataFrame) -> DataFrame:
    """(node, unit) of vectors by their number, and of the leaders of crowds by the name of the crowd."""
    return members.select("node", "unit").unionByName(crowded.select(F.col("class").alias("node"), "unit"))


def linked(units: DataFrame, rules: Vectors, first: Round, kept: Round) -> DataFrame:
    """node, n_links and root (the least class of its component) of (node, unit) rows; `first`, their table, ends here."""
    rows, size = units.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("unit")), F.lit(0))).first()
    crowd = crowds(units, rules, rows, size)
    members = units.join(crowd, "node", "left")
    members = members.select("node", F.coalesce("leader", "node").alias("class"), "unit", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.col("leader").isNotNull().alias("crowded"))
    # a leader need not follow itself, so a crowd is named by the negative of its leader
    members = members.withColumn("class", F.expr("IF(crowded, -class - 1, class)")).withColumn("single", ~F.col("crowded"))
    members = kept.table(members, "vector-members")
    first.end()
    crowded = members.where("NOT single").groupBy("class").agg(F.count(F.lit(1)).alias("size"), F.max("radius").alias("radius"))
    crowded = crowded.withColumn("node", F.expr("-class - 1")).join(members.select("node", "unit"), "node")
    crowded = kept.table(crowded.select("class", "size", "radius", "unit"), "vector-classes")
    pairs = class_pairs(members, crowded, rules, rows, size)
    both = cosines(pairs, either(members, crowded), rules, rows, size).withColumnsRenamed({"x": "a", "y": "b"})

    def side(name: str) -> DataFrame:
        return crowded.select(F.col("class").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("size", "radius")])

    both = spread_join(spread_join(both, side("a"), "a", "b", "left"), side("b"), "b", "a", "left")
    both = both.withColumns({f"size_{c}": F.coalesce(f"size_{c}", F.lit(1)) for c in "ab"})
    both = both.withColumns({f"radius_{c}": F.coalesce(f"radius_{c}", F.lit(0.0)) for c in "ab"}).withColumn("apart", angle("cosine"))
    near = both.where(F.col("apart") - F.col("radius_a") - F.col("radius_b") <= rules.theta + SLACK)
    near = written(near, "vector-near")
    ones = (F.col("a") >= 0) & (F.col("b") >= 0)
    all_linked = F.when(ones, F.col("cosine") >= rules.cosine).otherwise(F.col("apart") + F.col("radius_a") + F.col("radius_b") <= rules.theta - SLACK)
    whole = near.where(all_linked)
    split = near.where(~ones & ~all_linked)
    split = split.select(F.col("a").alias("class"), F.col("b").alias("to")).unionByName(split.select(F.col("b").alias("class"), F.col("a").alias("to")))
    some = written(member_links(split, members, crowded, rules, rows, size), "vector-some")
    per_class = whole.select(F.col("a").alias("class"), F.col("size_b").alias("n")).unionByName(whole.select(F.col("b").alias("class"), F.col("size_a").alias("n")))
    per_class = per_class.groupBy("class").agg(F.sum("n").alias("others"))
    edges = whole.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(some.select(F.col("class").alias("x"), F.col("to").alias("y")))
    roots = components(edges)
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    info = members.groupBy("class").agg(F.count(F.lit(1)).alias("size"))
    info = info.join(per_class, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    info = info.select("class", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("inner"), F.coalesce("root", "class").alias("root"))
    more = some.groupBy("node").agg(F.sum("n").alias("more"))
    out = spread_join(members.select("node", "class"), written(info, "vector-info"), "class", "node").join(more, "node", "left")
    return out.select("node", (F.col("inner") + F.coalesce("more", F.lit(0))).cast("bigint").alias("n_links"), "root")


def vector_table(vectors: DataFrame, rules: Vectors = Vectors()) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding)."""
    narrow = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    rules = replace(rules, stored="f4" if narrow else "f8")
    first, kept = Round(vectors), Round(vectors)
    rows = numbered(packed(vectors, rules), f"{first.folder}/vector-units", "node")
    ids = written(rows.select("node", "vec_id"), "vector-ids")
    found = written(linked(rows.where("unit IS NOT NULL").select("node", "unit"), rules, first, kept), "vector-links")
    kept.end()
    named = written(ids.join(found, "node", "left"), "vector-named")
    alone = named.where("root IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    named = named.where("root IS NOT NULL")
    least = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    grouped = spread_join(named, least, "root", "node").select("vec_id", "n_links", "component_id")
    stays = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return grouped.unionByName(alone).select("vec_id", "n_links", "component_id", stays)


def keep_one_vector_each(vectors: DataFrame, rules: Vectors = Vectors()) -> DataFrame:
    """The ids of the vectors that stand for their component: the least of each."""
    return vector_table(vectors, rules).where("kept").select("vec_id").distinct()
