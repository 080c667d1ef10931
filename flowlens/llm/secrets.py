"""Secret scan with an incremental blob ledger.

Every version of every text is addressed by the SHA-256 of its content (a blob). The ledger remembers which
(blob, rule, version) were scanned; an update scans each unseen pair once, however many documents or commits
hold the blob, and a rule with a new version is scanned alone. Findings belong to blobs and are joined back to
all paths that hold them.

Base rules `assign`, `access` and `hex` are matched leftmost, without overlap, each by itself; matches that are
too short are dropped. `jwt`, `pem` and `github` are further rules. Spans are in code points, end exclusive.
Null texts count as empty. Repeated rows get equal findings; an empty table leaves the ledger as it is.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import tokens as K
from flowlens.llm.work import shared_folder, written
from flowlens.shipping import ship

ship(__name__)

# Rules in the order in which kinds are listed, each with its version, pattern and the least length
# of a group's match. The patterns of the base kinds are given.
RULES = {
    "assign": (1, r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (1, r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (1, r"[0-9a-f]+", 0, 24),
    "jwt": (1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    "pem": (1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    "github": (1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
}
BASE = ("assign", "access", "hex")
ANCHORS = {
    "assign": (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"),
    "access": (b"akia",),
    "jwt": (b"eyj",),
    "pem": (b"-----begin ",),
    "github": (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"),
}
FOLD = bytes(K.LOWER)
HEX = np.zeros(256, bool)
HEX[[*range(48, 58), *range(97, 103)]] = True

FINDINGS = "blob binary, rule string, version int, start int, stop int"
SCANNED = "blob binary, rule string, version int"


def _compiled() -> dict[str, re.Pattern]:
    fold = {"assign": re.IGNORECASE | re.ASCII}
    return {name: re.compile(pattern, fold.get(name, 0)) for name, (_, pattern, _, _) in RULES.items()}


def find(rule: str, pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Spans of a rule in a text."""
    _, _, group, least = RULES[rule]
    return [m.span() for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def long_runs(data: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """Does each document touch a run of `least` hexadecimal digits? Runs are taken over the documents' ends."""
    inside = np.concatenate(([0], HEX[data].astype(np.int8), [0]))
    change = np.diff(inside)
    starts, stops = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    long = stops - starts >= least
    cover = np.zeros(len(data) + 1, np.int64)
    np.add.at(cover, starts[long], 1)
    np.add.at(cover, stops[long], -1)
    return K.sums(np.cumsum(cover)[:-1] > 0, offsets) > 0


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(blob, text, todo) -> FINDINGS; todo lists the rules to scan the text for."""
    patterns = _compiled()
    for batch in batches:
        data, offsets = K.utf8(batch.column("text"))
        blobs, todo = batch.column("blob"), batch.column("todo").to_pylist()
        out: list[tuple] = []
        for a, b in K.chunks(offsets):
            chunk = data[offsets[a] : offsets[b]]
            hexed = long_runs(chunk, offsets[a : b + 1] - offsets[a], RULES["hex"][3])
            for i in range(a, b):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                low, text = raw.translate(FOLD), None
                for rule in todo[i]:
                    if not (hexed[i - a] if rule == "hex" else any(x in low for x in ANCHORS[rule])):
                        continue
                    text = raw.decode() if text is None else text
                    for start, stop in find(rule, patterns[rule], text):
                        out.append((blobs[i].as_py(), rule, RULES[rule][0], start, stop))
        columns = list(zip(*out)) if out else [[]] * 5
        kinds = [pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        names = ["blob", "rule", "version", "start", "stop"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class Ledger:
    """Scanned pairs and findings as Parquet tables under a shared folder; updates append."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._table("scanned", SCANNED)

    def findings(self) -> DataFrame:
        """Findings of the present rule versions; an update that was cut off and run again adds nothing twice."""
        rules = F.create_map(*[F.lit(x) for name, rule in RULES.items() for x in (name, rule[0])])
        return self._table("findings", FINDINGS).where(F.col("version") == rules[F.col("rule")]).distinct()

    def update(self, versions: DataFrame) -> None:
        """Scan what is unseen of the texts (column text) under the present rules, and remember it.

        Texts are reduced to one per blob before and after their shuffle. Findings are stored before the
        pairs, so that a failure in between leads to a new scan and never to a lost finding.
        """
        texts = versions.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
        texts = texts.groupBy("blob").agg(F.first("text").alias("text"))
        wanted = [F.lit(f"{name}:{rule[0]}") for name, rule in RULES.items()]
        seen = self.scanned()
        if seen.isEmpty():
            todo = texts.withColumn("pairs", F.array(*wanted))
        else:
            done = seen.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "version")).alias("done"))
            left = F.array_except(F.array(*wanted), F.coalesce("done", F.array().cast("array<string>")))
            todo = texts.join(done, "blob", "left").withColumn("pairs", left).where("size(pairs) > 0")
        todo = todo.withColumn("todo", F.transform("pairs", lambda p: F.substring_index(p, ":", 1)))
        found = todo.select("blob", "text", "todo").mapInArrow(self._scan_and_mark, FINDINGS)
        found = written(found, "secret-scan")
        batch = uuid.uuid4().hex
        found.where("start >= 0").write.parquet(f"{self.folder}/findings/{batch}")
        found.where("start < 0").select("blob", "rule", "version").write.parquet(f"{self.folder}/scanned/{batch}")

    @staticmethod
    def _scan_and_mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Findings, and for every scanned pair a row that starts at -1."""

        def marks(batch: pa.RecordBatch) -> pa.RecordBatch:
            todo = batch.column("todo")
            rules = todo.flatten().to_pylist()
            sizes = np.diff(np.asarray(todo.offsets))
            blobs = batch.column("blob").take(pa.array(np.repeat(np.arange(len(batch)), sizes)))
            versions = pa.array([RULES[r][0] for r in rules], pa.int32())
            none = pa.array(np.full(len(rules), -1, np.int32))
            return pa.RecordBatch.from_arrays(
                [blobs, pa.array(rules, pa.string()), versions, none, none],
                names=["blob", "rule", "version", "start", "stop"],
            )

        for batch in batches:
            yield marks(batch)
            yield from scan_batches(iter([batch]))


def secret_table(docs: DataFrame, ledger: Ledger) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of every document, after an update of the ledger."""
    paths = docs.select("doc_id", blob_of(F.col("text")).alias("blob"))
    ledger.update(docs.select("text"))
    kinds = F.array(*[F.lit(name) for name in RULES])
    found = ledger.findings().withColumn("place", F.array_position(kinds, F.col("rule")))
    spans = F.sort_array(F.collect_list(F.struct("start", "place", "rule", "stop")))
    listed = found.groupBy("blob").agg(spans.alias("all"))

    def text_of(items: Column) -> Column:
        parts = F.transform(items, lambda s: F.concat_ws(":", s["rule"], s["start"], s["stop"]))
        return F.array_join(parts, ",")

    base = F.filter("all", lambda s: s["place"] <= len(BASE))
    counts = [F.size(F.filter("all", lambda s: s["rule"] == k)).cast("bigint").alias(f"n_{k}") for k in BASE]
    digest = F.sha2(text_of(base).cast("binary"), 256).alias("base_sha256")
    listed = written(listed.select("blob", *counts, digest, text_of(F.col("all")).alias("spans")), "secret-blobs")
    out = paths.join(listed, "blob", "left")
    return out.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in BASE],
        F.coalesce("base_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def fresh_ledger(spark: SparkSession) -> Ledger:
    return Ledger(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
