"""Words, shingles and per-document sums over a batch of texts, as numpy arrays.

A batch is one array of UTF-8 bytes and the offsets of its documents. Words are runs of bytes other than
space, tab, line feed, vertical tab, form feed and carriage return. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from flowlens.shipping import ship

ship(__name__)

CHUNK_BYTES = 1 << 20  # texts are worked on in chunks of about so many bytes; one document is never cut
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SEED = np.random.RandomState(20240101)
BYTE_CODE = _SEED.randint(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
SLOT_CODE = _SEED.randint(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than documents, from 0) of a string column; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about `limit` bytes; at least one row each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Words:
    """Word bounds of the documents of a chunk, and what document each word is of."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        solid = ~SPACE[data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begins[inner] = solid[inner]
        ends[inner - 1] = solid[inner - 1]
        self.solid = solid
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.starts, offsets)  # words of document i: bounds[i] to bounds[i + 1]
        self.counts = np.diff(self.bounds)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, fold: bool) -> np.ndarray:
        """A 64-bit hash per word; `fold` makes A-Z equal to a-z."""
        return span_hashes(LOWER[self.data] if fold else self.data, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans ascend and do not overlap."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    length = ends - starts
    where = np.repeat(starts - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
    at = where - np.repeat(starts, length)
    power = np.cumprod(np.full(int(length.max()) + 1, BASE, np.uint64))
    terms = BYTE_CODE[data[where]] * power[at]
    filled = length > 0
    sums = np.zeros(len(starts), np.uint64)
    if filled.any():
        first = np.concatenate(([0], np.cumsum(length)[:-1]))[filled]
        sums[filled] = np.add.reduceat(terms, first)
    return mix(sums + length.astype(np.uint64) * SLOT_CODE[15])


def shingles(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, document) of every `size`-word window; windows do not cross documents."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = words.doc()
    first = np.flatnonzero(doc[:n] == doc[size - 1 :])
    total = np.zeros(len(first), np.uint64)
    for j in range(size):
        total += hashes[first + j] * SLOT_CODE[j % 15] + np.uint64(j // 15)
    return mix(total), first, doc[first]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i."""
    running = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return running[bounds[1:]] - running[bounds[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is the key found elsewhere in the array, is an equal key found earlier) for each key."""
    n = len(keys)
    often, later = np.zeros(n, bool), np.zeros(n, bool)
    if n > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        often[order[1:]] |= same
        often[order[:-1]] |= same
        later[order[1:]] = same
    return often, later
