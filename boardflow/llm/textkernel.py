"""Words, shingles and hashes of whole Arrow columns of text, in numpy.

Texts are handled as UTF-8 bytes. Every byte from 0x80 belongs to a character outside ASCII, so the two word
patterns used here can be decided byte by byte. Hashes depend on nothing but the bytes, so that every executor
and every retry agrees.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_STEP = 100_000  # words hashed at once

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]+
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: 0-9, a-z and all beyond ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= _M1
    x ^= x >> U(27)
    x *= _M2
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``most`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """Words of several texts in order; those of text i are off[i]:off[i+1]."""

    starts: np.ndarray
    ends: np.ndarray
    off: np.ndarray
    hashes: np.ndarray | None

    def __len__(self) -> int:
        return len(self.off) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, eight bytes at a time."""
    out = np.empty(len(starts), dtype=U)
    for at in range(0, len(starts), _STEP):
        s, e = starts[at : at + _STEP], ends[at : at + _STEP]
        first = int(s[0])
        part = np.zeros(int(e[-1]) - first + 8, dtype=np.uint8)
        part[:-8] = data[first : int(e[-1])]
        eight = np.ndarray(len(part) - 7, dtype="<u8", buffer=part.data, strides=(1,)).copy()
        left = e - s
        h = left.astype(U) * _M2
        place, live = s - first, None
        while len(place):
            got = eight[place]
            short = left < 8
            got[short] &= (U(1) << (U(8) * left[short].astype(U))) - U(1)
            if live is None:
                h = mix(h ^ got)
                live = np.flatnonzero(left > 8)
                place, left = place[live] + 8, left[live] - 8
            else:
                h[live] = mix(h[live] ^ got)
                more = left > 8
                live, place, left = live[more], place[more] + 8, left[more] - 8
        out[at : at + _STEP] = h
    return out


def words(column: pa.Array, kind: np.ndarray, lower: bool = True, hashed: bool = True) -> Words:
    """Words of each text: longest runs of bytes that ``kind`` marks, A-Z lower-cased if asked."""
    data, off = text_bytes(column)
    if lower:
        data = LOWER[data]
    inside = kind[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = off[1:] > off[:-1]
        first[off[:-1][full]] = inside[off[:-1][full]]
        last[off[1:][full] - 1] = inside[off[1:][full] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(starts, ends, np.searchsorted(starts, off), word_hashes(data, starts, ends) if hashed else None)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words, and offsets by text; a text of fewer words, but not none, gives one of them all."""
    n, counts = len(w.hashes), w.counts
    out = np.zeros(n, dtype=U)
    if n >= k:
        h = np.zeros(n - k + 1, dtype=U)
        for i in range(k):
            h = mix(h + w.hashes[i : n - k + 1 + i] + U(i + 1))
        out[: n - k + 1] = h
    keep = np.ones(n, dtype=bool)
    ends = w.off[1:]
    for back in range(1, k):  # no run starts in a text's last k - 1 words
        at = ends[counts >= back] - back
        keep[at] = False
    few = np.flatnonzero((counts > 0) & (counts < k))
    for i in few:
        s, h = int(w.off[i]), np.array([0xA5A5 + int(counts[i])], dtype=U)
        for j in range(s, int(w.off[i + 1])):
            h = mix(h * _M1 + w.hashes[j : j + 1])
        keep[s], out[s] = True, h[0]
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    return out[keep], np.concatenate([[0], np.cumsum(made)])


def distinct(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes sorted and without repeats."""
    h = h.copy()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), dtype=bool)
    if len(h):
        keep[1:] = h[1:] != h[:-1]
        keep[off[:-1][off[1:] > off[:-1]]] = True
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def sums(h: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Sum modulo 2**64 of the hashes that share a place; exact for fewer than 2**21 hashes in one place."""
    low = np.bincount(place, weights=(h & U(0xFFFFFFFF)).astype(np.float64), minlength=n)
    high = np.bincount(place, weights=(h >> U(32)).astype(np.float64), minlength=n)
    return low.astype(U) + (high.astype(U) << U(32))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving the memory it has used back to the system: workers wait for further tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def trim() -> None:
    """Give memory that is free back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def for_long_rows(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows, where the session has Spark's 10,000: those of long texts take tens of MB, twice."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")
