"""Benchmark decontamination by a distributed positional inverted index.

The index is split by documents: a shard is a run of whole documents with the positions of each term, in order, as
(term, position) keys. Shards are stored as Parquet rows. A phrase is looked up in every shard: the positions of its
rarest term there, shifted to where the phrase would begin, are intersected with those of the other terms, also
shifted, from the rarest on. A proximity match asks that an item's rarest terms, by their postings in the whole index,
lie close to each other. Terms that surely no test item has are left out of the index: a table of fixed size tells.

Test items are taken in blocks of bounded size, one after the other, whatever their number; each block goes to the
tasks as it is.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardflow.llm import textkernel as tk
from boardflow.plans.staging import Rounds, staged

WINDOW = 13
#: Terms of an item that a proximity match looks for, and how many words they may lie from the rarest.
RAREST, SPAN = 4, 30
#: Bytes of text in a shard, and of test items in a block.
SHARD = 1 << 21
BLOCK = 4 << 20
#: What stands for a null id of an item.
NO_ID = -(1 << 63)
#: Bits of the table of terms that items may have.
ASKED_BITS = 23
INDEX = "shard long, docs binary, offsets binary, keys binary, terms binary"
U = np.uint64


@dataclass(frozen=True)
class Phrases:
    """Items of a block as one run of term numbers; terms are sorted hashes.

    A phrase is ``sizes`` words from ``first`` on, of the item with the id in ``items``. rare: the items' rarest terms,
    a row for each item of ``ids``, filled up with -1.
    """

    terms: np.ndarray
    code: np.ndarray
    first: np.ndarray
    sizes: np.ndarray
    items: np.ndarray
    ids: np.ndarray
    rare: np.ndarray

    def rows(self, some: np.ndarray) -> np.ndarray:
        """Term numbers of some phrases, filled up with -1."""
        wide = int(self.sizes.max(initial=0))
        at = self.first[some][:, None] + np.arange(wide)
        return np.where(np.arange(wide) < self.sizes[some][:, None], self.code[np.minimum(at, len(self.code) - 1)], -1)


def _items(texts: list[str | None]) -> tk.Words:
    return tk.words(pa.array(texts, pa.string()), tk.ALNUM)


def windows(ids: list[int], texts: list[str | None], size: int = WINDOW) -> Phrases:
    """Every run of ``size`` words of an item; an item of fewer, but not none, is one phrase."""
    w = _items(texts)
    terms, code = np.unique(w.hashes, return_inverse=True)
    n = w.counts
    made = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(n)), made)
    first = np.arange(made.sum()) - np.repeat(np.cumsum(made) - made - w.off[:-1], made)
    ids = np.array(ids, dtype=np.int64)
    return Phrases(terms, code.astype(np.int32), first, np.minimum(n, size)[owner], ids[owner], ids, np.zeros((len(ids), 0), dtype=np.int64))


def rarest(p: Phrases, texts: list[str | None], counts: np.ndarray, most: int) -> np.ndarray:
    """Each item's different terms of the fewest postings, ties by their bytes; filled up with -1."""
    w = _items(texts)
    data, _ = tk.text_bytes(pa.array(texts, pa.string()))
    _, at = np.unique(w.hashes, return_index=True)
    words = [tk.LOWER[data[s:e]].tobytes() for s, e in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)]
    rank = np.empty(len(words), dtype=np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    pairs = np.unique(w.owner * max(1, len(words)) + p.code)
    item, term = pairs // max(1, len(words)), pairs % max(1, len(words))
    order = np.lexsort((rank[term], counts[term], item))
    item, term = item[order], term[order]
    nth = np.arange(len(item)) - np.searchsorted(item, item)
    out = np.full((len(p.ids), most), -1, dtype=np.int64)
    out[item[nth < most], nth[nth < most]] = term[nth < most]
    return out


def asked(items: DataFrame) -> np.ndarray:
    """A table of 2**ASKED_BITS bits, packed: which hashes of terms items may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << ASKED_BITS, dtype=bool)
        for part in tk.slices(batches, "text"):
            bits[_spot(tk.words(part.column("text"), tk.ALNUM).hashes)] = True
        packed = np.packbits(bits, bitorder="little").view("<i8")
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at])], ["word", "bits"])

    got = items.select("text").mapInArrow(tk.lean(run), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    packed = np.zeros((1 << ASKED_BITS) // 64, dtype="<i8")
    packed[np.asarray(got.column("word"))] = np.asarray(got.column("bits"))
    return packed.view(np.uint8)


def _spot(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - ASKED_BITS)).astype(np.int64)


def index(docs: DataFrame, maybe: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards with the postings of all terms, or of those that the table of :func:`asked` marks.

    Null texts are documents without words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = TaskContext.get().partitionId() << 32
        bits = None if maybe is None else np.unpackbits(maybe, bitorder="little").view(bool)
        for part in tk.slices(batches, "text", SHARD):
            w = tk.words(part.column("text"), tk.ALNUM)
            at = np.arange(len(w.hashes)) if bits is None else np.flatnonzero(bits[_spot(w.hashes)])
            some, code = np.unique(w.hashes[at], return_inverse=True)
            keys = np.sort(code.astype(U) << U(32) | at.astype(U))
            blobs = (np.asarray(part.column("doc_id")).astype("<i8"), w.off.astype("<i8"), keys.astype("<u8"), some.astype("<u8"))
            yield pa.RecordBatch.from_arrays([pa.array([nth], pa.int64()), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], ["shard", "docs", "offsets", "keys", "terms"])
            nth += 1

    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tk.lean(run), INDEX)


class Shard:
    """One shard's postings."""

    def __init__(self, docs: bytes, offsets: bytes, keys: bytes, terms: bytes, asked: np.ndarray):
        self.docs, self.off, self.keys = np.frombuffer(docs, "<i8"), np.frombuffer(offsets, "<i8"), np.frombuffer(keys, "<u8")
        own = np.frombuffer(terms, "<u8")
        self.number = np.searchsorted(own, asked)
        if len(own):
            self.number[own[np.minimum(self.number, len(own) - 1)] != asked] = len(own)
        self.first = np.searchsorted(self.keys, self.number.astype(U) << U(32))
        self.count = np.searchsorted(self.keys, (self.number + 1).astype(U) << U(32)) - self.first

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(term), dtype=bool)
        key = self.number[term].astype(U) << U(32) | np.maximum(place, 0).astype(U)
        at = np.searchsorted(self.keys, key)
        return (place >= 0) & (self.keys[np.minimum(at, len(self.keys) - 1)] == key)

    def postings(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, position) of the postings of each row's term."""
        n = self.count[term]
        row = np.repeat(np.arange(len(term)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[term], n)
        return row, (self.keys[at] & U(0xFFFFFFFF)).astype(np.int64)

    def phrase(self, p: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, start, document) of every occurrence."""
        none = np.concatenate([[0], np.cumsum(self.count[p.code] == 0)])
        live = np.flatnonzero(none[p.first + p.sizes] == none[p.first])
        rows = p.rows(live)
        much = np.where(rows >= 0, self.count[rows], np.iinfo(np.int64).max)
        order = np.argsort(much, axis=1, kind="stable")  # from the rarest term on
        which = order[:, 0]
        row, place = self.postings(rows[np.arange(len(live)), which])
        start = place - which[row]
        for j in range(1, rows.shape[1]):
            if not len(row):
                break
            which = order[row, j]
            term = rows[row, which]
            keep = (term < 0) | self.has(np.maximum(term, 0), start + which)
            row, start = row[keep], start[keep]
        doc = np.searchsorted(self.off, np.maximum(start, 0), side="right") - 1
        phrase = live[row]
        keep = (start >= 0) & (start + p.sizes[phrase] <= self.off[np.minimum(doc + 1, len(self.off) - 1)])
        return phrase[keep], start[keep], doc[keep]

    def near(self, p: Phrases, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, document, position of the rarest term) wherever all of an item's rare terms lie at most ``span`` words from it."""
        live = np.flatnonzero((p.rare[:, 0] >= 0) & ((p.rare < 0) | (self.count[p.rare] > 0)).all(axis=1))
        rare = p.rare[live]
        row, place = self.postings(rare[:, 0])
        doc = np.searchsorted(self.off, place, side="right") - 1
        lo, hi = np.maximum(place - span, self.off[doc]), np.minimum(place + span + 1, self.off[doc + 1])
        for j in range(1, rare.shape[1]):
            term = rare[row, j]
            k = self.number[term].astype(U) << U(32)
            ok = (term < 0) | (np.searchsorted(self.keys, k | hi.astype(U)) > np.searchsorted(self.keys, k | lo.astype(U)))
            row, place, doc, lo, hi = row[ok], place[ok], doc[ok], lo[ok], hi[ok]
        return live[row], doc, place


def _shards(batches: Iterator[pa.RecordBatch], asked: np.ndarray) -> Iterator[tuple[int, Shard]]:
    for part in batches:
        for row in range(part.num_rows):
            n, *blobs = (part.column(i)[row].as_py() for i in range(5))
            yield n, Shard(*blobs, asked)


def _counted(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), dtype=np.int64)
        for _, shard in _shards(batches, terms):
            total += shard.count
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    return run


def _lists(n: int, doc: np.ndarray, values: np.ndarray) -> list[list[int]]:
    """The different values of each document."""
    out: list[list[int]] = [[] for _ in range(n)]
    if len(doc):
        for d, v in np.unique(np.stack([doc, values], axis=1), axis=0).tolist():
            out[d].append(v)
    return out


def _found(p: Phrases, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nth, shard in _shards(batches, p.terms):
            n = len(shard.docs)
            phrase, start, doc = shard.phrase(p) if len(p.first) else (np.zeros(0, dtype=np.int64),) * 3
            edge = np.zeros(int(shard.off[-1]) + 1, dtype=np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + p.sizes[phrase], -1)
            inside = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
            # spans end with their document: a hit lies in one, but two may touch
            ends = np.isin(np.arange(len(inside) - 1), shard.off)
            s = np.flatnonzero(inside[1:] & (~inside[:-1] | ends))
            e = np.flatnonzero(inside[:-1] & (~inside[1:] | ends))
            owner = np.searchsorted(shard.off, s, side="right") - 1
            spans: list[list] = [[] for _ in range(n)]
            for d, a, b in zip(owner.tolist(), s.tolist(), e.tolist(), strict=True):
                base = int(shard.off[d])
                spans[d].append({"from": a - base, "to": b - base})
            item, near_doc, place = shard.near(p, span) if p.rare.shape[1] else (np.zeros(0, dtype=np.int64),) * 3
            near: list[dict[int, int]] = [{} for _ in range(n)]
            for i, d, at in zip(p.ids[item].tolist(), near_doc.tolist(), (place - shard.off[near_doc]).tolist(), strict=True):
                near[d][i] = min(at, near[d].get(i, at))
            pairs = [[{"item": i, "at": at} for i, at in sorted(one.items())] for one in near]
            ids = pa.array(shard.docs, pa.int64(), mask=shard.docs == -(2**63))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, nth)), pa.array(np.arange(n)), ids, pa.array(np.diff(shard.off)), pa.array(spans, _SPANS), pa.array(_lists(n, doc, p.items[phrase]), pa.list_(pa.int64())), pa.array(pairs, _NEAR)],
                ["shard", "nth", "doc_id", "n_words", "spans", "items", "near"],
            )

    return run


_SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
_NEAR = pa.list_(pa.struct([("item", pa.int64()), ("at", pa.int64())]))
_MATCHES = "shard long, nth long, doc_id long, n_words long, spans array<struct<from:long,to:long>>, items array<long>, near array<struct<item:long,at:long>>"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of spans and items, of as many blocks as there were."""
    for part in batches:
        hit, n, sha, close = [], [], [], []
        for spans, items, near in zip(*(part.column(c).to_pylist() for c in ("spans", "items", "near")), strict=True):
            total, upto = 0, 0
            for s in sorted(spans, key=lambda s: s["from"]):
                total += max(0, s["to"] - max(s["from"], upto))
                upto = max(upto, s["to"])
            some = sorted({str(i) for i in items})
            hit.append(total), n.append(len(some)), sha.append(hashlib.sha256(",".join(some).encode()).hexdigest()), close.append(len({m["item"] for m in near}))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_words"), pa.array(hit, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(close, pa.int64())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "n_near"])


def blocks_of(rows: DataFrame, most: int = BLOCK) -> Iterator[tuple[list[int], list[str]]]:
    """(item_id, text) in blocks of about ``most`` bytes, one at a time; one at least."""
    n = math.ceil((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / most) or 1
    for i in range(n):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text").collect()
        yield [r["item_id"] for r in got], [r["text"] for r in got]


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, most: int = BLOCK, rare: int = RAREST, span: int = SPAN, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(shard, nth, doc_id, n_words, spans, items, near) of every document.

    spans: words inside any occurrence of a window; items: whose windows these are; near: items whose ``rare`` rarest
    terms lie at most ``span`` words from the rarest of them, and its first such place, in words from 0. Rarity is
    counted over all documents; items of fewer different terms are looked up with what they have. Items without an id
    give spans, but are not in the lists; those without a text take no part, repeated ones count once; a very long
    item is in one block.
    """
    tk.for_long_rows(docs.sparkSession)
    rows = items.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    stored = staged(index(docs, asked(rows)), "postings")

    def named(out: DataFrame) -> DataFrame:
        lists = {"items": F.filter("items", lambda i: i != NO_ID), "near": F.filter("near", lambda m: m["item"] != NO_ID)}
        return out.withColumns(lists)

    def found(ids: list[int], texts: list[str]) -> DataFrame:
        p = windows(ids, texts, window)
        if rare and len(p.terms):
            counts = np.zeros(len(p.terms), dtype=np.int64)
            got = stored.mapInArrow(tk.lean(_counted(p.terms)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
            counts[np.asarray(got.column("term"))] = np.asarray(got.column("n"))
            p = Phrases(p.terms, p.code, p.first, p.sizes, p.items, p.ids, rarest(p, texts, counts, rare))
        return stored.mapInArrow(tk.lean(_found(p, span)), _MATCHES)

    blocks = blocks_of(rows, most)
    first = found(*next(blocks))
    second = next(blocks, None)
    if second is None:
        return named(first)
    every = Rounds(docs.sparkSession, "blocks")  # written, so that the driver holds one block at a time
    every.add(first)
    while second is not None:
        every.add(found(*second))
        second = next(blocks, None)
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near")]
    return named(every.all().groupBy("shard", "nth", "doc_id", "n_words").agg(*lists))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, most: int = BLOCK, rare: int = RAREST, span: int = SPAN) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near) of every row.

    A word is hit if it lies inside any occurrence of a window of an item; contaminated: some word is, and
    ``share`` * n_hit >= n_words. n_near counts the items with a proximity match, which decides nothing here. Items
    without an id hit words, but are not counted. A null or empty text has no words; items without words match nothing, and without items nothing is hit. Very long texts
    are read whole. Repeated rows come back as often. Other columns are not looked at. An empty table gives no rows.
    """
    out = matches(docs, items, window, most, rare, span).select("doc_id", "n_words", "spans", "items", "near")
    out = out.mapInArrow(tk.lean(_joined), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, n_near long")
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "n_near")


def proximity(docs: DataFrame, items: DataFrame, rare: int = RAREST, span: int = SPAN, most: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, at) of the proximity matches of :func:`matches`, one for each document and item."""
    found = matches(docs, items, most=most, rare=rare, span=span)
    return found.select("doc_id", F.explode("near").alias("m")).select("doc_id", F.col("m.item").alias("item_id"), F.col("m.at").alias("at"))
