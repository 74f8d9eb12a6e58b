"""Line dedup by hashes of line runs.

A text's lines are hashed. From each line on, the shortest run of lines with at least ``min_words`` words is a unit,
and so is the shortest such run that ends with a line; units are hashed as a whole, and all are fingerprints. So every
line of a repeated passage of ``min_words`` words, of however few or short lines, lies in a unit that repeats with it:
one that starts at a line of the passage, or the one that ends with it. Each occurrence of a fingerprint is joined
with the first one (by doc_id, then line), never with all others. The match is extended both ways along its diagonal
as far as lines agree, and the run is deleted where it occurs later. The first occurrence stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardflow.llm import textkernel as tk
from boardflow.plans.staging import staged

MIN_WORDS = 50
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_NEWLINE = np.ones(256, dtype=bool)
_NEWLINE[0x0A] = False


def lines_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and word count of each line that has words, and offsets by text. Lines are compared by their words."""
    w = tk.words(column, tk.SPACED, lower=False)
    data, _ = tk.text_bytes(column)
    breaks = np.flatnonzero(data == 0x0A)
    # words in the same text with as many line breaks before them are one line
    line = np.searchsorted(breaks, w.starts) if len(w.starts) else np.zeros(0, dtype=np.int64)
    owner = w.owner
    first = np.ones(len(owner), dtype=bool)
    first[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    count = np.diff(np.concatenate([at, [len(owner)]]))
    nth = np.arange(len(owner)) - np.repeat(at, count)
    h = tk.mix(tk.sums(tk.mix(w.hashes + tk.mix(nth.astype(np.uint64))), np.cumsum(first) - 1, len(at)) + count.astype(np.uint64))
    return h, count, np.searchsorted(owner[at], np.arange(len(w) + 1))


def units(h: np.ndarray, count: np.ndarray, off: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start lines, counted from 0 in each text, and hashes of the units of several texts, and offsets by text."""
    n = len(h)
    total = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    line = np.arange(n)
    end = np.searchsorted(total, total[:-1] + min_words)
    start = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    ahead, behind = end <= off[1:][owner], start >= off[:-1][owner]
    both = np.unique(np.stack([np.concatenate([line[ahead], start[behind]]), np.concatenate([end[ahead], line[behind] + 1])], axis=1), axis=0)
    s, e = both[:, 0], both[:, 1]
    # a run's hash is a polynomial in its lines, as a difference of sums from the slice's first line on
    powers, backs = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x)])) for x in (_BASE, _BACK))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * powers[:-1])])
    unit = tk.mix((sums[e] - sums[s]) * backs[s] + (e - s).astype(np.uint64))
    return (s - off[:-1][owner[s]]).astype(np.int32), unit.view(np.int64), np.searchsorted(s, off)


def _lines(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches, "text"):
            h, count, off = lines_of(part.column("text"))
            starts, hashes, at = units(h, count, off, min_words)
            arrays, counts = [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                arrays.append(h[a:b].astype("<u8").tobytes()), counts.append(count[a:b].astype("<i4").tobytes())
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(c)) for c in (starts, hashes)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("v"), pa.array(arrays, pa.binary()), pa.array(counts, pa.binary()), *lists], ["doc_id", "v", "lines", "words", "starts", "units"])

    return run


def _extended(min_words: int):
    """Runs of lines that agree along a diagonal: what to delete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = []
            for doc, v, first, shift, lines, words, other in zip(*(part.column(c).to_pylist() for c in ("doc_id", "v", "first", "shift", "lines", "words", "other")), strict=True):
                a, b, n = np.frombuffer(lines, "<u8"), np.frombuffer(other, "<u8"), np.frombuffer(words, "<i4")
                lo, hi = max(0, -shift), min(len(a), len(b) - shift)
                same = np.concatenate([[False], a[lo:hi] == b[lo + shift : hi + shift], [False]])
                edge = np.flatnonzero(same[1:] != same[:-1]) + lo
                total = np.concatenate([[0], np.cumsum(n)])
                out += [(doc, v, s, e, first) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if total[e] - total[s] >= min_words]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "v", "from", "to", "first"])

    return run


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        texts, kept, gone, gone_words = [], [], [], []
        for text, runs in zip(part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True):
            drop = {i for r in runs or [] for i in range(r["from"], r["to"])}
            out, n, lost, words = [], -1, 0, 0
            for line in (text or "").split("\n"):
                got = line.encode().split()
                n += bool(got)
                if got and n in drop:
                    lost += 1
                    words += len(got)
                else:
                    out.append(line)
            texts.append(text if not lost else "\n".join(out))
            kept.append(n + 1 - lost), gone.append(lost), gone_words.append(words)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), pa.array(kept, pa.int64()), pa.array(gone, pa.int64()), pa.array(gone_words, pa.int64())], ["doc_id", "text", "n_lines", "n_removed", "words_removed"])


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, v, from, to, first): runs of lines with words, counted from 0, that occur before, in document ``first``.

    v, a hash of the text, tells texts of one id apart.
    """
    tk.for_long_rows(docs.sparkSession)
    texts = _texts(docs, id_col, text_col).where("doc_id is not null and text is not null")
    lines = staged(texts.mapInArrow(tk.lean(_lines(min_words)), "doc_id long, v int, lines binary, words binary, starts array<int>, units array<long>").dropDuplicates(["doc_id", "v"]), "lines")
    spots = lines.select("doc_id", "v", F.explode(F.arrays_zip("starts", "units")).alias("u")).select("doc_id", "v", F.col("u.starts").alias("at"), F.col("u.units").alias("unit"))
    # written, so that the join deals both sides anew and a very common unit can be split
    firsts = staged(spots.groupBy("unit").agg(F.min(F.struct("doc_id", "v", "at")).alias("f"), F.count("*").alias("n")).where("n > 1").select("unit", "f"), "firsts")
    later = spots.join(firsts, "unit").where("struct(doc_id, v, at) <> f")
    diagonals = later.select("doc_id", "v", F.col("f.doc_id").alias("first"), F.col("f.v").alias("w"), (F.col("f.at") - F.col("at")).alias("shift")).distinct()
    matched = diagonals.join(lines.select("doc_id", "v", "lines", "words"), ["doc_id", "v"]).join(lines.select(F.col("doc_id").alias("first"), F.col("v").alias("w"), F.col("lines").alias("other")), ["first", "w"])
    return matched.select("doc_id", "v", "first", "shift", "lines", "words", "other").mapInArrow(tk.lean(_extended(min_words)), "doc_id long, v int, from int, to int, first long")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.withColumn("v", F.hash("text"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_removed, words_removed) of every row, later repeats of passages gone from text.

    n_lines counts the lines left that have words. Lines agree if their words do; words are split at ASCII white
    space. A null text stays null; rows without an id stay as they are. Repeated rows of one id and text are one
    document: they are treated alike; another text of the same id is another document. A line that belongs to no
    repeated run of ``min_words`` words stays, whatever its count. Very long texts are compared whole. An empty table
    gives no rows. Other columns of ``docs`` are not looked at.
    """
    runs = repeated_runs(docs, min_words, id_col, text_col)
    runs = staged(runs.groupBy("doc_id", "v").agg(F.collect_set(F.struct("from", "to")).alias("runs")), "runs")
    # dealt by id at every size, so that the plan doesn't turn from broadcast to shuffle as runs get many
    both = _texts(docs, id_col, text_col).join(runs.hint("merge"), ["doc_id", "v"], "left").select("doc_id", "text", "runs")
    return both.mapInArrow(tk.lean(_rebuilt), "doc_id long, text string, n_lines long, n_removed long, words_removed long")
