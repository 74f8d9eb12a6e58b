"""Exact top-k search by inner product over a bit-sliced index.

Rows are dealt into blocks. In a block, each vector component, shifted to be non-negative, is a set of slices: the
bitmap of slice j has the rows whose value has bit j. A query adds up slices by bitmap arithmetic: those of component
d once for each bit of |q_d|, complemented where q_d is negative, through carry-save adders, so the slices of every
row's score come out at once. The largest scores are then found from the most significant slice downward, as bitmaps
of rows surely in and rows still tied. The rows left, those tied at the boundary among them, are resolved by their exact
inner products and ids. Slices are only as many as the block's values need.

Queries, a stated set, meet all rows in blocks: a task takes a block of rows and a block of queries, and what it sends
on is k rows for each query.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boardflow.plans.staging import staged

#: Rows in a block, and queries.
ROWS = 1 << 16
QUERIES = 128
U = np.uint64


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of integers; a shorter vector has zeros at its end."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    off = np.asarray(vectors.offsets).astype(np.int64)
    flat = np.asarray(vectors.values)[off[0] : off[-1]].astype(np.int64)
    size = np.diff(off)
    out = np.zeros((len(size), int(size.max(initial=0))), dtype=np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(off[:-1] - off[0], size)] = flat
    return out


class Slices:
    """The bit-sliced index of a block."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)
        self.words = -(-self.n // 64)
        low = x.min(axis=0, initial=0)
        shifted = x - low
        self.depth = [int(m).bit_length() for m in shifted.max(axis=0, initial=0)]
        self.slices = [[self._bitmap(shifted[:, d] >> j & 1) for j in range(n)] for d, n in enumerate(self.depth)]
        self.all = self._bitmap(np.ones(self.n, dtype=np.int64))
        self.flipped = [[s ^ self.all for s in one] for one in self.slices]

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        return np.packbits(np.pad(bits.astype(np.uint8), (0, self.words * 64 - self.n)), bitorder="little").view("<u8")

    def total(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices of the inner product with q, up to a constant of the query."""
        level: list[list[np.ndarray]] = []

        def put(w: int, s: np.ndarray) -> None:
            while len(level) <= w:
                level.append([])
            level[w].append(s)

        for d, v in enumerate(q.tolist()[: len(self.depth)]):
            use = self.slices[d] if v > 0 else self.flipped[d]
            for b in range(abs(v).bit_length()):
                if abs(v) >> b & 1:
                    for j, s in enumerate(use):
                        put(b + j, s)
        out, w = [], 0
        while w < len(level):
            at = level[w]
            while len(at) > 2:
                a, b, c = at.pop(), at.pop(), at.pop()
                ab = a ^ b
                carry = a & b
                carry |= ab & c
                ab ^= c
                at.insert(0, ab) if len(at) < 3 else at.append(ab)
                put(w + 1, carry)
            if len(at) == 2:
                a, b = at
                put(w + 1, a & b)
                out.append(a ^ b)
            else:
                out.append(at[0] if at else np.zeros(self.words, dtype="<u8"))
            w += 1
        return out

    def among(self, total: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
        """Bitmap of the rows with the k largest scores, all that tie with the last of them included."""
        sure, tied = np.zeros(self.words, dtype="<u8"), allowed
        have = 0
        for s in reversed(total):
            high = tied & s
            n = have + int(np.bitwise_count(high).sum())
            if n > k:
                tied = high
            else:
                sure = sure | high
                have = n
                tied = tied & ~s
                if n == k:
                    return sure
        return sure | tied

    def rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])


def _searched(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if block.num_rows and queries.num_rows:
            ids, qids = np.asarray(block.column("vec_id")), np.asarray(queries.column("query_id"))
            x, q = _matrix(block.column("v")), _matrix(queries.column("v"))
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            index = Slices(x)
            wide = min(x.shape[1], q.shape[1])
            for one, qid in zip(q, qids.tolist(), strict=True):
                allowed = index.all
                own = slice(*np.searchsorted(ids, [qid, qid + 1]).tolist())
                if own.start < own.stop:  # the query's own row is no candidate
                    mask = np.ones(index.n, dtype=np.int64)
                    mask[own] = 0
                    allowed = index._bitmap(mask)
                found = index.rows(index.among(index.total(one), allowed, k))
                exact = x[found][:, :wide] @ one[:wide]
                best = np.lexsort((ids[found], -exact))[:k]
                out += [(qid, int(ids[found[i]]), int(exact[i])) for i in best.tolist()]
        cols = list(zip(*out, strict=True)) or [[]] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    return run


def quantised(column: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component, or null if the vector is null or holds null or non-finite components."""
    v = F.col(column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNotNull() & ~bad, F.transform(v, lambda x: F.floor(x * scale).cast("long")))


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row where ``queries`` holds.

    Ties go to the smaller id. Rows without an id, and vectors that are null or hold null or non-finite components,
    take no part. An empty vector scores 0 with all; of vectors of different lengths, the common components count.
    A query never meets its own id. Rows that repeat an id with the same vector are candidates once, with another vector
    each by itself; as a query, an id counts once, with the smallest of its vectors. Fewer rows are given where there are fewer candidates. Other columns are not looked
    at. An empty table gives no rows. Scores are exact while they fit in 62 bits.
    """
    rows = staged(vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(vector_col, scale).alias("v"), queries.alias("q")).where("vec_id is not null and v is not null").dropDuplicates(["vec_id", "v"]), "vectors")
    n, m = rows.agg(F.count("*"), F.count_distinct(F.when(F.col("q"), F.col("vec_id")))).first()
    blocks = max(1, math.ceil(n / ROWS))
    # where rows are many, a task takes more queries too, so that fewer copies of a block are sent
    groups = max(1, math.ceil(m / (QUERIES * max(1, min(64, blocks)))))
    parts = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("long").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    asked = rows.where("q").groupBy("vec_id").agg(F.min("v").alias("v")).select(F.col("vec_id").alias("query_id"), "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("block"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int").alias("part"))
    best = parts.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(_searched(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows a block at most
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
