"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of n-grams of tokens: hashed words and marks, and their shapes, one to three in a
row. Each feature is scaled by the log ratio of its smoothed counts in the two classes, and a linear hinge-loss model
is fitted to the scaled indicators by dual coordinate descent. Margins become scores by a logistic curve fitted on
rows that the model was not fitted on.

The fit takes at most about ``max_train`` labelled rows, chosen by the hash of their id: 4,000 by default. That
bounds the driver's share; the weights are one array of fixed length. Every row is scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardflow.llm import textkernel as tk

MAX_TRAIN = 4_000
BITS = 18
U = np.uint64

#: Class of each byte: 0 white, 1 small letter, 2 capital, 3 digit, 4 beyond ASCII, 5 mark
_CLASS = np.full(256, 5, dtype=np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_WORDY = (_CLASS > 0) & (_CLASS < 5)
_MARK = _CLASS == 5


def _tokens(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = kind[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = off[1:] > off[:-1]
        first[off[:-1][full]] = inside[off[:-1][full]]
        last[off[1:][full] - 1] = inside[off[1:][full] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct feature numbers of each text, and offsets."""
    data, off = tk.text_bytes(column)
    low = tk.LOWER[data]
    ws, we = _tokens(data, off, _WORDY)
    ms, me = _tokens(data, off, _MARK)
    starts, ends = np.concatenate([ws, ms]), np.concatenate([we, me])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    mark = order >= len(ws)
    h = tk.word_hashes(low, starts, ends)
    capital = np.concatenate([[0], np.cumsum(_CLASS[data] == 2)])
    digit = np.concatenate([[0], np.cumsum(_CLASS[data] == 3)])
    n_cap, n_digit, n = capital[ends] - capital[starts], digit[ends] - digit[starts], ends - starts
    # shapes: marks as they are; else digits, capitals only, a capital first, small; and if the token repeats the last word
    shape = np.where(n_digit > 0, 3, np.where((n_cap > 1) & (2 * n_cap >= n), 2, np.where(n_cap > 0, 1, 0))).astype(U)
    shape = np.where(mark, h, tk.mix(shape + U(11)))
    owner = np.searchsorted(off, starts, side="right") - 1
    found, whose = [], []

    def add(x: np.ndarray, o: np.ndarray, salt: int) -> None:
        found.append(tk.mix(x ^ tk.mix(np.full(1, salt, dtype=U))[0]) >> U(64 - bits))
        whose.append(o)

    add(h, owner, 1)
    if len(h) > 1:
        two = owner[1:] == owner[:-1]
        add((tk.mix(h[:-1]) + h[1:])[two], owner[1:][two], 2)
        add((tk.mix(shape[:-1]) + shape[1:])[two], owner[1:][two], 3)
        again = two & (h[1:] == h[:-1])
        add(np.full(int(again.sum()), 5, dtype=U), owner[1:][again], 4)
    if len(h) > 2:
        three = owner[2:] == owner[:-2]
        add((tk.mix(tk.mix(shape[:-2]) + shape[1:-1]) + shape[2:])[three], owner[2:][three], 5)
        add((tk.mix(shape[:-2] + U(3)) + shape[2:])[three], owner[2:][three], 6)
    key = np.concatenate(whose).astype(np.int64) << bits | np.concatenate(found).astype(np.int64)
    key = np.unique(key)
    return key & ((1 << bits) - 1), np.searchsorted(key >> bits, np.arange(len(off)))


@dataclass(frozen=True)
class Model:
    """Weight of each feature, its squared scale, bias, and slope and shift of the logistic curve."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, x: np.ndarray, off: np.ndarray) -> np.ndarray:
        return _by_text(self.weights, x, off) / _norms(self.squares, x, off) + self.bias

    def scores(self, x: np.ndarray, off: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(x, off) + self.shift, -30, 30)))


def _by_text(values: np.ndarray, x: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values[x], dtype=np.float64)])
    return total[off[1:]] - total[off[:-1]]


def _norms(squares: np.ndarray, x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Lengths of scaled texts; margins are taken at length 1, so that long texts don't rule."""
    return np.sqrt(np.maximum(_by_text(squares, x, off), 1e-9))


def fit(x: np.ndarray, off: np.ndarray, y: np.ndarray, bits: int = BITS, c: float = 1.0, passes: int = 6, seed: int = 7) -> Model:
    """Fit on four fifths of the rows; the rest sets the logistic curve."""
    n, width = len(y), 1 << bits
    if n == 0 or y.min() == y.max():
        share = (y.sum() + 1.0) / (n + 2.0)
        return Model(np.zeros(width, np.float32), np.zeros(width, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    held, rows = order[: n // 5], order[n // 5 :]
    if len({*y[rows].tolist()}) < 2 or len({*y[held].tolist()}) < 2:
        held = rows = order
    of = np.repeat(np.arange(n), np.diff(off))
    used = np.isin(np.arange(n), rows)[of]
    good = 1.0 + np.bincount(x[used & (y[of] > 0)], minlength=width)
    bad = 1.0 + np.bincount(x[used & (y[of] < 1)], minlength=width)
    r = np.log(good / good.sum()) - np.log(bad / bad.sum())
    squares = r * r
    norm = _norms(squares, x, off)
    # hinge loss, dual: 0 <= alpha <= upper; the bias is the weight of a feature that every text has
    w, bias, alpha, sign = np.zeros(width), 0.0, np.zeros(n), np.where(y > 0, 1.0, -1.0)
    share = np.array([(y[rows] < 1).mean(), (y[rows] > 0).mean()])
    upper = c / (2 * share)  # classes weigh the same
    for _ in range(passes):
        for i in rng.permutation(rows).tolist():
            f = x[off[i] : off[i + 1]]
            v = r[f] / norm[i]
            old, k = alpha[i], int(y[i] > 0)
            length = (1.0 if len(f) else 0.0) + 1.0
            new = min(max(old - (sign[i] * (w[f] @ v + bias) - 1.0) / length, 0.0), upper[k])
            if new != old:
                alpha[i] = new
                step = (new - old) * sign[i]
                w[f] += step * v
                bias += step
    model = Model((w * r).astype(np.float32), squares.astype(np.float32), float(bias), 1.0, 0.0)
    ho = np.concatenate([[0], np.cumsum(np.diff(off)[held])])
    hx = np.concatenate([x[off[i] : off[i + 1]] for i in held.tolist()]) if len(held) else x[:0]
    slope, shift = _logistic(model.margins(hx, ho), y[held])
    return Model(model.weights, model.squares, model.bias, slope, shift)


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's steps, with targets drawn in a little."""
    t = np.where(y > 0, (y.sum() + 1.0) / (y.sum() + 2.0), 1.0 / ((1 - y).sum() + 2.0))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        v = p * (1 - p) + 1e-6
        grad = np.array([((p - t) * m).sum() + 1e-3 * a, (p - t).sum()])
        hess = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 0.0), b


def remainder(id_col: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col) if isinstance(id_col, str) else id_col, F.lit("")).cast("string")), F.lit(mod))


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in tk.slices(batches, "text"):
        x, off = features(part.column("text"))
        x = x.astype("<i4")
        yield pa.RecordBatch.from_arrays([part.column("y"), pa.array([x[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())], ["y", "x"])


def train(docs: DataFrame, labels: DataFrame, keep: Column, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model of labelled rows for which ``keep`` holds. Null labels count as none; an id labelled both ways is left out; of an id with several texts, the first in order teaches."""
    tk.for_long_rows(docs.sparkSession)
    ids = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null")
    ids = ids.where(keep).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("doc_id", "y")
    # the bound: at most max_train ids, so that broadcasting them is bounded too
    some = F.broadcast(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(some, "doc_id")
    encoded = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")).mapInArrow(tk.lean(_encoded), "y int, x binary")
    model = _fitted(encoded.toArrow())
    tk.trim()
    return model


def _fitted(got: pa.Table) -> Model:
    """Rows come in any order, so they are sorted by what they hold."""
    x = [np.frombuffer(b.as_buffer(), "<i4") for b in got.column("x")]
    y = np.asarray(got.column("y"), dtype=np.int64)
    order = sorted(range(len(x)), key=lambda i: (x[i].tobytes()[:64], len(x[i]), int(y[i])))
    off = np.concatenate([[0], np.cumsum([len(x[i]) for i in order])]).astype(np.int64)
    return fit(np.concatenate([x[i] for i in order]) if order else np.zeros(0, np.int32), off, y[order])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", name: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and the score, from 0 to 1; a column of its name goes. Null texts are scored as empty ones."""
    docs = docs.drop(name)
    at = docs.schema.fieldNames().index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches, text_col):
            scores = model.scores(*features(part.column(at)))
            names = [*part.schema.names, name]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names)

    return docs.mapInArrow(tk.lean(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, threshold: float = 0.3, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Learns from labelled rows whose crc32 of the id modulo ``fold`` isn't ``held``. predicted is 1 if score reaches
    ``threshold``. Without labels, or with labels of one class only, every score is the smoothed share of ones.
    Repeated rows come back as often, and teach once; a null id counts as an empty one for the fold, and teaches nothing.
    Very long texts are read whole. Other columns are not looked at. An empty table gives no rows.
    """
    model = train(docs, labels, remainder("doc_id", fold) != held, max_train)
    rows = docs.select("doc_id", (remainder("doc_id", fold) == held).alias("held_out"), F.col("text").cast("string").alias("text"))
    return score(rows, model).select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
