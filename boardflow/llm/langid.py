"""Language identification by word-first backoff.

A word known from the training texts counts with its log frequency in each language. An unseen word falls back to its
character n-grams, beginning with the longest: the first length of which some n-gram is known decides, by their mean
log frequency; one word boundary on either side is part of the n-grams. A text's language has the largest sum. Words
are runs of letters, as Unicode has them, in lower case.

The fit reads at most about ``max_train`` texts: 8,000 by default, shared evenly by the languages, whose texts are
chosen by the hash of their id. So a rare language stays in the model whatever the size of the table. That bounds the
model: it keeps words seen twice or more, and n-grams seen four times or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardflow.llm import textkernel as tk
from boardflow.llm.quality import remainder

MAX_TRAIN = 8_000
#: Texts of a language at least, however many languages share them.
LEAST = 20
LONGEST = 5
U = np.uint64


def letters(column: pa.Array) -> pa.Array:
    """Texts in lower case, with a space for what isn't a letter."""
    return pc.replace_substring_regex(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")), pattern=r"\PL+", replacement=" ")


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the n-grams of words, given as places in UTF-8 bytes, and the words that they are of; n from 1 on.

    A word has a space before and after it, which alone is no n-gram.
    """
    size = ends - starts + 1
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - starts, size)
    flat = data[np.minimum(at, max(0, len(data) - 1))]
    flat[np.cumsum(size) - 1] = 0x20
    points = np.frombuffer((b" " + flat.tobytes()).decode().encode("utf-32-le"), "<u4").astype(U)
    blank = points == 0x20
    spaces = np.flatnonzero(blank)
    upto = np.cumsum(blank)  # spaces so far: the word that a place is of, or before
    h = np.zeros(len(points), dtype=U)
    for n in range(1, LONGEST + 1):
        if n > len(points):
            return
        i = np.arange(len(points) - n + 1)
        h = tk.mix(h[: len(i)] + points[n - 1 :] * U(0x9E3779B97F4A7C15) + U(n))
        ok = (upto[i] < len(spaces)) & (i + n - 1 <= spaces[np.minimum(upto[i], len(spaces) - 1)])
        if n == 1:
            ok &= ~blank
        yield h[ok], upto[i[ok]] - 1


@dataclass(frozen=True)
class Table:
    """Items as sorted hashes, and a row of logs for each; one more of zeros for items that aren't known."""

    items: np.ndarray
    logs: np.ndarray

    def rows(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, row) of each hash."""
        if not len(self.items):
            return np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.items, h), len(self.items) - 1)
        known = self.items[at] == h
        return known, np.where(known, at, len(self.items))


@dataclass(frozen=True)
class Model:
    """Tables of words and of n-grams, n from 1 on, and logs of the languages' shares."""

    languages: list[str]
    tables: list[Table]
    priors: np.ndarray

    def fall_back(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros((len(starts), len(self.languages))), np.ones(len(starts), dtype=bool)
        for table, (h, owner) in reversed(list(zip(self.tables[1:], grams(data, starts, ends), strict=False))):
            known, row = table.rows(h)
            known &= open_[owner]
            of = owner[known]
            n = np.bincount(of, minlength=len(starts))
            for k in range(len(self.languages)):
                out[:, k] += np.bincount(of, weights=table.logs[row[known], k], minlength=len(starts)) / np.maximum(n, 1)
            open_ &= n == 0
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and its share of all, of every text; texts without letters are ``und`` and 0."""
        clean = letters(column)
        w = tk.words(clean, tk.SPACED, lower=False)
        if not self.languages:
            return ["und"] * len(w), np.zeros(len(w))
        known, row = self.tables[0].rows(w.hashes)
        logs = self.tables[0].logs[row]
        new = np.flatnonzero(~known)
        if len(new):
            _, first, back = np.unique(w.hashes[new], return_index=True, return_inverse=True)
            data, _ = tk.text_bytes(clean)
            logs[new] = self.fall_back(data, w.starts[new[first]], w.ends[new[first]])[back]
        some = w.counts > 0
        total = np.tile(self.priors, (len(w), 1))
        if some.any():
            total[some] += np.add.reduceat(logs, w.off[:-1][some], axis=0)
        p = np.exp(np.clip(total - total.max(axis=1, keepdims=True), -700, 0))
        best = total.argmax(axis=1)
        score = np.where(some, p[np.arange(len(p)), best] / p.sum(axis=1), 0.0)
        return [self.languages[i] if s else "und" for i, s in zip(best.tolist(), some.tolist(), strict=True)], score


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, item, lang, times) for words (n = 0) and n-grams, summed up in the task."""
    held: dict[tuple[int, str], list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        items, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return items, np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(items)).astype(np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        for (n, lang), parts in held.items():
            items, times = summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(items), n, dtype=np.int32)), pa.array(items.view(np.int64)), pa.array([lang] * len(items), pa.string()), pa.array(times)], ["n", "item", "lang", "times"])

    for part in tk.slices(batches, "text"):
        langs = part.column("lang").to_pylist()
        clean = letters(part.column("text"))
        w, (data, _) = tk.words(clean, tk.SPACED, lower=False), tk.text_bytes(clean)
        owner = w.owner
        for lang in sorted(set(langs)):
            at = np.flatnonzero(np.array([v == lang for v in langs])[owner])
            if not len(at):
                continue
            items, first, times = np.unique(w.hashes[at], return_index=True, return_counts=True)
            held.setdefault((0, lang), []).append((items, times))
            for n, (h, of) in enumerate(grams(data, w.starts[at[first]], w.ends[at[first]]), 1):
                held.setdefault((n, lang), []).append(summed([(h, times[of])]))
                size += len(held[n, lang][-1][0])
        if size > 2_000_000:
            held = {k: [summed(v)] for k, v in held.items()}
            size = sum(len(v[0][0]) for v in held.values())
            if size > 1_000_000:
                yield from out()
                held, size = {}, 0
    yield from out()


def train(docs: DataFrame, keep: Column, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of rows for which ``keep`` holds, with a text and a language."""
    tk.for_long_rows(docs.sparkSession)
    rows = docs.where(keep).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.lit("langid")).alias("h"))
    found = sorted(map(tuple, rows.groupBy("lang").agg(F.count("*").alias("n")).collect()))
    each = max(LEAST, max_train // max(1, len(found)))
    # hashes up to the share of each language, of all 64 bits: it is never rounded down to none
    share = F.broadcast(docs.sparkSession.createDataFrame([(k, -(2.0**63) + min(1.0, each / n) * 2.0**64) for k, n in found], "lang string, upto double"))
    texts = rows.join(share, "lang").where(F.col("h").cast("double") <= F.col("upto")).select("lang", "text")
    priors = dict(found)
    counts = texts.mapInArrow(tk.lean(_counted), "n int, item long, lang string, times long").groupBy("n", "item", "lang").agg(F.sum("times").alias("times"))
    languages = sorted(priors)
    # items seen too rarely in all go before they are collected; the rest is bounded by the texts read
    per = counts.groupBy("n", "item").agg(F.sum("times").alias("all"), *(F.sum(F.when(F.col("lang") == k, F.col("times")).otherwise(0)).alias(f"c{i}") for i, k in enumerate(languages)))
    got = per.where((F.col("n") == 0) & (F.col("all") >= 2) | (F.col("n") > 0) & (F.col("all") >= 4)).drop("all").toArrow()
    n, items = np.asarray(got.column("n")), np.asarray(got.column("item")).view(U)
    table = np.stack([np.asarray(got.column(f"c{i}")) for i in range(len(languages))], axis=1).astype(float) if languages else np.zeros((0, 0))
    tables = []
    for i in range(LONGEST + 1):
        at = np.flatnonzero(n == i)
        at = at[np.argsort(items[at])]
        c = table[at] + 0.5
        tables.append(Table(items[at], np.concatenate([np.log(c / c.sum(axis=0)), np.zeros((1, len(languages)))])))
    p = np.array([priors[k] for k in languages], dtype=float)
    return Model(languages, tables, np.log(p / p.sum()) if len(p) else p)


def identify(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """All columns of ``docs`` and two more; of the same names, those of ``docs`` go.

    A text that is null or has no letters is ``und``, score 0. Very long texts are read whole.
    """
    docs = docs.drop(*names)
    at = docs.schema.fieldNames().index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches, text_col):
            lang, score = model.predict(part.column(at))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, *names])

    return docs.mapInArrow(tk.lean(run), T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def language_id(docs: DataFrame, fold: int = 4, held: int = 2, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    Learns from rows with a text and a language whose crc32 of the id modulo ``fold`` isn't ``held``; without any,
    all is ``und``. Ties go to the language that sorts first. Repeated rows come back as often; a null id counts as
    an empty one for the fold. Other columns are not looked at. An empty table gives no rows.
    """
    model = train(docs, remainder("doc_id", fold) != held, max_train)
    rows = docs.select("doc_id", (remainder("doc_id", fold) == held).alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
