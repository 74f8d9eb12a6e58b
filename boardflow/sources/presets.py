"""Boards in text files: a comment line, then a board line."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from boardflow.functions import boards as P

BOARD = "w int, h int, gx int, gy int, restricted boolean, goal boolean, blocks array<int>"


def schema() -> T.StructType:
    return T.StructType.fromDDL(BOARD)


def _numbered(df: DataFrame, start: str) -> DataFrame:
    """Lines with that start, numbered in file order; a preset file is one small file, and its lines one partition."""
    order = Window.orderBy("file", "line")
    return df.where(F.col("value").startswith(start)).withColumn("idx", F.row_number().over(order)).drop("file", "line")


def read(spark: SparkSession, path: str, permissive: bool = False) -> DataFrame:
    """(idx, name, text, board columns) of a file, or of a folder's files in order of their names.

    Unless ``permissive``, nothing if any board is bad or comments don't match; else every good board, with the last
    comment before it in its file.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    if permissive:
        name = F.last(F.when(F.col("value").startswith("#"), F.trim(F.substring("value", 2, 10_000))), True).over(Window.partitionBy("file").orderBy("line"))
        rows = _numbered(lines.withColumn("name", name), "S").withColumnRenamed("value", "text")
    else:
        names, texts = _numbered(lines, "#"), _numbered(lines, "S")
        rows = names.select("idx", F.trim(F.substring("value", 2, 10_000)).alias("name")).join(texts.withColumnRenamed("value", "text"), "idx", "full")
    rows = rows.withColumn("b", P.from_text(F.col("text"))).select((F.col("idx") - 1).alias("idx"), "name", "text", "b.*")
    good = F.col("w").isNotNull() & P.dims_valid() & P.invalid_reason().isNull() & F.col("name").isNotNull()
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    if not permissive:
        rows = rows.withColumn("good", F.min("good").over(Window.partitionBy()))
    return rows.where("good").drop("good")


def _write(spark: SparkSession, folder: str, lines: list[str], overwrite: bool = False) -> None:
    """The lines as the folder's next file: names count up, so that the order of files is that of their writing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if overwrite:
        fs.delete(where, True)
    fs.mkdirs(where)
    n = sum(f.getPath().getName().endswith(".puzzle") for f in fs.listStatus(where))
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n:08d}.puzzle"), False)
    try:
        out.write(bytearray("".join(lines), "utf-8"))
    finally:
        out.close()


def append(boards: DataFrame, path: str, validate: bool = True) -> bool:
    """Add (name, board columns) to a folder of preset files, after those that are there, in order of name.

    With ``validate``, nothing is written and the answer is no if any board is invalid. Presets are made by people, and
    few.
    """
    rows = boards.select("name", P.to_text().alias("text"), P.invalid_reason().alias("reason")).orderBy("name", "text").collect()
    if validate and any(r["reason"] is not None for r in rows):
        return False
    _write(boards.sparkSession, path, [f"\n# {r['name']}\n{r['text']}" for r in rows])
    return True


def export(clusters: DataFrame, path: str) -> int:
    """Replace a folder by (idx, name, text), in order of idx; the number of boards."""
    n, lines = 0, []
    spark = clusters.sparkSession
    _write(spark, path, [], overwrite=True)
    for r in clusters.orderBy("idx").toLocalIterator():
        lines.append(f"\n# {r['name']}\n{r['text']}")
        n += 1
        if len(lines) == 100_000:
            _write(spark, path, lines)
            lines = []
    _write(spark, path, lines)
    return n


def neighbour(idx: int, step: int, n: int) -> int:
    """The preset before or after, around the ends."""
    return (idx + step) % n


@dataclass(frozen=True)
class Cycle:
    """The presets of a file or folder, one of them the current one."""

    path: str
    presets: tuple[Row, ...]
    at: int = 0

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Cycle:
        return cls(path, tuple(read(spark, path).orderBy("idx").collect()))

    @property
    def current(self) -> Row:
        return self.presets[self.at]

    def next(self) -> Cycle:
        return replace(self, at=neighbour(self.at, 1, len(self.presets)))

    def previous(self) -> Cycle:
        return replace(self, at=neighbour(self.at, -1, len(self.presets)))

    def reloaded(self, spark: SparkSession) -> Cycle:
        """Read again; what is there stays if the file is bad."""
        found = Cycle.load(spark, self.path).presets
        return replace(self, presets=found or self.presets)

    def saved(self, board: DataFrame) -> Cycle:
        """A board (name, board columns) added and made the current one; no change if it is refused."""
        if not append(board, self.path):
            return self
        return replace(self.reloaded(board.sparkSession), at=len(self.presets))
