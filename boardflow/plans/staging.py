"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where that is unset and the session runs in this process alone, as in tests, a temporary folder of our own; on a
    cluster an error, as executors there wouldn't see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="boardflow-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/boardflow-{uuid.uuid4().hex}"
    _files(spark, path, "deleteOnExit")
    return f"{path}/{name}"


def _files(spark: SparkSession, path: str, call: str, *args: bool) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    getattr(where.getFileSystem(spark._jsc.hadoopConfiguration()), call)(where, *args)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    The plan starts anew there, and a lost executor costs nothing that was computed before it.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Delete what :func:`staged` wrote for these, once nothing that is still to run reads them."""
    for df in dfs:
        if path := getattr(df, "_staged_at", None):
            _files(df.sparkSession, path.rsplit("/", 1)[0], "delete", True)


class Rounds:
    """The results of a loop's rounds, each written as it comes, side by side in one shared folder."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.n = spark, scratch(spark, name), 0

    def add(self, df: DataFrame) -> DataFrame:
        """``df`` written as the next round, and read back."""
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        self.n, self.schema = self.n + 1, df.schema
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self) -> DataFrame:
        """The rows of all rounds: one scan, however many rounds there were."""
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)
