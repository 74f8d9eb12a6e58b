"""Running sums over rows in buckets, without a task that holds all buckets of a group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows in a bucket, about; and buckets that one task puts in order.
IN_BUCKET = 256
FAN = 1024


def buckets_for(rows: int) -> int:
    return max(16, math.ceil(rows / IN_BUCKET))


def starts(sums: DataFrame, by: Sequence[str], value: str, buckets: int) -> DataFrame:
    """(by, bucket, start): the sum of ``value`` over smaller buckets, from one row per group and bucket.

    Beyond FAN buckets, runs of FAN are summed up first and put in order themselves, level by level.
    """
    if buckets <= FAN:
        before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        return sums.select(*by, "bucket", F.coalesce(F.sum(value).over(before), F.lit(0)).alias("start"))
    runs = sums.withColumn("run", F.floor(F.col("bucket") / FAN))
    above = runs.groupBy(*by, F.col("run").alias("bucket")).agg(F.sum(value).alias(value))
    above = starts(above, by, value, math.ceil(buckets / FAN)).withColumnRenamed("bucket", "run").withColumnRenamed("start", "base")
    before = Window.partitionBy(*by, "run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("inner", F.coalesce(F.sum(value).over(before), F.lit(0)))
    return runs.join(above, [*by, "run"]).select(*by, "bucket", (F.col("base") + F.col("inner")).alias("start"))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], buckets: int) -> DataFrame:
    """``df`` with nth, numbering the rows of each ``by`` from 0 in order of bucket and then ``order``; bucket goes."""
    counts = df.groupBy(*by, "bucket").agg(F.count("*").alias("c"))
    within = Window.partitionBy(*by, "bucket").orderBy(*order)
    out = df.withColumn("in_bucket", F.row_number().over(within)).join(starts(counts, by, "c", buckets), [*by, "bucket"])
    return out.withColumn("nth", (F.col("start") + F.col("in_bucket") - 1).cast("long")).drop("start", "in_bucket", "bucket")


#: Keys that may be so common that they are looked up in a broadcast table: at most so many have this share of the rows.
HOT = 4096


def looked_up(rows: DataFrame, table: DataFrame, key: str, count: str, n: int) -> DataFrame:
    """``rows``, which are read twice, with the one row that ``table`` has for their key; rows without one go.

    count is how many of the ``n`` rows have the key. Keys with 1 / HOT of all rows are HOT at most and go to every task;
    the other rows are dealt by their key, and none of these makes a task much larger than the rest.
    """
    hot = F.broadcast(table.where(F.col(count) * HOT >= n))
    cold = table.where(F.col(count) * HOT < n)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold.hint("merge"), key))
