"""Sharding by longest-processing-time scheduling.

Rows with equal texts stay together. Groups go, largest first, to the shard with the fewest bytes, which a heap
yields. Groups of one size are alike, so the schedule needs only how many groups each size has: sizes that differ
number at most sqrt(2 * all bytes), whatever the number of rows. The driver runs the schedule over that histogram, a
bounded run of sizes at a time; Spark numbers the groups of each size and looks up their shards. A size with many groups is scheduled in one step,
with the result that taking them one by one would have.
"""

from __future__ import annotations

import heapq
from itertools import accumulate, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardflow.llm.running import buckets_for, looked_up, numbered
from boardflow.plans.staging import Rounds, staged

#: Different sizes that the driver schedules at once.
AT_ONCE = 100_000


def schedule(histogram: list[tuple[int, int]], shards: int, load: list[int] | None = None) -> list[tuple[int, list[int]]]:
    """(size, groups that each shard gets) for (size, groups), by longest processing time.

    ``load`` is what the shards hold already; it is brought up to date.
    """
    load = [0] * shards if load is None else load
    out = []
    for size, count in sorted(histogram, reverse=True):
        gets = [0] * shards
        if count > 4 * shards:  # those that end below a common level, which is what greedy steps fill first
            lo, hi = min(load), max(load) + size * count
            while lo < hi:
                level = (lo + hi + 1) // 2
                if sum(max(0, -(-(level - x) // size)) for x in load) <= count:
                    lo = level
                else:
                    hi = level - 1
            gets = [max(0, -(-(lo - x) // size)) for x in load]
            load[:] = [x + size * g for x, g in zip(load, gets, strict=True)]
        heap = [(x, j) for j, x in enumerate(load)]
        heapq.heapify(heap)
        for _ in range(count - sum(gets)):
            x, j = heap[0]
            heapq.heapreplace(heap, (x + size, j))
            gets[j] += 1
            load[j] += size
        out.append((size, gets))
    return out


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    Size is the text's UTF-8 bytes plus 1, none for null, which is together with the empty text; the checksum of no
    bytes is 0. Law is always ``bytes``: the shards' sizes are near equal, as far as groups that stay together allow.
    slot numbers a shard's rows from 0 without a gap. grown_shard is null, as with one more shard all would be
    scheduled anew. Rows are numbered by their id's hash; rows without an id, too. Repeated rows are rows of their own, in
    one shard. Very long texts are one row as others. Other columns are not looked at. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("g")), "rows")
    groups = staged(rows.groupBy("g").agg(F.sum("size").alias("whole"), F.count("*").alias("c")), "groups")
    n = rows.count()
    counted = groups.groupBy("whole").agg(F.count("*").alias("n")).orderBy(F.desc("whole")).toLocalIterator()
    spark, load, plan = docs.sparkSession, [0] * shards, Rounds(docs.sparkSession, "plan")
    while True:
        some = [(r["whole"], r["n"]) for r in islice(counted, AT_ONCE)]
        if not some and plan.n:
            break
        made = [(size, list(accumulate(gets))) for size, gets in schedule(some, shards, load)]
        plan.add(spark.createDataFrame(made, "whole long, upto array<long>"))
    plan = plan.all()
    # the groups of a size are numbered over buckets of their hashes
    inside = F.conv(F.substring("g", 1, 8), 16, 10).cast("long")
    buckets = buckets_for(n)
    groups = groups.withColumn("bucket", F.pmod(inside, F.lit(buckets)))
    groups = numbered(groups, ["whole"], ["g"], buckets).join(plan, "whole")
    groups = groups.select("g", "c", F.size(F.filter("upto", lambda u: u <= F.col("nth"))).alias("shard"))
    # as are the rows of a shard
    rows = staged(looked_up(rows, staged(groups, "shards"), "g", "c", n).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets))), "placed")
    out = numbered(rows, ["shard"], ["doc_id", "text_crc32"], buckets)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("nth").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
