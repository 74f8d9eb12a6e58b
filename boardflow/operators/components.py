"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardflow.plans.staging import discard, staged


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge, component being its smallest reachable node.

    Each round hangs every node's neighbours under the smallest of them, so that stars remain after a number
    of rounds logarithmic in the longest path. Minima are aggregated before the shuffle and joined back, so a
    node with very many neighbours never has them gathered in one task. Edges may repeat, run either way, be
    loops, or hold a null end (ignored); no edges give no rows. Nodes are any one orderable type.
    """
    a, b = F.col(src), F.col(dst)
    start = edges.where(a.isNotNull() & b.isNotNull())
    nodes = start.where(a == b).select(a.alias("a"), b.alias("b"))
    links = staged(start.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lower = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.where("b > a").join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = staged(large, "large")
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        last, links = links, staged(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "links")
        discard(last, lower, large, least)
        # stars no longer change: as many links, with the same sum of hashes
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component"))
    found = links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    return found.unionByName(nodes.select(F.col("a").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
