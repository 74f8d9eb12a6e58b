"""Distances, next hops and paths to the nearest of many targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardflow.plans.staging import Rounds, staged


def undirected(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Both ways of every link, each once, without loops."""
    one = links.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def distances(links: DataFrame, targets: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 1000) -> DataFrame:
    """(id, distance, parent, nearest) of the nodes that a target can be reached from.

    One breadth-first search from all targets at once, level by level. Ties go to the smallest nearest target, then
    the smallest next hop: minima, which combine before the shuffle. parent of a target is null, nearest itself.
    Links go both ways, so a neighbour of a level is in it, in the one before or in the next: a round reads these
    two levels and not all that was reached.
    """
    edges = staged(undirected(links, src, dst), "edges")
    rounds = Rounds(links.sparkSession, "levels")
    level = rounds.add(targets.select(F.col(targets.columns[0]).alias("id")).distinct().select("id", F.lit(0).alias("distance"), F.col("id").alias("nearest"), F.expr("nullif(id, id)").alias("parent")))
    near = level
    for i in range(1, max_rounds):
        found = edges.join(level.select(F.col("id").alias("dst"), "nearest"), "dst").groupBy(F.col("src").alias("id")).agg(F.min(F.struct("nearest", "dst")).alias("m"))
        fresh = found.join(near.select("id"), "id", "left_anti").select("id", F.lit(i).alias("distance"), F.col("m.nearest").alias("nearest"), F.col("m.dst").alias("parent"))
        last, level = level, rounds.add(fresh)
        if level.isEmpty():
            return rounds.all()
        near = last.unionByName(level)
    raise RuntimeError(f"nodes are still being reached after {max_rounds} rounds")


def path(found: DataFrame, start: DataFrame, max_hops: int = 1000) -> DataFrame:
    """(start, step, id) from each start to its nearest target; none where no target can be reached."""
    rounds = Rounds(found.sparkSession, "steps")
    at = rounds.add(start.select(F.col(start.columns[0]).alias("id")).distinct().join(found.select("id", "parent"), "id").select(F.col("id").alias("start"), F.lit(0).alias("step"), "id", "parent"))
    for i in range(1, max_hops):
        at = rounds.add(at.where("parent is not null").select("start", F.col("parent").alias("id")).join(found.select("id", "parent"), "id").select("start", F.lit(i).alias("step"), "id", "parent"))
        if at.isEmpty():
            break
    return rounds.all().select("start", "step", "id")


def most_distant(found: DataFrame) -> DataFrame:
    """The smallest id at the largest distance; one row."""
    return found.agg(F.max_by(F.struct("id", "distance"), F.struct("distance", F.struct((-F.col("id")).alias("o")))).alias("m")).select("m.id", "m.distance")


def members(paths: DataFrame) -> DataFrame:
    """(id): every node that lies on some path."""
    return paths.select("id").distinct()


class Distances:
    """Distances that are worked out anew only when links or targets have changed, and kept where there are none of either."""

    def __init__(self) -> None:
        self.key: tuple | None = None
        self.found: DataFrame | None = None

    @property
    def empty(self) -> bool:
        return self.found is None

    def clear(self) -> None:
        self.key = self.found = None

    def of(self, links: DataFrame, targets: DataFrame) -> DataFrame | None:
        """Those of links (src, dst) to targets (id); what was found before where either is empty."""
        key = tuple(
            df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first() for df in (links.select("src", "dst"), targets)
        )
        if key != self.key and key[0][0] and key[1][0]:
            self.key, self.found = key, staged(distances(links, targets), "distances")
        return self.found
