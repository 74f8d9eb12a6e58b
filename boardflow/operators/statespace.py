"""Closure of legal moves, placements, clusters, and spaces of puzzles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardflow.functions import blocks as B
from boardflow.functions import boards as P
from boardflow.operators import local
from boardflow.operators.components import connected_components
from boardflow.operators.graph import distances, path
from boardflow.plans.staging import Rounds, discard, staged

#: States that a task finds before it hands the rest on, and steps from a frontier that several tasks share.
AT_ONCE = 200_000
SHARED_LEVELS = 8
#: States of a class that one worker searches; larger classes are searched level by level by all.
IN_CLASS = 1 << 19
BOARD = ["board_id", "w", "h", "gx", "gy", "restricted", "goal"]


@dataclass(frozen=True)
class Rules:
    """A family of puzzles: board, goal, shapes that may be added, the target and where it may start."""

    w: int
    h: int
    gx: int
    gy: int
    restricted: bool
    shapes: tuple[tuple[int, int], ...]
    target: tuple[int, int]
    start: tuple[int, int, int, int]  # first x, first y, last x, last y


RUSH_HOUR = Rules(6, 6, 4, 2, True, ((2, 1), (3, 1), (1, 2), (1, 3)), (2, 1), (0, 2, 4, 2))
KLOTSKI = Rules(4, 5, 1, 3, False, ((1, 1), (1, 2), (2, 1)), (2, 2), (0, 0, 2, 3))


def successors(states: DataFrame) -> DataFrame:
    """(all columns of states, idx, dir, next): a row per legal step."""
    blocks = states.withColumn("occ", P.occupied()).select("*", F.posexplode("blocks").alias("idx", "b")).withColumn("cells", B.mask(F.col("b"), F.col("w")))
    ways = [F.struct(F.lit(d).alias("dir"), change_of.alias("moved"), ok.alias("ok")) for d, change_of, ok in ((d, (F.col("b") + change).cast("int"), ok) for d, change, ok in P.steps_of(F.col("b"), F.col("occ"), F.col("cells")))]
    found = blocks.withColumn("m", F.explode(F.array(*ways))).where("m.ok")
    return found.select(*states.columns, "idx", "m.dir", P.replaced(F.col("b"), F.col("m.moved")).alias("next"))


def links_of(states: DataFrame) -> DataFrame:
    """(board_id, src, dst) of keys, one per legal step of the states."""
    return successors(states.withColumnRenamed("state_key", "src")).drop("blocks").withColumnRenamed("next", "blocks").select("board_id", "src", P.state_key().alias("dst"))


def explore(boards: DataFrame, max_rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(states, links) reachable from each board.

    states: board columns and state_key; links: (board_id, src, dst) of keys, one per legal step, so each undirected
    edge comes twice. A round lets tasks search from states that weren't expanded yet, for themselves, until they have
    found AT_ONCE; what they found meets by key, and what no task has expanded goes into the next round. So boards of
    up to that many states take one round, however deep they are, and larger ones are spread over all tasks, a few
    levels a round. Every round is written, so a lost executor costs that round at most.
    """
    cols = [*BOARD, "blocks"]
    spark = boards.sparkSession
    done = Rounds(spark, "states")
    open_ = boards.select(*cols).distinct().repartition("board_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in boards.select(*BOARD).schema) + ", blocks array<int>, expanded boolean"
    for i in range(max_rounds):
        found = open_.mapInArrow(local.reached(AT_ONCE, SHARED_LEVELS if i else 1 << 30), schema).withColumn("state_key", P.state_key())
        found = found.groupBy("board_id", "state_key").agg(F.max("expanded").alias("expanded"), *(F.any_value(c).alias(c) for c in cols[1:]))
        if done.n:
            found = found.join(done.all().select("board_id", "state_key"), ["board_id", "state_key"], "left_anti")
        found = staged(found, "found")
        done.add(found.where("expanded").select(*cols, "state_key"))
        left = found.where("not expanded").select(*cols)
        if left.isEmpty():
            discard(found)
            states = done.all()
            return states, staged(links_of(_dealt(states)), "links")
        open_ = left.repartition(F.xxhash64("blocks"))
    raise RuntimeError(f"states are still being found after {max_rounds} rounds")


def _dealt(states: DataFrame) -> DataFrame:
    """Few states lie in few files, which few tasks would read: dealt anew, as steps are much work for a row."""
    n = states.count()
    wide = int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return states.repartition(min(wide, 1 + n // 1000), "state_key") if n < 1000 * wide else states


def with_class(states: DataFrame) -> DataFrame:
    """states with class: a hash of what no step changes.

    Steps keep walls where they are, all shapes, and on restricted boards the row or column of a block that isn't square.
    """
    def kept(b):
        w, h = B.width_of(b), B.height_of(b)
        pinned = F.when(w > h, b.bitwiseAND(F.lit(~0x700))).when(h > w, b.bitwiseAND(F.lit(~0x3800))).otherwise(B.shape_of(b))
        return F.when(B.is_immovable(b), b).when(F.col("restricted"), pinned).otherwise(B.shape_of(b))

    return states.withColumn("class", F.xxhash64("board_id", P.meta(), F.sort_array(F.transform("blocks", kept))))


_SOLUTION = "board_id long, state_key string, cluster_id string, solved boolean, distance int, parent string, nearest string, step int"


def solve(states: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(board_id, state_key, cluster_id, solved, distance, parent, nearest, step) of every state.

    cluster_id is the smallest state connected with it, distance that to the nearest solved state, parent the next hop
    there; null where there is none. step numbers the states on the path from the states of ``starts`` (board_id,
    state_key). States are closed under steps, and dealt by class: no step leaves a class, so a worker searches whole
    classes by itself. Classes of more than IN_CLASS states are searched by rounds over all workers instead.
    """
    rows = with_class(states.withColumn("solved", P.goal_reached()))
    if starts is None:
        rows = rows.withColumn("start", F.lit(False))
    else:
        known = starts.select("board_id", "state_key").distinct().withColumn("start", F.lit(True))
        rows = rows.join(known, ["board_id", "state_key"], "left").withColumn("start", F.coalesce("start", F.lit(False)))
    rows = staged(rows.select("board_id", "class", "state_key", "w", "h", "gx", "gy", "restricted", "goal", "blocks", "solved", "start"), "classes")
    sizes = staged(rows.groupBy("class").agg(F.count("*").alias("n")), "sizes")
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    buckets = max(1, -(-2 * total // IN_CLASS), min(total // 1000, 4 * int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    small = rows
    if most > IN_CLASS:
        big = sizes.where(F.col("n") > IN_CLASS).select("class")
        small = rows.join(big, "class", "left_anti").select(*rows.columns)
    out = small.groupBy(F.pmod("class", F.lit(buckets)).alias("bucket")).applyInArrow(local.solution, _SOLUTION)
    if most > IN_CLASS:
        out = out.unionByName(_solve_by_rounds(rows.join(big, "class", "left_semi").select(*rows.columns)))
    return out


def _solve_by_rounds(rows: DataFrame) -> DataFrame:
    """As :func:`solve`, for classes that no worker can hold; nodes are (board_id, state_key) as one text."""
    def node(key: str) -> Column:
        return F.concat(F.lpad(F.col("board_id").cast("string"), 20, "0"), F.lit(" "), F.col(key))

    links = staged(links_of(rows).select(node("src").alias("src"), node("dst").alias("dst")), "links")
    nodes = staged(rows.select("board_id", "state_key", "solved", "start", node("state_key").alias("id")), "nodes")
    member = connected_components(links).toDF("id", "cluster")
    far = staged(distances(links, nodes.where("solved").select("id")), "distances")
    on_path = path(far, nodes.where("start").select("id")).groupBy("id").agg(F.max("step").cast("int").alias("step"))
    both = nodes.join(member, "id", "left").join(far, "id", "left").join(on_path, "id", "left")
    bare = [F.substring_index(c, " ", -1).alias(n) for c, n in ((F.coalesce("cluster", "id"), "cluster_id"), (F.col("parent"), "parent"), (F.col("nearest"), "nearest"))]
    return both.select("board_id", "state_key", bare[0], "solved", "distance", bare[1], bare[2], "step")


def block_sets(rules: Rules, max_blocks: int, spark: SparkSession) -> DataFrame:
    """(counts): how many of each shape, 1 to ``max_blocks`` in all, within the area that the target leaves."""
    area = rules.w * rules.h - rules.target[0] * rules.target[1]
    out = spark.range(1).select(F.array().cast("array<int>").alias("counts"), F.lit(0).alias("n"), F.lit(0).alias("used"))
    for bw, bh in rules.shapes:
        out = out.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(min(max_blocks, area // (bw * bh))))))
        out = out.select(F.array_append("counts", F.col("k")).alias("counts"), (F.col("n") + F.col("k")).alias("n"), (F.col("used") + F.col("k") * bw * bh).alias("used"))
        out = out.where((F.col("n") <= max_blocks) & (F.col("used") <= area))
    return out.where("n > 0").select("counts")


def upper_bound(shapes: int, max_blocks: int) -> int:
    """Sum of the multisets of 1 to ``max_blocks`` of the shapes."""
    return sum(comb(shapes + i - 1, i) for i in range(1, max_blocks + 1))


def initial_boards(rules: Rules, spark: SparkSession) -> DataFrame:
    """A board with the target alone for each place that it may start at."""
    x0, y0, x1, y1 = rules.start
    spots = spark.range(1).select(F.explode(F.sequence(F.lit(x0), F.lit(x1))).alias("x")).select("x", F.explode(F.sequence(F.lit(y0), F.lit(y1))).alias("y"))
    target = B.pack(F.col("x"), F.col("y"), F.lit(rules.target[0]), F.lit(rules.target[1]), F.lit(True), F.lit(False))
    return spots.select(F.lit(0).cast("long").alias("board_id"), F.lit(rules.w).alias("w"), F.lit(rules.h).alias("h"), F.lit(rules.gx).alias("gx"), F.lit(rules.gy).alias("gy"), F.lit(rules.restricted).alias("restricted"), F.lit(True).alias("goal"), F.array(target).alias("blocks"))


def placements(starts: DataFrame, shapes: Sequence[tuple[int, int]], w: int, h: int, most: int) -> DataFrame:
    """Every board of the starts' blocks and up to ``most`` blocks more that don't overlap, each once.

    Blocks are added in ascending order, so no board is made twice and nothing needs to be deduplicated: a level is one
    generator over the few hundred places a block can have. Levels are dealt anew while they are small.
    """
    places = sorted((y * 2048 + x * 256 + (bh - 1) * 32 + (bw - 1) * 4, sum(((1 << bw) - 1) << ((y + r) * w + x) for r in range(bh))) for bw, bh in set(shapes) for y in range(h - bh + 1) for x in range(w - bw + 1))
    spark = starts.sparkSession
    # bounded by the board: at most 64 places for each shape
    table = F.broadcast(spark.createDataFrame([(b, m - (1 << 64) if m >= 1 << 63 else m) for b, m in places], "piece int, cells long"))
    level = starts.withColumn("occ", P.occupied()).withColumn("last", F.lit(-1))
    out = level
    for i in range(most):
        if i < 3:
            level = level.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
        joined = level.join(table, (F.col("piece") > F.col("last")) & (F.col("occ").bitwiseAND(F.col("cells")) == 0))
        level = joined.withColumn("blocks", F.array_append("blocks", F.col("piece"))).withColumn("occ", F.col("occ").bitwiseOR(F.col("cells"))).withColumn("last", F.col("piece")).drop("piece", "cells")
        out = out.unionByName(level)
    return out.drop("occ", "last").withColumn("blocks", F.sort_array("blocks"))


def space_states(rules: Rules, max_blocks: int, spark: SparkSession) -> DataFrame:
    """All boards of the rules with up to ``max_blocks`` blocks, the target among them, and their keys.

    Both shipped rules are closed under moves, so this is what exploring every board gives; each state comes once.
    With room for the target alone there is no set of blocks to add, and the space is empty.
    """
    starts = initial_boards(rules, spark)
    states = placements(starts, rules.shapes, rules.w, rules.h, max_blocks - 1) if max_blocks > 1 else starts.limit(0)
    return staged(states.withColumn("state_key", P.state_key()), "states")


def space(rules: Rules, max_blocks: int, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(states, links) of :func:`space_states`."""
    states = space_states(rules, max_blocks, spark)
    return states, staged(links_of(_dealt(states)), "links")


def clusters(states: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(cluster_id, n_states, winnable, max_moves, hardest): the smallest state of each component, and its eccentricity.

    max_moves is the largest distance to the nearest solved state of the cluster, 0 if none can be solved; hardest the
    smallest state at that distance, the cluster's smallest if none can be solved. ``links`` are not needed.
    """
    far = F.coalesce("distance", F.lit(0))
    return solve(states).groupBy("cluster_id").agg(F.count("*").alias("n_states"), F.max("solved").alias("winnable"), F.max(far).cast("int").alias("max_moves"), F.min(F.struct((-far).alias("d"), "state_key")).alias("h")).select("cluster_id", "n_states", "winnable", "max_moves", F.col("h.state_key").alias("hardest"))


def puzzle_space(rules: Rules, max_blocks: int, min_moves: int, spark: SparkSession) -> DataFrame:
    """The clusters that can be solved and have a state at least ``min_moves`` from its solution."""
    found = clusters(space_states(rules, max_blocks, spark)).drop("hardest")
    return found.where(F.col("winnable") & (F.col("max_moves") >= min_moves))


def counters(found: DataFrame, min_moves: int) -> DataFrame:
    """(states, clusters, unsolvable, too_easy, kept) of :func:`clusters`: one row, as a run would log it."""
    won, hard = F.col("winnable"), F.col("max_moves") >= min_moves
    return found.agg(F.coalesce(F.sum("n_states"), F.lit(0)).alias("states"), F.count("*").alias("clusters"), F.count(F.when(~won, 1)).alias("unsolvable"), F.count(F.when(won & ~hard, 1)).alias("too_easy"), F.count(F.when(won & hard, 1)).alias("kept"))


@dataclass(frozen=True)
class Populated:
    """The whole graph of some boards: all states with their solution, all links, and what a header line says."""

    states: DataFrame
    links: DataFrame

    def path(self) -> DataFrame:
        """(board_id, step, state_key) from each board to its nearest solved state."""
        return self.states.where("step is not null").select("board_id", "step", "state_key")

    def winning(self) -> DataFrame:
        return self.states.where("solved").select("board_id", "state_key")

    def stats(self) -> DataFrame:
        """(board_id, states, winning, transitions, moves_to_solution); moves are 0 where there is no solution."""
        counts = self.states.groupBy("board_id").agg(F.count("*").alias("states"), F.count(F.when(F.col("solved"), 1)).alias("winning"), F.coalesce(F.max("step"), F.lit(0)).cast("int").alias("moves_to_solution"))
        steps = self.links.groupBy("board_id").agg(F.count("*").alias("transitions"))
        return counts.join(steps, "board_id", "left").select("board_id", "states", "winning", F.coalesce("transitions", F.lit(0)).alias("transitions"), "moves_to_solution")

    def most_distant(self) -> DataFrame:
        """(board_id, state_key, distance): the smallest of the states farthest from a solution."""
        far = self.states.where("distance is not null").groupBy("board_id").agg(F.min(F.struct((-F.col("distance")).alias("d"), "state_key")).alias("m"))
        return far.select("board_id", "m.state_key", (-F.col("m.d")).alias("distance"))


def populate(boards: DataFrame) -> Populated:
    """Explore each board, find its solved states, all distances to them, and the path from the board itself."""
    states, links = explore(boards)
    return Populated(staged(solve(states, boards.withColumn("state_key", P.state_key())), "solution"), links)


def exported(found: DataFrame, states: DataFrame) -> DataFrame:
    """(idx, name, text, hardest): the clusters' smallest states as presets, in descending order, and a hardest state."""
    cols = ["state_key", P.to_text().alias("text")]
    rows = found.join(states.select(*cols), found["cluster_id"] == F.col("state_key"))
    if "hardest" in found.columns:
        rows = rows.drop("state_key").join(states.select(F.col("state_key").alias("hardest"), P.to_text().alias("hardest_text")), "hardest")
    else:
        rows = rows.drop("state_key").withColumn("hardest_text", F.lit(None).cast("string"))
    # clusters are few against states; sorted by ranges, they are numbered by the rows of the ranges before
    ranked = staged(rows.orderBy(F.desc("cluster_id")).select("text", "hardest_text", F.monotonically_increasing_id().alias("o")), "ranked")
    part = F.shiftright("o", 33)
    before = {r["p"]: r["n"] for r in ranked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    upto, total = [], 0
    for p in sorted(before):
        upto.append((p, total))
        total += before[p]
    starts = F.broadcast(ranked.sparkSession.createDataFrame(upto, "p long, start long"))  # a row per task
    out = ranked.withColumn("p", part).join(starts, "p").select((F.col("start") + F.col("o").bitwiseAND(F.lit((1 << 33) - 1))).alias("idx"), "text", "hardest_text")
    return out.select("idx", F.concat(F.lit("Cluster "), F.col("idx").cast("string")).alias("name"), "text", F.col("hardest_text").alias("hardest")).orderBy("idx")
