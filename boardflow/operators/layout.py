"""One step of a force-directed layout: springs, Barnes-Hut repulsion, Verlet integration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardflow.plans.staging import Rounds, staged


@dataclass(frozen=True)
class Config:
    """Fixed values of the simulation."""

    spring: float = 4.0
    damping: float = 1.5
    rest: float = 3.0
    drag: float = 0.1
    repulsion: float = 2.5
    theta: float = 1.0
    softening: float = 0.05
    mass: float = 1.0
    dt: float = 4.0 / 90.0
    depth: int = 21


def spring_forces(points: DataFrame, links: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(id, fx, fy, fz): Hooke's law along every link, on both ends. Ends that coincide feel nothing."""
    a, b = (points.select(F.col("id").alias(k), *(F.col(c).alias(f"{c}{k[0]}") for c in "xyz")) for k in ("src", "dst"))
    both = links.select("src", "dst").join(a, "src").join(b, "dst")
    d = [F.col(f"{c}s") - F.col(f"{c}d") for c in "xyz"]
    length = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    pull = F.when(length > 0, -cfg.spring * (length - cfg.rest) / length).otherwise(0.0)
    both = both.select("src", "dst", *((v * pull).alias(f"f{c}") for c, v in zip("xyz", d, strict=True)))
    ends = both.select(F.explode(F.array(F.struct(F.col("src").alias("id"), *(F.col(f"f{c}") for c in "xyz")), F.struct(F.col("dst").alias("id"), *((-F.col(f"f{c}")).alias(f"f{c}") for c in "xyz")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(*(F.sum(f"f{c}").alias(f"f{c}") for c in "xyz"))


def _spread(v: Column) -> Column:
    """21 bits, each followed by two zeros."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = v.bitwiseOR(F.call_function("shiftleft", v, F.lit(shift))).bitwiseAND(F.lit(mask))
    return v


def bounds(points: DataFrame) -> dict[str, float]:
    row = points.agg(*(f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max)))).first()
    extent = max(row[f"hi{c}"] - row[f"lo{c}"] for c in "xyz") if row["lox"] is not None else 0.0
    return {**{f"lo{c}": row[f"lo{c}"] for c in "xyz"}, "extent": extent}


def morton(points: DataFrame, box: dict[str, float], depth: int = 21) -> DataFrame:
    """points with code: the bits of the quantised axes interleaved, x lowest."""
    top = (1 << depth) - 1

    def axis(c: str) -> Column:
        if not box["extent"]:
            return F.lit(0).cast("long")
        return F.least(F.floor((F.col(c) - box[f"lo{c}"]) / box["extent"] * top), F.lit(top)).cast("long")

    x, y, z = (_spread(axis(c)) for c in "xyz")
    return points.withColumn("code", x.bitwiseOR(F.call_function("shiftleft", y, F.lit(1))).bitwiseOR(F.call_function("shiftleft", z, F.lit(2))))


def cells(coded: DataFrame, depth: int = 21) -> DataFrame:
    """(depth, code, n, cx, cy, cz): every cell with points, by one aggregation of all prefixes of the codes."""
    up = coded.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    up = up.withColumn("prefix", F.expr(f"shiftright(code, 3 * ({depth} - d))"))
    return up.groupBy(F.col("d").alias("depth"), F.col("prefix").alias("code")).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"c{c}") for c in "xyz"))


#: Pairs of a point and a cell that a worker holds at once.
PAIRS = 1 << 19

_STEP = "id long, x double, y double, z double, code long, depth int, cell long, done boolean, fx double, fy double, fz double"


def leaves_and_above(all_cells: DataFrame) -> DataFrame:
    """The cells of :func:`cells` down to those of one point, with ``above``, the points of the cell above (the root: its own)."""
    up = all_cells.where("n > 1").select((F.col("depth") + 1).alias("depth"), F.col("code").alias("up"), F.col("n").alias("above"))
    below = all_cells.where("depth > 0").withColumn("up", F.expr("shiftright(code, 3)")).join(up, ["depth", "up"]).drop("up")
    return all_cells.where("depth = 0").withColumn("above", F.col("n")).unionByName(below)


def repulsion(points: DataFrame, cfg: Config = Config(), most: int = 200_000) -> DataFrame:
    """(id, fx, fy, fz): each point is pushed away by all others; far cells count as one mass at their centre.

    A cell that holds the point itself is always open, a leaf never: that is a cell of one point or of the deepest
    level, where the others in a point's own leaf are one mass. The cells below those of most points, at most ``most``,
    go to every task; what a point opens beyond them goes down by joins, a level a round. Points without a place feel and
    exert nothing.
    """
    points = points.where(" and ".join(f"{c} is not null and not isnan({c})" for c in "xyz")).select("id", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    box = bounds(points)
    coded = staged(morton(points, box, cfg.depth), "coded")
    nodes = staged(leaves_and_above(cells(coded, cfg.depth)), "cells")
    heavy = F.floor(F.log2("above")).cast("int")
    counts = {r["h"]: r["count"] for r in nodes.groupBy(heavy.alias("h")).count().collect()}
    least = min((h for h in counts if sum(n for k, n in counts.items() if k >= h) <= most), default=max(counts, default=0) + 1)
    top = nodes.where((heavy >= least) | (F.col("depth") == 0)).orderBy("depth", "code").toArrow()
    rounds = Rounds(points.sparkSession, "forces")
    step = rounds.add(coded.mapInArrow(_walked(top, cfg, box["extent"]), _STEP))
    while not (near := step.where("not done")).isEmpty():
        step = rounds.add(_opened(near, nodes, cfg, box["extent"]))
    return _summed(rounds.all().select("id", "fx", "fy", "fz"))


def _walked(top: pa.Table, cfg: Config, extent: float):
    """Points down the cells of ``top``, all pairs of a level at once: their forces, and rows for what they open beyond."""
    depth, code, n = (np.asarray(top.column(c)).astype(np.int64) for c in ("depth", "code", "n"))
    centre = np.stack([np.asarray(top.column(f"c{c}")) for c in "xyz"], axis=1)
    first, kids = np.zeros(len(code), dtype=np.int64), np.zeros(len(code), dtype=np.int64)
    for d in np.unique(depth).tolist():
        here, (lo, hi) = np.flatnonzero(depth == d), np.searchsorted(depth, [d + 1, d + 2])
        first[here] = lo + np.searchsorted(code[lo:hi], code[here] << 3)
        kids[here] = lo + np.searchsorted(code[lo:hi], (code[here] + 1) << 3) - first[here]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            at = np.stack([np.asarray(part.column(c)) for c in "xyz"], axis=1)
            ids, own_code, force = np.asarray(part.column("id")), np.asarray(part.column("code")), np.zeros(at.shape)
            stack = [(np.arange(len(at)), np.zeros(len(at), dtype=np.int64))]
            while stack:
                i, j = stack.pop()
                if len(i) > PAIRS:
                    stack += [(i[k : k + PAIRS], j[k : k + PAIRS]) for k in range(0, len(i), PAIRS)]
                    continue
                own, leaf = own_code[i] >> 3 * (cfg.depth - depth[j]) == code[j], (n[j] == 1) | (depth[j] == cfg.depth)
                among = own & leaf & (n[j] > 1)
                others = (n[j] - among).astype(float)
                mean = np.where(among[:, None], (n[j][:, None] * centre[j] - at[i]) / others[:, None], centre[j])
                apart = at[i] - mean
                r2 = (apart * apart).sum(axis=1) + cfg.softening
                done = leaf | (~own & ((extent / 2.0 ** depth[j]) ** 2 / r2 < cfg.theta**2))
                push = np.where(done & ~(own & (n[j] == 1)), cfg.repulsion * cfg.mass * others / r2 / np.sqrt(r2), 0.0)
                for axis in range(3):
                    force[:, axis] += np.bincount(i, apart[:, axis] * push, len(at))
                inside, beyond = ~done & (kids[j] > 0), ~done & (kids[j] == 0)
                if beyond.any():
                    yield rows(part.take(pa.array(i[beyond])), depth[j[beyond]], code[j[beyond]], False, np.zeros((int(beyond.sum()), 3)))
                i, j = i[inside], j[inside]
                if len(i):
                    stack.append((np.repeat(i, kids[j]), np.arange(kids[j].sum()) + np.repeat(first[j] - np.cumsum(kids[j]) + kids[j], kids[j])))
            yield rows(part, np.zeros(len(ids)), np.zeros(len(ids)), True, force)

    def rows(part: pa.RecordBatch, depth: np.ndarray, cell: np.ndarray, done: bool, force: np.ndarray) -> pa.RecordBatch:
        columns = [part.column(c) for c in ("id", "x", "y", "z", "code")] + [pa.array(depth.astype(np.int32)), pa.array(cell.astype(np.int64)), pa.array(np.full(len(depth), done)), *(pa.array(f) for f in force.T.copy())]
        return pa.RecordBatch.from_arrays(columns, ["id", "x", "y", "z", "code", "depth", "cell", "done", "fx", "fy", "fz"])

    return run


def _opened(near: DataFrame, nodes: DataFrame, cfg: Config, extent: float) -> DataFrame:
    """The cells in those that points open: what they push, or that they are open too."""
    below = nodes.where("depth > 0").select((F.col("depth") - 1).cast("int").alias("depth"), F.expr("shiftright(code, 3)").alias("cell"), F.col("depth").alias("d"), F.col("code").alias("c"), "n", "cx", "cy", "cz")
    both = near.drop("done", "fx", "fy", "fz").join(below, ["depth", "cell"])
    own, leaf = F.expr(f"shiftright(code, 3 * ({cfg.depth} - d)) = c"), F.expr(f"n = 1 or d = {cfg.depth}")
    among = own & leaf & (F.col("n") > 1)
    others = F.col("n") - among.cast("int")
    apart = [F.col(c) - F.when(among, (F.col("n") * F.col(f"c{c}") - F.col(c)) / others).otherwise(F.col(f"c{c}")) for c in "xyz"]
    r2 = apart[0] * apart[0] + apart[1] * apart[1] + apart[2] * apart[2] + cfg.softening
    size = extent / F.pow(F.lit(2.0), "d")
    done = leaf | (~own & (size * size / r2 < cfg.theta**2))
    push = F.when(done & ~(own & (F.col("n") == 1)), cfg.repulsion * cfg.mass * others / r2 / F.sqrt(r2)).otherwise(0.0)
    return both.select("id", "x", "y", "z", "code", F.col("d").cast("int").alias("depth"), F.col("c").alias("cell"), done.alias("done"), *((v * push).alias(f"f{c}") for c, v in zip("xyz", apart, strict=True)))


def _summed(forces: DataFrame) -> DataFrame:
    return forces.groupBy("id").agg(*(F.sum(f"f{c}").alias(f"f{c}") for c in "xyz"))


def verlet(points: DataFrame, forces: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(id, x, y, z, px, py, pz) a step later."""
    both = points.join(forces, "id", "left")
    new = [(F.col(c) + (F.col(c) - F.col(f"p{c}")) * (1 - cfg.drag) + F.coalesce(F.col(f"f{c}"), F.lit(0.0)) / cfg.mass * cfg.dt * cfg.dt).alias(c) for c in "xyz"]
    return both.select("id", *new, *(F.col(c).alias(f"p{c}") for c in "xyz"))


def centered(points: DataFrame) -> DataFrame:
    mean = points.agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    return points.join(F.broadcast(mean)).select("id", *((F.col(c) - F.col(f"m{c}")).alias(c) for c in "xyz"))


def seeded(nodes: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Starting places within a tenth of the rest length around 0, by the hash of the id."""
    at = [((F.pmod(F.xxhash64("id", F.lit(c)), F.lit(2001)) - 1000) / 1000.0 * cfg.rest * 0.1).alias(c) for c in "xyz"]
    return nodes.select("id", *at).select("id", "x", "y", "z", *(F.col(c).alias(f"p{c}") for c in "xyz"))


def layout(points: DataFrame, links: DataFrame, steps: int, cfg: Config = Config()) -> DataFrame:
    """``steps`` steps; each is written, so that plans stay short."""
    for i in range(steps):
        forces = _summed(spring_forces(points, links, cfg).unionByName(repulsion(points, cfg)))
        points = staged(verlet(points, forces, cfg), f"step{i}")
    return points


# geometry of cells, integration by Euler, and the commands that change a layout


def octant(center: tuple[Column, Column, Column]) -> Column:
    """Which eighth around a centre (x, y, z) lies in: bit 0 for x, 1 for y, 2 for z, set from the centre on."""
    return sum(((F.col(c) >= m).cast("int") * (1 << i) for i, (c, m) in enumerate(zip("xyz", center, strict=True))), F.lit(0))


def child_bounds(lo: tuple[Column, ...], hi: tuple[Column, ...], which: Column) -> Column:
    """A struct of lox, hix, ... of an eighth of a box."""
    out = []
    for i, c in enumerate("xyz"):
        middle, upper = (lo[i] + hi[i]) / 2, which.bitwiseAND(F.lit(1 << i)) > 0
        out += [F.when(upper, middle).otherwise(lo[i]).alias(f"lo{c}"), F.when(upper, hi[i]).otherwise(middle).alias(f"hi{c}")]
    return F.struct(*out)


def ancestor(code: Column, depth: Column | int, deepest: int = 21) -> Column:
    """The cell of a code at a depth."""
    return F.call_function("shiftrightunsigned", code, (3 * (F.lit(deepest) - depth)).cast("int"))


def octant_at(code: Column, depth: Column | int, deepest: int = 21) -> Column:
    """Which child of its cell at ``depth`` - 1 a code's cell is."""
    return ancestor(code, depth, deepest).bitwiseAND(F.lit(7).cast("long")).cast("int")


def branching(all_cells: DataFrame) -> DataFrame:
    """The cells of :func:`cells` that are the root, a leaf, or have two children or more: a tree without chains."""
    up = all_cells.select((F.col("depth") - 1).alias("depth"), F.call_function("shiftright", "code", F.lit(3)).alias("code"))
    children = up.where("depth >= 0").groupBy("depth", "code").agg(F.count("*").alias("children"))
    found = all_cells.join(children, ["depth", "code"], "left").withColumn("children", F.coalesce("children", F.lit(0)))
    return found.where("depth = 0 or children <> 1")


def euler(points: DataFrame, forces: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(id, x, y, z, vx, vy, vz) a step later: velocity by force, then place by velocity."""
    both = points.join(forces, "id", "left")
    v = {c: F.col(f"v{c}") + F.coalesce(F.col(f"f{c}"), F.lit(0.0)) / cfg.mass * cfg.dt for c in "xyz"}
    return both.select("id", *((F.col(c) + v[c] * cfg.dt).alias(c) for c in "xyz"), *(v[c].alias(f"v{c}") for c in "xyz"))


def commanded(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(masses, springs) that a log of commands (seq, command, a, b) leaves: ``clear``, ``mass`` a, ``spring`` a b.

    Only what comes after the last ``clear`` counts, so nothing needs to be replayed in order.
    """
    since = F.broadcast(log.where("command = 'clear'").agg(F.coalesce(F.max("seq"), F.lit(-1).cast("long")).alias("since")))
    left = log.join(since, log["seq"] > since["since"]).drop("since")
    return left.where("command = 'mass'").select(F.col("a").alias("id")).distinct(), left.where("command = 'spring'").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def linked(links: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Starting places of the ends of links: each node a tenth of the rest length from the smallest node linked with it.

    Nodes without a smaller neighbour start by the hash of their id; the others around where that one would.
    """
    both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    parent = both.groupBy("src").agg(F.min("dst").alias("dst")).select(F.col("src").alias("id"), F.least("src", "dst").alias("of"))
    own, root = ({c: (F.pmod(F.xxhash64(k, F.lit(c)), F.lit(2001)) - 1000) / 1000.0 for c in "xyz"} for k in ("id", "of"))
    size = F.sqrt(sum((own[c] * own[c] for c in "xyz"), F.lit(0.0)))
    apart = F.when((F.col("id") == F.col("of")) | (size == 0), 0.0).otherwise(cfg.rest * 0.1 / size)
    at = [(root[c] * cfg.rest + own[c] * apart).alias(c) for c in "xyz"]
    return parent.select("id", *at).select("id", "x", "y", "z", *(F.col(c).alias(f"p{c}") for c in "xyz"))
