"""What a view of the graph and of a board shows, as columns."""

from __future__ import annotations

from dataclasses import dataclass
from math import cos, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardflow.functions import blocks as B
from boardflow.functions import boards as P


def segments(links: DataFrame, points: DataFrame) -> DataFrame:
    """(src, dst, x0, y0, z0, x1, y1, z1) of every link."""
    a = points.select(F.col("id").alias("src"), *(F.col(c).alias(f"{c}0") for c in "xyz"))
    b = points.select(F.col("id").alias("dst"), *(F.col(c).alias(f"{c}1") for c in "xyz"))
    return links.select("src", "dst").join(a, "src").join(b, "dst")


def connections(points: DataFrame, current: int, winning: DataFrame) -> DataFrame:
    """(src, dst, x0, ..., z1) from the current node to every winning one (id)."""
    return segments(winning.select(F.lit(current).cast("long").alias("src"), F.col("id").alias("dst")), points)


def ordinal(n: Column) -> Column:
    teen = F.pmod(n, F.lit(100)).between(11, 13)
    last = F.pmod(n, F.lit(10))
    end = F.when(teen, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def vertex_class(winning: Column, on_path: Column, start: Column, visited: Column, picked: Column, distance: Column | None = None) -> Column:
    """The first that holds; with ``distance``, what is none of these and has one is coloured by it."""
    out = F.when(picked, "picked").when(winning, "winning").when(on_path, "path").when(start, "start").when(visited, "visited")
    return out.when(distance.isNotNull(), "distance").otherwise("default") if distance is not None else out.otherwise("default")


def ramp(distance: Column, longest: Column, far: tuple[int, int, int], close: tuple[int, int, int]) -> Column:
    """Colour between ``far`` and ``close``; all are close where the longest distance is 0."""
    weight = F.when(longest > 0, 1.0 - distance / longest).otherwise(1.0)
    return F.array(*(F.floor((1 - weight) * f + weight * n).cast("int") for f, n in zip(far, close, strict=True)))


def picked(points: DataFrame, origin: tuple[float, float, float], ray: tuple[float, float, float], size: float = 0.75) -> DataFrame:
    """(id): the smallest id whose cube the ray meets, null if none."""
    lo, hi = F.lit(float("-inf")), F.lit(float("inf"))
    ok = F.lit(True)
    for c, o, d in zip("xyz", origin, ray, strict=True):
        a, b = F.col(c) - size / 2 - o, F.col(c) + size / 2 - o
        if d == 0:
            ok = ok & (a <= 0) & (b >= 0)
        else:
            lo, hi = F.greatest(lo, F.least(a / d, b / d)), F.least(hi, F.greatest(a / d, b / d))
    return points.where(ok & (lo <= hi) & (hi >= 0)).agg(F.min("id").alias("id"))


def painted(boards: DataFrame, key: str = "board_id") -> DataFrame:
    """(key, x, y, kind, goal) of every cell: kind is empty, block, target or wall; goal, whether the target belongs there."""
    cells = boards.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    b, t, x, y = P.block_at(F.col("x"), F.col("y")), P.target_block(), F.col("x"), F.col("y")
    kind = F.when(b.isNull(), "empty").when(B.is_target(b), "target").when(B.is_immovable(b), "wall").otherwise("block")
    inside = (x >= F.col("gx")) & (x < F.col("gx") + B.width_of(t)) & (y >= F.col("gy")) & (y < F.col("gy") + B.height_of(t))
    return cells.select(key, "x", "y", kind.alias("kind"), (F.col("goal") & F.coalesce(inside, F.lit(False))).alias("goal"))


def openings() -> Column:
    """Edges of the board that the goal touches, as an array of left, right, top, bottom; empty without goal or target."""
    t = P.target_block()
    sides = [("left", F.col("gx") == 0), ("right", F.col("gx") + B.width_of(t) == F.col("w")), ("top", F.col("gy") == 0), ("bottom", F.col("gy") + B.height_of(t) == F.col("h"))]
    return F.when(F.col("goal") & t.isNotNull(), F.array_compact(F.array(*(F.when(ok, name) for name, ok in sides)))).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Camera:
    """A camera that circles a point. Speeds and limits are parameters; angles in radians."""

    angle_x: float = 0.0
    angle_y: float = 0.0
    distance: float = 20.0
    target: tuple[float, float, float] = (0.0, 0.0, 0.0)
    nearest: float = 2.0
    farthest: float = 2000.0

    def rotated(self, dx: float, dy: float, speed: float = 1.0) -> Camera:
        up = min(1.5, max(-1.5, self.angle_y + dy * speed / 200.0))
        return Camera(self.angle_x - dx * speed / 200.0, up, self.distance, self.target, self.nearest, self.farthest)

    def panned(self, dx: float, dy: float, speed: float = 2.0) -> Camera:
        """The target moved in the plane that the camera looks at, the faster the farther it is."""
        much = self.distance * speed / 1000.0
        sx, cx, sy, cy = sin(self.angle_x), cos(self.angle_x), sin(self.angle_y), cos(self.angle_y)
        right, up = (cx, 0.0, -sx), (-sy * sx, cy, -sy * cx)
        to = tuple(t - dx * much * r + dy * much * u for t, r, u in zip(self.target, right, up, strict=True))
        return Camera(self.angle_x, self.angle_y, self.distance, to, self.nearest, self.farthest)

    def followed(self, point: tuple[float, float, float], share: float) -> Camera:
        """The target moved towards a point by a share of what is between them."""
        share = min(1.0, share)
        to = tuple(t + (p - t) * share for t, p in zip(self.target, point, strict=True))
        return Camera(self.angle_x, self.angle_y, self.distance, to, self.nearest, self.farthest)

    def position(self) -> tuple[float, float, float]:
        d = min(self.farthest, max(self.nearest, self.distance))
        x, y, z = self.target
        return x + cos(self.angle_y) * sin(self.angle_x) * d, y + sin(self.angle_y) * d, z + cos(self.angle_y) * cos(self.angle_x) * d
