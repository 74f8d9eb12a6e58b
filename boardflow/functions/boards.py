"""Boards as columns: w, h, gx, gy int, restricted, goal boolean, blocks array<int>, sorted and without repeats.

Functions take the names of these columns for granted and give Columns; edits that can't be made give null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardflow.functions import blocks as B

MAX_BLOCKS, LEAST, MOST = 15, 3, 8


def c(name: str) -> Column:
    return F.col(name)


def dims_valid() -> Column:
    return c("w").between(LEAST, MOST) & c("h").between(LEAST, MOST)


def target_block() -> Column:
    """The first target in order."""
    return F.get(F.filter("blocks", B.is_target), F.lit(0))


def block_at(x: Column | int, y: Column | int) -> Column:
    return F.get(F.filter("blocks", lambda b: B.covers(b, x, y)), F.lit(0))


def inside(b: Column, width: Column | None = None, height: Column | None = None) -> Column:
    return (B.x_of(b) + B.width_of(b) <= (c("w") if width is None else width)) & (B.y_of(b) + B.height_of(b) <= (c("h") if height is None else height))


def covers(x: Column | int, y: Column | int, w: Column | int = 1, h: Column | int = 1) -> Column:
    """Whether a rectangle lies on the board."""
    x, y = F.lit(0) + x, F.lit(0) + y
    return (x >= 0) & (y >= 0) & (x + w <= c("w")) & (y + h <= c("h"))


def goal_reached() -> Column:
    t = target_block()
    return c("goal") & F.coalesce((B.x_of(t) == c("gx")) & (B.y_of(t) == c("gy")), F.lit(False))


def invalid_reason() -> Column:
    t = target_block()
    dirs = B.principal_dirs(t)
    unreachable = ((dirs.bitwiseAND(F.lit(B.NORTH)) > 0) & (B.x_of(t) != c("gx"))) | ((dirs.bitwiseAND(F.lit(B.EAST)) > 0) & (B.y_of(t) != c("gy")))
    within = (c("gx") > 0) & (c("gx") + B.width_of(t) < c("w")) & (c("gy") > 0) & (c("gy") + B.height_of(t) < c("h"))
    return (
        F.when(c("goal") & t.isNull(), "Goal Without Target")
        .when(~c("goal") & t.isNotNull(), "Target Without Goal")
        .when(c("goal") & t.isNotNull() & c("restricted") & unreachable, "Goal Unreachable")
        .when(c("goal") & t.isNotNull() & within, "Goal Inside")
        .when(~dims_valid(), "Invalid Dims")
    )


def state_key() -> Column:
    """Text whose order is the order of states of one board: slots from the last to the first in hex, empty ones 8000."""
    slots = [F.coalesce(F.get("blocks", F.lit(i)), F.lit(B.INVALID)).cast("long") for i in range(MAX_BLOCKS - 1, -1, -1)] + [meta().cast("long")]
    words = [reduce(Column.bitwiseOR, [F.call_function("shiftleft", v, F.lit(48 - 16 * j)) for j, v in enumerate(slots[i : i + 4])]) for i in range(0, 16, 4)]
    return F.concat(*(F.lpad(F.lower(F.hex(w)), 16, "0") for w in words))


def meta() -> Column:
    """All but the blocks in 16 bits: restricted, goal x and y, width - 1, height - 1 in three bits each, goal."""
    return (c("restricted").cast("int") + c("gx") * 2 + c("gy") * 16 + (c("w") - 1) * 128 + (c("h") - 1) * 1024 + c("goal").cast("int") * 8192).cast("int")


def unpack_meta(m: Column) -> Column:
    """A struct of the board's columns but the blocks."""
    def part(first: int, bits: int = 3) -> Column:
        return F.call_function("shiftright", m.cast("int"), F.lit(first)).bitwiseAND(F.lit((1 << bits) - 1))

    return F.struct((part(7) + 1).alias("w"), (part(10) + 1).alias("h"), part(1).alias("gx"), part(4).alias("gy"), (part(0, 1) == 1).alias("restricted"), (part(13, 1) == 1).alias("goal"))


def created(w: Column | int, h: Column | int, gx: Column | int, gy: Column | int, restricted: Column, goal: Column, blocks: Column) -> Column:
    """A struct of board columns with its blocks in order, or null where a size or the goal is out of range."""
    w, h, gx, gy = (F.lit(0) + v for v in (w, h, gx, gy))
    ok = w.between(1, MOST) & h.between(1, MOST) & gx.between(0, MOST - 1) & gy.between(0, MOST - 1) & (F.size(blocks) <= MAX_BLOCKS)
    return F.when(ok, F.struct(w.cast("int").alias("w"), h.cast("int").alias("h"), gx.cast("int").alias("gx"), gy.cast("int").alias("gy"), restricted.alias("restricted"), goal.alias("goal"), F.sort_array(blocks).alias("blocks")))


# bitmaps


def occupied(which: Column | None = None) -> Column:
    some = F.col("blocks") if which is None else which
    return F.aggregate(some, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(B.mask(b, c("w"))))


def occupied_by(dirs: int) -> Column:
    """Cells of the blocks that may go one of these ways on a restricted board."""
    return occupied(F.filter("blocks", lambda b: B.principal_dirs(b).bitwiseAND(F.lit(dirs)) > 0))


def _bit(x: Column | int, y: Column | int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), ((F.lit(0) + y) * c("w") + x).cast("int"))


def set_bit(bitmap: Column, x: Column | int, y: Column | int) -> Column:
    return bitmap.bitwiseOR(_bit(x, y))


def clear_bit(bitmap: Column, x: Column | int, y: Column | int) -> Column:
    return bitmap.bitwiseAND(F.bitwise_not(_bit(x, y)))


def get_bit(bitmap: Column, x: Column | int, y: Column | int) -> Column:
    return bitmap.bitwiseAND(_bit(x, y)) != 0


def set_block(bitmap: Column, b: Column) -> Column:
    return bitmap.bitwiseOR(B.mask(b, c("w")))


def clear_block(bitmap: Column, b: Column) -> Column:
    return bitmap.bitwiseAND(F.bitwise_not(B.mask(b, c("w"))))


def hits(bitmap: Column, b: Column) -> Column:
    """Whether the block's cells meet any of the bitmap."""
    return bitmap.bitwiseAND(B.mask(b, c("w"))) != 0


def entered(b: Column, direction: int, cells: Column | None = None) -> Column:
    """Cells that a block newly takes with one step, null if it would leave the board; ``cells``: those it has."""
    m = B.mask(b, c("w")) if cells is None else cells
    x, y, w = B.x_of(b), B.y_of(b), c("w").cast("int")
    ok, moved = {
        B.NORTH: (y > 0, F.call_function("shiftrightunsigned", m, w)),
        B.EAST: (x + B.width_of(b) < c("w"), F.call_function("shiftleft", m, F.lit(1))),
        B.SOUTH: (y + B.height_of(b) < c("h"), F.call_function("shiftleft", m, w)),
        B.WEST: (x > 0, F.call_function("shiftrightunsigned", m, F.lit(1))),
    }[direction]
    return F.when(ok, moved.bitwiseAND(F.bitwise_not(m)))


def hits_moving(bitmap: Column, b: Column, direction: int) -> Column:
    """Whether a step's new cells meet any of the bitmap; null if the step leaves the board."""
    return bitmap.bitwiseAND(entered(b, direction)) != 0


def drawn(bitmap: Column) -> Column:
    """The bitmap as lines of 0 and 1, the top row first."""
    def row(y: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), c("w") - 1), lambda x: get_bit(bitmap, x, y).cast("int").cast("string")), "")

    return F.array_join(F.transform(F.sequence(F.lit(0), c("h") - 1), row), "\n")


def full_mask() -> Column:
    return F.when(c("w") * c("h") >= 64, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), (c("w") * c("h")).cast("int")) - 1)


def is_empty(bitmap: Column) -> Column:
    return bitmap.bitwiseAND(full_mask()) == 0


def is_full(bitmap: Column) -> Column:
    return bitmap.bitwiseAND(full_mask()) == full_mask()


def first_empty(bitmap: Column) -> Column:
    """Number of the lowest cell that is free, or null."""
    free = F.bitwise_not(bitmap).bitwiseAND(full_mask())
    below = free.bitwiseXOR(free - 1)  # the lowest one and what is under it; a lone sign bit can't be counted down from
    return F.when(free == -(2**63), 63).when(free != 0, (F.bit_count(below) - 1).cast("int"))


def first_empty_at(bitmap: Column) -> Column:
    """(x, y) of the lowest free cell, or null."""
    at = first_empty(bitmap)
    return F.when(at.isNotNull(), F.struct(F.pmod(at, c("w")).cast("int").alias("x"), F.floor(at / c("w")).cast("int").alias("y")))


# text


def to_text() -> Column:
    """``S:[WxH] G:[x,y] M:[R|F] B:[{row} {row}]``: a block is printed at its top left cell, X marks the target, * a wall."""

    def cell(x: Column, y: Column) -> Column:
        b = F.get(F.filter("blocks", lambda b: (B.x_of(b) == x) & (B.y_of(b) == y)), F.lit(0))
        sign = F.when(B.is_target(b), "X").when(B.is_immovable(b), "*").otherwise("x")
        return F.coalesce(F.concat(B.width_of(b).cast("string"), sign, B.height_of(b).cast("string")), F.lit("_"))

    rows = F.transform(F.sequence(F.lit(0), c("h") - 1), lambda y: F.concat(F.lit("{"), F.array_join(F.transform(F.sequence(F.lit(0), c("w") - 1), lambda x: cell(x, y)), " "), F.lit("}")))
    goal_text = F.when(c("goal"), F.format_string("G:[%d,%d] ", "gx", "gy")).otherwise("")
    return F.concat(F.format_string("S:[%dx%d] ", "w", "h"), goal_text, F.when(c("restricted"), "M:[R] ").otherwise("M:[F] "), F.lit("B:["), F.array_join(rows, " "), F.lit("]"))


def from_text(text: Column) -> Column:
    """A struct of the board's columns, or null. S, M and B are needed, G is not; each once, in any order."""
    size, mode = F.regexp_extract_all(text, F.lit(r"S:\[(\d)x(\d)\]"), F.lit(0)), F.regexp_extract_all(text, F.lit(r"M:\[[RF]\]"), F.lit(0))
    goals, body = F.regexp_extract_all(text, F.lit(r"G:\[(\d),(\d)\]"), F.lit(0)), F.regexp_extract_all(text, F.lit(r"B:\[[^\]]*\]"), F.lit(0))
    rows = F.regexp_extract_all(F.get(body, F.lit(0)), F.lit(r"\{([^}]*)\}"), F.lit(1))

    def cells(row: Column, y: Column) -> Column:
        def one(cell: Column, x: Column) -> Column:
            sign = F.substring(cell, 2, 1)
            return F.when(cell.rlike(r"^\d[xX*]\d$"), B.pack(x, y, F.substring(cell, 1, 1).cast("int"), F.substring(cell, 3, 1).cast("int"), sign == "X", sign == "*"))

        return F.transform(F.split(F.trim(row), " +"), one)

    found = F.sort_array(F.array_compact(F.flatten(F.transform(rows, cells))))
    words = F.flatten(F.transform(rows, lambda r: F.split(F.trim(r), " +")))
    good = F.forall(words, lambda v: v.rlike(r"^(_|\d[xX*]\d)$")) & (F.size(F.filter(words, lambda v: v != "_")) == F.size(found)) & (F.size(found) <= MAX_BLOCKS)
    ok = (F.size(size) == 1) & (F.size(mode) == 1) & (F.size(body) == 1) & (F.size(goals) <= 1) & good

    def digit(part: Column, i: int) -> Column:
        return F.coalesce(F.try_element_at(F.regexp_extract_all(part, F.lit(r"\d"), F.lit(0)), F.lit(i)).cast("int"), F.lit(0))

    return F.when(
        ok,
        F.struct(
            digit(F.get(size, F.lit(0)), 1).alias("w"),
            digit(F.get(size, F.lit(0)), 2).alias("h"),
            digit(F.coalesce(F.get(goals, F.lit(0)), F.lit("")), 1).alias("gx"),
            digit(F.coalesce(F.get(goals, F.lit(0)), F.lit("")), 2).alias("gy"),
            (F.get(mode, F.lit(0)) == "M:[R]").alias("restricted"),
            (F.size(goals) == 1).alias("goal"),
            found.alias("blocks"),
        ),
    )


# edits


def add_block(b: Column) -> Column:
    """blocks with ``b``, or null if there are 15, or it leaves the board, or meets another block."""
    free = ~F.exists("blocks", lambda o: B.collides(o, b))
    return F.when((F.size("blocks") < MAX_BLOCKS) & inside(b) & free, F.sort_array(F.array_append("blocks", b)))


def remove_block(x: Column | int, y: Column | int) -> Column:
    b = block_at(x, y)
    return F.when(b.isNotNull(), F.filter("blocks", lambda o: o != b))


def toggle_restricted() -> Column:
    return ~c("restricted")


def toggle_target(x: Column | int, y: Column | int) -> Column:
    """(gx, gy, goal, blocks) with the one at the cell as the only target, or none if it was; null without one, or for a wall.

    The goal goes back to (0, 0), though not off, where the block at the cell wouldn't fit there.
    """
    b = block_at(x, y)
    changed = F.transform("blocks", lambda o: F.when(o == b, B.retarget(o, ~B.is_target(o))).otherwise(B.retarget(o, F.lit(False))))
    stays = covers(c("gx"), c("gy"), B.width_of(b), B.height_of(b))
    gx, gy = (F.when(stays, c(g)).otherwise(0).cast("int").alias(g) for g in ("gx", "gy"))
    return F.when(b.isNotNull() & ~B.is_immovable(b), F.struct(gx, gy, c("goal").alias("goal"), F.sort_array(changed).alias("blocks")))


def toggle_wall(x: Column | int, y: Column | int) -> Column:
    b = block_at(x, y)
    return F.when(b.isNotNull() & ~B.is_target(b), F.sort_array(F.transform("blocks", lambda o: F.when(o == b, B.rewall(o, ~B.is_immovable(o))).otherwise(o))))


def set_goal(x: Column | int, y: Column | int) -> Column:
    """(gx, gy, goal): null without a target that fits; the goal that is set already is cleared."""
    t = target_block()
    fits = t.isNotNull() & (F.lit(0) + x + B.width_of(t) <= c("w")) & (F.lit(0) + y + B.height_of(t) <= c("h"))
    same = (c("gx") == x) & (c("gy") == y)
    def val(v: Column | int) -> Column:
        return F.when(same, 0).otherwise(F.lit(0) + v).cast("int")

    return F.when(fits, F.struct(val(x).alias("gx"), val(y).alias("gy"), (~same).alias("goal")))


def clear_goal() -> Column:
    """(gx, gy, goal) of a board without one."""
    return F.struct(F.lit(0).alias("gx"), F.lit(0).alias("gy"), F.lit(False).alias("goal"))


def resized(dw: int, dh: int) -> Column:
    """(w, h, gx, gy, goal, blocks) with a column or row more or less, or null beyond 3 to 8. Blocks that no longer fit go."""
    nw, nh = c("w") + dw, c("h") + dh
    kept = F.filter("blocks", lambda b: inside(b, nw, nh)) if dw < 0 or dh < 0 else F.col("blocks")
    t = F.get(F.filter(kept, B.is_target), F.lit(0))
    fits = t.isNotNull() & (c("gx") + B.width_of(t) <= nw) & (c("gy") + B.height_of(t) <= nh)
    stays = c("goal") & (F.lit(True) if dw >= 0 and dh >= 0 else F.coalesce(fits, F.lit(False)))
    x = F.lit(0) if dw < 0 else c("gx")  # taking a column away forgets where the goal was
    y = F.lit(0) if dw < 0 else c("gy")
    if dw < 0 or dh < 0:
        x, y = F.when(stays | ~c("goal"), x).otherwise(0), F.when(stays | ~c("goal"), y).otherwise(0)
    ok = nw.between(LEAST, MOST) & nh.between(LEAST, MOST)
    return F.when(ok, F.struct(nw.alias("w"), nh.alias("h"), x.cast("int").alias("gx"), y.cast("int").alias("gy"), stays.alias("goal"), kept.alias("blocks")))


# moves


def steps_of(b: Column, occ: Column, cells: Column | None = None) -> list[tuple[int, int, Column]]:
    """(direction, change of the block, whether it may go there) for a block on a board with these cells taken.

    Only the cells that a step newly takes need to be free.
    """
    ways = F.when(c("restricted"), B.principal_dirs(b)).otherwise(F.when(B.is_immovable(b), 0).otherwise(15))
    return [(d, change, (ways.bitwiseAND(F.lit(d)) > 0) & F.coalesce(entered(b, d, cells).bitwiseAND(occ) == 0, F.lit(False))) for d, _, _, change in B.STEPS]


def _with_occupied(make) -> Column:
    """``make`` of the cells taken, worked out once."""
    return F.get(F.transform(F.array(occupied()), make), F.lit(0))


def moves() -> Column:
    """All legal single steps: structs of idx, dir, next (blocks), in order of idx and then north, east, south, west."""

    def all_of(occ: Column) -> Column:
        def of(b: Column, i: Column) -> Column:
            return F.array_compact(F.array(*(F.when(ok, F.struct(i.alias("idx"), F.lit(d).alias("dir"), F.sort_array(F.array_append(F.array_remove("blocks", b), (b + change).cast("int"))).alias("next"))) for d, change, ok in steps_of(b, occ))))

        return F.flatten(F.transform("blocks", of))

    return _with_occupied(all_of)


def move_count() -> Column:
    """How many legal single steps there are."""
    def count(occ: Column) -> Column:
        return F.aggregate("blocks", F.lit(0), lambda n, b: n + sum((ok.cast("int") for _, _, ok in steps_of(b, occ)), F.lit(0)))

    return _with_occupied(count)


def move_at(x: Column | int, y: Column | int, direction: int) -> Column:
    """blocks after the block at a cell has gone one step, or null."""
    def of(b: Column) -> Column:
        change, ok = next((change, ok) for d, change, ok in steps_of(b, occupied()) if d == direction)
        return F.when(b.isNotNull() & ok, replaced(b, (b + change).cast("int")))

    return F.get(F.transform(F.array(block_at(x, y)), of), F.lit(0))


def replaced(old: Column, new: Column) -> Column:
    """blocks with one taken out and another put in at its place in order."""
    return F.sort_array(F.array_append(F.array_remove("blocks", old), new))
