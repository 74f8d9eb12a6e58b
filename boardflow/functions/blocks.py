"""Blocks as integers.

Fixed layout: bit 0 immovable, 1 target, 2-4 width - 1, 5-7 height - 1, 8-10 x, 11-13 y, 15 invalid. Numeric order is
that of (y, x, height, width, target, immovable). Directions are bits: north 1, east 2, south 4, west 8.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORTH, EAST, SOUTH, WEST = 1, 2, 4, 8
INVALID = 0x8000
#: direction, change of x, change of y, change of the integer
STEPS = ((NORTH, 0, -1, -2048), (EAST, 1, 0, 256), (SOUTH, 0, 1, 2048), (WEST, -1, 0, -256))


def pack(x: Column, y: Column, w: Column, h: Column, target: Column, immovable: Column) -> Column:
    """The block, or null if it leaves an 8 by 8 board or is both target and immovable."""
    ok = (x >= 0) & (y >= 0) & (w >= 1) & (h >= 1) & (x + w <= 8) & (y + h <= 8) & ~(target & immovable)
    value = y * 2048 + x * 256 + (h - 1) * 32 + (w - 1) * 4 + target.cast("int") * 2 + immovable.cast("int")
    return F.when(ok, value.cast("int"))


def _field(b: Column, first: int, mask: int) -> Column:
    return F.call_function("shiftright", b.cast("int"), F.lit(first)).bitwiseAND(F.lit(mask))


def x_of(b: Column) -> Column:
    return _field(b, 8, 7)


def y_of(b: Column) -> Column:
    return _field(b, 11, 7)


def width_of(b: Column) -> Column:
    return _field(b, 2, 7) + 1


def height_of(b: Column) -> Column:
    return _field(b, 5, 7) + 1


def is_target(b: Column) -> Column:
    return _field(b, 1, 1) == 1


def is_immovable(b: Column) -> Column:
    return _field(b, 0, 1) == 1


def shape_of(b: Column) -> Column:
    """What is left when the position is not looked at."""
    return b.bitwiseAND(F.lit(0xFF))


def valid(b: Column) -> Column:
    return (b.bitwiseAND(F.lit(INVALID)) == 0) & ~(is_target(b) & is_immovable(b)) & (x_of(b) + width_of(b) <= 8) & (y_of(b) + height_of(b) <= 8)


def principal_dirs(b: Column) -> Column:
    """Ways a block may go on a restricted board: along its longer side, a square any way, a wall none."""
    w, h = width_of(b), height_of(b)
    return F.when(is_immovable(b), 0).when(w > h, EAST | WEST).when(h > w, NORTH | SOUTH).otherwise(15)


def covers(b: Column, x: Column | int, y: Column | int) -> Column:
    return (x_of(b) <= x) & (x_of(b) + width_of(b) > x) & (y_of(b) <= y) & (y_of(b) + height_of(b) > y)


def collides(a: Column, b: Column) -> Column:
    return (x_of(a) < x_of(b) + width_of(b)) & (x_of(b) < x_of(a) + width_of(a)) & (y_of(a) < y_of(b) + height_of(b)) & (y_of(b) < y_of(a) + height_of(a))


#: Bitmaps of the left column of a board's top left corner, by board width and height; made by rule, a constant in plans.
_COLUMNS = ", ".join(f"{sum(1 << (r * w) for r in range(h)) & ((1 << 63) - 1)}L" for w in range(1, 9) for h in range(1, 9))


def mask(b: Column, board_width: Column | int) -> Column:
    """The block's cells as a bitmap; cell (x, y) is bit y * board_width + x. The block is no wider than the board."""
    w = (board_width if isinstance(board_width, Column) else F.lit(board_width)).cast("int")
    row = F.call_function("shiftleft", F.lit(1).cast("long"), width_of(b)) - 1
    column = F.get(F.expr(f"array({_COLUMNS})"), (w - 1) * 8 + _field(b, 5, 7))
    # a column of bits times a row is all its cells; with 64 of them, the product has no sign bit to spare
    shape = F.when(b.bitwiseAND(F.lit(0xFC)) == 0xFC, F.lit(-1).cast("long")).otherwise(column * row)
    return F.call_function("shiftleft", shape, y_of(b) * w + x_of(b))


def retarget(b: Column, on: Column) -> Column:
    return b.bitwiseAND(F.lit(~2)).bitwiseOR(F.when(on, 2).otherwise(0))


def rewall(b: Column, on: Column) -> Column:
    return b.bitwiseAND(F.lit(~1)).bitwiseOR(F.when(on, 1).otherwise(0))
