"""Bit fields of unsigned words of 8, 16, 32 or 64 bits, kept in a long."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def shl(x: Column | int, n: Column | int) -> Column:
    return F.call_function("shiftleft", _col(x).cast("long"), _col(n).cast("int"))


def shr(x: Column | int, n: Column | int) -> Column:
    return F.call_function("shiftrightunsigned", _col(x).cast("long"), _col(n).cast("int"))


def create_mask(first: Column | int, last: Column | int) -> Column:
    """Ones from bit ``first`` to bit ``last``, both included; all 64 bits are ones too."""
    size = _col(last) - _col(first) + 1
    return shl(F.when(size >= 64, F.lit(-1).cast("long")).otherwise(shl(1, size) - 1), first)


def clear_bits(bits: Column, first: Column | int, last: Column | int) -> Column:
    return bits.cast("long").bitwiseAND(F.bitwise_not(create_mask(first, last)))


def set_bits(bits: Column, first: Column | int, last: Column | int, value: Column | int) -> Column:
    """The field replaced; what of ``value`` doesn't fit is dropped."""
    return clear_bits(bits, first, last).bitwiseOR(shl(value, first).bitwiseAND(create_mask(first, last)))


def get_bits(bits: Column, first: Column | int, last: Column | int) -> Column:
    return shr(bits.cast("long").bitwiseAND(create_mask(first, last)), first)
