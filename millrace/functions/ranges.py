"""Range values as structs (lower, upper, lower_inc, upper_inc, empty); a null bound is infinite.

Ranges over whole numbers and dates are made canonical, [lower, upper), so equal ranges are equal
structs. The empty range is contained in every range, contains and overlaps nothing, and has no
side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(lower: Column, upper: Column, bounds: str = "[)", *, discrete: bool = False) -> Column:
    low_inc, up_inc = bounds[0] == "[", bounds[1] == "]"
    if discrete:
        lower = lower if low_inc else lower + 1
        upper = upper + 1 if up_inc else upper
        low_inc, up_inc = True, False
    none = (lower > upper) | ((lower == upper) & F.lit(not (low_inc and up_inc)))
    none = F.coalesce(none, F.lit(False))
    null = F.lit(None)
    return F.struct(
        F.when(none, null).otherwise(lower).alias("lower"),
        F.when(none, null).otherwise(upper).alias("upper"),
        (~none & lower.isNotNull() & F.lit(low_inc)).alias("lower_inc"),
        (~none & upper.isNotNull() & F.lit(up_inc)).alias("upper_inc"),
        none.alias("empty"),
    )


def _low_cmp(a: Column, b: Column) -> Column:
    """a's lower bound starts no later than b's."""
    x, y = a["lower"], b["lower"]
    return F.when(x.isNull(), True).when(y.isNull(), False).otherwise((x < y) | ((x == y) & (a["lower_inc"] | ~b["lower_inc"])))


def _up_cmp(a: Column, b: Column) -> Column:
    """a's upper bound ends no earlier than b's."""
    x, y = a["upper"], b["upper"]
    return F.when(x.isNull(), True).when(y.isNull(), False).otherwise((x > y) | ((x == y) & (a["upper_inc"] | ~b["upper_inc"])))


def contains_element(r: Column, v: Column) -> Column:
    low = F.when(r["lower"].isNull(), True).otherwise((v > r["lower"]) | ((v == r["lower"]) & r["lower_inc"]))
    up = F.when(r["upper"].isNull(), True).otherwise((v < r["upper"]) | ((v == r["upper"]) & r["upper_inc"]))
    return ~r["empty"] & low & up


def contains(a: Column, b: Column) -> Column:
    return F.when(b["empty"], True).when(a["empty"], False).otherwise(_low_cmp(a, b) & _up_cmp(a, b))


def contained_by(a: Column, b: Column) -> Column:
    return contains(b, a)


def strictly_left(a: Column, b: Column) -> Column:
    x, y = a["upper"], b["lower"]
    return F.when(a["empty"] | b["empty"] | x.isNull() | y.isNull(), False).otherwise((x < y) | ((x == y) & ~(a["upper_inc"] & b["lower_inc"])))


def strictly_right(a: Column, b: Column) -> Column:
    return strictly_left(b, a)


def overlaps(a: Column, b: Column) -> Column:
    return F.when(a["empty"] | b["empty"], False).otherwise(~strictly_left(a, b) & ~strictly_left(b, a))


def not_extends_right(a: Column, b: Column) -> Column:
    return F.when(a["empty"] | b["empty"], False).otherwise(_up_cmp(b, a))


def not_extends_left(a: Column, b: Column) -> Column:
    return F.when(a["empty"] | b["empty"], False).otherwise(_low_cmp(b, a))


def adjacent(a: Column, b: Column) -> Column:
    touch = lambda x, y: F.coalesce((x["upper"] == y["lower"]) & (x["upper_inc"] != y["lower_inc"]), F.lit(False))
    return F.when(a["empty"] | b["empty"], False).otherwise(touch(a, b) | touch(b, a))
