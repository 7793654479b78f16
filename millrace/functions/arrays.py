"""Array predicates, two-valued where an element is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains(c: Column, values: Column) -> Column:
    """Every element of ``values`` is in ``c``; a null element is contained by nothing."""
    return F.when(c.isNotNull() & values.isNotNull(), F.forall(values, lambda v: F.coalesce(F.array_contains(c, v), F.lit(False))))


def contained_by(c: Column, values: Column) -> Column:
    return contains(values, c)


def overlap(c: Column, values: Column) -> Column:
    """Some non-null element is in both."""
    return F.when(c.isNotNull() & values.isNotNull(), F.coalesce(F.arrays_overlap(c, values), F.lit(False)))
