"""Set operations: positional, with explicit nesting; each arm keeps its own order and limit."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

if TYPE_CHECKING:
    from millrace.queryset import QuerySet


def _apply(kind: str, a: DataFrame, b: DataFrame) -> DataFrame:
    if kind == "union":
        return a.union(b).distinct()
    return {"union_all": a.union, "intersect": a.intersect, "except": a.subtract}[kind](b)


def combine(kind: str, left: QuerySet, right: QuerySet) -> QuerySet:
    """A new relation; chains associate to the left, nested arms are evaluated as they stand."""
    from millrace.queryset import QuerySet

    return QuerySet(left.model, _apply(kind, left.to_df(), right.to_df()))


def combine_as(kind: str, left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Rows of different models by position, under new names; counts and types must agree."""
    if len(left.columns) != len(right.columns) or len(names) != len(left.columns):
        raise ValueError(f"set operation over {len(left.columns)} and {len(right.columns)} columns, named {len(names)}")
    for i, (x, y) in enumerate(zip(left.schema, right.schema, strict=True)):
        if x.dataType.typeName() != y.dataType.typeName():
            raise TypeError(f"column {i} is {x.dataType.simpleString()} on the left and {y.dataType.simpleString()} on the right")
    return _apply(kind, left, right).toDF(*names)
