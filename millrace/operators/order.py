"""Sort terms with stated null placement: ascending puts nulls last, descending first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Order:
    column: str | Column
    ascending: bool = True
    nulls: str | None = None  # "first" or "last"; by default last if ascending and first if not

    def nulls_first(self) -> Order:
        return Order(self.column, self.ascending, "first")

    def nulls_last(self) -> Order:
        return Order(self.column, self.ascending, "last")

    def reverse(self) -> Order:
        flip = {"first": "last", "last": "first", None: None}
        return Order(self.column, not self.ascending, flip[self.nulls])

    def build(self) -> Column:
        c = F.col(self.column) if isinstance(self.column, str) else self.column
        place = self.nulls or ("last" if self.ascending else "first")
        return getattr(c, f"{'asc' if self.ascending else 'desc'}_nulls_{place}")()


def asc(column: str | Column) -> Order:
    return Order(column)


def desc(column: str | Column) -> Order:
    return Order(column, False)


def terms(order) -> list[Column]:
    """Columns to sort by; a bare name is ascending, one with ``-`` in front descending."""
    out = []
    for o in order:
        if isinstance(o, str):
            o = desc(o[1:]) if o.startswith("-") else asc(o)
        out.append(o.build() if isinstance(o, Order) else o)
    return out
