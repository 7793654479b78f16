"""Predicates: fields, the Q algebra, and the two null rules.

``field`` follows SQL: a comparison with null is unknown and the row goes. ``portable`` treats an
absent value as a value of its own, so ``neq`` keeps null rows. String matching ignores case
unless told otherwise, and needs no wildcard escapes because nothing is a pattern.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _value(v):
    return v if isinstance(v, Column) else F.lit(v)


class Field:
    """A column under SQL's three-valued logic."""

    def __init__(self, column: str | Column):
        self.c = F.col(column) if isinstance(column, str) else column

    def eq(self, v) -> Column:
        return self.c == _value(v)

    def neq(self, v) -> Column:
        return self.c != _value(v)

    def gt(self, v) -> Column:
        return self.c > _value(v)

    def gte(self, v) -> Column:
        return self.c >= _value(v)

    def lt(self, v) -> Column:
        return self.c < _value(v)

    def lte(self, v) -> Column:
        return self.c <= _value(v)

    def between(self, low, high) -> Column:
        return self.c.between(_value(low), _value(high))

    def in_(self, values) -> Column:
        values = list(values)
        return self.c.isin(values) if values else F.lit(False)

    def not_in(self, values) -> Column:
        values = list(values)
        return ~self.c.isin(values) if values else F.lit(True)

    def is_null(self) -> Column:
        return self.c.isNull()

    def is_not_null(self) -> Column:
        return self.c.isNotNull()

    def distinct_from(self, v) -> Column:
        return ~self.c.eqNullSafe(_value(v))

    def not_distinct_from(self, v) -> Column:
        return self.c.eqNullSafe(_value(v))

    def contains(self, s: str) -> Column:
        return F.lower(self.c).contains(s.lower())

    def starts_with(self, s: str) -> Column:
        return F.lower(self.c).startswith(s.lower())

    def ends_with(self, s: str) -> Column:
        return F.lower(self.c).endswith(s.lower())

    def contains_case_sensitive(self, s: str) -> Column:
        return self.c.contains(s)

    def starts_with_case_sensitive(self, s: str) -> Column:
        return self.c.startswith(s)

    def ends_with_case_sensitive(self, s: str) -> Column:
        return self.c.endswith(s)

    def iexact(self, s: str) -> Column:
        return F.lower(self.c) == s.lower()

    def regex(self, pattern: str) -> Column:
        return self.c.rlike(pattern)

    def iregex(self, pattern: str) -> Column:
        return self.c.rlike(f"(?i){pattern}")

    def some(self) -> Field:
        """The value where there is one; comparisons of absent values are unknown."""
        return Field(F.when(self.c.isNotNull(), self.c))


_FOLD = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Portable(Field):
    """A column whose predicates are never unknown: an absent value equals only an absent value."""

    def eq(self, v) -> Column:
        return self.c.eqNullSafe(_value(v))

    def neq(self, v) -> Column:
        return ~self.c.eqNullSafe(_value(v))

    def _two_valued(self, c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    def gt(self, v) -> Column:
        return self._two_valued(super().gt(v))

    def gte(self, v) -> Column:
        return self._two_valued(super().gte(v))

    def lt(self, v) -> Column:
        return self._two_valued(super().lt(v))

    def lte(self, v) -> Column:
        return self._two_valued(super().lte(v))

    def between(self, low, high) -> Column:
        return self._two_valued(super().between(low, high))

    def in_(self, values) -> Column:
        values = list(values)
        some = [v for v in values if v is not None]
        found = F.coalesce(self.c.isin(some), F.lit(False)) if some else F.lit(False)
        return found | self.c.isNull() if len(some) < len(values) else found

    def not_in(self, values) -> Column:
        return ~self.in_(values)

    def contains(self, s: str) -> Column:
        return self._two_valued(super().contains(s))

    def starts_with(self, s: str) -> Column:
        return self._two_valued(super().starts_with(s))

    def ends_with(self, s: str) -> Column:
        return self._two_valued(super().ends_with(s))

    def iexact(self, s: str) -> Column:
        """ASCII case folding only."""
        return self._two_valued(F.translate(self.c, *_FOLD) == s.translate(str.maketrans(*_FOLD)))


def field(column: str | Column) -> Field:
    return Field(column)


def portable(column: str | Column) -> Portable:
    return Portable(column)


def all_of(*conditions: Column) -> Column:
    """AND; true if there is nothing to hold."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True)) if conditions else F.lit(True)


def any_of(*conditions: Column) -> Column:
    """OR; false if there is nothing to hold."""
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def xor(a: Column, b: Column) -> Column:
    return (~a & b) | (a & ~b)


def lookups(**named) -> Column:
    """A conjunction from ``column__lookup=value`` (``column=value`` is equality)."""
    parts = []
    for key, v in named.items():
        name, _, kind = key.partition("__")
        kind = {"": "eq", "in": "in_", "isnull": "is_null"}.get(kind, kind)
        f = Field(name)
        if kind == "is_null":
            parts.append(f.is_null() if v else f.is_not_null())
        elif kind == "between":
            parts.append(f.between(*v))
        else:
            parts.append(getattr(f, kind)(v))
    return all_of(*parts)
