"""Scalar expressions whose meaning is fixed where Spark's default differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def int_div(a: Column, b: Column) -> Column:
    """Integer division, truncating toward zero; dividing by zero is an error."""
    return F.call_function("div", a, b)


def divide(df: DataFrame, a: str, b: str) -> Column:
    """``a / b`` as SQL types it: truncated between whole numbers, and of the wider type."""
    kinds = [df.schema[x].dataType for x in (a, b)]
    if all(isinstance(k, _WHOLE) for k in kinds):
        wide = max(kinds, key=lambda k: _WHOLE.index(type(k)))
        return int_div(F.col(a), F.col(b)).cast(wide)
    return F.col(a) / F.col(b)


def case(*branches: tuple[Column, object], otherwise) -> Column:
    """CASE WHEN; the ELSE branch must be given."""
    if not branches:
        raise ValueError("a case needs a branch")
    (cond, value), *rest = branches
    out = F.when(cond, value)
    for cond, value in rest:
        out = out.when(cond, value)
    return out.otherwise(otherwise)


def current_year() -> Column:
    return F.year(F.current_date())


def interval(microseconds: int) -> Column:
    """A day-time interval."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(microseconds) / F.lit(1_000_000))


def calendar_interval(months: int = 0, days: int = 0, microseconds: int = 0) -> Column:
    """An interval of months, days and time as a struct; ``plus`` applies it."""
    return F.struct(F.lit(months).alias("months"), F.lit(days).alias("days"), F.lit(microseconds).cast("long").alias("micros"))


def plus(ts: Column, span: Column) -> Column:
    """``ts`` later by a ``calendar_interval``."""
    return ts + F.make_interval(months=span["months"], days=span["days"], secs=span["micros"] / F.lit(1_000_000))


def array_length(c: Column) -> Column:
    """Elements of a one-dimensional array; null for an empty one, as SQL's ``array_length`` has it."""
    return F.when(F.size(c) > 0, F.size(c))


def is_empty(c: Column) -> Column:
    """True for an empty array (the intent; ``array_length = 0`` would never hold). Null stays null."""
    return F.when(c.isNotNull(), F.size(c) == 0)
