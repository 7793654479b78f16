"""Aggregates with SQL's results: cast-back sums, kept nulls, ordered and hypothetical sets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where(condition: Column, value: Column | None = None) -> Column:
    """FILTER (WHERE ..): what the aggregate sees. Without a value, 1 for counting rows."""
    return F.when(condition, F.lit(1) if value is None else value)


def sum_(df: DataFrame, column: str, condition: Column | None = None) -> Column:
    """Sum in the column's own type; an overflow is an error."""
    c = F.col(column)
    return F.sum(c if condition is None else where(condition, c)).cast(df.schema[column].dataType)


def avg(c: Column) -> Column:
    return F.avg(c).cast("double")


def count_distinct(*c: Column) -> Column:
    return F.count_distinct(*c)


def every(c: Column) -> Column:
    return F.bool_and(c)


def _ordered(c: Column, order: Iterable[Column] | None, descending: bool) -> Column:
    """All values, nulls too, as a list in the order's order (nulls last, or first if descending)."""
    keys = list(order) if order is not None else [c]
    parts = [x for i, k in enumerate(keys) for x in (k.isNull().alias(f"n{i}"), k.alias(f"k{i}"))]
    rows = F.array_sort(F.collect_list(F.struct(*parts, c.alias("v"))))
    return F.transform(F.reverse(rows) if descending else rows, lambda x: x["v"])


def array_agg(c: Column, order: Iterable[Column] | None = None, *, descending: bool = False, distinct: bool = False) -> Column:
    """Every value, nulls included. Distinct lists are in the values' order unless one is given."""
    out = _ordered(c, order, descending)
    return F.array_distinct(out) if distinct else out


def json_agg(c: Column, order: Iterable[Column] | None = None) -> Column:
    return F.to_json(array_agg(c, order), {"ignoreNullFields": "false"})


def json_object_agg(key: Column, value: Column) -> Column:
    """An object text of one pair a row; keys must not be null or repeat (see ``LAST_WIN``)."""
    return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.cast("string").alias("k"), value.alias("v"))))), {"ignoreNullFields": "false"})


def string_agg(c: Column, separator: str, order: Iterable[Column] | None = None, *, descending: bool = False, distinct: bool = False) -> Column:
    """Joined non-null values; DISTINCT needs an order."""
    if distinct and order is None:
        raise ValueError("string_agg with distinct needs an order")
    found = F.filter(_ordered(c, order, descending), lambda x: x.isNotNull())
    text = F.array_join(F.array_distinct(found) if distinct else found, separator)
    return F.when(F.count(c) > 0, text)


def percentile_cont(c: str, p: float, *, descending: bool = False) -> Column:
    return F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY {c}{' DESC' if descending else ''})")


def percentile_disc(c: Column, p: float, *, descending: bool = False) -> Column:
    """The first value with at least ``p`` of the non-null values up to it; any orderable type."""
    values = F.sort_array(F.collect_list(c), asc=not descending)
    return F.when(F.count(c) > 0, F.element_at(values, F.greatest(F.lit(1), F.ceil(F.lit(p) * F.count(c)).cast("int"))))


def mode(c: str, *, descending: bool = False) -> Column:
    """The most frequent value; of several, the first in the order."""
    return F.expr(f"mode() WITHIN GROUP (ORDER BY {c}{' DESC' if descending else ''})")


def _ahead(c: Column, v, descending: bool) -> Column:
    """Whether a row sorts before the hypothetical one: nulls last ascending, first descending."""
    return F.coalesce(c > v, F.lit(True)) if descending else F.coalesce(c < v, F.lit(False))


def _upto(c: Column, v, descending: bool) -> Column:
    return F.coalesce(c >= v, F.lit(True)) if descending else F.coalesce(c <= v, F.lit(False))


def rank_of(v, c: Column, *, descending: bool = False) -> Column:
    return F.count_if(_ahead(c, v, descending)) + 1


def dense_rank_of(v, c: Column, *, descending: bool = False) -> Column:
    nulls = F.max(F.when(c.isNull(), 1).otherwise(0)) if descending else F.lit(0)
    return F.count_distinct(F.when(_ahead(c, v, descending), c)) + F.coalesce(nulls, F.lit(0)) + 1


def percent_rank_of(v, c: Column, *, descending: bool = False) -> Column:
    n = F.count(F.lit(1))
    return F.when(n > 0, F.count_if(_ahead(c, v, descending)) / n).otherwise(F.lit(0.0))


def cume_dist_of(v, c: Column, *, descending: bool = False) -> Column:
    return (F.count_if(_upto(c, v, descending)) + 1) / (F.count(F.lit(1)) + 1)


def grouping_of(*columns: str) -> Column:
    """Bit mask of the columns that are grouped away; the rightmost is bit 0."""
    out = F.lit(0)
    for c in columns:
        out = out * 2 + F.grouping(c).cast("int")
    return out.cast("long")


#: Built-in aggregates under the names of the query surface (receiver y first, argument x second).
count, min_, max_ = F.count, F.min, F.max
stddev_pop, stddev_samp, stddev = F.stddev_pop, F.stddev_samp, F.stddev
var_pop, var_samp, variance = F.var_pop, F.var_samp, F.variance
covar_pop, covar_samp, corr = F.covar_pop, F.covar_samp, F.corr
regr_avgx, regr_avgy, regr_count, regr_intercept, regr_r2 = F.regr_avgx, F.regr_avgy, F.regr_count, F.regr_intercept, F.regr_r2
regr_slope, regr_sxx, regr_sxy, regr_syy = F.regr_slope, F.regr_sxx, F.regr_sxy, F.regr_syy
bool_and, bool_or, bit_and, bit_or, bit_xor = F.bool_and, F.bool_or, F.bit_and, F.bit_or, F.bit_xor
