"""QuerySet: the lazy relation. State is kept apart and lowered in SQL's order of evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from millrace.operators import joins, predicates, setops, subqueries, windows
from millrace.operators.order import terms

if TYPE_CHECKING:
    from millrace.model import Model


class NotFound(LookupError):
    """``fetch_one`` found no row."""


class MultipleObjects(LookupError):
    """``fetch_one`` found more than one row."""


@dataclass(frozen=True)
class QuerySet:
    """WHERE, then DISTINCT, then ORDER BY, then OFFSET and LIMIT, whatever order they are chained in."""

    model: Model | None
    source: DataFrame
    where: tuple[Column, ...] = ()
    order: tuple = ()
    unique: bool | tuple[str, ...] = False
    skip: int = 0
    most: int | None = None
    empty: bool = False

    # -- predicates

    def filter(self, *conditions: Column, **named) -> QuerySet:
        extra = (*conditions, *([predicates.lookups(**named)] if named else []))
        return replace(self, where=(*self.where, *extra))

    def exclude(self, *conditions: Column, **named) -> QuerySet:
        """Rows for which the condition is false; unknown is not false, so null rows go as well."""
        extra = (*conditions, *([predicates.lookups(**named)] if named else []))
        return replace(self, where=(*self.where, ~predicates.all_of(*extra)))

    filter_expr = filter

    def filter_struct(self, fields: dict) -> QuerySet:
        return self.filter(predicates.lookups(**fields)) if fields else self

    def exclude_struct(self, fields: dict) -> QuerySet:
        return self.exclude(predicates.lookups(**fields)) if fields else self

    def not_deleted(self) -> QuerySet:
        return self.filter(F.col(self.model.deleted_at if self.model else "deleted_at").isNull())

    def none(self) -> QuerySet:
        """The empty relation; nothing chained before or after changes that."""
        return replace(self, empty=True)

    # -- shape

    def order_by(self, *order) -> QuerySet:
        return replace(self, order=order)

    def limit(self, n: int) -> QuerySet:
        return replace(self, most=n)

    def offset(self, n: int) -> QuerySet:
        return replace(self, skip=n)

    def distinct(self) -> QuerySet:
        return replace(self, unique=True)

    def distinct_on(self, *columns: str) -> QuerySet:
        """The first row of each combination under the ordering, which must begin with these columns."""
        return replace(self, unique=columns)

    def rows(self) -> DataFrame:
        """Filtered rows, before distinct, order and limits."""
        df = self.source
        if self.empty:
            return df.limit(0)
        for c in self.where:
            df = df.where(c)
        return df

    def unordered(self) -> DataFrame:
        """Rows after distinct, before order and limits: what counts count."""
        df = self.rows()
        if self.unique is True:
            return df.distinct()
        if self.unique:
            names = [str(o).lstrip("-") if isinstance(o, str) else getattr(o, "column", None) for o in self.order[: len(self.unique)]]
            if self.order and set(names) - set(self.unique):
                raise ValueError("distinct_on: the order must begin with the distinct columns")
            rest = terms(self.order[len(self.unique) :]) or [F.col(self.unique[0])]
            w = Window.partitionBy(*self.unique).orderBy(*rest)
            return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        return df

    def to_df(self) -> DataFrame:
        df = self.unordered()
        if self.order:
            df = df.orderBy(*terms(self.order))
        if self.skip:
            df = df.offset(self.skip)
        return df if self.most is None else df.limit(self.most)

    # -- projection

    def project(self, **columns: str | Column) -> QuerySet:
        """A named projection: renames, derived and embedded (struct) columns."""
        df = self.to_df().select(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in columns.items()])
        return QuerySet(None, df)

    def selecting(self, column: str) -> DataFrame:
        """One column as a subquery source; an order or limit on it is an error."""
        if self.order or self.most is not None or self.skip:
            raise ValueError("a subquery source has no order, limit or offset")
        return self.unordered().select(column)

    def computed(self, **columns: str | Column) -> QuerySet:
        """Columns computed for each row, from SQL fragments or expressions."""
        return replace(self, source=self.source.withColumns({k: F.expr(v) if isinstance(v, str) else v for k, v in columns.items()}))

    def annotate(self, **columns: Column) -> QuerySet:
        """Window or scalar columns beside every row."""
        return QuerySet(None, self.to_df().withColumns(columns))

    def annotate_totals(self, **aggregates: Column) -> QuerySet:
        """Aggregates of the whole relation beside every row.

        The aggregate is one row and is joined as a broadcast, so the rows stay where they are;
        a window over everything would move them all to one task.
        """
        df = self.to_df()
        return QuerySet(None, df.crossJoin(F.broadcast(df.agg(*[v.alias(k) for k, v in aggregates.items()]))))

    def qualify(self, condition: Column, **columns: Column) -> QuerySet:
        return QuerySet(None, windows.qualify(self.to_df(), condition, **columns))

    # -- groups

    def aggregate(self, **aggregates: Column) -> DataFrame:
        return self.unordered().agg(*[v.alias(k) for k, v in aggregates.items()])

    def group_by(self, *keys: str | Column) -> Grouped:
        return Grouped(self.unordered().groupBy(*keys))

    def rollup(self, *keys: str) -> Grouped:
        return Grouped(self.unordered().rollup(*keys))

    def cube(self, *keys: str) -> Grouped:
        return Grouped(self.unordered().cube(*keys))

    def grouping_sets(self, sets: list[list[str]], keys: list[str]) -> Grouped:
        return Grouped(self.unordered().groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in keys]))

    # -- joins and subqueries

    def select_related(self, column: str, target: DataFrame, key: str) -> DataFrame:
        return joins.select_related(self.to_df(), column, target, key)

    def cross_join_with(self, other: QuerySet) -> joins.Pairs:
        return joins.Pairs(self.rows(), other.rows(), self._key(), other._key())

    def self_pairs(self) -> joins.Pairs:
        return joins.Pairs(self.rows(), self.rows(), self._key(), self._key(), drop_equal=True)

    def _key(self) -> str | None:
        return self.model.key if self.model else None

    def join_values(self, values: DataFrame, on: dict[str, str]) -> DataFrame:
        return joins.join_values(self, values, on, "inner")

    def left_join_values(self, values: DataFrame, on: dict[str, str]) -> DataFrame:
        return joins.join_values(self, values, on, "left")

    def cross_join_values(self, values: DataFrame) -> DataFrame:
        return joins.join_values(self, values, {}, "cross")

    def join_lateral(self, inner: DataFrame, on: dict[str, str], order, limit: int, *, left: bool = False) -> DataFrame:
        return joins.lateral(self.to_df(), inner, on, order, limit, left=left)

    def where_exists(self, inner: DataFrame, on: Column | list[str], *, negate: bool = False) -> QuerySet:
        return replace(self, source=subqueries.exists(self.source, inner, on, negate=negate))

    # -- set operations

    def union(self, other: QuerySet) -> QuerySet:
        return setops.combine("union", self, other)

    def union_all(self, other: QuerySet) -> QuerySet:
        return setops.combine("union_all", self, other)

    def intersect(self, other: QuerySet) -> QuerySet:
        return setops.combine("intersect", self, other)

    def except_(self, other: QuerySet) -> QuerySet:
        return setops.combine("except", self, other)

    # -- terminals

    def fetch_all(self) -> list[Row]:
        return [] if self.empty else self.to_df().collect()

    def first(self) -> Row | None:
        return next(iter(self.limit(1).fetch_all()), None)

    def fetch_one(self) -> Row:
        found = self.limit(2).fetch_all()
        if not found:
            raise NotFound("no row matches")
        if len(found) > 1:
            raise MultipleObjects("several rows match")
        return found[0]

    def in_bulk(self, keys: list) -> dict:
        """Rows by key, for a caller's list of keys (joined, so the list may be long)."""
        if not keys:
            return {}
        key = self._key()
        wanted = self.source.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(keys)], self.source.select(key).schema)
        return {r[key]: r for r in self.rows().join(wanted, key, "left_semi").collect()}

    def count(self) -> int:
        """Rows after distinct; order, limit and offset are ignored."""
        return 0 if self.empty else self.unordered().count()

    def exists(self) -> bool:
        return not self.empty and not self.rows().limit(1).isEmpty()

    def stream(self, *, prefetch: bool = True) -> Iterator[Row]:
        """Rows one partition at a time, so the driver never holds them all."""
        return self.to_df().toLocalIterator(prefetchPartitions=prefetch)

    def cached(self) -> QuerySet:
        return replace(self, source=self.rows().cache(), where=())

    def pipe(self, f: Callable[[DataFrame], DataFrame]) -> QuerySet:
        return QuerySet(self.model, f(self.to_df()))


@dataclass(frozen=True)
class Grouped:
    """Grouped rows: aggregates first, then HAVING, order and limits on the result."""

    grouped: object

    def annotate(self, **aggregates: Column) -> GroupedRows:
        return GroupedRows(self.grouped.agg(*[v.alias(k) for k, v in aggregates.items()]))


@dataclass(frozen=True)
class GroupedRows:
    df: DataFrame

    def having(self, condition: Column) -> GroupedRows:
        return GroupedRows(self.df.where(condition))

    def order_by(self, *order) -> GroupedRows:
        return GroupedRows(self.df.orderBy(*terms(order)))

    def offset(self, n: int) -> GroupedRows:
        return GroupedRows(self.df.offset(n))

    def limit(self, n: int) -> GroupedRows:
        return GroupedRows(self.df.limit(n))

    def to_df(self) -> DataFrame:
        return self.df

    def fetch_all(self) -> list[Row]:
        return self.df.collect()
