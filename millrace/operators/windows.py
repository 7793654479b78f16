"""Window frames, including GROUPS and EXCLUDE, which Spark does not parse, and filters on windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.operators.order import terms

UNBOUNDED = None


@dataclass(frozen=True)
class Over:
    """PARTITION BY, ORDER BY and a frame. Without a frame, SQL's default holds (up to the last peer)."""

    partition: tuple = ()
    order: tuple = ()
    kind: str | None = None  # rows, range or groups
    start: int | None = UNBOUNDED
    end: int | None = 0
    exclude: str = "no others"  # current row, group, ties

    def rows(self, start: int | None, end: int | None, exclude: str = "no others") -> Over:
        return Over(self.partition, self.order, "rows", start, end, exclude)

    def range(self, start: int | None, end: int | None, exclude: str = "no others") -> Over:
        return Over(self.partition, self.order, "range", start, end, exclude)

    def groups(self, start: int | None, end: int | None, exclude: str = "no others") -> Over:
        return Over(self.partition, self.order, "groups", start, end, exclude)

    def base(self) -> WindowSpec:
        w = Window.partitionBy(*self.partition)
        return w.orderBy(*terms(self.order)) if self.order else w

    def spec(self) -> WindowSpec:
        w = self.base()
        if self.kind is None:
            return w
        low = Window.unboundedPreceding if self.start is None else self.start
        high = Window.unboundedFollowing if self.end is None else self.end
        return w.rowsBetween(low, high) if self.kind == "rows" else w.rangeBetween(low, high)


def over(partition=(), order=()) -> Over:
    tup = lambda x: (x,) if isinstance(x, str | Column) else tuple(x)
    return Over(tup(partition), tup(order))


def with_frame(df: DataFrame, name: str, aggregate: str, value: Column, w: Over) -> DataFrame:
    """``df`` with ``name``: sum, count, avg, min, max or list of ``value`` over the frame.

    Peer groups are numbered by dense_rank; a GROUPS frame is a RANGE over that number. EXCLUDE
    subtracts for sum, count and avg; for the rest the frame is listed with row and group numbers
    and the excluded ones are filtered out, so its memory grows with the frame.
    """
    own = df.columns
    df = df.withColumns({"_v": value, "_g": F.dense_rank().over(w.base()), "_r": F.row_number().over(w.base())})
    frame = w.spec()
    if w.kind == "groups":
        frame = Over(w.partition, ("_g",), "range", w.start, w.end).spec()
    plain = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max}
    if w.exclude == "no others":
        found = plain[aggregate]("_v").over(frame) if aggregate in plain else F.collect_list("_v").over(frame)
        return df.withColumn(name, found).select(*own, name)
    rows = F.collect_list(F.struct(F.col("_r").alias("r"), F.col("_g").alias("g"), F.col("_v").alias("v"))).over(frame)
    drop = {
        "current row": lambda x: x["r"] != F.col("_r"),
        "group": lambda x: x["g"] != F.col("_g"),
        "ties": lambda x: (x["g"] != F.col("_g")) | (x["r"] == F.col("_r")),
    }[w.exclude]
    if aggregate in ("sum", "count", "avg") and w.exclude == "current row" and w.kind == "rows" and (w.start is None or w.start <= 0) and (w.end is None or w.end >= 0):
        n = F.count("_v").over(frame) - F.when(F.col("_v").isNotNull(), 1).otherwise(0)
        total = F.coalesce(F.sum("_v").over(frame), F.lit(0)) - F.coalesce(F.col("_v"), F.lit(0))
        found = {"count": n, "sum": F.when(n > 0, total), "avg": F.when(n > 0, total / n)}[aggregate]
        return df.withColumn(name, found).select(*own, name)
    df = df.withColumn("_f", rows)
    kept = F.transform(F.filter("_f", drop), lambda x: x["v"])
    some = F.filter(kept, lambda v: v.isNotNull())
    zero = F.lit(0).cast(df.schema["_v"].dataType)
    total = F.aggregate(some, zero, lambda a, b: (a + b).cast(df.schema["_v"].dataType))
    n = F.size(some)
    found = {"count": n.cast("long"), "sum": F.when(n > 0, total), "avg": F.when(n > 0, total / n), "min": F.array_min(some), "max": F.array_max(some)}.get(aggregate, kept)
    return df.withColumn(name, found).select(*own, name)


def qualify(df: DataFrame, condition: Column, **windows: Column) -> DataFrame:
    """Add window columns, then keep the rows that meet a condition on them.

    ``rank <= k`` conditions let the planner stop each partition after k rows before the shuffle.
    """
    return df.withColumns(windows).where(condition)


row_number, rank, dense_rank, percent_rank, cume_dist, ntile = F.row_number, F.rank, F.dense_rank, F.percent_rank, F.cume_dist, F.ntile
lead, lag, first_value, last_value, nth_value = F.lead, F.lag, F.first_value, F.last_value, F.nth_value


def count_distinct_over(c: Column, w: WindowSpec) -> Column:
    """COUNT(DISTINCT ..) over a window, which Spark lacks; nulls don't count."""
    return F.size(F.collect_set(c).over(w)).cast("long")
