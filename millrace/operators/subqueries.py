"""Subquery predicates: EXISTS, IN, scalar, and the ANY / ALL comparisons that Spark lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exists(df: DataFrame, inner: DataFrame, on: Column | list[str], *, negate: bool = False) -> DataFrame:
    return df.join(inner, on, "left_anti" if negate else "left_semi")


def in_(df: DataFrame, column: str, inner: DataFrame) -> DataFrame:
    return df.join(inner.toDF("_in"), F.col(column) == F.col("_in"), "left_semi")


def not_in(df: DataFrame, column: str, inner: DataFrame) -> DataFrame:
    """NOT IN with SQL's nulls: one null inside and nothing qualifies; an empty set and all do.

    One-row statistics of the set (count, nulls) decide those cases; the rest is an anti join that
    can be hashed and shuffled, unlike the planner's null-aware one, which must broadcast.
    """
    v = inner.toDF("_in")
    stats = v.agg(F.count("*").alias("_n"), F.count("_in").alias("_k"))
    kept = df.join(v.where("_in is not null"), F.col(column) == F.col("_in"), "left_anti")
    ok = (F.col("_n") == 0) | ((F.col("_n") == F.col("_k")) & F.col(column).isNotNull())
    return kept.crossJoin(F.broadcast(stats)).where(ok).drop("_n", "_k")


def scalar(df: DataFrame, name: str, inner: DataFrame, value: Column, on: dict[str, str]) -> DataFrame:
    """A correlated scalar aggregate beside each row: grouped once, joined left. No match is null."""
    keys = list(on.values())
    once = inner.groupBy(*keys).agg(value.alias(name))
    once = once.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], name)
    cond = F.lit(True)
    for i, a in enumerate(on):
        cond = cond & (F.col(a) == F.col(f"_s{i}"))
    return df.join(once, cond, "left").drop(*[f"_s{i}" for i in range(len(keys))])


def compare(df: DataFrame, name: str, column: str, op: str, quantifier: str, inner: DataFrame) -> DataFrame:
    """``column op ANY|ALL (inner)`` as a three-valued column, from one row of statistics of the set."""
    v = inner.toDF("_v").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"), F.count("_v").alias("_k"))
    x = F.col(column)
    test = {">": lambda e: x > e, ">=": lambda e: x >= e, "<": lambda e: x < e, "<=": lambda e: x <= e}
    unknown = (F.col("_n") > F.col("_k")) | x.isNull()
    null = F.lit(None).cast("boolean")
    if (op, quantifier) == ("=", "all"):
        differs = (F.col("_k") > 0) & ((x != F.col("_lo")) | (x != F.col("_hi")))
        out = F.when(F.col("_n") == 0, True).when(differs, False).when(unknown, null).otherwise(True)
    elif quantifier == "any":
        best = F.col("_lo") if op in (">", ">=") else F.col("_hi")
        out = F.when(F.col("_n") == 0, False).when(test[op](best), True).when(unknown, null).otherwise(False)
    else:
        worst = F.col("_hi") if op in (">", ">=") else F.col("_lo")
        out = F.when(F.col("_n") == 0, True).when(~test[op](worst), False).when(unknown, null).otherwise(True)
    return df.crossJoin(F.broadcast(v)).withColumn(name, out).drop("_lo", "_hi", "_n", "_k")
