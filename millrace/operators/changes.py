"""Data-modification operators as frames: the table after the change, and the rows it touched."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def update(df: DataFrame, condition: Column, sets: dict[str, Column], *, stamp: str | None = "updated_at") -> tuple[DataFrame, DataFrame]:
    """(table after, changed rows as they are now). ``stamp`` gets the current time if the table has it."""
    if not sets:
        raise ValueError("an update sets something")
    hit = F.coalesce(condition, F.lit(False))
    values = dict(sets)
    if stamp in df.columns:
        if stamp in sets:
            raise ValueError(f"{stamp} is set by the update itself")
        values[stamp] = F.current_timestamp()
    marked = df.withColumn("_hit", hit)
    kinds = dict(df.dtypes)
    after = marked.select(*[F.when(F.col("_hit"), values[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns], "_hit")
    return after.drop("_hit"), after.where("_hit").drop("_hit")


def increment(column: str, by=1) -> Column:
    return F.col(column) + by


def delete(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows deleted); an unknown condition deletes nothing."""
    hit = F.coalesce(condition, F.lit(False))
    return df.where(~hit), df.where(hit)


def returning_pairs(df: DataFrame, condition: Column, sets: dict[str, Column]) -> DataFrame:
    """Changed rows as ``old_*`` and ``new_*`` columns."""
    kinds = dict(df.dtypes)
    return df.where(condition).select(*[F.col(c).alias(f"old_{c}") for c in df.columns], *[(sets[c].cast(kinds[c]) if c in sets else F.col(c)).alias(f"new_{c}") for c in df.columns])


def _refuse_repeats(source: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``source``; the query fails when a key repeats in it (checked as it runs, grouped before the shuffle)."""
    n = source.groupBy(*keys).agg(F.count("*").alias("_n"))
    checked = n.where(F.when(F.col("_n") > 1, F.raise_error(F.lit(what)).cast("boolean")).otherwise(F.lit(True)))
    return source.join(checked.select(*keys), keys)


def insert_select(target: DataFrame, source: DataFrame, mapping: dict[str, Column | str], *, conflict: list[str] | None = None, do_update: dict[str, Column] | None = None, update_where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(table after, rows inserted or updated).

    ``mapping`` gives target columns from source ones; the rest are null. Without ``conflict`` rows
    are appended. With it, a source row whose key exists is skipped, or updates the target row by
    ``do_update`` (expressions over ``t_*`` and ``s_*`` columns) if ``update_where`` holds. Two
    source rows with one key fail when updating; otherwise the second is skipped like any conflict.
    """
    if not mapping:
        raise ValueError("an insert maps at least one column")
    kinds = dict(target.dtypes)
    rows = source.select(*[((F.col(v) if isinstance(v, str) else v) if (v := mapping.get(c)) is not None else F.lit(None)).cast(kinds[c]).alias(c) for c in target.columns])
    if not conflict:
        return target.unionByName(rows), rows
    if do_update is not None and not do_update:
        raise ValueError("DO UPDATE sets something")
    rows = rows.dropDuplicates(conflict) if do_update is None else _refuse_repeats(rows, conflict, "two source rows have one conflict key")
    fresh = rows.join(target.select(*conflict), conflict, "left_anti").select(*target.columns)
    if do_update is None:
        return target.unionByName(fresh), fresh
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in target.columns])
    s = rows.select(*[F.col(c).alias(f"s_{c}") for c in target.columns])
    cond = F.lit(True)
    for c in conflict:
        cond = cond & (F.col(f"t_{c}") == F.col(f"s_{c}"))
    both = t.join(s, cond, "left").withColumn("_hit", F.coalesce(F.col(f"s_{conflict[0]}").isNotNull() & (F.lit(True) if update_where is None else update_where), F.lit(False)))
    after = both.select(*[(F.when(F.col("_hit"), do_update[c].cast(kinds[c])).otherwise(F.col(f"t_{c}")) if c in do_update else F.col(f"t_{c}")).alias(c) for c in target.columns], "_hit")
    return after.drop("_hit").unionByName(fresh), after.where("_hit").drop("_hit").unionByName(fresh)


@dataclass(frozen=True)
class Branch:
    """One WHEN of a merge. kind: matched, not_matched or by_source; action: update, delete or insert."""

    kind: str
    action: str
    sets: dict[str, Column] = field(default_factory=dict)
    condition: Column | None = None


def merge(target: DataFrame, source: DataFrame, on: dict[str, str], branches: list[Branch], *, stamp: str | None = "updated_at") -> tuple[DataFrame, DataFrame]:
    """(table after, one row of counts: updated, deleted, inserted, total).

    Expressions see target columns as ``t_*`` and source columns as ``s_*``. Branches of a kind
    are tried in order and the first whose condition holds acts; two source rows that match one
    target row are an error.
    """
    if not on or not branches:
        raise ValueError("a merge has an equality and a branch")
    closed: set[str] = set()
    for b in branches:
        if b.kind in closed:
            raise ValueError(f"a {b.kind} branch after an unconditional one is never reached")
        if b.condition is None:
            closed.add(b.kind)
        if stamp and stamp in b.sets and b.action == "update":
            raise ValueError(f"{stamp} is set by the merge itself")
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in target.columns]).withColumn("_t", F.lit(True))
    s = source.select(*[F.col(c).alias(f"s_{c}") for c in source.columns]).withColumn("_s", F.lit(True))
    cond = F.lit(True)
    for a, b in on.items():
        cond = cond & (F.col(f"t_{a}") == F.col(f"s_{b}"))
    keys = [f"s_{b}" for b in on.values()]
    hits = s.join(t.select(*[F.col(f"t_{a}").alias(k) for a, k in zip(on, keys, strict=True)]).distinct(), keys, "left_semi")
    repeats = hits.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").limit(1)
    joined = t.join(s, cond, "full_outer").withColumn("_kind", F.when(F.col("_t") & F.col("_s"), "matched").when(F.col("_s"), "not_matched").otherwise("by_source"))
    chosen = F.lit(-1)
    for i, b in reversed(list(enumerate(branches))):
        fits = (F.col("_kind") == b.kind) & (F.lit(True) if b.condition is None else F.coalesce(b.condition, F.lit(False)))
        chosen = F.when(fits, F.lit(i)).otherwise(chosen)
    guard = repeats.agg(F.count("*").alias("_bad")).withColumn("_bad", F.when(F.col("_bad") > 0, F.raise_error(F.lit("two source rows match one target row")).cast("long")).otherwise(F.col("_bad")))
    acted = joined.withColumn("_b", chosen).crossJoin(F.broadcast(guard)).where(F.col("_bad") == 0)
    kinds = dict(target.dtypes)

    def value(c: str) -> Column:
        out = F.col(f"t_{c}")
        for i, b in enumerate(branches):
            if b.action == "update" and (c in b.sets or c == stamp):
                out = F.when(F.col("_b") == i, b.sets[c].cast(kinds[c]) if c in b.sets else F.current_timestamp().cast(kinds[c])).otherwise(out)
            elif b.action == "insert":
                out = F.when(F.col("_b") == i, b.sets[c].cast(kinds[c]) if c in b.sets else F.lit(None).cast(kinds[c])).otherwise(out)
        return out.alias(c)

    act = F.lit(None).cast("string")
    for i, b in enumerate(branches):
        act = F.when(F.col("_b") == i, b.action).otherwise(act)
    acted = acted.withColumn("_act", act)
    after = acted.where((F.col("_kind") != "not_matched") | (F.col("_act") == "insert")).where(~F.coalesce(F.col("_act") == "delete", F.lit(False))).select(*[value(c) for c in target.columns])
    counts = acted.agg(*[F.count_if(F.col("_act") == a).alias(n) for a, n in (("update", "updated"), ("delete", "deleted"), ("insert", "inserted"))])
    return after, counts.withColumn("total", F.col("updated") + F.col("deleted") + F.col("inserted"))
