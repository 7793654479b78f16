"""Delta refresh by a high-water mark, and change events with tombstones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tick:
    """Rows of one refresh (in watermark order), rows gone since, and the mark to go on from."""

    rows: DataFrame
    tombstones: DataFrame
    mark: object


def tick(table: DataFrame, key: str, watermark: str, *, last=None, tracked: DataFrame | None = None, keep: Column | None = None, deleted_at: str | None = None) -> Tick:
    """One refresh. The first is the full baseline under ``keep``; later ones are unfiltered.

    Later ticks fetch rows whose watermark is at or after ``last`` (so boundary rows repeat and a
    consumer must be idempotent) and those whose key is tracked. The mark is the table's maximum,
    so it also passes rows that the filter left out.
    """
    mark = table.agg(F.max(watermark)).first()[0]
    if last is None:
        rows = table if keep is None else table.where(keep)
    else:
        rows = table.where(F.col(watermark) >= F.lit(last))
        if tracked is not None:
            more = table.where(F.col(watermark) < F.lit(last)).join(tracked.select(key).distinct(), key, "left_semi")
            rows = rows.unionByName(more.select(*rows.columns))
    gone = rows.where(F.col(deleted_at).isNotNull()).select(key) if deleted_at else rows.limit(0).select(key)
    live = rows.where(F.col(deleted_at).isNull()) if deleted_at else rows
    return Tick(live.orderBy(F.col(watermark).asc_nulls_last(), key), gone, mark if mark is not None else last)


def apply(state: DataFrame, t: Tick, key: str) -> DataFrame:
    """The consumer's state after a tick: changed rows replaced, tombstones dropped."""
    changed = t.rows.select(key).unionByName(t.tombstones.select(key))
    return state.join(changed, key, "left_anti").unionByName(t.rows.select(*state.columns))
