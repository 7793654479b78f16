"""Joins: relations, pairs, inline values, lateral."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from decimal import ROUND_HALF_UP, Context, Decimal
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from millrace import runtime
from millrace.operators.order import terms

if TYPE_CHECKING:
    from millrace.queryset import QuerySet


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def select_related(df: DataFrame, column: str, target: DataFrame, key: str, prefix: str | None = None) -> DataFrame:
    """Each row with its related row's columns as ``rel_<column>_<name>``; a row without one has nulls."""
    prefix = prefix or f"rel_{column}_"
    t = prefixed(target, prefix)
    return df.join(t, df[column] == t[f"{prefix}{key}"], "left")


def prefetch(parents: DataFrame, key: str, children: DataFrame, via: str, name: str = "children") -> DataFrame:
    """Each parent with the list of its children (one join, no second query a row)."""
    packed = children.groupBy(via).agg(F.array_sort(F.collect_list(F.struct(*children.columns))).alias(name))
    found = parents.join(packed.withColumnRenamed(via, "_via"), F.col(key) == F.col("_via"), "left").drop("_via")
    return found.withColumn(name, F.coalesce(name, F.array().cast(found.schema[name].dataType)))


def reverse(parents: DataFrame, key: str, children: DataFrame, via: str) -> DataFrame:
    """Children of the given parents (reverse foreign key)."""
    return children.join(parents.select(F.col(key).alias(via)).distinct(), via, "left_semi")


def many_to_many(df: DataFrame, key: str, through: DataFrame, near: str, far: str, target: DataFrame, target_key: str) -> DataFrame:
    """Pairs over a link table, with the link's own columns."""
    t = prefixed(target, "target_")
    return df.join(through, df[key] == through[near]).join(t, through[far] == t[f"target_{target_key}"])


@dataclass(frozen=True)
class Pairs:
    """The pair relation (left, right): columns ``l_*`` and ``r_*``. A side's order and limit do not apply."""

    left: DataFrame
    right: DataFrame
    left_key: str | None = None
    right_key: str | None = None
    drop_equal: bool = False
    on: Column | None = None
    conditions: tuple[Column, ...] = ()
    order: tuple = ()
    most: int | None = None
    keep: dict = field(default_factory=dict)

    def include_equal_pk(self) -> Pairs:
        return replace(self, drop_equal=False)

    def filter_left(self, c: Column) -> Pairs:
        return replace(self, left=self.left.where(c))

    def filter_right(self, c: Column) -> Pairs:
        return replace(self, right=self.right.where(c))

    def where(self, c: Column) -> Pairs:
        """A condition over prefixed columns; equalities in it make the planner hash instead of looping."""
        return replace(self, conditions=(*self.conditions, c))

    def order_by(self, *order) -> Pairs:
        return replace(self, order=order)

    def limit(self, n: int) -> Pairs:
        return replace(self, most=n)

    def unordered(self) -> DataFrame:
        l, r = prefixed(self.left, "l_"), prefixed(self.right, "r_")
        conditions = list(self.conditions)
        if self.drop_equal:
            conditions.append(F.col(f"l_{self.left_key}") != F.col(f"r_{self.right_key}"))
        return l.join(r, reduce(lambda a, b: a & b, conditions)) if conditions else l.crossJoin(r)

    def to_df(self) -> DataFrame:
        df = self.unordered()
        if self.order:
            df = df.orderBy(*terms(self.order))
        return df if self.most is None else df.limit(self.most)

    def count(self) -> int:
        return self.unordered().count()

    def left_join_closure(self, closure: DataFrame) -> DataFrame:
        """Each pair with the ancestors that both sides share (nulls if none).

        closure: src, anc, depth, path_count. Columns la_* and ra_*.
        """
        la, ra = prefixed(closure, "la_"), prefixed(closure, "ra_")
        df = self.unordered()
        first = df.join(la, F.col(f"l_{self.left_key}") == F.col("la_src"), "left")
        return first.join(ra, (F.col(f"r_{self.right_key}") == F.col("ra_src")) & (F.col("ra_anc") == F.col("la_anc")), "left")


def kinship(pairs: Pairs, closure: DataFrame, digits: int | None = None) -> DataFrame:
    """Kinship of every pair: the sum over shared ancestors of paths * paths * 0.5 ** (depths + 1); 0 if none.

    A side's part of each term is summed by ancestor first. All pairs of two sides are computed in
    tiles of rows by rows and never exchanged; a condition's pairs are joined with their shared
    ancestors. ``digits`` rounds as Spark's ``round``.
    """
    weight = F.sum(F.col("path_count") * F.pow(F.lit(0.5), F.col("depth"))).alias("weight")
    weights = closure.where(F.col("anc").isNotNull()).groupBy("src", "anc").agg(weight)
    if not pairs.conditions:
        return _tiled(pairs, weights, digits)
    ids = pairs.unordered()
    l, r = f"l_{pairs.left_key}", f"r_{pairs.right_key}"
    la, ra = prefixed(weights, "la_"), prefixed(weights, "ra_")
    shared = ids.select(l, r).distinct().join(la, F.col(l) == F.col("la_src")).join(ra, (F.col(r) == F.col("ra_src")) & (F.col("la_anc") == F.col("ra_anc")))
    total = shared.groupBy(l, r).agg((F.sum(F.col("la_weight") * F.col("ra_weight")) / 2).alias("kinship"))
    value = F.coalesce("kinship", F.lit(0.0))
    return ids.join(total, [l, r], "left").withColumn("kinship", value if digits is None else F.round(value, digits))


#: A block's rows and (row, ancestor) entries at most, pairs sent at once, and blocks' partitions a side.
_SIDE, _ENTRIES, _SENT, _PARTS = 2048, 1_000_000, 1 << 17, 256


def _tiled(pairs: Pairs, weights: DataFrame, digits: int | None) -> DataFrame:
    spark = pairs.left.sparkSession
    runtime.ship(spark)
    work = runtime.Workspace(spark, "kinship")
    found = weights.groupBy("src").agg(F.collect_list(F.struct("anc", "weight")).alias("found"))
    anc, kind = dict(weights.dtypes)["anc"], lambda df: df.select(F.struct(*df.columns)).dtypes[0][1]
    side, entries = _SIDE, _ENTRIES

    def blocks(df: DataFrame, key: str) -> DataFrame:
        rows = df.select(F.col(key).alias("_key"), F.struct(*df.columns).alias("row")).join(found, F.col("_key") == F.col("src"), "left")
        # Rows of near keys have more ancestors that whole blocks share, which are the cheap ones.
        packed = rows.repartitionByRange("_key").sortWithinPartitions("_key").select("row", F.col("_key").alias("key"), F.coalesce("found.anc", F.array().cast(f"array<{anc}>")).alias("anc"), F.coalesce("found.weight", F.array().cast("array<double>")).alias("weight"))
        out = packed.mapInArrow(lambda it: _packed(it, side, entries), f"row array<{kind(df)}>, key array<{dict(df.dtypes)[key]}>, n array<int>, anc array<{anc}>, weight array<double>")
        return work.save(out)

    left = blocks(pairs.left, pairs.left_key)
    right = left if pairs.right is pairs.left and pairs.right_key == pairs.left_key else blocks(pairs.right, pairs.right_key)
    l, r = (prefixed(b, p).repartition(max(1, min(b.count(), _PARTS))) for b, p in ((left, "l_"), (right, "r_")))
    lists = StructType([StructField(f.name, ArrayType(f.dataType)) for f in prefixed(pairs.right, "r_").schema])
    schema = StructType([*prefixed(pairs.left, "l_").schema, *lists, StructField("kinship", ArrayType(DoubleType(), False))])
    drop_equal = pairs.drop_equal
    found = l.crossJoin(r.hint("shuffle_replicate_nl")).mapInArrow(lambda it: _pairs(it, schema.names, drop_equal, digits), schema)
    # A left row comes with lists, which generated code opens for a fraction of what a pair from Python costs.
    opened = found.select(*found.columns[:-1], F.posexplode("kinship").alias("_at", "kinship"))
    return opened.select(*[c if c.startswith("l_") else F.get(c, F.col("_at")).alias(c) for c in found.columns[:-1]], "kinship")


def _packed(batches: Iterator[pa.RecordBatch], side: int, entries: int) -> Iterator[pa.RecordBatch]:
    """Rows as blocks, each a row of lists: of rows, keys, numbers of entries, and the entries."""

    def block(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        row, key, anc, weight = (c.chunk(0) for c in t.columns)
        n = pc.list_value_length(anc).cast(pa.int32())
        lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (row, key, n, anc.flatten(), weight.flatten())]
        return pa.RecordBatch.from_arrays(lists, names=["row", "key", "n", "anc", "weight"])

    held: list[pa.Table] = []
    rows = size = 0
    for batch in batches:
        ends, at = np.cumsum(pc.list_value_length(batch.column("anc")).to_numpy()), 0
        while at < batch.num_rows:
            # As many rows as fit; one at least, so that a row larger than a block is one of its own.
            base = ends[at - 1] if at else 0
            fit = int(np.searchsorted(ends, base + entries - size, "right")) - at
            take = min(batch.num_rows - at, side - rows, max(fit, 0 if rows else 1))
            if take:
                held.append(pa.Table.from_batches([batch.slice(at, take)]))
                rows, size, at = rows + take, size + int(ends[at + take - 1] - base), at + take
            if rows == side or at < batch.num_rows:
                yield block(pa.concat_tables(held))
                held, rows, size = [], 0, 0
    if rows:
        yield block(pa.concat_tables(held))


def _products(l: list[np.ndarray], r: list[np.ndarray], nl: int, nr: int) -> np.ndarray:
    """The sum over codes of weight * weight for each left and right row. l, r: rows, codes, weights."""
    out, most = np.zeros((nl, nr)), max(int(x[1].max(initial=-1)) for x in (l, r)) + 1
    count_l, count_r = (np.bincount(x[1], minlength=most) for x in (l, r))
    met = count_l * count_r
    heavy = np.flatnonzero(met * 16 >= max(nl * nr, 1))
    for k in range(0, len(heavy), 1024):
        place = np.full(most, -1)
        place[heavy[k : k + 1024]] = np.arange(len(heavy[k : k + 1024]))
        dense = []
        for (row, code, weight), n in ((l, nl), (r, nr)):
            at = place[code]
            dense.append(np.zeros((n, len(heavy[k : k + 1024]))))
            dense[-1][row[at >= 0], at[at >= 0]] = weight[at >= 0]
        out += dense[0] @ dense[1].T
    met[heavy], flat = 0, out.reshape(-1)
    (l_order, l_end), (r_order, r_end) = ((np.argsort(x[1], kind="stable"), np.cumsum(n)) for x, n in ((l, count_l), (r, count_r)))
    for c in np.flatnonzero(met):
        i, j = l_order[l_end[c] - count_l[c] : l_end[c]], r_order[r_end[c] - count_r[c] : r_end[c]]
        flat[(l[0][i] * nr)[:, None] + r[0][j]] += l[2][i][:, None] * r[2][j]
    return out


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's round: half up of the shortest decimal that gives the double. x: not negative."""
    scale = 10.0**digits
    y = x * scale
    low = np.floor(y)
    unsure = (np.abs(y - low - 0.5) <= y.max(initial=0.0) * 2.0**-50) | (y >= 2.0**51)
    out = (low + (y - low >= 0.5)) / scale
    if unsure.any():
        values, which = np.unique(x[unsure], return_inverse=True)
        exact, unit = Context(prec=800, rounding=ROUND_HALF_UP), Decimal(1).scaleb(-digits)
        out[unsure] = np.array([float(exact.quantize(Decimal(repr(v)), unit)) for v in values.tolist()])[which]
    return out


def _pairs(batches: Iterator[pa.RecordBatch], names: list[str], drop_equal: bool, digits: int | None) -> Iterator[pa.RecordBatch]:
    """For each left row of the two blocks in a row: its columns, and lists of the right rows' columns and of kinships."""
    for batch in batches:
        for i in range(batch.num_rows):
            (l_row, l_key, l_n, l_anc, l_w), (r_row, r_key, r_n, r_anc, r_w) = ([c.slice(i, 1).flatten() for c in batch.columns[k : k + 5]] for k in (0, 5))
            nl, nr = len(l_row), len(r_row)
            code = lambda a, b: pc.fill_null(pa.concat_arrays([a, b]).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            codes, keys = code(l_anc, r_anc), code(l_key, r_key)
            l, r = ([np.repeat(np.arange(len(n)), n.to_numpy()), c, w.to_numpy()] for n, c, w in ((l_n, codes[: len(l_anc)], l_w), (r_n, codes[len(l_anc) :], r_w)))
            sums = _products(l, r, nl, nr)
            l_key, r_key = keys[:nl], keys[nl:]
            met = drop_equal and (keys.min() < 0 or len(np.intersect1d(l_key, r_key)) > 0)
            step = max(1, min(_SENT // nr, nl))
            tiled = [c.take(pa.array(np.tile(np.arange(nr), step))) for c in r_row.flatten()]
            for at in range(0, nl, step):
                n = min(step, nl - at)
                value = sums[at : at + n].ravel() / 2
                columns, ends = [*[c.slice(0, n * nr) for c in tiled], pa.array(value if digits is None else _half_up(value, digits))], np.arange(n + 1) * nr
                if met:  # a null key is not known to differ
                    a = l_key[at : at + n, None]
                    differs = (a != r_key) & (a >= 0) & (r_key >= 0)
                    columns, ends = [c.filter(pa.array(differs.ravel())) for c in columns], np.append(0, np.cumsum(differs.sum(axis=1)))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([*[c.slice(at, n) for c in l_row.flatten()], *[pa.ListArray.from_arrays(ends, c) for c in columns]], names=names)


def join_values(q: QuerySet, values: DataFrame, on: dict[str, str], how: str) -> DataFrame:
    """Join an inline relation (columns ``v_*``); the query's order and limit apply to the joined rows."""
    if q.unique:
        raise ValueError("a values join needs a query without distinct")
    df, v = q.rows(), F.broadcast(prefixed(values, "v_"))
    if how == "cross":
        out = df.crossJoin(v)
    else:
        out = df.join(v, reduce(lambda a, b: a & b, [df[a] == F.col(f"v_{b}") for a, b in on.items()]), how)
    if q.order:
        out = out.orderBy(*terms(q.order))
    if q.skip:
        out = out.offset(q.skip)
    return out if q.most is None else out.limit(q.most)


def lateral(outer: DataFrame, inner: DataFrame, on: dict[str, str], order, limit: int, *, left: bool = False) -> DataFrame:
    """For each outer row the first ``limit`` inner rows (columns ``r_*``) that match.

    ``outer`` is taken as it is, with its own limit. The inner rows are ranked once a key, before
    the join, so their number bounds the work and the planner can stop each key after ``limit``.
    ``r_present`` tells a matched row of nulls from no match in the left form.
    """
    keys = list(on.values())
    w = Window.partitionBy(*keys).orderBy(*terms(order))
    top = inner.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")
    r = prefixed(top, "r_").withColumn("r_present", F.lit(True))
    cond = reduce(lambda a, b: a & b, [outer[a] == F.col(f"r_{b}") for a, b in on.items()])
    out = outer.join(r, cond, "left" if left else "inner")
    return out.withColumn("r_present", F.coalesce("r_present", F.lit(False))) if left else out.drop("r_present")
