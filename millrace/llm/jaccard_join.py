"""Grouped prefix join: documents whose word n-gram sets have a Jaccard similarity of t or more.

1. Each text becomes its set of distinct shingle hashes; equal sets are one class.
2. Shingles are ordered rarest first. The order comes from counts of the shingles that are
   frequent anywhere (a bounded table); it steers cost only, any total order is correct.
3. Classes with the same prefix (under that order) and the same size are one group. Prefix
   tokens are matched between groups, under length and positional bounds; a bucket (the groups
   that hold a token) of two that do not fit is out at once.
4. First every group is verified against one centre, the group of its buckets that has the
   fewest rarer tokens, and members against their group's own centre. Linked classes merge into
   components. A bucket whose members are now in one component holds nothing more to find, so a
   large family of copies costs one pair a member instead of all pairs.
5. In buckets that still hold several components, groups are paired across components, each
   between a group outside the bucket's commonest component and the others. Buckets of the same
   groups are one. Within a bucket only groups meet whose sizes and positions allow a link: the
   smaller is filed under its size, the larger under the sizes that its position leaves. The
   prefixes of those pairs are compared, by 16 bits a token; only group pairs that count, length and positions allow
   are expanded to members and verified. So every pair that may link is verified or already
   connected: components are exact.

Verification compares whole sets. Defined cases: a null or wordless text has an empty set and
links with nothing; a text shorter than a shingle is one shingle; rows that repeat are one class
and share a component; a null doc_id never names a component unless nothing else is in it; only
``doc_id`` and ``text`` are read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import runtime
from millrace.llm import wordscan
from millrace.operators import components

_NO_ID = (1 << 63) - 1
#: Keys that may be broadcast to fetch texts (under 100 bytes each); more are joined by a shuffle.
_FEW = 200_000
#: Shingles that a slice of texts reports, its most frequent ones; this steers cost only.
_SUMMARY = 1 << 14


def _sets(text: pa.Array, shingle: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, shingle sets as sorted arrays) by slice."""
    for at, to, data, offsets in wordscan.slices(text):
        w = wordscan.scan(data, offsets, wordscan.SPACED, True)
        g = wordscan.grams(w.hash, shingle)
        out = []
        for s, e in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if e - s >= shingle:
                out.append(np.unique(g[s : e - shingle + 1]))
            elif e > s:
                out.append(wordscan.grams(w.hash[s:e], e - s, e - s))
            else:
                out.append(g[:0])
        yield at, out


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _rows(batches: Iterator[pa.RecordBatch], shingle: int, often: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, sets in _sets(b.column("text"), shingle):
            n = len(sets)
            sigs = [_digest(s) for s in sets]
            once = list({k: s for k, s in zip(sigs, sets, strict=True)}.values())
            h, c = np.unique(np.concatenate(once), return_counts=True) if once else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keep = np.flatnonzero(c >= often)
            keep = keep[np.argsort(-c[keep], kind="stable")[:_SUMMARY]]
            hot = [{"h": int(x), "c": int(y)} for x, y in zip(h[keep].view(np.int64), c[keep], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(at, n), b.column("th").slice(at, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary()), pa.array([hot] + [None] * (n - 1), pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64())])))],
                names=["doc_id", "th", "n", "sig", "hot"],
            )


class Order:
    """Rarest first: shingles not in the table by hash, then the table's by count."""

    def __init__(self, h: np.ndarray, c: np.ndarray):
        at = np.argsort(h)
        self.h, self.c = h[at], c[at]

    def sort(self, s: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return s
        k = np.minimum(np.searchsorted(self.h, s), len(self.h) - 1)
        count = np.where(self.h[k] == s, self.c[k], 0)
        return s if not count.any() else s[np.lexsort((s, count))]


def _parity(s: np.ndarray) -> np.ndarray:
    """A set's parity map as longs: each shingle flips one bit, so two maps differ in at most as
    many bits as their sets differ in shingles. It has the power of two from twice the set's size
    on; the halves' XOR is the map of half the size.
    """
    size = 1 << max(8, (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _folded(c: F.Column, other: F.Column) -> F.Column:
    """``c``, or its map of half the size if ``other`` has fewer words."""
    half = F.shiftright(F.size(c), 1)
    return F.when(F.size(c) > F.size(other), F.zip_with(F.slice(c, F.lit(1), half), F.slice(c, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(c)


def _prefixes(batches: Iterator[pa.RecordBatch], shingle: int, percent: int, order: Order) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, sets in _sets(b.column("text"), shingle):
            n = len(sets)
            sigs = [_digest(s) for s in sets]
            prefix = [order.sort(s)[: len(s) + (-percent * len(s)) // 100 + 1] for s in sets]
            groups = [int.from_bytes(hashlib.blake2b(p.tobytes() + len(s).to_bytes(8, "big"), digest_size=8).digest(), "big", signed=True) for p, s in zip(prefix, sets, strict=True)]
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            maps = [_parity(s) for s in sets]
            cut = np.concatenate(([0], np.cumsum([len(m) for m in maps]))).astype(np.int32)
            bits = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(maps) if maps else np.zeros(0, np.int64)))
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.uint64)
            off = np.concatenate(([0], np.cumsum([len(p) for p in prefix]))).astype(np.int32)
            full = pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(at, n), b.column("th").slice(at, n), pa.array(sizes), pa.array(sigs, pa.binary()), pa.array(groups, pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64))), bits],
                names=["doc_id", "th", "n", "sig", "pg", "prefix", "bits"],
            )
            yield full.filter(pa.array(sizes > 0))


def _verified(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sides = []
        for side in ("tx", "ty"):
            sides.append((s for _, part in _sets(b.column(side), shingle) for s in part))
        ok = []
        for s, t in zip(*sides, strict=True):
            both = len(np.intersect1d(s, t, assume_unique=True))
            ok.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
        yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), pa.array(ok, pa.bool_())], names=["x", "y", "ok"])


def links_and_components(documents: DataFrame, *, shingle: int = 4, percent: int = 85, hot_table: int = 1 << 18, often: int = 2) -> DataFrame:
    """Every row of ``documents``: doc_id, th (xxhash64 of its text), n_shingles, component_id.

    Documents link when 100 * |intersection| >= percent * |union|; component_id is the smallest
    doc_id that links reach. ``hot_table`` bounds the table of frequent shingles that is
    broadcast (16 bytes each); a shingle is counted where ``often`` different sets of a slice
    of texts hold it and it is among the slice's most frequent.
    """
    spark = documents.sparkSession
    runtime.ship(spark)
    work = runtime.Workspace(spark, "jaccard")
    docs = runtime.pick(documents, doc_id="long", text="string").withColumn("th", F.xxhash64("text"))
    rows = work.save(docs.mapInArrow(lambda it: _rows(it, shingle, often), "doc_id long, th long, n long, sig binary, hot array<struct<h: long, c: long>>"))
    hot = rows.where("hot is not null").select(F.inline("hot")).groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(hot_table).toArrow()
    order = spark.sparkContext.broadcast(Order(hot["h"].to_numpy().view(np.uint64), hot["c"].to_numpy()))

    marked = work.save(docs.mapInArrow(lambda it: _prefixes(it, shingle, percent, order.value), "doc_id long, th long, n long, sig binary, pg long, prefix array<long>, bits array<long>"))
    who = F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "th")
    classes = work.save(marked.groupBy("sig").agg(F.min(who).alias("rep"), F.first("pg").alias("pg"), F.first("n").alias("n"), F.first("bits").alias("bits")))
    groups = work.save(marked.groupBy("pg").agg(F.first("n").cast("int").alias("n"), F.first("prefix").alias("prefix")))
    work.drop(marked)

    # Narrow rows: a token is carried once, cut to 40 bits, under the key that both sides exchange by.
    # Tokens that collide share a bucket, which can only add pairs to compare.
    often_held = groups.select(F.explode("prefix").alias("t")).groupBy(_cut("t").alias("token")).count().where("count > 1").select(runtime.rekey("token").alias("token"))
    tokens = groups.select("pg", "n", F.posexplode("prefix").alias("pos", "t")).select(_cut("t").alias("t"), "pg", "n", "pos").select(runtime.rekey("t").alias("token"), "pg", "n", "pos")
    held = work.save(tokens.join(often_held, "token"))
    brief = work.save(_brief(groups))
    work.drop(groups)
    shared = work.save(_buckets(held, percent))
    work.drop(held)
    stars = shared.where("pg <> centre").where(_fits("n", "pos", "cn", "cpos", percent)).groupBy("pg", "centre").count().groupBy("pg").agg(F.max_by("centre", F.struct("count", "centre")).alias("centre"))
    stars = _overlap(stars.withColumnRenamed("centre", "o_pg"), brief).where(_reaches(percent)).select("pg", F.col("o_pg").alias("centre"))

    middle = classes.groupBy("pg").agg(F.min("sig").alias("y"), F.count("*").alias("m"))
    inner = components.joined(classes.select(F.col("sig").alias("x"), "pg"), middle.where("m > 1").select("pg", "y"), "pg").where("x <> y").select("x", "y")
    outer = stars.join(middle.select("pg", F.col("y").alias("x")), "pg")
    outer = components.joined(outer.drop("pg").withColumnRenamed("centre", "pg"), middle.select("pg", "y"), "pg").select("x", "y")
    first = inner.union(outer)

    known = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)))

    def verify(pairs: DataFrame) -> DataFrame:
        """Whether each pair of classes links; only the texts of classes in a pair are fetched, one a class."""
        asked = pairs.select(F.col("x").alias("sig")).union(pairs.select(F.col("y").alias("sig"))).distinct()
        want = work.save(components.joined(classes.select("sig", "rep"), asked, "sig").select("sig", "rep.*"))
        keys = F.broadcast(want) if want.count() <= _FEW else want
        texts = work.save(known.join(keys, ["doc_id", "th"]).dropDuplicates(["sig"]).select("sig", "text"))
        a = components.joined(pairs, texts.select(F.col("sig").alias("x"), F.col("text").alias("tx")), "x")
        b = components.joined(a, texts.select(F.col("sig").alias("y"), F.col("text").alias("ty")), "y")
        out = work.save(b.select("x", "y", "tx", "ty").mapInArrow(lambda it: _verified(it, shingle, percent), "x binary, y binary, ok boolean"))
        work.drop(want, texts)
        return out

    def plausible(pairs: DataFrame) -> DataFrame:
        """Pairs that their parity maps allow: sets that differ in too many bits cannot link."""
        of = classes.select("sig", "n", "bits")
        a = components.joined(pairs, of.toDF("x", "n", "a"), "x")
        b = components.joined(a, of.toDF("y", "m", "b"), "y")
        b = b.select("x", "y", "n", "m", _folded(F.col("a"), F.col("b")).alias("a"), _folded(F.col("b"), F.col("a")).alias("b"))
        differ = F.aggregate(F.zip_with("a", "b", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, k: t + k)
        may = (100 + percent) * (F.col("n") + F.col("m") - differ) >= 2 * percent * (F.col("n") + F.col("m"))
        return b.where((F.size("a") != F.size("b")) | may).select("x", "y")

    names = classes.select(F.col("sig").alias("v"), F.col("rep.doc_id").alias("name"))
    seen = verify(work.save(plausible(first)))
    linked = work.save(components.label(seen.where("ok"), names, work))

    # What is left: pairs across components in buckets that hold several.
    rooted = components.joined(classes.select(F.col("sig").alias("v"), "pg"), linked.select("v", "root"), "v")
    placed = work.save(rooted.select("v", "pg", F.xxhash64("root").alias("root")))
    spread = placed.groupBy("pg").agg(F.min("root").alias("r0"), F.max("root").alias("r1"))
    rows_of = work.save(components.joined(shared.select("token", "pg", "n", "pos"), spread, "pg"))
    work.drop(shared)
    # Tokens held by the same groups are one bucket, at the first one's places (all groups order tokens alike).
    span = rows_of.groupBy("token").agg(F.min("r0").alias("least"), F.max("r1").alias("most"), F.xxhash64(F.bit_xor("pg"), F.count("*")).alias("held")).where("least <> most")
    mixed = rows_of.select(runtime.rekey("token").alias("t"), "pg", "n", "pos", "r0", "r1").join(span.select(runtime.rekey("token").alias("t"), "held"), "t")
    mixed = work.save(mixed.groupBy(F.col("held").alias("k"), "pg").agg(F.min("pos").alias("pos"), *[F.first(c).alias(c) for c in ("n", "r0", "r1")]))
    work.drop(rows_of)
    met = work.save(_meetings(mixed, percent).select("pg", "o_pg").distinct())
    work.drop(mixed)
    asked = work.save(met.select("pg").union(met.select("o_pg")).distinct())
    compared = work.save(components.joined(brief, asked, "pg", "left_semi"))
    across = work.save(_overlap(met, compared).where(_beyond(percent)).select("pg", "o_pg"))
    work.drop(met, asked, compared, brief)
    across = components.joined(across, placed, "pg").select("v", "root", F.col("o_pg").alias("pg"))
    across = components.joined(across, placed.select("pg", F.col("v").alias("o_v"), F.col("root").alias("o_root")), "pg").where("root <> o_root")
    inside = components.joined(placed, spread.where("r0 <> r1").select("pg"), "pg", "left_semi")
    inside = components.joined(inside.select("pg", "v", "root"), inside.select("pg", F.col("v").alias("o_v"), F.col("root").alias("o_root")), "pg").where("v < o_v and root <> o_root")
    second = across.select("v", "o_v").union(inside.select("v", "o_v")).select(F.least("v", "o_v").alias("x"), F.greatest("v", "o_v").alias("y")).distinct()
    tried = seen.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    second = work.save(plausible(second.join(tried, ["x", "y"], "left_anti")))
    if not second.isEmpty():
        more = verify(second).where("ok").select("x", "y")
        linked = work.save(components.label(seen.where("ok").select("x", "y").union(more), names, work))
    least = linked.select(F.col("v").alias("sig"), F.nullif("name", F.lit(_NO_ID)).alias("component_id"))
    out = components.joined(rows.select("doc_id", "th", "sig", "n"), least, "sig", "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _meetings(mixed: DataFrame, percent: int) -> DataFrame:
    """(pg, n, pos, o_pg, o_n, o_pos): groups that meet in a bucket and may link across components.

    mixed: (k, pg, n, pos, r0, r1), a row for each bucket of a group, with the least and greatest
    root of its members. A bucket's groups that lie whole in its commonest component are not
    paired with each other. The smaller group of a pair (by size, then key) is filed under the bin
    of its size, where its position allows a partner at all, and the larger one under the bins
    of the sizes that length and position leave to a smaller partner. So the many groups of a family
    that differ in too much come into no common bin, rather than being met and refused.
    """
    major = mixed.where("r0 = r1").groupBy("k", "r0").count().groupBy("k").agg(F.max_by("r0", F.struct("count", "r0")).alias("major"))
    sides = components.joined(mixed, major, "k", "left").withColumn("minor", ~F.coalesce((F.col("r0") == F.col("r1")) & (F.col("r0") == F.col("major")), F.lit(False)))
    sides = sides.withColumns({"n": F.col("n").cast("long"), "pos": F.col("pos").cast("long")})
    small = sides.where(f"{100 + percent} * (n - pos) >= {2 * percent} * n").select(F.expr(f"xxhash64(k, {_bin('n')}, minor)").alias("t"), "pg", "n", "pos", "r0", "r1")
    large = sides.withColumns({"low": F.expr(f"({percent} * n + 99) div 100"), "high": F.expr(f"least(n, (100 * n - {100 + percent} * pos) div {percent})")}).where("low <= high")
    large = large.withColumn("bin", F.explode(F.expr(f"sequence({_bin('low')}, {_bin('high')})")))
    large = large.withColumn("to_minor", F.explode(F.when(F.col("minor"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    large = large.select(F.xxhash64("k", "bin", "to_minor").alias("t"), *[F.col(c).alias(f"o_{c}") for c in ("pg", "n", "pos", "r0", "r1")])
    met = small.join(large, "t").where("(n < o_n or n = o_n and pg < o_pg) and (r0 <> r1 or o_r0 <> o_r1 or r0 <> o_r0)")
    return met.where(_fits("n", "pos", "o_n", "o_pos", percent)).select("pg", "n", "pos", "o_pg", "o_n", "o_pos")


def _bin(size: str) -> str:
    """SQL for the bin of a size, its five leading bits: sizes up to 31 have their own; consecutive and ascending."""
    shift = f"greatest(length(bin({size})) - 5, 0)"
    return f"(shiftright({size}, {shift}) + 16 * {shift})"


def _cut(token: str) -> F.Column:
    """A token's last 40 bits, which are enough to tell nearly all of them apart."""
    return F.col(token).bitwiseAND(F.lit((1 << 40) - 1))


def _brief(groups: DataFrame) -> DataFrame:
    """(pg, n, brief, twice): the prefix by 16 bits a token, and how many tokens repeat the bits of an earlier one."""
    out = groups.select("pg", "n", F.transform("prefix", lambda t: (t.bitwiseAND(F.lit(0xFFFF)) - F.lit(1 << 15)).cast("short")).alias("brief"))
    return out.withColumn("twice", F.size("brief") - F.size(F.array_distinct("brief")))


def _buckets(held: DataFrame, percent: int) -> DataFrame:
    """The rows of ``held`` (token, pg, n, pos) whose bucket may hold a link, with the bucket's centre and the centre's size and place.

    A bucket of two rows is out if the two do not fit: a pair that links fits at its first shared token.
    """
    place = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))
    buckets = held.groupBy("token").agg(F.min_by("pg", place).alias("centre"), F.min(place).alias("first"), F.count("*").alias("rows"), F.sum("n").alias("total"), F.min(F.col("n") - F.col("pos")).alias("rest"))
    buckets = buckets.where(f"rows > 2 or {100 + percent} * cast(rest as long) >= {percent} * total")
    buckets = buckets.select(runtime.rekey("token").alias("k"), "centre", F.shiftright("first", 32).cast("int").alias("cpos"), F.col("first").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("cn"))
    return held.select(runtime.rekey("token").alias("k"), "pg", "n", "pos").join(buckets, "k").withColumnRenamed("k", "token")


def _overlap(pairs: DataFrame, brief: DataFrame) -> DataFrame:
    """Pairs (pg, o_pg) with their sizes n and m, at least the number of prefix tokens that both hold, and the last one's places p and q.

    Tokens are compared by 16 bits, so ``both`` may be too great, and p and q may be those of
    tokens that differ: only bounds that allow for it may rule a pair out for good.
    """
    out = components.joined(pairs, brief.select("pg", "n", F.col("brief").alias("a"), F.col("twice").alias("s")), "pg")
    out = components.joined(out, brief.select(F.col("pg").alias("o_pg"), F.col("n").alias("m"), F.col("brief").alias("b"), F.col("twice").alias("t")), "o_pg")
    out = out.withColumn("common", F.array_intersect("a", "b")).withColumn("last", F.try_element_at("common", F.lit(-1)))
    return out.withColumns({"both": F.size("common") + F.least("s", "t"), "p": F.array_position("a", F.col("last")) - 1, "q": F.array_position("b", F.col("last")) - 1})


def _beyond(percent: int) -> F.Column:
    """A pair shares what its prefixes share and what lies behind the prefix that ends first."""
    longer = F.greatest(F.col("n"), F.col("m")).cast("long")
    behind = F.floor((percent * longer + 99) / 100) - 1
    return (100 + percent) * (F.col("both") + behind) >= percent * (F.col("n").cast("long") + F.col("m"))


def _fits(n: str, pos: str, m: str, qos: str, percent: int) -> F.Column:
    """Length bound, and the positional bound if this is the first token that the two share.

    A pair that links meets it at its first shared token, so a pair that meets it at none is out.
    """
    a, b, p, q = F.col(n).cast("long"), F.col(m).cast("long"), F.col(pos).cast("long"), F.col(qos).cast("long")
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((100 + percent) * F.least(a - p, b - q) >= percent * (a + b))


def _reaches(percent: int) -> F.Column:
    """Positional bound of a pair: its shared prefix tokens and at most all that follows the last one.

    With places by 16 bits it may refuse a pair that links, which the pass over all pairs then finds.
    """
    rest = F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q")) - 1
    return (100 + percent) * (F.col("both") + rest) >= percent * (F.col("n").cast("long") + F.col("m"))
