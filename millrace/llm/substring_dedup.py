"""Exact substring dedup by level-wise doubling over word windows.

Repeats of ``window`` words are found through levels ``first``, ``2 * first``, ... up to
``window``. Only windows that repeat between documents at one length are extended to the next,
so each level works on what the level before it let through:

* Equal texts are one class, judged once; only the class with the smallest doc_id is scanned.
* First level: of the ``first``-word runs inside each target window, the one with the least hash
  stands for the window (ties: the leftmost). Equal target windows choose the same run, so a
  window whose run occurs in one document only cannot repeat. About 2 in (window - first + 2)
  positions are kept, and no repeat is lost.
* Next levels: the windows of twice the length around surviving runs, hashed to 96 bits,
  grouped before the shuffle; those that start in a document with a smaller doc_id survive.

Documents that hold a candidate are written once to the shared folder and read again for the
next level and for cutting; the others are exchanged once, to learn that they hold none. What is
exchanged by hash is narrow (hash, doc_id, and 38 bits of the text's hash packed with a place), and
each step's result is written before the next begins, so that one exchange's files exist at a time.

Defined cases: a null text has no words; texts shorter than the window lose nothing; a null
doc_id is larger than any other; rows that repeat an id are judged one by one and never remove
each other's words; only ``doc_id`` and ``text`` are read; an empty table gives no rows.
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
_BITS = 26
_PLACE = np.uint64((1 << _BITS) - 1)
#: Which of the texts of one doc_id is meant, beside a place: 38 bits of the text's hash.
_TAG = (1 << 64 - _BITS) - 1


def levels(window: int, first: int | None = None) -> list[int]:
    """Lengths of the levels: ``first`` (half the window unless given), doubled until the window."""
    out = [min(window, first or (window + 1) // 2)]
    while out[-1] < window:
        out.append(min(window, 2 * out[-1]))
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    part, have = values, 1
    while have < width:
        step = min(have, width - have)
        part = np.minimum(part[:-step], part[step:])
        have += step
    return part


def _anchors(w: wordscan.Words, window: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run hashes, the valid target windows' first words, and the run that stands for each."""
    runs = wordscan.grams(w.hash, first)
    whole = np.flatnonzero(wordscan.whole(w, window))
    if not len(whole):
        return runs, whole, whole
    keyed = (runs & ~_PLACE) | np.arange(len(runs), dtype=np.uint64)
    least = _least(keyed, window - first + 1)
    return runs, whole, (least[whole] & _PLACE).astype(np.int64)


def _scan(batches: Iterator[pa.RecordBatch], window: int, first: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, to, data, offsets in wordscan.slices(b.column("text")):
            w = wordscan.scan(data, offsets, wordscan.SPACED, False)
            runs, _, chosen = _anchors(w, window, first)
            chosen = np.unique(chosen)
            off = np.searchsorted(chosen, w.first).astype(np.int32)
            n = to - at
            kept = [_kept(w, d, None) for d in range(n)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(at, n), b.column("th").slice(at, n), pa.array(w.count(), pa.int64()), pa.array(kept), pa.ListArray.from_arrays(pa.array(off), pa.array(runs[chosen].view(np.int64)))],
                names=["doc_id", "th", "n_words", "whole_sha256", "runs"],
            )


def _kept(w: wordscan.Words, d: int, keep: np.ndarray | None) -> str:
    """SHA-256 of a text's kept words (all without ``keep``), joined by one space."""
    s, e = int(w.first[d]), int(w.first[d + 1])
    return hashlib.sha256(_joined(w, np.arange(s, e) if keep is None else s + np.flatnonzero(keep))).hexdigest()


def _joined(w: wordscan.Words, at: np.ndarray) -> bytes:
    if not len(at):
        return b""
    a, z = w.start[at], w.end[at]
    span = w.data[a[0] : z[-1]]
    inside = np.zeros(len(span) + 1, dtype=np.int8)
    np.add.at(inside, a - a[0], 1)
    np.add.at(inside, z - a[0], -1)
    take = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    take[z[:-1] - a[0]] = True  # the byte after each word but the last, which a space replaces
    out = span.copy()
    out[z[:-1] - a[0]] = 0x20
    return out[take].tobytes()


def _windows(batches: Iterator[pa.RecordBatch], window: int, first: int, length: int) -> Iterator[pa.RecordBatch]:
    """Windows of ``length`` words that hold a target window's surviving run: 96-bit hash and tagged place."""
    for b in batches:
        places = b.column("places")
        for at, to, data, offsets in wordscan.slices(b.column("text")):
            w = wordscan.scan(data, offsets, wordscan.SPACED, False)
            n = to - at
            alive = np.zeros(len(w.start) + 1, dtype=bool)
            part = places.slice(at, n)
            rank = np.repeat(np.arange(n), np.asarray(part.value_lengths()))
            _, whole, chosen = _anchors(w, window, first)
            runs = np.unique(chosen)
            base = np.searchsorted(runs, w.first)
            alive[runs[base[rank] + part.flatten().to_numpy()]] = True
            if length == window:
                starts = whole[alive[chosen]]
            else:  # every run of this length inside a target window that is still alive
                on = np.zeros(len(w.start) + 1, dtype=np.int32)
                s = whole[alive[chosen]]
                np.add.at(on, s, 1)
                np.add.at(on, s + window - length + 1, -1)
                starts = np.flatnonzero(np.cumsum(on[:-1]) > 0)
            doc = w.doc[starts]
            tag = b.column("th").slice(at, n).to_numpy() << _BITS
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(wordscan.grams(w.hash, length, 1)[starts].view(np.int64)),
                    pa.array((wordscan.grams(w.hash, length, 2)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    b.column("doc_id").slice(at, n).take(pa.array(doc)),
                    pa.array(tag[doc] | (starts - w.first[doc])),
                ],
                names=["h", "g", "doc_id", "p"],
            )


def _cut(batches: Iterator[pa.RecordBatch], window: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        starts = b.column("starts")
        for at, to, data, offsets in wordscan.slices(b.column("text")):
            w = wordscan.scan(data, offsets, wordscan.SPACED, False)
            removed, kept, texts = [], [], []
            for d in range(to - at):
                n = int(w.first[d + 1] - w.first[d])
                s = starts[at + d].values.to_numpy()
                on = np.zeros(n + window + 1, dtype=np.int32)
                np.add.at(on, s, 1)
                np.add.at(on, s + window, -1)
                gone = np.cumsum(on)[:n] > 0
                removed.append(int(gone.sum()))
                text = _joined(w, w.first[d] + np.flatnonzero(~gone))
                kept.append(hashlib.sha256(text).hexdigest())
                texts.append(text.decode() if keep_text else None)
            n = to - at
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(at, n), b.column("th").slice(at, n), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "th", "n_removed", "kept_sha256", "kept_text"],
            )


def repeated_windows(documents: DataFrame, *, window: int = 50, first: int | None = None, keep_text: bool = True) -> tuple[DataFrame, DataFrame, runtime.Workspace]:
    """(rows, cut): every row with its words counted, and the texts that repeat an earlier document.

    rows: doc_id, th (xxhash64 of the text), n_words, whole_sha256, first_id (the class's smallest
    doc_id). cut: doc_id, th, n_removed, kept_sha256, kept_text (null unless asked for), one a class
    that loses words.
    """
    spark = documents.sparkSession
    runtime.ship(spark)
    work = runtime.Workspace(spark, "substring")
    steps = levels(window, first)
    base = steps[0]
    docs = runtime.pick(documents, doc_id="long", text="string").where("text is not null").select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "text", F.xxhash64("text", F.lit(0)).alias("th"))
    scanned = work.save(docs.mapInArrow(lambda it: _scan(it, window, base), "doc_id long, th long, n_words long, whole_sha256 string, runs array<long>"))

    # One class for each text: by its hash and the hash of its words. Only its first document keeps the runs.
    classes = scanned.groupBy("th", "whole_sha256").agg(F.min("doc_id").alias("first_id"))
    classed = components.joined(scanned, classes.select("th", F.col("whole_sha256").alias("_w"), "first_id"), "th").where("whole_sha256 = _w").drop("_w")
    rows = work.save(classed.withColumn("runs", F.when(F.col("doc_id") == F.col("first_id"), F.col("runs"))))
    work.drop(scanned)
    heads = rows.where(F.size("runs") > 0)
    ids = work.save(heads.select(F.explode("runs").alias("h"), "doc_id").groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h"))
    places = heads.select("doc_id", "th", F.posexplode("runs").alias("place", "h")).select("h", "doc_id", F.shiftleft("th", _BITS).bitwiseOR(F.col("place").cast("long")).alias("p"))
    alive = work.save(_by_text(components.joined(places, ids, "h", "left_semi"), "places"))
    work.drop(ids)
    tagged = docs.withColumn("tag", F.col("th").bitwiseAND(F.lit(_TAG)))
    held = work.save(tagged.join(alive, ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag", "th"]))
    work.drop(alive)

    for length in steps[1:] or steps:
        found = held.mapInArrow(lambda it, n=length: _windows(it, window, base, n), "h long, g int, doc_id long, p long")
        least = work.save(found.groupBy("h", "g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h", F.col("g").alias("g2"), "lo"))
        again = components.joined(found, least, "h").where("g = g2")
        if length == window:
            starts = work.save(_by_text(again.where("lo < doc_id").select("doc_id", "p"), "starts"))
            work.drop(least)
            cut = held.select("doc_id", "tag", "th", "text").join(starts, ["doc_id", "tag"])
            return rows.drop("runs"), cut.mapInArrow(lambda it: _cut(it, window, keep_text), "doc_id long, th long, n_removed long, kept_sha256 string, kept_text string"), work
        still = work.save(_by_text(again.select("doc_id", "p"), "on"))
        narrowed = work.save(held.join(still, ["doc_id", "tag"]).mapInArrow(lambda it, n=length: _still(it, window, base, n), "doc_id long, tag long, th long, text string, places array<int>").where(F.size("places") > 0))
        work.drop(least, still, held)
        held = narrowed
    raise AssertionError("the last level is the window")


def _by_text(found: DataFrame, name: str) -> DataFrame:
    """Tagged places (doc_id, p) as one row a text: doc_id, tag, and its distinct places."""
    place, tag = F.col("p").bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int"), F.shiftrightunsigned("p", _BITS)
    return found.groupBy("doc_id", tag.alias("tag")).agg(F.collect_set(place).alias(name))


def _still(batches: Iterator[pa.RecordBatch], window: int, base: int, length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, to, data, offsets in wordscan.slices(b.column("text")):
            w = wordscan.scan(data, offsets, wordscan.SPACED, False)
            _, whole, chosen = _anchors(w, window, base)
            out = []
            for d in range(to - at):
                first = int(w.first[d])
                mine = (whole >= first) & (whole < w.first[d + 1])
                ok = np.zeros(int(w.first[d + 1]) - first + 1, dtype=bool)
                ok[np.asarray(b.column("on")[at + d].values)] = True
                # a target window is alive while all its windows of this length are
                bad = np.concatenate(([0], np.cumsum(~ok)))
                s = whole[mine] - first
                alive = bad[s + window - length + 1] - bad[s] == 0
                runs = np.unique(chosen[mine])
                was = b.column("places")[at + d].values.to_numpy()
                out.append(np.intersect1d(was, np.searchsorted(runs, np.unique(chosen[mine][alive]))).astype(np.int32))
            n = to - at
            kept = ["doc_id", "tag", "th", "text"]
            yield pa.RecordBatch.from_arrays([b.column(c).slice(at, n) for c in kept] + [pa.array(out, pa.list_(pa.int32()))], names=[*kept, "places"])


def dedup(documents: DataFrame, *, window: int = 50, first: int | None = None, keep_text: bool = False) -> DataFrame:
    """Every row: doc_id, n_words, n_removed, kept_sha256 (and kept_text where words were removed)."""
    rows, cut, _ = repeated_windows(documents, window=window, first=first, keep_text=keep_text)
    text = ["kept_text"] if keep_text else []
    cut = cut.select("th", F.col("doc_id").alias("first_id"), "n_removed", "kept_sha256", *text)
    out = _left(rows, cut)
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= window)
    empty = F.sha2(F.lit(""), 256)
    found = out.select(
        F.nullif("doc_id", F.lit(_NO_ID)).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, empty).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        *[F.when(copy, F.lit("")).otherwise(F.col(c)).alias(c) for c in text],
    )
    none = runtime.pick(documents, doc_id="long", text="string").where("text is null")
    zero = F.lit(0).cast("long")
    return found.unionByName(none.select("doc_id", zero.alias("n_words"), zero.alias("n_removed"), empty.alias("kept_sha256"), *[F.lit("").alias(c) for c in text]))


def _left(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """Rows with their class's cut; a hot class can be split, since both sides are plain exchanges."""
    key = [F.xxhash64("th", "first_id").alias("_k")]
    return rows.select("*", *key).join(cut.select("*", *key), ["_k", "th", "first_id"], "left").drop("_k")
