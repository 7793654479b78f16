"""Benchmark decontamination by a prefix-filtered set join with exact containment.

An item's windows are its runs of ``window`` consecutive words (an item with fewer, but not none,
is one window). A window occurs in a document when all its shingles do, in order, so for
containment 1 a single shingle is a sufficient prefix: each window is filed under its rarest
shingle (fewest windows of the benchmark have it; ties by hash). Document shingles are looked up
among those prefix shingles, a match is kept if the window fits between the document's ends at
that offset (positional and length bounds), and the survivors are verified word by word.

The benchmark is broadcast in blocks of at most ``block_bytes`` of item text, measured before
anything is collected. Several blocks are chained map stages over the same documents, so a large
benchmark costs further passes but neither a shuffle of documents nor unbounded memory.

Defined cases: null or wordless texts have no words and no hits; an item without words has no
windows; items that repeat count once; an item without id marks words but is not listed; rows
that repeat are judged each on its own; only ``doc_id``/``text`` and ``item_id``/``text`` are
read, so further columns of any name are ignored; empty tables give no rows or no hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import runtime
from millrace.llm import wordscan

_SPANS = "array<struct<start: int, end: int>>"
_OUT = f"doc_id long, text string, n_words long, spans {_SPANS}, items array<string>"


class Index:
    """Windows of a block of items, filed under their prefix shingles by shingle length."""

    def __init__(self, ids: list, texts: pa.Array, window: int, shingle: int):
        rows, lengths, owners = [], [], []
        for at, to, data, offsets in wordscan.slices(texts):
            w = wordscan.scan(data, offsets, wordscan.ALNUM, True)
            for d in range(to - at):
                h = w.hash[w.first[d] : w.first[d + 1]]
                size = min(window, len(h))
                for s in range(len(h) - size + 1 if size else 0):
                    rows.append(np.pad(h[s : s + size], (0, window - size)))
                    lengths.append(size)
                    owners.append(ids[at + d])
        self.window = window
        self.words = np.array(rows, dtype=np.uint64).reshape(len(rows), window)
        self.length = np.array(lengths, dtype=np.int64)
        self.owner = owners
        self.by_size = {}
        for size in sorted({min(shingle, n) for n in lengths}):
            self._file(size, shingle)

    def _file(self, size: int, shingle: int) -> None:
        mine = np.flatnonzero(np.minimum(self.length, shingle) == size)
        each = [wordscan.grams(self.words[i, : self.length[i]], size) for i in mine]
        flat = np.concatenate(each)
        values, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(values), dtype=np.int64)
        rank[np.lexsort((values, counts))] = np.arange(len(values))
        prefix, shift, at = [], [], 0
        for g in each:
            best = int(np.argmin(rank[inverse[at : at + len(g)]]))
            prefix.append(g[best])
            shift.append(best)
            at += len(g)
        order = np.argsort(np.array(prefix, dtype=np.uint64), kind="stable")
        keys, first = np.unique(np.array(prefix, dtype=np.uint64)[order], return_index=True)
        bits = 1 << max(16, math.ceil(math.log2(len(keys) * 32)))
        seen = np.zeros(bits, dtype=bool)
        seen[(keys & np.uint64(bits - 1)).astype(np.int64)] = True
        self.by_size[size] = (keys, np.append(first, len(order)), mine[order], np.array(shift)[order], seen)

    def find(self, w: wordscan.Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence in a slice."""
        starts, windows = [], []
        for size, (keys, first, filed, shift, seen) in self.by_size.items():
            g = wordscan.grams(w.hash, size)
            at = np.flatnonzero(seen[(g & np.uint64(len(seen) - 1)).astype(np.int64)])
            k = np.searchsorted(keys, g[at])
            ok = (k < len(keys)) & (keys[np.minimum(k, len(keys) - 1)] == g[at])
            at, k = at[ok], k[ok]
            n = first[k + 1] - first[k]
            slot = np.repeat(first[k] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, dtype=np.int64)
            window = filed[slot]
            start = np.repeat(at, n) - shift[slot]
            doc = np.repeat(w.doc[at], n)
            fits = (start >= w.first[doc]) & (start + self.length[window] <= w.first[doc + 1])
            start, window = start[fits], window[fits]
            for j in range(self.window):
                longer = self.length[window] > j
                same = ~longer
                same[longer] = w.hash[start[longer] + j] == self.words[window[longer], j]
                start, window = start[same], window[same]
            starts.append(start)
            windows.append(window)
        if not starts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(starts), np.concatenate(windows)


def _mark(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = b.column("text")
        for at, to, data, offsets in wordscan.slices(text):
            w = wordscan.scan(data, offsets, wordscan.ALNUM, True)
            start, window = index.find(w)
            yield _merged(b.slice(at, to - at), index, w, start, window)


def _merged(b: pa.RecordBatch, index: Index, w: wordscan.Words, start: np.ndarray, window: np.ndarray) -> pa.RecordBatch:
    n = b.num_rows
    spans: list = [[] for _ in range(n)]
    items: list = [[] for _ in range(n)]
    touched = set()
    if b.column("spans").null_count < n:  # what earlier blocks have found
        for d, (s, i) in enumerate(zip(b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True)):
            if s:
                touched.add(d)
                spans[d], items[d] = s, i
    if len(start):
        order = np.lexsort((start, w.doc[start]))
        start, window = start[order], window[order]
        at = start - w.first[w.doc[start]]
        for d, a, z, k in zip(w.doc[start].tolist(), at.tolist(), (at + index.length[window]).tolist(), window.tolist(), strict=True):
            touched.add(d)
            spans[d].append({"start": a, "end": z})
            if index.owner[k] is not None:
                items[d].append(index.owner[k])
    for d in touched:
        spans[d], items[d] = _union(spans[d]), sorted(set(items[d]))
    return pa.RecordBatch.from_arrays(
        [b.column("doc_id"), b.column("text"), pa.array(w.count(), pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))],
        names=["doc_id", "text", "n_words", "spans", "items"],
    )


def _union(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def _clean(batches: Iterator[pa.RecordBatch], at: int, index: Index) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = np.ones(b.num_rows, dtype=bool)
        for a, _, data, offsets in wordscan.slices(b.column(at)):
            w = wordscan.scan(data, offsets, wordscan.ALNUM, True)
            start, _ = index.find(w)
            ok[a + w.doc[start]] = False
        yield b.filter(pa.array(ok))


def _blocks(benchmark: DataFrame, window: int, shingle: int, block_bytes: int) -> Iterator[Index]:
    """The benchmark's windows, a block of items at a time; sizes are measured before any is collected."""
    items = runtime.pick(benchmark, item_id="string", text="string").where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        rows = part.toArrow()
        yield Index(rows["item_id"].to_pylist(), rows["text"].combine_chunks(), window, shingle)


def keep_clean(documents: DataFrame, benchmark: DataFrame, *, window: int = 10, shingle: int = 5, block_bytes: int = 8 << 20) -> DataFrame:
    """``documents`` without those in which a benchmark window occurs."""
    spark = documents.sparkSession
    runtime.ship(spark)
    at = documents.columns.index("text")
    out = documents
    for block in _blocks(benchmark, window, shingle, block_bytes):
        index = spark.sparkContext.broadcast(block)
        out = out.mapInArrow(lambda it, index=index: _clean(it, at, index.value), documents.schema)
    return out


def find_overlaps(documents: DataFrame, benchmark: DataFrame, *, window: int = 10, shingle: int = 5, block_bytes: int = 8 << 20) -> DataFrame:
    """Every document with what it shares with the benchmark.

    Returns doc_id, text, n_words, spans (merged runs of hit words, end exclusive) and items
    (ids, as strings, of the items with occurring windows; sorted, distinct).
    """
    spark = documents.sparkSession
    runtime.ship(spark)
    out = runtime.pick(documents, doc_id="long", text="string").select("*", *[F.lit(None).cast(k).alias(n) for n, k in (("n_words", "long"), ("spans", _SPANS), ("items", "array<string>"))])
    work = None
    for k, block in enumerate(_blocks(benchmark, window, shingle, block_bytes)):
        index = spark.sparkContext.broadcast(block)
        if k and k % 4 == 0:
            work = work or runtime.Workspace(spark, "decontaminate")
            out = work.save(out)
        out = out.mapInArrow(lambda it, index=index: _mark(index.value, it), _OUT)
    return out


def contamination(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return find_overlaps(documents, benchmark, **options).select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )
