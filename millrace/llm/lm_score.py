"""Bigram language model with deleted interpolation, learned from and applied to whole texts.

P(w | h) = a2(b) c(h w) / c(h) + a1(b) c(w) / N + a0(b) / (V + 1), where b = floor(log2(c(h) + 1))
is the context's frequency bucket. The mixture weights of each bucket come from expectation
maximisation on held-out counts: every training document in turn is held out, its own counts are
deleted from the corpus counts, and its tokens are scored by what remains.

Counting and look-up are one exchange. Documents are dealt into chunks; a chunk asks for the
counts of its distinct n-grams, packed by key range into one binary piece a bucket, and adds how
often its training documents hold them. A bucket sums the pieces of all chunks and answers each
piece in place, so an answer needs no keys. Nothing that grows with the corpus is broadcast or
reaches the driver: only N, V and a fixed-size histogram of count ratios for the weights, rounded
to half powers of two on both sides of the uniform probability. A
frequent n-gram costs one entry a chunk. Chunks and buckets grow with the corpus so that pieces
stay few (``chunk_bytes`` and ``bucket_bytes`` are lower limits).

Defined cases: a null text is empty (its end token remains); a null doc_id counts as held out;
rows that repeat are counted and scored each; only ``doc_id`` and ``text`` are read; an empty
table gives no rows, and without training documents every count is 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import runtime
from millrace.llm import wordscan

_END, _START = np.uint64(0x8B72E1A54F0D36C9), np.uint64(0x3C6EF372FE94F82B)
_BUCKETS, _STEPS, _MOST_PIECES = 40, 2, 1 << 17


class Chunk:
    """Tokens and contexts of a chunk's texts, with its distinct unigrams and bigrams in key order."""

    def __init__(self, table: pa.Table):
        hashes, counts = [], []
        text = table.column("text").combine_chunks() if isinstance(table.column("text"), pa.ChunkedArray) else table.column("text")
        for _, _, data, offsets in wordscan.slices(text):
            w = wordscan.scan(data, offsets, wordscan.SPACED, True)
            hashes.append(w.hash)
            counts.append(w.count())
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.size = (np.concatenate(counts) if counts else np.zeros(0, np.int64)) + 1
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        n = int(self.first[-1])
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        ends = np.zeros(n, dtype=bool)
        ends[self.first[1:] - 1] = True
        token = np.full(n, _END, dtype=np.uint64)
        token[~ends] = words
        context = np.full(n, _START, dtype=np.uint64)
        begins = np.zeros(n, dtype=bool)
        begins[self.first[:-1]] = True
        context[~begins] = words
        with np.errstate(over="ignore"):
            pair = wordscan.mix(context * np.uint64(0x9E3779B97F4A7C15) + wordscan.mix(token, 3), 5)
        self.uni, self.u = np.unique(token, return_inverse=True)
        self.bi, self.b = np.unique(pair, return_inverse=True)
        # A word is a context as often as it is a token, and the start as often as the end.
        self.h = np.empty(n, dtype=np.int64)
        self.h[~begins] = self.u[~ends]
        self.h[begins] = self.u[ends]
        self.train = ~table.column("held_out").to_numpy(zero_copy_only=False).astype(bool)


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a batch that go to one chunk as one compressed piece, so that texts are exchanged small."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for b in batches:
        order = b.column("chunk").to_numpy().argsort(kind="stable")
        b = b.take(pa.array(order))
        chunk = b.column("chunk").to_numpy()
        cut = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])) if len(chunk) else np.zeros(0, np.int64)
        ids, blobs = [], []
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(chunk)], strict=False):
            part = pa.Table.from_batches([b.slice(s, e - s).select(["doc_id", "text", "held_out"])]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=options) as w:
                w.write_table(part)
            ids.append(int(chunk[s]))
            blobs.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "docs"])


def _opened(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in table.column("docs").to_pylist()]).combine_chunks()


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences by byte plane: the planes of leading zeros compress away."""
    return zlib.compress(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(blob), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _pack_counts(c: np.ndarray) -> bytes:
    return zlib.compress(c.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack_counts(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel().astype(np.int64)


def _ask(key: tuple, table: pa.Table, buckets: int) -> pa.Table:
    c = Chunk(_opened(table))
    learned = c.train[c.doc]
    rows: list[tuple] = []
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)
    for kind, keys, index in ((0, c.uni, c.u), (1, c.bi, c.b)):
        n = np.bincount(index[learned], minlength=len(keys))
        cut = np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))
        for i, (s, e) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            if e > s:
                rows.append((kind * buckets + i, key[0].as_py(), _pack(keys[s:e]), _pack_counts(n[s:e])))
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    cols = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.Table.from_arrays([pa.array(list(x), k) for x, k in zip(cols, kinds, strict=True)], names=["bucket", "chunk", "keys", "counts"])


def _answer(key: tuple, table: pa.Table, buckets: int) -> pa.Table:
    bucket = key[0].as_py()
    chunks = table.column("chunk").to_pylist()
    pieces = [_unpack(x) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([_unpack_counts(x) for x in table.column("counts").to_pylist()])
    values, inverse = np.unique(np.concatenate(pieces), return_inverse=True)
    total = np.bincount(inverse, weights=counts, minlength=len(values)).astype(np.int64)
    found, at = [], 0
    for p in pieces:
        found.append(_pack_counts(total[inverse[at : at + len(p)]]))
        at += len(p)
    unigrams = bucket < buckets
    n = len(chunks)
    stat = lambda x: pa.array([int(x) if unigrams else 0] + [0] * (n - 1), pa.int64())
    return pa.Table.from_arrays(
        [pa.array(chunks, pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array(found, pa.binary()), stat((total > 0).sum()), stat(total.sum())],
        names=["chunk", "bucket", "found", "distinct", "tokens"],
    )


def _counts(c: Chunk, replies: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    order = sorted(zip(replies.column("bucket").to_pylist(), replies.column("found").to_pylist(), strict=True))
    out = []
    for kind, keys in ((0, c.uni), (1, c.bi)):
        mine = [_unpack_counts(x) for b, x in order if b // buckets == kind]
        got = np.concatenate(mine) if mine else np.zeros(0, np.int64)
        if len(got) != len(keys):
            raise ValueError("a chunk's answers don't match its n-grams: the input changed between passes")
        out.append(got)
    return out[0], out[1]


def _level(p: np.ndarray, unit: float, at: int) -> np.ndarray:
    """0 for 0, else 1 + twice the rounded-off log2 of p / unit without its sign, as bits of a cell.

    The size has the seven bits from 7 * ``at``; bit 20 + ``at`` is set for what is less than ``unit``.
    """
    with np.errstate(divide="ignore"):
        steps = np.where(p > 0, np.rint(_STEPS * np.log2(p / unit)), 0)
    size = np.where(p > 0, 1 + np.minimum(np.abs(steps), 126), 0).astype(np.int64)
    return size << 7 * at | (steps < 0).astype(np.int64) << 20 + at


def _cell(context: np.ndarray, p2: np.ndarray, p1: np.ndarray, unit: float) -> np.ndarray:
    return _bucket(np.maximum(context, 0)) << 14 | _level(p2, unit, 1) | _level(p1, unit, 0)


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(c + 1.0).astype(np.int64), _BUCKETS - 1)


def _ratios(docs: pa.Table, replies: pa.Table, buckets: int, n: int, v: int) -> pa.Table:
    c = Chunk(_opened(docs))
    uni, bi = _counts(c, replies, buckets)
    use = c.train[c.doc]

    def rest(counts: np.ndarray, index: np.ndarray, ask: np.ndarray) -> np.ndarray:
        """Counts of ``ask`` without the token's own document, whose counts are those of ``index``."""
        key = c.doc.astype(np.int64) * len(counts) + index
        seen, own = np.unique(key, return_counts=True)
        k = c.doc.astype(np.int64) * len(counts) + ask
        at = np.minimum(np.searchsorted(seen, k), len(seen) - 1)
        return np.maximum(counts[ask] - np.where(seen[at] == k, own[at], 0), 0)

    pair, context, token = rest(bi, c.b, c.b), rest(uni, c.u, c.h), rest(uni, c.u, c.u)
    others = np.maximum(n - c.size[c.doc], 1)
    unit = 1 / (v + 1)
    p2 = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
    cell = _cell(context, p2, token / others, unit)
    cells, k = np.unique(cell[use], return_counts=True)
    return pa.Table.from_arrays([pa.array(cells, pa.int64()), pa.array(k, pa.int64())], names=["cell", "n"])


def weights(cells: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Mixture weights (uniform, unigram, bigram) of every context bucket, by EM."""
    out = np.tile(np.array([0.1, 0.9, 0.0]), (_BUCKETS, 1))
    ratio = lambda q, below: np.where(q > 0, 2.0 ** (np.where(below > 0, 1 - q, q - 1) / _STEPS), 0.0)
    bucket = cells >> 14 & 63
    for b in np.unique(bucket):
        mine = bucket == b
        p = np.stack([np.ones(mine.sum()), *[ratio(cells[mine] >> 7 * at & 127, cells[mine] >> 20 + at & 1) for at in (0, 1)]], axis=1)
        a = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = a * p
            share *= (counts[mine] / share.sum(axis=1))[:, None]
            a = share.sum(axis=0) / counts[mine].sum()
        a = np.maximum(a, [1e-6, 0, 0])
        if b == 0:
            a[2] = 0
        out[b] = a / a.sum()
    return out


def _scored(docs: pa.Table, replies: pa.Table, buckets: int, n: int, v: int, mix: np.ndarray) -> pa.Table:
    docs = _opened(docs)
    c = Chunk(docs)
    uni, bi = _counts(c, replies, buckets)
    token, context, pair = uni[c.u], uni[c.h], bi[c.b]
    a = mix[_bucket(context)]
    p = a[:, 0] / (v + 1) + a[:, 1] * token / max(n, 1) + a[:, 2] * np.where(context > 0, pair / np.maximum(context, 1), 0.0)
    base = np.log10((token + 0.1) / (n + 0.1 * (v + 1)))
    at = c.first[:-1]
    total = lambda x: np.add.reduceat(x, at) if len(at) else np.zeros(0)
    d = docs.num_rows
    return pa.Table.from_arrays(
        [docs.column("doc_id"), docs.column("held_out"), pa.array(c.size, pa.int64()), pa.array(total((token > 0).astype(np.int64)), pa.int64()), pa.array(np.full(d, n), pa.int64()), pa.array(total(base), pa.float64()), pa.array(total(np.log10(p)), pa.float64())],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def score(documents: DataFrame, *, folds: int = 10, chunk_bytes: int = 8 << 20, bucket_bytes: int = 24 << 20) -> DataFrame:
    """Every row scored by a model of the rows whose crc32(doc_id as text) mod ``folds`` is not 0.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = documents.sparkSession
    runtime.ship(spark)
    work = runtime.Workspace(spark, "lm")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(True))
    docs = runtime.pick(documents, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("held_out", held)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = min(_MOST_PIECES, max(1, math.ceil(total / chunk_bytes)))
    buckets = min(_MOST_PIECES // 2, max(1, math.ceil(total / bucket_bytes)))
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).mapInArrow(_bundle, "chunk int, docs binary")
    asked = dealt.groupBy("chunk").applyInArrow(lambda k, t: _ask(k, t, buckets), "bucket int, chunk int, keys binary, counts binary")
    replies = work.save(asked.groupBy("bucket").applyInArrow(lambda k, t: _answer(k, t, buckets), "chunk int, bucket int, found binary, distinct long, tokens long"))
    work.release()
    stat = replies.agg(F.sum("distinct").alias("v"), F.sum("tokens").alias("n")).first()
    v, n = stat["v"] or 0, stat["n"] or 0

    pairs = lambda: dealt.groupBy("chunk").cogroup(replies.groupBy("chunk"))
    seen = pairs().applyInArrow(lambda d, r: _ratios(d, r, buckets, n, v), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    work.release()
    mix = weights(seen["cell"].to_numpy(), seen["n"].to_numpy())
    return pairs().applyInArrow(lambda d, r: _scored(d, r, buckets, n, v, mix), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
