"""Language identification as a mixture: every document's language proportions by EM.

Each language has a multinomial model of letter trigrams (bytes of the lower-cased text, word
ends included, hashed to ``features`` bins), counted over all labelled training rows. A word's
likelihood under a language is the product over its trigrams. For each document, expectation
maximisation over its words estimates the proportions of all languages. The languages are then
ranked by proportion, and of the nested sets with the best 1, 2, .. of them (all, unless ``most``
bounds it) the one with
the highest log-likelihood less ``penalty`` * log(words + 1) for each further language is chosen;
its re-estimated proportions are the document's. Whole texts are read in slices that never cut a
document. The model has features * languages numbers, whatever the corpus.

Defined cases: a null text, or one without a letter (``\\p{L}``), is ``und`` with score 0, and so
is every text if no row is labelled; ties go to the language that sorts first; rows that repeat
are judged each; a null doc_id counts as held out; only ``doc_id``, ``text`` and (for training)
``lang`` are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import runtime
from millrace.llm import wordscan

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True


class Letters:
    """Words of letters of a slice and the hashed trigram at each letter."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, features: int):
        inside = _LETTER[data]
        n = len(data)
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edge = offsets[(offsets > 0) & (offsets < n)]
        before[edge], after[edge - 1] = False, False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        size = end - start
        self.first = np.searchsorted(start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        letters = data[inside]
        self.word = np.concatenate(([0], np.cumsum(size)))[:-1]
        place = np.arange(len(letters)) + np.repeat(np.arange(1, len(size) + 1), size)
        line = np.zeros(len(letters) + len(size) + 2, dtype=np.uint32)
        line[place] = letters
        k = line[place - 1] * np.uint32(0x9E3779B1) ^ line[place] * np.uint32(0x85EBCA77) ^ line[place + 1] * np.uint32(0xC2B2AE3D)
        k ^= k >> np.uint32(15)
        k *= np.uint32(0x2C1B3C6D)
        self.feature = (k >> np.uint32(12)).astype(np.int64) % features


def _lowered(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    yield from wordscan.slices(pc.utf8_lower(text.fill_null("")))


def _count(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[pa.RecordBatch]:
    """Trigram counts of every language, summed over the task."""
    total: dict[str, np.ndarray] = {}
    for b in batches:
        langs = b.column("lang").to_pylist()
        for at, _, data, offsets in _lowered(b.column("text")):
            x = Letters(data, offsets, features)
            of = np.repeat(x.doc, np.diff(np.append(x.word, len(x.feature))))
            names = langs[at : at + len(offsets) - 1]
            for lang in set(names):
                mine = np.array([y == lang for y in names])
                total.setdefault(lang, np.zeros(features, np.int64))
                total[lang] += np.bincount(x.feature[mine[of]], minlength=features)
    for lang, c in total.items():
        k = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(c[k], pa.int64())], names=["lang", "feature", "n"])


def _shares(likelihood: np.ndarray, first: np.ndarray, doc: np.ndarray, p: np.ndarray, rounds: int) -> np.ndarray:
    """EM on proportions ``p`` (documents x languages); documents without words keep theirs."""
    n = np.diff(first)
    busy = n > 0
    for _ in range(rounds):
        r = p[doc] * likelihood
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
        p = p.copy()
        p[busy] = np.add.reduceat(r, first[:-1][busy], axis=0) / n[busy, None]
    return p


def _fit(likelihood: np.ndarray, top: np.ndarray, first: np.ndarray, doc: np.ndarray, most: int | None, penalty: float, rounds: int) -> np.ndarray:
    d, k = len(first) - 1, likelihood.shape[1]
    p = _shares(likelihood, first, doc, np.full((d, k), 1 / k), rounds)
    rank = np.argsort(np.argsort(-p, axis=1, kind="stable"), axis=1)
    busy = np.diff(first) > 0
    best, out = np.full(d, -np.inf), p
    for m in range(1, min(most or k, k) + 1):
        q = np.where(rank < m, p + 1e-12, 0)
        q = _shares(likelihood, first, doc, q / q.sum(axis=1, keepdims=True), 3 if m > 1 else 0)
        fit = np.log(np.maximum((q[doc] * likelihood).sum(axis=1), 1e-300)) + top
        total = np.zeros(d)
        total[busy] = np.add.reduceat(fit, first[:-1][busy])
        total -= (m - 1) * penalty * np.log(np.diff(first) + 1.0)
        out = np.where((total > best)[:, None], q, out)
        best = np.maximum(best, total)
    return out


def _predict(batches: Iterator[pa.RecordBatch], langs: list[str], model: np.ndarray, most: int | None, penalty: float, rounds: int) -> Iterator[pa.RecordBatch]:
    names = np.array(langs, dtype=object)
    for b in batches:
        letter = b.column("letter").to_numpy(zero_copy_only=False).astype(bool)
        for at, to, data, offsets in _lowered(b.column("text")):
            x = Letters(data, offsets, model.shape[1])
            n = to - at
            ok = letter[at:to] & bool(langs)
            share = np.zeros((n, max(1, len(langs))))
            if len(x.word) and langs:
                word = np.stack([np.add.reduceat(row[x.feature], x.word) for row in model], axis=1).astype(np.float64)
                top = word.max(axis=1)
                share = _fit(np.exp(word - top[:, None]), top, x.first, x.doc, most, penalty, rounds)
            best = share.argmax(axis=1)
            score = np.where(ok, np.clip(share[np.arange(n), best], 0, 1), 0.0)
            pred = np.where(ok, names[best], "und") if langs else np.array(["und"] * n, dtype=object)
            mix = [[{"lang": langs[k], "share": float(s[k])} for k in np.argsort(-s, kind="stable") if s[k] > 0.01] if o else [] for s, o in zip(share, ok, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(at, n), b.column("held_out").slice(at, n), pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(mix, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                names=["doc_id", "held_out", "lang_pred", "score", "languages"],
            )


def train(labelled: DataFrame, *, features: int = 1 << 16, smoothing: float = 0.1) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihoods by language and feature) from all rows of (text, lang)."""
    runtime.ship(labelled.sparkSession)
    rows = runtime.pick(labelled, text="string", lang="string").where("text is not null and lang is not null")
    counts = rows.mapInArrow(lambda it: _count(it, features), "lang string, feature int, n long")
    found = counts.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    c = np.zeros((len(langs), features))
    if langs:
        at = {x: i for i, x in enumerate(langs)}
        c[[at[x] for x in found["lang"].to_pylist()], found["feature"].to_numpy()] = found["n"].to_numpy()
    c += smoothing
    return langs, np.log(c / c.sum(axis=1, keepdims=True)).astype(np.float32)


def identify(documents: DataFrame, model: tuple[list[str], np.ndarray], *, folds: int = 5, most: int | None = None, penalty: float = 2.0, rounds: int = 8) -> DataFrame:
    """Every row: doc_id, held_out, lang_pred, score (the predicted language's share), languages."""
    spark = documents.sparkSession
    runtime.ship(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = runtime.pick(documents, doc_id="long", text="string")
    docs = docs.withColumn("held_out", held_out(folds)).withColumn("letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return docs.mapInArrow(lambda it: _predict(it, *shared.value, most, penalty, rounds), "doc_id long, held_out boolean, lang_pred string, score double, languages array<struct<lang: string, share: double>>")


def held_out(folds: int = 5) -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(True))


def detect(documents: DataFrame, *, folds: int = 5, **options) -> DataFrame:
    """Learn from the labelled rows whose crc32(doc_id as text) mod ``folds`` is not 0; judge all."""
    known = runtime.pick(documents, doc_id="long", text="string", lang="string").where(~held_out(folds))
    return identify(documents, train(known), folds=folds, **options)


def _kept(batches: Iterator[pa.RecordBatch], at: int, model: tuple[list[str], np.ndarray], most: int | None, penalty: float, rounds: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        *own, letter = range(b.num_columns)
        none = pa.nulls(b.num_rows, pa.int64())
        judged = pa.RecordBatch.from_arrays([none, none, b.column(at).cast(pa.string()), b.column(letter)], names=["doc_id", "held_out", "text", "letter"])
        ok: list[bool] = []
        for r in _predict(iter([judged]), *model, most, penalty, rounds):
            ok += [p != "und" for p in r.column("lang_pred").to_pylist()]
        if not model[0]:
            ok = b.column(letter).to_pylist()
        yield pa.RecordBatch.from_arrays([b.column(i) for i in own], names=[b.schema.names[i] for i in own]).filter(pa.array(ok, pa.bool_()))


def keep_identified(documents: DataFrame, *, folds: int = 5, most: int | None = None, penalty: float = 2.0, rounds: int = 8) -> DataFrame:
    """``documents`` without those that are ``und``, however many languages the others mix.

    If no row is labelled nothing can be judged, and only texts without a letter go.
    """
    spark = documents.sparkSession
    runtime.ship(spark)
    known = runtime.pick(documents, doc_id="long", text="string", lang="string").where(~held_out(folds))
    shared = spark.sparkContext.broadcast(train(known))
    at = documents.columns.index("text")
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return documents.select("*", letter.alias("_letter")).mapInArrow(lambda it: _kept(it, at, shared.value, most, penalty, rounds), documents.schema)
