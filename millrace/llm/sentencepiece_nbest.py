"""SentencePiece encoding, N-best segmentation and decoding over the piece lattice.

A text's lattice has a node between characters and an edge for each piece. A forward Viterbi pass
gives the best score from the start to every node; those are exact heuristics, so A* backward from
the end pops complete segmentations best first, and the first N pops are the N best.

No piece holds a space after another character, so the lattice of a text is a chain of segments
(spaces and the word after them); its best segmentation joins the segments' best, and its N best
need only the N - 1 segments whose second-best path costs least. That cost is exact without a
search: the best path through any edge off the best one. Viterbi runs over many distinct segments
at once, a character a step, at most ``_BLOCK`` characters of them (or one longer segment) at a
time; a worker remembers solved segments up to a bound. A* runs over the few that need it.

Piece scores are taken as log probabilities, as the model file has them. Characters without a
piece cost ``unknown`` below the least score and become byte pieces. Decoding is exact: every text
is restored, spaces, control characters and the space mark itself included.

Defined cases: a null or empty text has no pieces; ties prefer the longer last piece; rows that
repeat are encoded each; only ``doc_id`` and ``text`` are read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace import runtime
from millrace.llm import wordscan

#: The model file unless a path is given.
MODEL = os.environ.get("MILLRACE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
_MARK = "▁"
#: Bounds of memory: alternatives and characters of solved segments that a worker remembers,
#: characters whose lattices are solved at once, bytes of texts that are encoded at once.
_KEEP, _KNOWN, _BLOCK, _SLICE = 20_000, 1 << 20, 1 << 16, 1 << 18


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message; fixed and length-delimited values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = raw[at]
            at += 1
            x |= (b & 127) << shift
            if b < 128:
                return x
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, raw[at : at + n]
        at += n


@dataclass
class Vocabulary:
    """Pieces of a model file. Spaces stand for the space mark; bytes have ids of their own."""

    names: list[str] = field(default_factory=list)
    edges: dict[str, tuple[float, int]] = field(default_factory=dict)
    byte_id: dict[int, int] = field(default_factory=dict)
    prefix: bool = True
    unknown: float = 0.0
    starts: set[str] = field(default_factory=set)
    alone: str = ""

    @classmethod
    def load(cls, path: str, penalty: float = 10.0) -> Vocabulary:
        with open(path, "rb") as f:
            raw = f.read()
        v = cls()
        for number, value in _fields(raw):
            if number == 1:
                x = dict(_fields(value))
                name, kind = x[1].decode(), x.get(3, 1)
                i = len(v.names)
                v.names.append(name)
                if kind == 6:
                    v.byte_id[int(name[3:5], 16)] = i
                elif kind in (1, 4) and name:
                    v.edges.setdefault(name.replace(_MARK, " "), (struct.unpack("<f", x[2])[0] if 2 in x else 0.0, i))
            elif number == 3:
                v.prefix = bool(dict(_fields(value)).get(3, 1))
        return v.ready(penalty)

    def ready(self, penalty: float = 10.0) -> Vocabulary:
        self.unknown = min((s for s, _ in self.edges.values()), default=0.0) - penalty
        self.starts = {p[:k] for p in self.edges for k in range(1, len(p) + 1)}
        if any(" " in p.lstrip(" ") for p in self.edges):
            raise ValueError("a piece holds a space after another character; segments would not be independent")
        inside = set("".join(p for p in self.edges if len(p) > 1))
        self.alone = "".join(c for c in "\n\t\r" if c not in inside)
        return self

    def splitter(self) -> re.Pattern:
        a = re.escape(self.alone)
        return re.compile(f"[{a}]| *[^ {a}]+| +" if a else " *[^ ]+| +")

    def ids(self, pieces: list) -> list[int]:
        """Ids of a path; a character without a piece stands as itself."""
        out: list[int] = []
        for p in pieces:
            if isinstance(p, int):
                out.append(p)
            elif self.byte_id:
                out.extend(self.byte_id[b] for b in p.encode())
            else:
                out.append(0)
        return out

    def lattice(self, s: str) -> tuple[list[float], list[list]]:
        """Best score from the start to every node, and the edges (start, score, piece) into it."""
        n = len(s)
        edges: list[list] = [[] for _ in range(n + 1)]
        get, starts = self.edges.get, self.starts
        for i in range(n):
            single = False
            for j in range(i + 1, n + 1):
                p = s[i:j]
                if p not in starts:
                    break
                if (e := get(p)) is not None:
                    edges[j].append((i, *e))
                    single |= j == i + 1
            if not single:
                edges[i + 1].append((i, self.unknown, s[i]))
        best = [0.0] * (n + 1)
        for j in range(1, n + 1):
            best[j] = max([best[i] + w for i, w, _ in edges[j]])
        return best, edges

    def n_best(self, s: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best paths by A* from the end, with the forward scores as heuristics."""
        best, edges = self.lattice(s)
        heap: list = [(-best[-1], 0, len(s), 0.0, None)]
        out, made = [], 0
        while heap and len(out) < n:
            _, _, j, done, tail = heapq.heappop(heap)
            if j == 0:
                path = []
                while tail:
                    path.append(tail[0])
                    tail = tail[1]
                out.append((done, self.ids(path)))
                continue
            for i, w, p in edges[j]:
                made += 1
                heapq.heappush(heap, (-(best[i] + w + done), made, i, w + done, (p, tail)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text that these ids stand for."""
        value = {i: b for b, i in self.byte_id.items()}
        out = bytearray()
        for i in ids:
            if i in value:
                out.append(value[i])
            else:
                out += self.names[i].replace(_MARK, " ").encode()
        text = out.decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


class Table:
    """Pieces by hash of their characters, for looking up many substrings at once."""

    def __init__(self, v: Vocabulary):
        self.unknown = v.unknown
        self.by_length = []
        names = list(v.edges)
        self.longest = max(map(len, names), default=1)
        for n in range(1, self.longest + 1):
            mine = [p for p in names if len(p) == n]
            code = np.frombuffer("".join(mine).encode("utf-32-le"), dtype=np.uint32).reshape(len(mine), n)
            h = np.zeros(len(mine), dtype=np.uint64)
            for k in range(n):
                h = _step(h, code[:, k])
            order = np.argsort(h)
            seen = np.zeros(1 << 18, dtype=bool)
            seen[(h >> np.uint64(46)).astype(np.int64)] = True
            score = np.array([v.edges[mine[i]][0] for i in order])
            ids = np.array([v.edges[mine[i]][1] for i in order], dtype=np.int64)
            self.by_length.append((h[order], score, ids, seen))

    def edges(self, code: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first character, length, score, id) of every piece; ``room`` is the characters left in the segment.

        A character without a piece has an edge whose id is -1 less its code.
        """
        found = []
        h = np.zeros(len(code), dtype=np.uint64)
        at = np.arange(len(code))
        single = np.zeros(len(code), dtype=bool)
        for n, (keys, score, ids, seen) in enumerate(self.by_length, 1):
            fits = room[at] >= n
            at, h = at[fits], h[fits]
            if not len(at):
                break
            h = _step(h, code[at + n - 1])
            likely = np.flatnonzero(seen[(h >> np.uint64(46)).astype(np.int64)])
            if not len(keys):
                continue
            k = np.minimum(np.searchsorted(keys, h[likely]), len(keys) - 1)
            ok = keys[k] == h[likely]
            k, start = k[ok], at[likely[ok]]
            found.append((start, np.full(len(start), n), score[k], ids[k]))
            if n == 1:
                single[start] = True
        bare = np.flatnonzero(~single)
        found.append((bare, np.ones(len(bare), dtype=np.int64), np.full(len(bare), self.unknown), -1 - code[bare].astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return wordscan.mix(h ^ (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


class Paths:
    """Best paths of many segments: ``ids[first[k]:first[k + 1]]``, their scores, and the loss of the second best."""

    def __init__(self, v: Vocabulary, table: Table, segments: list[str]):
        size = np.array([len(s) for s in segments], dtype=np.int64)
        code = np.frombuffer("".join(segments).encode("utf-32-le"), dtype=np.uint32)
        base = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(code)) - base[owner]
        start, length, score, ids = table.edges(code, size[owner] - place)
        node = start + owner[start]  # every segment has one more node than characters
        into = node + length
        nodes = len(code) + len(size)

        best = np.zeros(nodes)
        back = np.zeros(nodes, dtype=np.int64)
        order = np.lexsort((-length, into, place[start] + length))
        for a, z in _runs((place[start] + length)[order]):
            e = order[a:z]
            got = best[node[e]] + score[e]
            head = np.flatnonzero(np.append(True, into[e][1:] != into[e][:-1]))
            top = np.maximum.reduceat(got, head)
            best[into[e[head]]] = top
            ties = np.flatnonzero(got == np.repeat(top, np.diff(np.append(head, len(e)))))
            first = ties[np.append(True, into[e[ties]][1:] != into[e[ties]][:-1])]
            back[into[e[first]]] = e[first]

        after = np.zeros(nodes)
        left = size[owner[start]] - place[start]
        order = np.lexsort((node, left))
        for a, z in _runs(left[order]):
            e = order[a:z]
            head = np.flatnonzero(np.append(True, node[e][1:] != node[e][:-1]))
            after[node[e[head]]] = np.maximum.reduceat(score[e] + after[into[e]], head)

        on = np.zeros(len(start), dtype=bool)
        cur = base + np.arange(len(size)) + size
        first_node = base + np.arange(len(size))
        live = np.flatnonzero(cur > first_node)
        while len(live):
            e = back[cur[live]]
            on[e] = True
            cur[live] = node[e]
            live = live[cur[live] > first_node[live]]

        self.score = best[first_node + size]
        second = np.full(len(size), -np.inf)
        off = np.flatnonzero(~on)
        np.maximum.at(second, owner[start[off]], best[node[off]] + score[off] + after[into[off]])
        self.loss = np.maximum(self.score - second, 0.0)
        used = np.flatnonzero(on)
        used = used[np.argsort(start[used], kind="stable")]
        self.ids, count = _expanded(v, ids[used])
        per = np.bincount(owner[start[used]], weights=count, minlength=len(size)).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(per)))


def _runs(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, np.int64)
    return list(zip(cut.tolist(), [*cut[1:].tolist(), len(sorted_values)], strict=True)) if len(cut) else []


def _expanded(v: Vocabulary, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids with characters that have no piece as their bytes' ids; and how many each became."""
    count = np.ones(len(ids), dtype=np.int64)
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        return ids.astype(np.int32), count
    spelled = [v.ids([chr(-1 - c)]) for c in ids[bare].tolist()]
    count[bare] = [len(x) for x in spelled]
    out = np.repeat(ids, count)
    begin = np.cumsum(count) - count
    for at, x in zip(begin[bare].tolist(), spelled, strict=True):
        out[at : at + len(x)] = x
    return out.astype(np.int32), count


class Encoder:
    """Encodes lists of texts; a segment has its lattice solved once while it is remembered."""

    def __init__(self, v: Vocabulary):
        self.v, self.split, self.table = v, v.splitter().findall, Table(v)
        self._ways: dict[tuple[str, int], list] = {}
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.segments: list[str] = []
        self.held = 0
        self.score, self.loss, self.first, self.ids = np.zeros(0), np.zeros(0), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _learn(self) -> None:
        """Solve the segments that were met since the last call."""
        segments = list(islice(self.number, len(self.segments), None))
        parts, at = [], 0
        while at < len(segments):
            to, size = at, 0
            while to < len(segments) and (to == at or size + len(segments[to]) <= _BLOCK):
                size += len(segments[to])
                to += 1
            parts.append(Paths(self.v, self.table, segments[at:to]))
            self.held += size
            at = to
        self.segments += segments
        self.score = np.concatenate([self.score, *[p.score for p in parts]])
        self.loss = np.concatenate([self.loss, *[p.loss for p in parts]])
        base = np.cumsum([self.first[-1], *[p.first[-1] for p in parts]])
        self.first = np.concatenate([self.first, *[p.first[1:] + b for p, b in zip(parts, base[:-1], strict=True)]])
        self.ids = np.concatenate([self.ids, *[p.ids for p in parts]])

    def encode(self, texts: list[str], n: int = 1) -> list[list[tuple[float, np.ndarray]]]:
        """Of each text, its ``n`` best (score, ids), best first."""
        if self.held > _KNOWN:
            self._forget()
        number = self.number
        add, lead = number.setdefault, " " if self.v.prefix else ""
        flat: list[int] = []
        bounds = [0]
        for t in texts:
            if t:
                flat += [add(s, len(number)) for s in self.split(lead + t)]
            bounds.append(len(flat))
        if not flat:
            return [[(0.0, np.zeros(0, np.int32))] for _ in texts]
        self._learn()
        which = np.array(flat, dtype=np.int64)
        size = np.diff(self.first)[which]
        start = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.arange(start[-1]) + np.repeat(self.first[which] - start[:-1], size)]
        score, loss = self.score[which], self.loss[which]
        out = []
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            found = [(float(score[a:z].sum()), ids[start[a] : start[z]])]
            if n > 1 and z > a:
                found += self._others(self.segments, which[a:z], loss[a:z], start[a : z + 1] - start[a], found[0], n - 1)
            out.append(found)
        return out

    def _others(self, segments: list[str], which: np.ndarray, loss: np.ndarray, start: np.ndarray, best: tuple, n: int) -> list[tuple[float, np.ndarray]]:
        """The next ``n``: only the n segments that lose least by their second-best path can change."""
        worst = np.partition(loss, n - 1)[n - 1] if len(loss) > n else np.inf
        near = np.flatnonzero((loss <= worst) & (loss < np.inf))
        near = near[np.argsort(loss[near], kind="stable")][:n]
        ways = [self._alternatives(segments[which[k]], best[1][start[k] : start[k + 1]], n) for k in near.tolist()]
        heap: list = [(0.0, (0,) * len(ways))]
        seen, picks = {heap[0][1]}, []
        while heap and len(picks) <= n:
            lost, pick = heapq.heappop(heap)
            picks.append((lost, pick))
            for w in range(len(ways)):
                if pick[w] < len(ways[w]):
                    to = (*pick[:w], pick[w] + 1, *pick[w + 1 :])
                    if to not in seen:
                        seen.add(to)
                        heapq.heappush(heap, (sum(ways[x][y - 1][0] for x, y in enumerate(to) if y), to))
        out = []
        for lost, pick in picks[1:]:
            parts, at = [], 0
            for k, w, y in sorted((int(near[w]), w, y) for w, y in enumerate(pick) if y):
                parts += [best[1][at : start[k]], ways[w][y - 1][1]]
                at = start[k + 1]
            out.append((best[0] - lost, np.concatenate([*parts, best[1][at:]])))
        return out

    def _alternatives(self, segment: str, own: np.ndarray, n: int) -> list[tuple[float, np.ndarray]]:
        """(loss, ids) of the segment's ``n`` best paths after its best one."""
        key = (segment, n)
        if key not in self._ways:
            if len(self._ways) >= _KEEP:
                self._ways.clear()
            found = self.v.n_best(segment, n + 1)
            mine = own.tolist()
            self._ways[key] = [(found[0][0] - s, np.array(i, dtype=np.int32)) for s, i in found if i != mine][:n]
        return self._ways[key]


def digest(ids) -> str:
    """SHA-256 of ids as little-endian 32-bit numbers."""
    return hashlib.sha256(np.asarray(ids, dtype="<i4").tobytes()).hexdigest()


def _rows(batches: Iterator[pa.RecordBatch], v: Vocabulary, n: int, decoded: bool) -> Iterator[pa.RecordBatch]:
    encoder, decoder = Encoder(v), Decoder(v)
    kind = pa.list_(pa.struct([("score", pa.float64()), ("ids_sha256", pa.string())]))
    for b in batches:
        for at, to, _, _ in wordscan.slices(b.column("text"), _SLICE):
            found = encoder.encode([x or "" for x in b.column("text").slice(at, to - at).to_pylist()], n)
            ids = [paths[0][1] for paths in found]
            scores = [paths[0][0] for paths in found]
            best = [[{"score": s, "ids_sha256": digest(i)} for s, i in paths] for paths in found]
            off = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            columns = {"doc_id": b.column("doc_id").slice(at, to - at), "ids": pa.ListArray.from_arrays(pa.array(off), pa.array(flat)), "score": pa.array(scores, pa.float64()), "n_best": pa.array(best, kind)}
            if decoded:
                columns["decoded"] = pa.array([decoder.text(i) for i in ids], pa.string())
            yield pa.RecordBatch.from_pydict(columns)


class Decoder:
    """Texts from the pieces' ids."""

    def __init__(self, v: Vocabulary):
        value = {i: b for b, i in v.byte_id.items()}
        self.prefix = v.prefix
        self.pieces = [bytes([value[i]]) if i in value else name.replace(_MARK, " ").encode() for i, name in enumerate(v.names)]

    def text(self, ids: np.ndarray) -> str:
        x = b"".join(map(self.pieces.__getitem__, ids.tolist()))
        return (x[1:] if self.prefix and x[:1] == b" " else x).decode(errors="replace")


def _decode(batches: Iterator[pa.RecordBatch], v: Vocabulary) -> Iterator[pa.RecordBatch]:
    decoder = Decoder(v)
    for b in batches:
        ids = b.column("ids")
        text = [decoder.text(ids[row].values.to_numpy()) if ids[row].is_valid else "" for row in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*b.schema.names, "decoded"])


_ENCODED = "doc_id long, ids array<int>, score double, n_best array<struct<score: double, ids_sha256: string>>"


def _over(documents: DataFrame, model: str, n: int, decoded: bool) -> DataFrame:
    spark = documents.sparkSession
    runtime.ship(spark)
    v = spark.sparkContext.broadcast(Vocabulary.load(model))
    docs = runtime.pick(documents, doc_id="long", text="string")
    return docs.mapInArrow(lambda it: _rows(it, v.value, n, decoded), _ENCODED + ", decoded string" * decoded)


def encode(documents: DataFrame, *, model: str = MODEL, n: int = 3) -> DataFrame:
    """Every row: doc_id, ids (the best segmentation), score, n_best (score and digest of the ``n`` best)."""
    return _over(documents, model, n, False)


def round_trip(documents: DataFrame, *, model: str = MODEL, n: int = 3) -> DataFrame:
    """``decode(encode(documents))`` in one pass of one worker: ``decoded`` comes from the encoded ids alone."""
    return _over(documents, model, n, True)


def decode(encoded: DataFrame, *, model: str = MODEL) -> DataFrame:
    """``encode``'s rows with ``decoded``, the text of ``ids``."""
    spark = encoded.sparkSession
    runtime.ship(spark)
    v = spark.sparkContext.broadcast(Vocabulary.load(model))
    return encoded.select("doc_id", "ids", "score", "n_best").mapInArrow(lambda it: _decode(it, v.value), _ENCODED + ", decoded string")
