"""Words of whole texts as numpy arrays, straight from Arrow's UTF-8 buffers.

A batch of texts is one byte buffer with offsets. Separators are ASCII bytes, which never occur
inside a multi-byte character, so words are found and hashed bytewise without decoding. Slices
of at most ``SLICE`` bytes bound memory; a longer text is a slice of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 2 << 20
_POW_N = 4096
_U = np.uint64


def _mix_scalar(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ (x >> 31)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64 finaliser: a bijection of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x + _U((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BASE = _mix_scalar(77) & ~7 | 3
_LUT = np.array([_mix_scalar(i * 7919 + 1) for i in range(256)], dtype=_U)
_LOW = np.arange(256)
_LOW[65:91] += 32
_LUT_LOW = _LUT[_LOW]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=_U)
    x = 1
    for i in range(n):
        out[i] = x
        x = x * base & (2**64 - 1)
    return out


_POW = _powers(_BASE, _POW_N)
_POW_BLOCK = _powers(pow(_BASE, _POW_N, 2**64) ^ 0x10, 1 << 14)

#: Bytes of ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
ALNUM = np.ones(256, dtype=bool)
ALNUM[:0x80] = False
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


@dataclass
class Words:
    """All words of a slice. ``first[d]:first[d + 1]`` are the words of its text ``d``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; a null is an empty text."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = text.fill_null("")
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    _, off, data = text.buffers()
    n = len(text)
    if n == 0 or off is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    o = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(text: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts with at most ``most`` bytes, or one text."""
    data, off = buffers(text)
    n, at = len(off) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, to, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def scan(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool) -> Words:
    n = len(data)
    inside = kind[data]
    before = np.zeros(n, dtype=bool)
    after = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before[edge] = False
    after[edge - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, start, end, doc, first, _hash(data, inside, start, end, lower))


def _hash(data: np.ndarray, inside: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    if not len(start):
        return np.zeros(0, dtype=_U)
    size = end - start
    at = np.zeros(len(start), dtype=np.int64)
    np.cumsum(size[:-1], out=at[1:])
    with np.errstate(over="ignore"):
        value = (_LUT_LOW if lower else _LUT)[data[inside]]
        place = np.arange(len(value), dtype=np.int32) if len(value) < 2**31 else np.arange(len(value))
        place -= np.repeat(at, size).astype(place.dtype)
        if size.max() < _POW_N:
            value *= _POW[place]
        else:
            value *= _POW[place & (_POW_N - 1)] * _POW_BLOCK[(place >> 12) & ((1 << 14) - 1)]
        return mix(np.add.reduceat(value, at) + size.astype(_U))


def grams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` words by its first word; the last ``n - 1`` places are left out."""
    base = _mix_scalar(1000 + seed) & ~7 | 3
    if len(hashes) < n:
        return np.zeros(0, dtype=_U)
    with np.errstate(over="ignore"):
        part, width, out, done, left = hashes, 1, None, 0, n
        while left:
            if left & 1:
                piece = part[done : len(hashes) - width + 1]
                if out is None:
                    out = piece.copy()
                else:
                    piece = piece[: len(hashes) - (done + width) + 1]
                    out = out[: len(piece)] + _U(pow(base, done, 2**64)) * piece
                done += width
            left >>= 1
            if left:
                part = part[: len(part) - width] + _U(pow(base, width, 2**64)) * part[width:]
                width *= 2
        return mix(out[: len(hashes) - n + 1], seed)


def whole(words: Words, n: int) -> np.ndarray:
    """True where a run of ``n`` words lies in one text."""
    if len(words.doc) < n:
        return np.zeros(0, dtype=bool)
    return words.doc[: len(words.doc) - n + 1] == words.doc[n - 1 :]
