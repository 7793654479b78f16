"""FLAC media columns: encode byte payloads as 8-bit mono FLAC, and decode FLAC with all checks.

The decoder reads STREAMINFO and SEEKTABLE, then decodes many frames in step: at each step every
frame decodes its next Rice code, so numpy does the work whatever the number of streams. It
handles constant, verbatim, fixed and LPC subframes, partitioned Rice residuals of both codings,
escaped partitions and wasted bits, verifies each frame header's CRC-8 and frame's CRC-16, and the
stream's MD5. Frames start where the seek table says (every frame has a point in streams that
``encode`` writes); without one, frames are followed one after the other.

The format is the public one (RFC 9639); streams have one channel of up to 16 bits.

Defined cases: a null payload is empty; a null or damaged stream raises ``ValueError`` in
``decode_streams`` (``decode`` returns its message in ``error`` and nulls elsewhere); equal
payloads give equal streams; rows that repeat and further columns do not matter; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import runtime
from millrace.llm import wordscan

RATE = 8000
_BLOCK = 1024
_FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def _crc_table(poly: int, width: int, bits: int) -> np.ndarray:
    """Remainders of all ``bits``-bit inputs for a CRC of ``width`` bits."""
    r = np.arange(1 << bits, dtype=np.int64) << (width - bits)
    for _ in range(bits):
        r = np.where(r >> (width - 1) & 1, (r << 1) ^ poly, r << 1) & ((1 << width) - 1)
    return r


_CRC8 = _crc_table(0x07, 8, 8)
_CRC16 = _crc_table(0x8005, 16, 16)


def _crc16(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of each span, two bytes a step; zeros in front leave a CRC of 0 as it is."""
    crc = np.zeros(len(start), dtype=np.int64)
    if not len(start):
        return crc
    wide = np.concatenate((data.astype(np.uint16), [0, 0]))
    steps = int((end - start).max() + 1) // 2
    for t in range(steps, 0, -1):
        at = end - 2 * t
        here = np.flatnonzero(at + 1 >= start)
        p = at[here]
        hi = np.where(p >= start[here], wide[p], 0).astype(np.int64)
        crc[here] = _CRC16[crc[here] ^ (hi << 8 | wide[p + 1])]
    return crc


def _crc8(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(start), dtype=np.int64)
    for t in range(int(size.max(initial=0))):
        here = np.flatnonzero(size > t)
        crc[here] = _CRC8[crc[here] ^ data[start[here] + t]]
    return crc


def _number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the extended UTF-8 form: (bytes as n x 4, sizes)."""
    if n.max(initial=0) >= 1 << 21:
        raise ValueError("a stream has more than 2**21 frames")
    size = 1 + (n >= 0x80) + (n >= 0x800).astype(np.int64) + (n >= 0x10000)
    out = np.zeros((len(n), 4), dtype=np.uint8)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
    for j in range(4):
        here = size > j
        shift = 6 * (size - 1 - j)
        piece = n >> np.maximum(shift, 0)
        out[here, j] = (np.where(j == 0, lead | piece, 0x80 | (piece & 0x3F)))[here]
    return out, size


def encode_payloads(payloads: list[bytes], block: int = _BLOCK) -> list[bytes]:
    """One FLAC stream a payload (not empty, a multiple of 16 bytes); bytes are samples less 128."""
    if not payloads:
        return []
    lengths = np.array([len(p) for p in payloads], dtype=np.int64)
    s = np.frombuffer(b"".join(payloads), dtype=np.uint8).astype(np.int32) - 128
    per = -(-lengths // block)
    stream = np.repeat(np.arange(len(payloads)), per)
    number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    size = np.minimum(block, lengths[stream] - number * block)
    first = np.cumsum(size) - size
    t = np.arange(len(s)) - np.repeat(first, size)

    diffs = [s]
    for o in range(1, 5):
        d = diffs[-1].copy()
        d[1:] -= diffs[-1][:-1]
        diffs.append(d)
    cost = np.stack([np.add.reduceat(np.where(t >= 4, np.abs(d), 0), first) for d in diffs])
    order = cost.argmin(axis=0)
    same = np.maximum.reduceat(s, first) == np.minimum.reduceat(s, first)
    order[same] = 0
    o = np.repeat(order, size)
    r = diffs[0].copy()
    for j in range(1, 5):
        r = np.where(o == j, diffs[j], r)
    u = (r << 1) ^ (r >> 31)

    parts = np.where((size % 64 == 0) & (size >= 64), 4, 1)
    width = np.repeat(size // parts, size)
    edge = t % width == 0
    part = np.flatnonzero(edge)
    code = t >= o
    n = np.add.reduceat(code.astype(np.int64), part)
    mean = np.add.reduceat(np.where(code, u, 0).astype(np.int64), part) / np.maximum(n, 1)
    k0 = np.clip(np.floor(np.log2(np.maximum(mean, 1))).astype(np.int64), 0, 14)
    span = np.diff(np.append(part, len(s)))
    best, k = None, k0
    for guess in (k0, np.maximum(k0 - 1, 0), np.minimum(k0 + 1, 14)):
        bits = n * (guess + 1) + np.add.reduceat(np.where(code, u >> np.repeat(guess, span), 0).astype(np.int64), part)
        k = guess.copy() if best is None else np.where(bits < best, guess, k)
        best = bits if best is None else np.minimum(bits, best)
    k = np.repeat(k, span).astype(np.int32)

    plain = np.repeat(same, size)
    q = np.where(code, u >> k, 0)
    prefix = np.where(t == o, 10, 0) + np.where(edge & (t > 0), 4, 0)
    length = np.where(plain, np.where(t == 0, 8, 0), np.where(code, q + 1 + k, 8) + prefix).astype(np.int64)
    body = np.add.reduceat(length, first) + 8
    digits, digit_n = _number(number)
    usual = size == 1024
    extra = np.where(usual, 0, np.where(size <= 256, 1, 2))
    head = 4 + digit_n + extra + 1
    frame = head + (body + 7) // 8 + 2
    at = np.cumsum(frame) - frame
    total = int(frame.sum())

    bits = np.zeros(total * 8, dtype=np.uint8)
    begin = (at + head) * 8
    run = np.cumsum(length) - length
    pos = run - np.repeat(run[first], size) + np.repeat(begin + 8, size)
    kinds = np.where(same, 0, 8 + order)
    for j in range(6):
        bits[begin + 1 + j] = kinds >> (5 - j) & 1
    raw = np.flatnonzero((plain & (t == 0)) | (~plain & ~code))
    for j in range(8):
        bits[pos[raw] + j] = s[raw] >> (7 - j) & 1
    tag = np.flatnonzero(~plain & (t == o))
    quarter = np.repeat(parts == 4, size)[tag]
    bits[pos[tag] + 4] = quarter  # partition order 2 is 0010, after the coding's 00
    for sel, off in ((tag, 6), (np.flatnonzero(~plain & edge & (t > 0)), 0)):
        for j in range(4):
            bits[pos[sel] + off + j] = k[sel] >> (3 - j) & 1
    live = np.flatnonzero(~plain & code)
    p = pos[live] + prefix[live] + q[live]
    bits[p] = 1
    kk, uu = k[live], u[live]
    for j in range(int(kk.max(initial=0))):
        here = np.flatnonzero(kk > j)
        bits[p[here] + kk[here] - j] = uu[here] >> j & 1
    out = np.packbits(bits)
    del bits

    out[at], out[at + 1] = 0xFF, 0xF8
    out[at + 2] = np.where(usual, 0xA0, np.where(extra == 1, 0x60, 0x70))
    out[at + 3] = 0x02
    for j in range(4):
        here = digit_n > j
        out[at[here] + 4 + j] = digits[here, j]
    one, two = extra == 1, extra == 2
    out[at[one] + 4 + digit_n[one]] = size[one] - 1
    out[at[two] + 4 + digit_n[two]] = (size[two] - 1) >> 8
    out[at[two] + 5 + digit_n[two]] = (size[two] - 1) & 255
    out[at + head - 1] = _crc8(out, at, head - 1)
    crc = _crc16(out, at, at + frame - 2)
    out[at + frame - 2], out[at + frame - 1] = crc >> 8, crc & 255

    result = []
    bounds = np.concatenate(([0], np.cumsum(per)))
    for i, payload in enumerate(payloads):
        a, z = int(bounds[i]), int(bounds[i + 1])
        md5 = hashlib.md5((np.frombuffer(payload, dtype=np.uint8) ^ 0x80).tobytes()).digest()
        small = int(size[a:z].min()) if z - a == 1 else block
        info = struct.pack(">HHBHBHQ", small, max(small, int(size[a])), *_u24(frame[a:z].min()), *_u24(frame[a:z].max()), RATE << 44 | 0 << 41 | 7 << 36 | int(lengths[i])) + md5
        points = np.zeros(z - a, dtype=[("s", ">u8"), ("o", ">u8"), ("n", ">u2")])
        points["s"], points["o"], points["n"] = np.arange(z - a) * block, at[a:z] - at[a], size[a:z]
        table = points.tobytes()
        blocks = [(0, info)]
        for cut in range(0, len(table), 18 * 900_000):  # a metadata block has a 24-bit length
            blocks.append((3, table[cut : cut + 18 * 900_000]))
        meta = b"".join(struct.pack(">I", (1 << 31 if b is blocks[-1] else 0) | b[0] << 24 | len(b[1])) + b[1] for b in blocks)
        end = int(at[z - 1] + frame[z - 1])
        result.append(b"fLaC" + meta + out[at[a] : end].tobytes())
    return result


def _u24(n) -> tuple[int, int]:
    return int(n) >> 16, int(n) & 0xFFFF


class _Bits:
    """Big-endian bit reads at many places of one buffer."""

    def __init__(self, data: np.ndarray):
        d = np.concatenate((data, np.zeros(12, dtype=np.uint8)))
        n = len(data) + 4
        w = np.zeros(n, dtype=np.uint64)
        for j in range(8):
            w |= d[j : j + n].astype(np.uint64) << np.uint64(56 - 8 * j)
        self.w = w
        self.end = len(data) * 8
        one = np.unpackbits(data)
        at = np.where(one, np.arange(len(one), dtype=np.int32 if len(one) < 2**31 else np.int64), len(one)).astype(np.int32 if len(one) < 2**31 else np.int64)
        self.next_one = np.append(np.minimum.accumulate(at[::-1])[::-1], self.end) if len(at) else np.zeros(1, np.int64)

    def read(self, pos: np.ndarray, n) -> np.ndarray:
        """Up to 56 bits at each place; ``n`` may differ by place, and 0 bits are 0."""
        if len(pos) and int(pos.max()) > self.end:
            raise ValueError("a frame runs past the end of its stream")
        n = np.asarray(n, dtype=np.uint64)
        x = self.w[pos >> 3] << (pos & 7).astype(np.uint64)
        return np.where(n > 0, x >> (np.uint64(64) - np.maximum(n, np.uint64(1))), 0).astype(np.int64)

    def signed(self, pos: np.ndarray, n) -> np.ndarray:
        v, n = self.read(pos, n), np.asarray(n, dtype=np.int64)
        return np.where((n > 0) & (v >> np.maximum(n - 1, 0) & 1 > 0), v - (1 << n), v)


def _frames(data: np.ndarray, bits: _Bits, at: np.ndarray, depth: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Decode the frames at these bytes in step: (samples as t x frame, sizes, end bytes, frame numbers)."""
    pad = np.concatenate((data, np.zeros(20, dtype=np.uint8)))
    if (pad[at] != 0xFF).any() or (pad[at + 1] & 0xFE != 0xF8).any():
        raise ValueError("a frame doesn't start with the sync code")
    code, rate = pad[at + 2] >> 4, pad[at + 2] & 15
    if (pad[at + 3] >> 4 != 0).any():
        raise ValueError("only streams of one channel are supported")
    lead = pad[at + 4].astype(np.int64)
    digits = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    number = np.where(digits == 1, lead, lead & (0x7F >> digits))
    for j in range(1, 7):
        number = np.where(digits > j, number << 6 | (pad[at + 4 + j] & 0x3F), number)
    e = at + 4 + digits
    size = np.select([code == 1, (code >= 2) & (code <= 5), code == 6, code == 7], [192, 576 << np.maximum(code.astype(np.int64) - 2, 0), pad[e].astype(np.int64) + 1, (pad[e].astype(np.int64) << 8 | pad[e + 1]) + 1], 256 << np.maximum(code.astype(np.int64) - 8, 0))
    head = 4 + digits + np.select([code == 6, code == 7], [1, 2], 0) + np.select([rate == 12, rate >= 13], [1, 2], 0) + 1
    if (_crc8(pad, at, head - 1) != pad[at + head - 1]).any():
        raise ValueError("a frame header's CRC-8 is wrong")
    coded = pad[at + 3] >> 1 & 7
    bps = np.where(coded == 0, depth, np.array([0, 8, 12, 0, 16, 20, 24, 32])[coded])

    pos = (at + head) * 8
    tag = bits.read(pos, 8)
    kind = tag >> 1 & 63
    pos = pos + 8
    wasted = np.zeros(len(at), dtype=np.int64)
    if (has := (tag & 1) > 0).any():
        wasted[has] = bits.next_one[pos[has]] - pos[has] + 1
        pos = pos + wasted
    bps = bps - wasted
    order = np.select([(kind >= 8) & (kind <= 12), kind >= 32], [kind - 8, kind - 31], 0)
    if ((kind > 1) & (kind < 8) | (kind > 12) & (kind < 32)).any():
        raise ValueError("a subframe has a reserved type")
    longest = int(size.max(initial=0))
    out = np.zeros((longest, len(at)), dtype=np.int32)
    flat, verbatim = kind == 0, kind == 1
    if flat.any():
        out[:, flat] = bits.signed(pos[flat], bps[flat])[None, :]
        pos = np.where(flat, pos + bps, pos)
    for t in range(int(size[verbatim].max(initial=0))):
        here = np.flatnonzero(verbatim & (size > t))
        out[t, here] = bits.signed(pos[here], bps[here])
        pos[here] += bps[here]
    coded = ~(flat | verbatim)
    for t in range(int(order[coded].max(initial=0))):
        here = np.flatnonzero(coded & (order > t))
        out[t, here] = bits.signed(pos[here], bps[here])
        pos[here] += bps[here]
    taps = np.zeros((32, len(at)), dtype=np.int64)
    shift = np.zeros(len(at), dtype=np.int64)
    if (lpc := kind >= 32).any():
        here = np.flatnonzero(lpc)
        precision = bits.read(pos[here], 4) + 1
        shift[here] = bits.signed(pos[here] + 4, 5)
        pos[here] += 9
        for j in range(int(order[here].max())):
            mine = order[here] > j
            taps[j, here[mine]] = bits.signed(pos[here[mine]], precision[mine])
            pos[here[mine]] += precision[mine]
    _residuals(bits, out, pos, size, order, np.flatnonzero(coded))
    _restore(out, order, taps, shift, coded & ~lpc, lpc)
    out <<= wasted[None, :].astype(np.int32)
    end = (pos + 7) // 8
    if (end + 2 > limit).any():
        raise ValueError("a frame runs past the end of its stream")
    if (_crc16(pad, at, end) != (pad[end].astype(np.int64) << 8 | pad[end + 1])).any():
        raise ValueError("a frame's CRC-16 is wrong")
    return out, size, end + 2, number


def _residuals(bits: _Bits, out: np.ndarray, pos: np.ndarray, size: np.ndarray, order: np.ndarray, who: np.ndarray) -> None:
    """Rice codes of the frames ``who``, one of each frame a step, into ``out``; moves ``pos``."""
    if not len(who):
        return
    who = who[np.argsort(-size[who], kind="stable")]
    p = pos[who]
    method, parts = bits.read(p, 2), bits.read(p + 2, 4)
    if (method > 1).any():
        raise ValueError("a residual has a reserved coding")
    p = p + 6
    wide = 4 + method
    n, o = size[who], order[who]
    step = n >> parts
    k = np.zeros(len(who), dtype=np.int64)
    raw = np.zeros(len(who), dtype=bool)
    due = o.copy()
    active = len(who)
    stops = np.searchsorted(-n, -np.arange(int(n[0]) + 1), "left")  # frames longer than t come first
    word, next_one = bits.w, bits.next_one
    u64 = np.uint64
    drop = np.full(len(who), 64, dtype=np.uint64)
    simple = True
    for t in range(int(o.min()), int(n[0])):
        active = int(stops[t])
        if (new := due[:active] == t).any():
            i = np.flatnonzero(new)
            got = bits.read(p[i], wide[i])
            p[i] += wide[i]
            raw[i] = got == (1 << wide[i]) - 1
            if (esc := i[raw[i]]).size:
                k[esc] = bits.read(p[esc], 5)
                p[esc] += 5
            k[i[~raw[i]]] = got[~raw[i]]
            drop[i] = (64 - k[i]).astype(np.uint64)
            due[i] = (t // step[i] + 1) * step[i]
            simple = not raw.any() and int(k.max()) > 0 and (k > 0).all()
        if int(p[:active].max()) > bits.end:
            raise ValueError("a frame runs past the end of its stream")
        if simple and t >= int(o[:active].max(initial=0)):
            one = next_one[p[:active]]
            a = one + 1
            low = word[a >> 3] << (a & 7).astype(u64) >> drop[:active]
            u = (one - p[:active]) << k[:active] | low.astype(np.int64)
            out[t, who[:active]] = (u >> 1) ^ -(u & 1)
            p[:active] = a + k[:active]
            continue
        live = np.flatnonzero(o[:active] <= t)
        rice, esc = live[~raw[live]], live[raw[live]]
        one = next_one[p[rice]].astype(np.int64)
        u = (one - p[rice]) << k[rice] | bits.read(one + 1, k[rice])
        out[t, who[rice]] = (u >> 1) ^ -(u & 1)
        p[rice] = one + 1 + k[rice]
        if esc.size:
            out[t, who[esc]] = bits.signed(p[esc], k[esc])
            p[esc] += k[esc]
    pos[who] = p


def _restore(out: np.ndarray, order: np.ndarray, taps: np.ndarray, shift: np.ndarray, fixed: np.ndarray, lpc: np.ndarray) -> None:
    for o in range(1, 5):
        here = np.flatnonzero(fixed & (order == o))
        if not len(here):
            continue
        x = out[:, here].astype(np.int64)
        warm = x[:o].copy()
        for j in range(o - 1, -1, -1):
            x[j] = np.diff(warm, n=j, axis=0)[0]
            x[j:] = np.cumsum(x[j:], axis=0)
        out[:, here] = x
    if lpc.any():
        here = np.flatnonzero(lpc)
        x = out[:, here].astype(np.int64)
        most, o = int(order[here].max()), order[here]
        for t in range(1, len(x)):
            sum_ = np.zeros(len(here), dtype=np.int64)
            for j in range(min(most, t)):
                sum_ += taps[j, here] * x[t - 1 - j]
            x[t] += np.where(t >= o, sum_ >> shift[here], 0)
        out[:, here] = x


def _stream_head(media: bytes) -> tuple[dict, int, np.ndarray]:
    """(STREAMINFO, byte of the first frame, seek points' offsets)."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, points, last = 4, None, [], False
    while not last:
        if at + 4 > len(media):
            raise ValueError("the metadata is cut off")
        h = int.from_bytes(media[at : at + 4], "big")
        last, kind, n = h >> 31 == 1, h >> 24 & 127, h & 0xFFFFFF
        body = media[at + 4 : at + 4 + n]
        if kind == 0:
            x = int.from_bytes(body[10:18], "big")
            info = {"rate": x >> 44, "channels": (x >> 41 & 7) + 1, "depth": (x >> 36 & 31) + 1, "samples": x & (1 << 36) - 1, "md5": bytes(body[18:34]), "block": int.from_bytes(body[2:4], "big")}
        elif kind == 3:
            p = np.frombuffer(body, dtype=[("s", ">u8"), ("o", ">u8"), ("n", ">u2")])
            points.append(p[p["s"] != 2**64 - 1])
        at += 4 + n
    if info is None:
        raise ValueError("STREAMINFO is missing")
    if info["channels"] != 1 or info["depth"] > 16:
        raise ValueError("only one channel of up to 16 bits is supported")
    return info, at, np.concatenate(points) if points else np.zeros(0, dtype=[("s", ">u8"), ("o", ">u8"), ("n", ">u2")])


def decode_streams(streams: list[bytes]) -> list[dict]:
    """Decode and verify: of each stream, samples (int32), depth, and its blocks' first samples and bytes."""
    heads = [_stream_head(m) for m in streams]
    data = np.frombuffer(b"".join(streams), dtype=np.uint8)
    base = np.cumsum([0, *map(len, streams)])
    bits = _Bits(data)
    found: list[list] = [[] for _ in streams]
    todo: list[tuple[int, int]] = []
    chains = []
    for i, (info, at, points) in enumerate(heads):
        if info["samples"] and int(points["n"].astype(np.int64).sum()) == info["samples"] and (points["s"].astype(np.int64) == np.cumsum(points["n"].astype(np.int64)) - points["n"]).all():
            todo += [(i, int(base[i] + at + o)) for o in points["o"].tolist()]
        elif base[i] + at < base[i + 1]:
            chains.append((i, int(base[i] + at)))
    while todo or chains:
        todo += chains
        following = {i for i, _ in chains}
        who = np.array([i for i, _ in todo])
        at = np.array([a for _, a in todo])
        depth = np.array([heads[i][0]["depth"] for i in who])
        if (at + 10 > base[who + 1]).any():
            raise ValueError("a frame runs past the end of its stream")
        x, size, end, number = _frames(data, bits, at, depth, base[who + 1])
        chains = []
        for f, i in enumerate(who.tolist()):
            found[i].append((int(at[f] - base[i]), int(end[f] - base[i]), x[: size[f], f], int(number[f])))
            if i in following and end[f] < base[i + 1]:
                chains.append((i, int(end[f])))
        todo = []
    out = []
    for (info, first, _), frames, media in zip(heads, found, streams, strict=True):
        at = first
        for n, (a, z, _, number) in enumerate(frames):
            if a != at or number != n:
                raise ValueError("frames don't follow each other")
            at = z
        samples = np.concatenate([f[2] for f in frames]) if frames else np.zeros(0, np.int32)
        if at != len(media) or info["samples"] not in (0, len(samples)):
            raise ValueError("the stream's length doesn't match")
        raw = samples.astype(np.int8 if info["depth"] <= 8 else "<i2").tobytes()
        if info["md5"] != bytes(16) and hashlib.md5(raw).digest() != info["md5"]:
            raise ValueError("the stream's MD5 is wrong")
        sizes = [len(f[2]) for f in frames]
        out.append({"samples": samples, "depth": info["depth"], "rate": info["rate"], "first": np.cumsum([0, *sizes])[:-1].tolist(), "sizes": sizes, "offsets": [f[0] for f in frames]})
    return out


def feature(samples: np.ndarray) -> str:
    """Mean, RMS, zero-crossing rate and mean step of the samples, as text."""
    x = samples.astype(np.float64)
    cross = np.count_nonzero((samples[1:] >= 0) != (samples[:-1] >= 0)) / max(1, len(x) - 1)
    step = np.abs(np.diff(samples)).mean() if len(x) > 1 else 0.0
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};zcr={cross:.4f};step={step:.4f}" if len(x) else "empty"


def _encode(batches: Iterator[pa.RecordBatch], unit: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, to, data, offsets in wordscan.slices(b.column("payload"), 1 << 20):
            n = np.diff(offsets)
            raw = data.tobytes()
            size = np.maximum(-(-n // unit), 1) * unit
            padded = [raw[s : s + k] + bytes(z - k) for s, k, z in zip(offsets[:-1].tolist(), n.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, to - at), pa.array(n, pa.int64()), pa.array(encode_payloads(padded), pa.binary())], names=["doc_id", "n_bytes", "media"])


def _decoded(media: list) -> list[dict]:
    try:
        return decode_streams(media)
    except (ValueError, IndexError, TypeError) as e:
        if len(media) == 1:
            return [{"error": str(e) or type(e).__name__}]
        return [x for m in media for x in _decoded([m])]


def _decode(batches: Iterator[pa.RecordBatch], blocks: bool) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("first_sample", pa.int64()), ("n_samples", pa.int32()), ("byte_offset", pa.int64()), ("pcm", pa.binary())]))
    for b in batches:
        for at, to, data, offsets in wordscan.slices(b.column("media"), 1 << 20):
            raw, valid = data.tobytes(), b.column("media").slice(at, to - at).is_valid().to_pylist()
            media = [raw[s:e] if ok else None for s, e, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), valid, strict=True)]
            cols: list[list] = [[] for _ in range(7)]
            for m, x in zip(media, _decoded(media), strict=True):
                if "error" in x:
                    row = (None, None, None, None, None, x["error"], None)
                else:
                    s = x["samples"]
                    pcm = (s + 128).astype(np.uint8).tobytes() if x["depth"] <= 8 else s.astype("<i2").tobytes()
                    w = 1 if x["depth"] <= 8 else 2
                    parts = [{"first_sample": f, "n_samples": n, "byte_offset": o, "pcm": pcm[f * w : (f + n) * w]} for f, n, o in zip(x["first"], x["sizes"], x["offsets"], strict=True)] if blocks else None
                    row = (len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-64:]), hashlib.sha256(m).hexdigest(), feature(s), None, parts)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), kind]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature", "error", "blocks"]
            keep = [b.column(c).slice(at, to - at) for c in ("doc_id", "n_bytes")]
            size = pa.array([None if m is None else len(m) for m in media], pa.int64())
            yield pa.RecordBatch.from_arrays([*keep, size, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_bytes", "media_bytes", *names])


def encode(rows: DataFrame, *, payload: str = "payload", unit: int = 64) -> DataFrame:
    """doc_id, n_bytes and media: the FLAC stream of each payload, with zeros up to a positive multiple of ``unit``."""
    runtime.ship(rows.sparkSession)
    picked = runtime.pick(rows, doc_id="long", **{payload: "binary"}).select("doc_id", F.coalesce(payload, F.lit(b"")).alias("payload"))
    return picked.mapInArrow(lambda it: _encode(it, unit), "doc_id long, n_bytes long, media binary")


def decode(rows: DataFrame, *, blocks: bool = True) -> DataFrame:
    """Decode and verify ``media``; with ``blocks``, PCM blocks with their sample and byte offsets."""
    runtime.ship(rows.sparkSession)
    picked = runtime.pick(rows, doc_id="long", n_bytes="long", media="binary")
    kind = "array<struct<first_sample: long, n_samples: int, byte_offset: long, pcm: binary>>"
    return picked.mapInArrow(lambda it: _decode(it, blocks), f"doc_id long, n_bytes long, media_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string, error string, blocks {kind}")


def write_pcm(rows: DataFrame, path: str) -> None:
    """Write the PCM blocks of ``media`` as rows (doc_id, first_sample, n_samples, byte_offset, pcm)."""
    decode(rows).where("error is null").select("doc_id", F.inline("blocks")).write.mode("overwrite").parquet(path)
