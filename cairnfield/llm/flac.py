"""Media columns: FLAC streams of 8-bit mono samples, many frames at a time in numpy.

A stream holds STREAMINFO, a SEEKTABLE with a point a frame, and frames of a fixed block size. The encoder chooses a
predictor a frame (constant, verbatim, fixed polynomials of order 0 to 4, or a quantised linear predictor from the
autocorrelation) and one Rice parameter. The decoder takes the frames that the seek table points at as lanes of a vector
and reads the Rice codes of all of them side by side, sample by sample; CRC-8 of headers, CRC-16 of frames and the stream's
MD5 are verified. Frames of another shape (several partitions, escape codes, long predictors, other block sizes) and
streams without a full seek table go through a plain decoder, frame by frame.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Samples in a frame, longest linear predictor and its coefficients' bits, and frames encoded or decoded at a time.
BLOCK, ORDER, PRECISION, LANES = 576, 8, 12, 4096
#: Fixed values of the format: generator polynomials, block size code of 576, fixed predictors, most points a table.
CRC8, CRC16, CODE_576, MAX_POINTS = 0x07, 0x8005, 2, 900_000
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


class FlacError(ValueError):
    """A stream that isn't FLAC, or one whose checksums differ."""


def _table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, (out << 1) ^ poly, out << 1) & ((1 << bits) - 1)
    return out


TABLE8, TABLE16 = _table(CRC8, 8), _table(CRC16, 16)


def crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """CRC of data[start : start + size] for every lane, a byte of all lanes at a time."""
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order], sizes[order]
    crc = np.zeros(len(starts), np.uint32)
    mask, up = np.uint32((1 << bits) - 1), np.uint32(bits - 8)
    live = len(at)
    for i in range(int(left[0]) if len(left) else 0):
        while live and left[live - 1] <= i:
            live -= 1
        c = crc[:live]
        crc[:live] = table[(c >> up) ^ data[at[:live] + i]] ^ ((c << np.uint32(8)) & mask)
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    """The frame number in the header's UTF-8-like code."""
    if n < 0x80:
        return bytes([n])
    size = 2
    while n >> (5 * size + 1):
        size += 1
    rest = [0x80 | (n >> (6 * i)) & 0x3F for i in reversed(range(size - 1))]
    return bytes([(0xFF << (8 - size)) & 0xFF | n >> (6 * (size - 1)), *rest])


def _predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, shift) of a linear predictor of ORDER for each row of samples: Levinson-Durbin in lanes.

    Sums are integers and the recursion works on each row alone, so a row's predictor doesn't depend on its company.
    """
    lags = np.stack([(x[:, : BLOCK - k] * x[:, k:]).sum(1, dtype=np.int64) for k in range(ORDER + 1)], 1).astype(np.float64)
    lags[:, 0] = lags[:, 0] * (1 + 1e-9) + 1e-9
    a, err = np.zeros((len(x), ORDER)), lags[:, 0].copy()
    for i in range(ORDER):
        acc = lags[:, i + 1].copy()
        for j in range(i):
            acc -= a[:, j] * lags[:, i - j]
        k = acc / err
        old = a[:, :i].copy()
        for j in range(i):
            a[:, j] = old[:, j] - k * old[:, i - 1 - j]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    top = np.abs(a).max(1)
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(np.maximum(top, 1e-6))).astype(np.int64) - 1, 0, 14)
    q = np.clip(np.rint(a * (1 << shift)[:, None]), -(1 << (PRECISION - 1)), (1 << (PRECISION - 1)) - 1).astype(np.int32)
    return q, shift.astype(np.int32)


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, n: int) -> None:
    for j in range(n):
        bits[at + j] = (values >> (n - 1 - j)) & 1


def _encode_block(x: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of the rows of samples x, numbered numbers."""
    n = len(x)
    # Predictors by the sum of absolute residuals.
    res, cost = [x], [np.abs(x).sum(1)]
    d = x
    for o in range(1, 5):
        d = d[:, 1:] - d[:, :-1]
        res.append(d)
        cost.append(np.abs(d).sum(1) + o * 8)
    coefs, shift = _predictors(x)
    pred = np.zeros((n, BLOCK - ORDER), np.int32)
    for j in range(ORDER):
        pred += coefs[:, j : j + 1] * x[:, ORDER - 1 - j : BLOCK - 1 - j]
    res.append(x[:, ORDER:] - (pred >> shift[:, None]))
    cost.append(np.abs(res[5]).sum(1) + ORDER * 16)
    kind = np.argmin(np.stack(cost, 1), 1)
    kind[(x == x[:, :1]).all(1)] = 6  # constant; 7 is verbatim
    # Rice parameters, exact sizes.
    param, body, coded = np.zeros(n, np.int64), np.zeros(n, np.int64), {}
    for t in range(6):
        rows = np.flatnonzero(kind == t)
        if not len(rows):
            continue
        r = res[t][rows]
        u = ((r << 1) ^ (r >> 31)).astype(np.int32)
        guess = np.clip(np.floor(np.log2(np.maximum(u.sum(1) / u.shape[1], 1))).astype(np.int64), 0, 14)
        best, size = guess, None
        for k in (guess - 1, guess, guess + 1):
            k = np.clip(k, 0, 14)
            s = (u >> k[:, None].astype(np.int32)).sum(1, dtype=np.int64) + u.shape[1] * (k + 1)
            better = np.ones(len(rows), bool) if size is None else s < size
            best, size = np.where(better, k, best), s if size is None else np.where(better, s, size)
        order = t if t < 5 else ORDER
        body[rows] = 8 + 8 * order + 10 + size + (9 + ORDER * PRECISION if t == 5 else 0)
        param[rows] = best
        coded[t] = rows, u
    body[kind == 6] = 16
    kind[body > 8 + 8 * BLOCK] = 7
    body[kind == 7] = 8 + 8 * BLOCK
    # Bytes of each frame, and a bit array for all.
    heads = [b"\xff\xf8" + bytes([CODE_576 << 4, 0x02]) + _coded_number(int(k)) for k in numbers]
    head = np.array([len(h) + 1 for h in heads], np.int64)
    size = head + (body + 7) // 8 + 2
    starts = np.concatenate([[0], np.cumsum(size)])
    bits = np.zeros(int(starts[-1]) * 8, np.uint8)
    at = (starts[:-1] + head) * 8
    kinds = np.array([8, 9, 10, 11, 12, 32 + ORDER - 1, 0, 1])[kind]
    _put(bits, at, kinds << 1, 8)
    at += 8
    for t, (rows, u) in coded.items():
        own = kind[rows] == t
        rows, u = rows[own], u[own]
        if not len(rows):
            continue
        order = t if t < 5 else ORDER
        for j in range(order):
            _put(bits, at[rows] + 8 * j, x[rows, j], 8)
        here = at[rows] + 8 * order
        if t == 5:
            _put(bits, here, np.full(len(rows), PRECISION - 1), 4)
            _put(bits, here + 4, shift[rows], 5)
            for j in range(ORDER):
                _put(bits, here + 9 + PRECISION * j, coefs[rows, j], PRECISION)
            here = here + 9 + PRECISION * ORDER
        _put(bits, here + 6, param[rows], 4)  # method 0 and partition order 0 before it
        here = here + 10
        for k in np.unique(param[rows]):
            same = param[rows] == k
            v = u[same]
            q = v >> np.int32(k)
            ends = np.cumsum(q.astype(np.int64) + (k + 1), 1) + here[same][:, None]
            _put(bits, (ends - (k + 1)).ravel(), ((v & np.int32((1 << k) - 1)) | np.int32(1 << k)).ravel(), int(k) + 1)
    rows = np.flatnonzero(kind == 6)
    _put(bits, at[rows], x[rows, 0], 8)
    rows = np.flatnonzero(kind == 7)
    if len(rows):
        _put(bits, (at[rows][:, None] + 8 * np.arange(BLOCK)).ravel(), x[rows].ravel(), 8)
    data = np.packbits(bits)
    whole = np.frombuffer(b"".join(heads), np.uint8)
    sizes = head - 1
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data[np.repeat(starts[:-1] - offsets, sizes) + np.arange(len(whole))] = whole
    data[starts[:-1] + sizes] = crcs(data, starts[:-1], sizes, TABLE8, 8)
    c = crcs(data, starts[:-1], size - 2, TABLE16, 16)
    data[starts[1:] - 2], data[starts[1:] - 1] = c >> 8, c & 255
    raw = data.tobytes()
    edges = starts.tolist()
    return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def encode(payloads: list[bytes], rate: int = 8000) -> list[bytes]:
    """A FLAC stream for each payload, whose length is a positive multiple of BLOCK; a sample is a byte less 128."""
    counts = [len(p) // BLOCK for p in payloads]
    if any(len(p) % BLOCK or not p for p in payloads):
        raise FlacError(f"a payload must be a positive multiple of {BLOCK} bytes")
    frames: list[bytes] = []
    number = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, np.int64)
    whole = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    for k in range(0, len(whole), LANES):
        frames += _encode_block(whole[k : k + LANES].astype(np.int32) - 128, number[k : k + LANES])
    out, at = [], 0
    for p, c in zip(payloads, counts, strict=True):
        own = frames[at : at + c]
        at += c
        sizes = [len(f) for f in own]
        signed = (np.frombuffer(p, np.uint8) ^ 128).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (rate << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        every = -(-c // MAX_POINTS)
        points = np.zeros(-(-c // every), np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        points["sample"] = np.arange(0, c, every) * BLOCK
        points["offset"] = np.concatenate([[0], np.cumsum(sizes)[:-1]])[::every]
        points["n"] = BLOCK
        seek = points.tobytes()
        out.append(b"".join([b"fLaC", bytes([0]), len(info).to_bytes(3, "big"), info, bytes([0x83]), len(seek).to_bytes(3, "big"), seek, *own]))
    return out


@dataclass
class Stream:
    """What a stream's metadata says; points are (sample, byte offset in data, samples)."""

    data: bytes
    block: int
    rate: int
    channels: int
    depth: int
    total: int
    md5: bytes
    audio: int
    points: list[tuple[int, int, int]] = field(default_factory=list)


def opened(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, out, table = 4, None, b""
    while True:
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind & 127 == 0:
            packed = int.from_bytes(body[10:18], "big")
            out = Stream(data, struct.unpack(">H", body[2:4])[0], packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1), body[18:34], 0)
        elif kind & 127 == 3:
            table = body
        at += 4 + size
        if kind & 128:
            break
    if out is None:
        raise FlacError("a stream without STREAMINFO")
    out.audio = at
    out.points = [(s, at + o, n) for s, o, n in struct.iter_unpack(">QQH", table) if s != (1 << 64) - 1]
    return out


class _Bits:
    """Reads a frame bit by bit, for the plain decoder."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        self.at += n
        return (int.from_bytes(self.data[a:b], "big") >> (8 * b - self.at)) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v - (1 << n) if n and v >> (n - 1) else v

    def zeros(self) -> int:
        n = 0
        while self.at >> 3 < len(self.data):
            rest = self.data[self.at >> 3] & (255 >> (self.at & 7))
            if rest:
                step = 8 - rest.bit_length() - (self.at & 7)
                self.at += step + 1
                return n + step
            n += 8 - (self.at & 7)
            self.at += 8 - (self.at & 7)
        raise FlacError("a frame that doesn't end")


def decode_frame(s: Stream, at: int) -> tuple[list[list[int]], int]:
    """(samples by channel, byte after the frame) of any frame whose channels are coded independently or as pairs."""
    b = _Bits(s.data, at)
    if b.take(14) != 0x3FFE:
        raise FlacError("no frame here")
    b.take(2)
    code, rate, channels, depth = b.take(4), b.take(4), b.take(4), b.take(3)
    b.take(1)
    first = b.take(8)
    for _ in range(max(0, 8 - (first ^ 255).bit_length() - 1)):
        b.take(8)
    n = 192 if code == 1 else 576 << (code - 2) if 2 <= code <= 5 else b.take(8) + 1 if code == 6 else b.take(16) + 1 if code == 7 else 256 << (code - 8)
    if rate in (12, 13, 14):
        b.take(8 if rate == 12 else 16)
    end = b.at >> 3
    if _crc(s.data[at:end], TABLE8, 8) != b.take(8):
        raise FlacError("a frame header whose CRC-8 differs")
    width = {0: s.depth, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[depth]
    side = {8: 1, 9: 0, 10: 1}.get(channels)
    out = [_subframe(b, n, width + (side == c)) for c in range(2 if side is not None else channels + 1)]
    b.at += -b.at % 8
    end = b.at >> 3
    if _crc(s.data[at:end], TABLE16, 16) != b.take(16):
        raise FlacError("a frame whose CRC-16 differs")
    if channels == 8:
        out[1] = [x - y for x, y in zip(*out, strict=True)]
    elif channels == 9:
        out[0] = [x + y for x, y in zip(*out, strict=True)]
    elif channels == 10:
        mid = [2 * x + (y & 1) for x, y in zip(*out, strict=True)]
        out = [[(m + y) >> 1 for m, y in zip(mid, out[1], strict=True)], [(m - y) >> 1 for m, y in zip(mid, out[1], strict=True)]]
    return out, b.at >> 3


def _crc(data: bytes, table: np.ndarray, bits: int) -> int:
    return int(crcs(np.frombuffer(data, np.uint8), np.zeros(1, np.int64), np.array([len(data)]), table, bits)[0])


def _subframe(b: _Bits, n: int, width: int) -> list[int]:
    b.take(1)
    kind, wasted = b.take(6), 0
    if b.take(1):
        wasted = b.zeros() + 1
    width -= wasted
    if kind == 0:
        out = [b.signed(width)] * n
    elif kind == 1:
        out = [b.signed(width) for _ in range(n)]
    else:
        if 8 <= kind <= 12:
            order = kind - 8
        elif kind >= 32:
            order = kind - 31
        else:
            raise FlacError("a reserved subframe type")
        out = [b.signed(width) for _ in range(order)]
        coefs, shift = FIXED[order] if kind < 32 else (), 0
        if kind >= 32:
            precision, shift = b.take(4) + 1, b.signed(5)
            coefs = tuple(b.signed(precision) for _ in range(order))
        wide = b.take(2)
        parts = 1 << b.take(4)
        for p in range(parts):
            k = b.take(5 if wide else 4)
            raw = b.take(5) if k == (31 if wide else 15) else None
            for _ in range(n // parts - (order if p == 0 else 0)):
                if raw is not None:
                    r = b.signed(raw)
                else:
                    q = b.zeros()
                    u = q << k | (b.take(k) if k else 0)
                    r = (u >> 1) ^ -(u & 1)
                out.append(r + (sum(c * x for c, x in zip(coefs, reversed(out), strict=False)) >> shift))
    return [x << wasted for x in out] if wasted else out


_ZEROS16 = (16 - np.ceil(np.log2(np.arange(1 << 16) + 1)).astype(np.int64)).astype(np.int64)


def _decode_block(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples of the frames data[at : at + size], which of them have the common shape); checksums are verified."""
    n = len(at)
    pad = np.concatenate([data, np.zeros(24, np.uint8)])
    window = np.zeros(len(data) + 8, np.uint64)
    for j in range(8):
        window |= pad[j : j + len(window)].astype(np.uint64) << np.uint64(56 - 8 * j)

    def peek(pos: np.ndarray) -> np.ndarray:
        return window[pos >> 3] << (pos & 7).astype(np.uint64)

    def take(pos: np.ndarray, width: int) -> np.ndarray:
        return (peek(pos) >> np.uint64(64 - width)).astype(np.int64)

    def signed(pos: np.ndarray, width: int) -> np.ndarray:
        v = take(pos, width)
        return np.where(v >> (width - 1), v - (1 << width), v)

    fine = (data[at] == 0xFF) & (data[at + 1] == 0xF8) & (data[at + 2] == CODE_576 << 4) & (data[at + 3] == 0x02)
    lead = data[at + 4].astype(np.int64)
    number = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0) + (lead >= 0xF8) + (lead >= 0xFC) + (lead >= 0xFE)
    if (crcs(data, at, 4 + number, TABLE8, 8) != data[at + 4 + number])[fine].any():
        raise FlacError("a frame header whose CRC-8 differs")
    c = crcs(data, at, sizes - 2, TABLE16, 16)
    if ((c >> 8 != data[at + sizes - 2]) | ((c & 255) != data[at + sizes - 1])).any():
        raise FlacError("a frame whose CRC-16 differs")
    pos = (at + 5 + number) * 8
    head = take(pos, 8)
    kind, pos = head >> 1, pos + 8
    fine &= (head & 0x81) == 0
    order = np.where((kind >= 8) & (kind <= 12), kind - 8, np.where(kind >= 32, kind - 31, 0))
    rice = (kind >= 8) & (kind <= 12) | (kind >= 32)
    fine &= (rice & (order <= ORDER)) | (kind <= 1)
    x = np.zeros((BLOCK + ORDER, n), np.int32)  # samples after ORDER rows of zeros
    for i in np.flatnonzero(fine & (kind == 0)):
        x[ORDER:, i] = signed(pos[i : i + 1], 8)
    plain = np.flatnonzero(fine & (kind == 1))
    if len(plain):
        x[ORDER:, plain] = data[(pos[plain] >> 3) + np.arange(BLOCK)[:, None]].view(np.int8)
    lanes = np.flatnonzero(fine & rice)
    if len(lanes):
        order, pos, kind = order[lanes], pos[lanes], kind[lanes]
        warm = [signed(pos + 8 * j, 8) for j in range(ORDER)]
        pos = pos + 8 * order
        coefs, shift = np.zeros((ORDER, len(lanes)), np.int32), np.zeros(len(lanes), np.int32)
        for o in range(5):
            for j, v in enumerate(FIXED[o]):
                coefs[j, kind == 8 + o] = v
        linear = kind >= 32
        if linear.any():
            precision = take(pos, 4) + 1
            shift = np.where(linear, signed(pos + 4, 5), 0).astype(np.int32)
            if (shift < 0).any():
                raise FlacError("a predictor that shifts left")
            for width in np.unique(precision[linear]):
                own = linear & (precision == width)
                for j in range(ORDER):
                    has = own & (order > j)
                    coefs[j, has] = signed(pos[has] + 9 + int(width) * j, int(width))
            pos = np.where(linear, pos + 9 + precision * order, pos)
        method, k = take(pos, 6), take(pos + 6, 4)
        usual = (method == 0) & (k < 15)
        fine[lanes[~usual]] = False
        lanes, order, pos, k, shift, coefs = lanes[usual], order[usual], pos[usual] + 10, k[usual], shift[usual], np.ascontiguousarray(coefs[:, usual])
        warm = [w[usual] for w in warm]
        y = np.zeros((BLOCK + ORDER, len(lanes)), np.int32)
        low = np.uint64(63) - k.astype(np.uint64)
        one = np.uint64(1)
        back = coefs[::-1]
        for i in range(BLOCK):
            w = peek(pos)
            q = _ZEROS16[(w >> np.uint64(48)).astype(np.int64)]
            long_run = q == 16
            while long_run.any():
                more = _ZEROS16[(peek(pos + q) >> np.uint64(48)).astype(np.int64)]
                q = np.where(long_run, q + more, q)
                long_run &= more == 16
                if (q > 1 << 20).any():
                    raise FlacError("a Rice code that doesn't end")
            after = pos + q + 1
            u = (q << k) | ((peek(after) >> low) >> one).astype(np.int64)
            r = ((u >> 1) ^ -(u & 1)).astype(np.int32)
            here = i + ORDER
            y[here] = r + (np.einsum("jf,jf->f", back, y[i:here]) >> shift)
            after += k
            if i < ORDER:
                early = order > i
                y[here] = np.where(early, warm[i], y[here])
                after = np.where(early, pos, after)
            pos = after
        x[:, lanes] = y
    return x[ORDER:].T, fine


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The samples (int8, mono) of each stream, all checksums and the MD5 verified."""
    parsed = [opened(s) for s in streams]
    out: list[np.ndarray | None] = [None] * len(streams)
    lanes: list[tuple[int, int, int, int]] = []  # stream, first sample, byte, bytes
    for i, s in enumerate(parsed):
        if s.channels != 1 or s.depth != 8:
            raise FlacError("a media column holds 8-bit mono streams")
        full = s.block == BLOCK and s.total % BLOCK == 0 and [p[0] for p in s.points] == list(range(0, s.total, BLOCK))
        if full:
            ends = [p[1] for p in s.points[1:]] + [len(s.data)]
            lanes += [(i, p[0], p[1], e - p[1]) for p, e in zip(s.points, ends, strict=True)]
            out[i] = np.zeros(s.total, np.int8)
        else:
            at, got = s.audio, []
            while at < len(s.data):
                samples, at = decode_frame(s, at)
                got += samples[0]
            out[i] = np.array(got, np.int8)
    for k in range(0, len(lanes), LANES):
        part = lanes[k : k + LANES]
        data = np.frombuffer(b"".join(parsed[i].data[a : a + n] for i, _, a, n in part), np.uint8)
        sizes = np.array([p[3] for p in part], np.int64)
        if (sizes < 9).any():
            raise FlacError("a seek table that doesn't fit the frames")
        samples, fine = _decode_block(data, np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        samples = samples.astype(np.int8)
        for j, (i, first, a, _) in enumerate(part):
            out[i][first : first + BLOCK] = samples[j] if fine[j] else np.array(decode_frame(parsed[i], a)[0][0], np.int8)
    for s, x in zip(parsed, out, strict=True):
        if hashlib.md5(x.tobytes()).digest() != s.md5 and any(s.md5):
            raise FlacError("samples whose MD5 differs")
    return out


def read_samples(stream: bytes, start: int, count: int) -> np.ndarray:
    """Samples start to start + count, from the seek point before them on: what lies before isn't decoded."""
    s = opened(stream)
    first, at, _ = max((p for p in s.points if p[0] <= start), default=(0, s.audio, 0))
    got: list[int] = []
    while first + len(got) < min(start + count, s.total):
        samples, at = decode_frame(s, at)
        got += samples[0]
    return np.array(got, np.int8)[start - first : start - first + count]


def padded(text: str | None) -> tuple[bytes, int]:
    """(payload, unpadded bytes): a text in UTF-8, null being empty, with bytes 255 up to a positive multiple of BLOCK."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (-len(data) % BLOCK if data else BLOCK), len(data)


def _batches(b: pa.RecordBatch, sizes: list[int], most: int = LANES * BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes each, so that memory doesn't follow a batch's rows."""
    start = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield b.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < b.num_rows:
        yield b.slice(start)


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) for every row of docs(doc_id, text): the text's bytes as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _batches(b, [len(t.as_buffer()) if t.is_valid else 0 for t in b.column(1)]):
                payloads = [padded(t) for t in part.column(1).to_pylist()]
                media = encode([p for p, _ in payloads])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in payloads], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


#: Columns of a table of blocks.
BLOCKS = "n_bytes bigint, media_bytes bigint, media_sha256 string, block bigint, sample_offset bigint, samples bigint, total bigint, pcm binary"


def to_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, BLOCKS) for every block of every row of media(doc_id, n_bytes, media), which is decoded and verified.

    pcm are the samples, 8 bits each with a sign, from sample_offset on; total is how many the stream has. Blocks of a
    row follow one another in order. Null media have no block; other columns are ignored.
    """
    names = ["doc_id", *(f.split()[0] for f in BLOCKS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _batches(b, [len(m.as_buffer()) if m.is_valid else 0 for m in b.column(2)]):
                rows = [r for r in range(part.num_rows) if part.column(2)[r].is_valid]
                streams = [part.column(2)[r].as_py() for r in rows]
                for r, m, x in zip(rows, streams, decode(streams), strict=True):
                    whole, offsets = x.tobytes(), np.arange(0, len(x), BLOCK)
                    n, one = len(offsets), pa.array([r] * len(offsets), pa.int64())
                    pcm = pa.array([whole[o : o + BLOCK] for o in offsets.tolist()], pa.binary())
                    same = [pa.array([v] * n, t) for v, t in ((len(m), pa.int64()), (hashlib.sha256(m).hexdigest(), pa.string()))]
                    columns = [part.column(0).take(one), part.column(1).take(one), *same, pa.array(np.arange(n)), pa.array(offsets), pa.array(np.minimum(len(x) - offsets, BLOCK)), pa.array(np.full(n, len(x))), pcm]
                    yield from _sliced(pa.RecordBatch.from_arrays(columns, names=names))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, {BLOCKS}")


def _sliced(b: pa.RecordBatch, rows: int = 8192) -> Iterator[pa.RecordBatch]:
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


class Features:
    """Peak, sum, energy and sign changes of samples that come block by block, all of them integers."""

    def __init__(self) -> None:
        self.peak = self.total = self.energy = self.changes = 0
        self.last: np.ndarray | None = None

    def add(self, x: np.ndarray) -> None:
        wide = x.astype(np.int64)
        self.peak = max(self.peak, int(np.abs(wide).max(initial=0)))
        self.total += int(wide.sum())
        self.energy += int(np.dot(wide, wide))
        below = (x if self.last is None else np.concatenate([self.last, x])) < 0
        self.changes += int(np.count_nonzero(below[1:] != below[:-1]))
        self.last = x[-1:]

    def __str__(self) -> str:
        return f"peak={self.peak};sum={self.total};energy={self.energy};changes={self.changes}"


def digests(blocks: DataFrame) -> DataFrame:
    """For every stream of to_blocks(media): payload, tail and media digests, and features, of the PCM blocks read back.

    A stream's blocks have to follow one another in a partition, as to_blocks() makes them: a stream ends where its
    samples reach its total.
    """
    import zlib

    kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, seen, tail, feature = hashlib.sha256(), 0, b"", Features()
        for b in batches:
            offset, samples, total = (b.column(k).to_numpy() for k in (5, 6, 7))
            ends = np.flatnonzero(offset + samples == total) + 1
            rows, which = [], []
            for x, y in zip([0, *ends.tolist()], [*ends.tolist(), b.num_rows], strict=True):
                if x == y:
                    continue
                if offset[x] != seen or (np.diff(offset[x:y]) != samples[x : y - 1]).any():
                    raise FlacError("blocks out of order")
                pcm = np.frombuffer(b"".join(p.as_buffer() for p in b.column(8).slice(x, y - x)), np.int8)
                payload = (pcm.view(np.uint8) ^ 128).tobytes()
                sha.update(payload)
                feature.add(pcm)
                seen, tail = seen + len(payload), (tail + payload)[-32:]
                if seen == total[y - 1]:
                    rows.append((b.column(1)[y - 1].as_py(), seen, sha.hexdigest(), zlib.crc32(tail), b.column(2)[y - 1].as_py(), b.column(3)[y - 1].as_py(), str(feature)))
                    which.append(y - 1)
                    sha, seen, tail, feature = hashlib.sha256(), 0, b"", Features()
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True))], names=["doc_id", *kinds])

    ids = blocks.schema["doc_id"].dataType.simpleString()
    return blocks.select("doc_id", *(f.split()[0] for f in BLOCKS.split(", "))).mapInArrow(run, f"doc_id {ids}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
