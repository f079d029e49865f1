"""FLAC, written and read in numpy with frames as lanes.

Reading goes through all frames of a batch at once: a step reads the next
Rice code of every frame, whatever stream it is in, so a batch takes as many
steps as a frame has samples. At most ``LANES`` frames go together, on either
way, so a long stream needs memory for its samples and little more. Frames are found by the seek table if it names
every frame, else one after the other. Every frame's CRC-8 and CRC-16 and
every stream's MD5 are verified. Writing takes, for each frame, the least of a
constant, verbatim, fixed predictors and a fitted linear predictor.

Readable: 1 to 8 channels, 4 to 24 bits, fixed or variable blocks, all
predictors, both Rice forms with partitions and escapes, wasted bits. Written:
one channel of 8-bit samples.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np

#: Fixed values of the format: block sizes and sample sizes by code.
BLOCK_CODES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
BIT_CODES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
#: What is written: samples a frame, rate, predictor order and precision.
BLOCK, RATE, RATE_CODE, LPC_ORDER, LPC_BITS = 1152, 8000, 4, 4, 10
#: Frames that are worked on together.
LANES = 4096
_DIFFERENCES = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}


class FlacError(ValueError):
    pass


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, (out << 1) ^ poly, out << 1) & ((1 << bits) - 1)
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CRC8 = CRC8.tolist()


def crc8(raw: bytes) -> int:
    out = 0
    for x in raw:
        out = _CRC8[out ^ x]
    return out


_far = np.zeros((0, 256), np.uint16)


def crc16(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of many runs of bytes. The sum is linear, so it is the XOR of
    what each byte gives at its distance from its run's end."""
    global _far
    most = int(sizes.max(initial=0))
    if most > len(_far):
        rows = [CRC16]
        while len(rows) < most:
            last = rows[-1]
            rows.append(((last << 8) & 0xFFFF) ^ CRC16[last >> 8])
        _far = np.array(rows, np.uint16)
    ends = np.cumsum(sizes)
    first = ends - sizes
    at = np.arange(int(ends[-1]))
    inside = at - np.repeat(first, sizes)
    byte = data[np.repeat(starts, sizes) + inside]
    away = np.repeat(sizes, sizes) - 1 - inside
    return np.bitwise_xor.reduceat(_far.reshape(-1)[away * 256 + byte], first).astype(np.int64)


# ---------------------------------------------------------------- writing


def _fold(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _rice(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best Rice parameter of each row, of three around the one that the
    mean suggests, and the bits its codes take."""
    near = np.clip(np.floor(np.log2(np.maximum(u.mean(1) * 0.6931, 1e-9))), 0, 14).astype(np.int32)
    tried = np.clip(near + np.array([[-1], [0], [1]], np.int32), 0, 14)
    bits = np.stack([(u >> k[:, None]).sum(1, dtype=np.int64) + u.shape[1] * (1 + k.astype(np.int64)) for k in tried])
    best = bits.argmin(0), np.arange(len(u))
    return tried[best], bits[best]


def _fit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients of a linear predictor of each row, and shifts."""
    f = x.astype(np.float64)
    n = f.shape[1]
    auto = np.stack([np.einsum("ij,ij->i", f[:, : n - lag], f[:, lag:]) for lag in range(LPC_ORDER + 1)], 1)
    error, a = auto[:, 0] * (1 + 1e-9) + 1e-9, np.zeros((len(x), LPC_ORDER))
    for i in range(LPC_ORDER):
        k = (auto[:, i + 1] - (a[:, :i] * auto[:, i:0:-1]).sum(1)) / error
        a[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error = error * (1 - k * k) + 1e-12
    top = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.clip(LPC_BITS - 2 - np.ceil(np.log2(top)), 0, 15).astype(np.int32)
    most = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.rint(a * (1 << shift.astype(np.int64))[:, None]), -most, most).astype(np.int32), shift


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, n: int) -> None:
    for j in range(n):
        bits[at + j] = (value >> (n - 1 - j)) & 1


def _number(n: int) -> bytes:
    """A frame number as FLAC writes it: UTF-8 carried on to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 6
    while n >= 1 << room:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        room -= 1
    return bytes([(0xFF << (room + 1)) & 0xFF | n, *tail[::-1]])


def _subframes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits (one a byte) of a subframe for each row of samples, rows one after
    the other and each filled up to a whole byte, and the rows' bytes."""
    rows, n = x.shape
    x = x.astype(np.int32)
    residuals, kinds = [], []
    r = x
    for order in range(3):
        residuals.append(_fold(r))
        kinds.append(0b001000 | order)
        r = r[:, 1:] - r[:, :-1]
    coefs, shift = _fit(x)
    predicted = np.zeros((rows, n - LPC_ORDER), np.int32)
    for j in range(LPC_ORDER):
        predicted += coefs[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : n - 1 - j]
    residuals.append(_fold(x[:, LPC_ORDER:] - (predicted >> shift[:, None])))
    kinds.append(0b100000 | (LPC_ORDER - 1))
    heads = [8 + 8 * o + 10 for o in range(3)] + [8 + 8 * LPC_ORDER + 9 + LPC_ORDER * LPC_BITS + 10]
    params, costs = zip(*(_rice(u) for u in residuals), strict=True)
    cost = np.stack([c + h for c, h in zip(costs, heads, strict=True)] + [np.full(rows, 8 + 8 * n), np.where((x == x[:, :1]).all(1), 16, 1 << 40)], 1)
    best = cost.argmin(1)
    sizes = -(-cost[np.arange(rows), best] // 8)
    base = 8 * np.concatenate(([0], np.cumsum(sizes)[:-1]))
    bits = np.zeros(8 * int(sizes.sum()), np.uint8)
    for b in np.unique(best).tolist():
        of = np.flatnonzero(best == b)
        at = base[of].copy()
        if b >= 4:  # verbatim, constant
            _put(bits, at, np.full(len(of), (5 - b) << 1), 8)
            raw = (x[of] if b == 4 else x[of, :1]) & 0xFF
            _put(bits, (at[:, None] + 8 + 8 * np.arange(raw.shape[1])).ravel(), raw.ravel(), 8)
            continue
        order = b if b < 3 else LPC_ORDER
        _put(bits, at, np.full(len(of), kinds[b] << 1), 8)
        at += 8
        for j in range(order):
            _put(bits, at, x[of, j] & 0xFF, 8)
            at += 8
        if b == 3:
            _put(bits, at, np.full(len(of), LPC_BITS - 1), 4)
            _put(bits, at + 4, shift[of], 5)
            at += 9
            for j in range(LPC_ORDER):
                _put(bits, at, coefs[of, j], LPC_BITS)
                at += LPC_BITS
        k, u = params[b][of], residuals[b][of]
        _put(bits, at, k, 10)  # method 0, one partition, its parameter
        at += 10
        unary = u >> k[:, None]
        width = unary + (1 + k)[:, None]
        stop = at[:, None] + np.cumsum(width, 1, dtype=np.int64) - (1 + k)[:, None]
        bits[stop.ravel()] = 1
        for j in range(int(k.max(initial=0))):
            live = k > j
            low = u[live] >> (k[live] - 1 - j)[:, None] & 1
            bits[(stop[live] + 1 + j).ravel()] = low.ravel()
    return bits, sizes


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload; its bytes are samples of offset 128. Sizes
    are positive multiples of 192 bytes."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    samples = (data ^ 0x80).view(np.int8)
    lengths = np.fromiter(map(len, payloads), np.int64, len(payloads))
    firsts = np.cumsum(lengths) - lengths
    counts = -(-lengths // BLOCK)
    frame_of = np.repeat(np.arange(len(payloads)), counts)
    number = np.arange(len(frame_of)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = firsts[frame_of] + number * BLOCK
    size = np.minimum(BLOCK, lengths[frame_of] - number * BLOCK)
    bodies: list = [None] * len(frame_of)
    for n in np.unique(size).tolist():
        alike = np.flatnonzero(size == n)
        for lo in range(0, len(alike), LANES):
            of = alike[lo : lo + LANES]
            bits, sizes = _subframes(samples[at[of, None] + np.arange(n)])
            packed = np.packbits(bits).tobytes()
            ends = np.cumsum(sizes).tolist()
            for f, a, b in zip(of.tolist(), [0, *ends[:-1]], ends, strict=True):
                bodies[f] = packed[a:b]
    heads = []
    for i, n in zip(number.tolist(), size.tolist(), strict=True):
        code = next((c for c, s in BLOCK_CODES.items() if s == n), 7)
        head = bytes([0xFF, 0xF8, code << 4 | RATE_CODE, 1 << 1]) + _number(i) + (struct.pack(">H", n - 1) if code == 7 else b"")
        heads.append(head + bytes([crc8(head)]))
    frames = [h + b for h, b in zip(heads, bodies, strict=True)]
    for lo in range(0, len(frames), LANES):
        own = frames[lo : lo + LANES]
        spans = np.fromiter(map(len, own), np.int64, len(own))
        sums = crc16(np.frombuffer(b"".join(own), np.uint8), np.cumsum(spans) - spans, spans).tolist()
        frames[lo : lo + LANES] = [f + struct.pack(">H", c) for f, c in zip(own, sums, strict=True)]
    out, f = [], 0
    for payload, first, count in zip(payloads, firsts.tolist(), counts.tolist(), strict=True):
        own = frames[f : f + count]
        f += count
        widths = [len(x) for x in own]
        pcm = samples[first : first + len(payload)].tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + min(widths).to_bytes(3) + max(widths).to_bytes(3) + (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8) + hashlib.md5(pcm, usedforsecurity=False).digest()
        points, offset = [], 0
        for k, w in enumerate(widths):
            points.append(struct.pack(">QQH", k * BLOCK, offset, min(BLOCK, len(payload) - k * BLOCK)))
            offset += w
        table = b"".join(points)
        out.append(b"fLaC" + bytes([0]) + len(info).to_bytes(3) + info + bytes([0x83]) + len(table).to_bytes(3) + table + b"".join(own))
    return out


# ---------------------------------------------------------------- reading


@dataclass
class Info:
    """A stream's facts, and where its first frame begins."""

    block: int
    channels: int
    bits: int
    rate: int
    total: int
    md5: bytes
    points: list[tuple[int, int, int]]
    first: int


def read_info(raw: bytes) -> Info:
    if raw[:4] != b"fLaC" or len(raw) < 42:
        raise FlacError("not a FLAC stream")
    at, last, info, points = 4, False, None, []
    while not last:
        if at + 4 > len(raw):
            raise FlacError("metadata is cut off")
        last, kind, size = raw[at] >> 7, raw[at] & 0x7F, int.from_bytes(raw[at + 1 : at + 4])
        body = raw[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            packed = int.from_bytes(body[10:18])
            info = (int.from_bytes(body[2:4]), (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed >> 44, packed & ((1 << 36) - 1), body[18:34])
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
    if info is None:
        raise FlacError("no stream information")
    return Info(*info, points, at)


@dataclass
class Frame:
    """A frame's header: which sample it begins with and where its data lie."""

    stream: int
    start: int
    data: int
    n: int
    first: int
    channels: int
    assignment: int
    bits: int


def _header(raw: bytes, at: int, info: Info, stream: int) -> Frame:
    if at + 6 > len(raw) or raw[at] != 0xFF or raw[at + 1] & 0xFE != 0xF8:
        raise FlacError("no frame where one should begin")
    variable, size_code, rate_code = raw[at + 1] & 1, raw[at + 2] >> 4, raw[at + 2] & 15
    assignment, bit_code = raw[at + 3] >> 4, raw[at + 3] >> 1 & 7
    p = at + 4
    lead = raw[p]
    extra = 0 if lead < 0x80 else next((j for j in range(1, 7) if not lead >> (6 - j) & 1), 7) if lead >= 0xC0 else 8
    if extra == 8 or p + extra + 6 > len(raw):
        raise FlacError("bad frame number")
    number = lead if not extra else lead & ((1 << (6 - extra)) - 1)
    for j in range(1, extra + 1):
        number = number << 6 | raw[p + j] & 0x3F
    p += 1 + extra
    if size_code == 6:
        n, p = raw[p] + 1, p + 1
    elif size_code == 7:
        n, p = int.from_bytes(raw[p : p + 2]) + 1, p + 2
    elif size_code in BLOCK_CODES or 2 <= size_code <= 5:
        n = BLOCK_CODES[size_code]
    else:
        raise FlacError("reserved block size")
    p += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if crc8(raw[at:p]) != raw[p]:
        raise FlacError("a frame header's CRC-8 is wrong")
    if assignment > 10 or bit_code == 3:
        raise FlacError("reserved channels or sample size")
    return Frame(stream, at, p + 1, n, number if variable else number * info.block, assignment + 1 if assignment < 8 else 2, assignment, BIT_CODES.get(bit_code, info.bits))


class _Lanes:
    """Reads bits at a place of its own in each lane."""

    def __init__(self, raw: bytes):
        padded = raw + bytes(16)
        self.words = np.empty(len(raw) + 8, np.uint64)
        for o in range(8):
            part = self.words[o::8]
            part[:] = np.frombuffer(padded, ">u8", len(part), o) if len(part) else 0
        self.end = 8 * len(raw)

    def peek(self, p: np.ndarray) -> np.ndarray:
        """At least 57 bits from p, left-aligned."""
        if len(p) and int(p.max()) > self.end:
            raise FlacError("a frame is cut off")
        return self.words[p >> 3] << (p & 7).astype(np.uint64)

    def take(self, p: np.ndarray, n, signed: bool = False) -> np.ndarray:
        """The next n bits (a number, or one for each lane, at most 57)."""
        n = np.broadcast_to(np.asarray(n, np.int64), p.shape)
        w = self.peek(p)
        out = ((w >> np.uint64(1)) >> (63 - n).astype(np.uint64)).astype(np.int64)
        p += n
        return np.where(n > 0, (out ^ (s := np.int64(1) << np.maximum(n - 1, 0))) - s, 0) if signed else out

    def rice(self, p: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The next Rice code of each lane, unfolded."""
        w = self.peek(p)
        q = _ZEROS[(w >> np.uint64(48)).astype(np.int64)]
        if (q == 16).any():
            long = np.flatnonzero(q == 16)
            q = q.astype(np.int64)
            while len(long):
                at = p[long] + q[long]
                more = _ZEROS[(self.peek(at) >> np.uint64(48)).astype(np.int64)].astype(np.int64)
                q[long] += more
                long = long[more == 16]
        q = q.astype(np.int64)
        p += q + 1
        u = q << k | ((self.peek(p) >> np.uint64(1)) >> (63 - k).astype(np.uint64)).astype(np.int64)
        p += k
        return (u >> 1) ^ -(u & 1)


_ZEROS = np.array([16] + [16 - x.bit_length() for x in range(1, 1 << 16)], np.uint8)


def _residual(lanes: _Lanes, p: np.ndarray, n: int, order: int) -> np.ndarray:
    out = np.empty((len(p), n - order), np.int64)
    method, parts = lanes.take(p, 2), lanes.take(p, 4)
    if (method > 1).any():
        raise FlacError("reserved residual coding")
    for m, pe in np.unique(np.stack([method, parts], 1), axis=0).tolist():
        of = np.flatnonzero((method == m) & (parts == pe))
        at, width, span, done = p[of], 4 + m, n >> pe, 0
        if span << pe != n or span < order:
            raise FlacError("partitions don't fit the block")
        held = np.empty((n - order, len(of)), np.int64)
        for part in range(1 << pe):
            k = lanes.take(at, width)
            raw = k == (1 << width) - 1
            size = span - (order if part == 0 else 0)
            if not raw.any():
                for t in range(done, done + size):
                    held[t] = lanes.rice(at, k)
            else:
                e, c = np.flatnonzero(raw), np.flatnonzero(~raw)
                ae, ac, kc = at[e], at[c], k[c]
                bits = lanes.take(ae, 5)
                for t in range(done, done + size):
                    held[t, e] = lanes.take(ae, bits, signed=True)
                    if len(c):
                        held[t, c] = lanes.rice(ac, kc)
                at[e], at[c] = ae, ac
            done += size
        p[of] = at
        out[of] = held.T
    return out


def _restore(x: np.ndarray, residual: np.ndarray, coefs: np.ndarray, shift: np.ndarray) -> None:
    """Fills x (lanes, n), whose first columns are the warm-up, by prediction."""
    order = coefs.shape[1]
    t = np.ascontiguousarray(x.T)
    r, c = residual.T, np.ascontiguousarray(coefs.T)
    for i in range(order, len(t)):
        s = c[0] * t[i - 1]
        for j in range(1, order):
            s += c[j] * t[i - 1 - j]
        t[i] = r[i - order] + (s >> shift)
    x[:] = t.T


def _subframe(lanes: _Lanes, p: np.ndarray, n: int, bits: np.ndarray) -> np.ndarray:
    """The next subframe of n samples of every lane; p moves behind it."""
    out = np.empty((len(p), n), np.int64)
    head = lanes.take(p, 8)
    if (head >> 7).any():
        raise FlacError("a subframe has a wrong first bit")
    wasted = np.zeros(len(p), np.int64)
    for i in np.flatnonzero(head & 1).tolist():
        one = p[i : i + 1]
        while not int(lanes.take(one, 1)[0]):
            wasted[i] += 1
        wasted[i] += 1
    kind, bits = head >> 1 & 63, bits - wasted
    for which in np.unique(kind).tolist():
        of = np.flatnonzero(kind == which)
        at, size = p[of], bits[of]
        x = np.empty((len(of), n), np.int64)
        if which == 0:
            x[:] = lanes.take(at, size, signed=True)[:, None]
        elif which == 1:
            for t in range(n):
                x[:, t] = lanes.take(at, size, signed=True)
        elif 8 <= which <= 12 or which >= 32:
            order = which - 8 if which < 32 else which - 31
            if order > n:
                raise FlacError("a predictor is longer than its block")
            for t in range(order):
                x[:, t] = lanes.take(at, size, signed=True)
            if which >= 32:
                precision = lanes.take(at, 4) + 1
                shift = lanes.take(at, 5, signed=True)
                if (precision == 16).any() or (shift < 0).any():
                    raise FlacError("reserved predictor precision or shift")
                coefs = np.stack([lanes.take(at, precision, signed=True) for _ in range(order)], 1)
            residual = _residual(lanes, at, n, order)
            if which >= 32:
                _restore(x, residual, coefs, shift)
            elif order == 0:
                x = residual
            elif order <= 2:  # running sums undo differences
                for level in range(order - 1, -1, -1):
                    start = x[:, level : level + 1] if level == 0 else x[:, 1:2] - x[:, 0:1]
                    residual = np.cumsum(np.concatenate([start, residual], 1), 1)
                x = residual
            else:
                _restore(x, residual, np.tile(_DIFFERENCES[order], (len(of), 1)), np.zeros(len(of), np.int64))
        else:
            raise FlacError("reserved subframe type")
        out[of] = x << wasted[of, None]
        p[of] = at
    return out


def _frames(raw: bytes, frames: list[Frame]) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples (channels, n) of each frame, and where each frame ends."""
    lanes, out = _Lanes(raw), [None] * len(frames)
    ends = np.zeros(len(frames), np.int64)
    for n, channels in sorted({(f.n, f.channels) for f in frames}):
        of = [i for i, f in enumerate(frames) if (f.n, f.channels) == (n, channels)]
        p = np.array([8 * frames[i].data for i in of])
        kind = np.array([frames[i].assignment for i in of])
        bits = np.array([frames[i].bits for i in of])
        got = []
        for c in range(channels):
            side = (kind == 8) & (c == 1) | (kind == 9) & (c == 0) | (kind == 10) & (c == 1)
            got.append(_subframe(lanes, p, n, bits + side))
        if channels == 2:
            a, b = got
            k = kind[:, None]
            mid = (a << 1) | (b & 1)
            left = np.where(k == 9, a + b, np.where(k == 10, (mid + b) >> 1, a))
            right = np.where(k == 8, a - b, np.where(k == 10, (mid - b) >> 1, b))
            got = [left, right]
        ends[of] = -(-p // 8) + 2
        for lane, i in enumerate(of):
            out[i] = [g[lane] for g in got]
    starts = np.array([f.start for f in frames], np.int64)
    data = np.frombuffer(raw, np.uint8)
    if len(ends) and int(ends.max()) > len(data):
        raise FlacError("a frame is cut off")
    if len(ends):
        said = data[ends - 2].astype(np.int64) << 8 | data[ends - 1]
        if (crc16(data, starts, ends - 2 - starts) != said).any():
            raise FlacError("a frame's CRC-16 is wrong")
    return out, ends


def _all_indexed(info: Info) -> bool:
    """Whether the seek table names every frame, end to end."""
    at = 0
    for first, _, n in info.points:
        if first != at:
            return False
        at += n
    return bool(info.total) and at == info.total


@dataclass
class Stream:
    """A decoded stream: samples (channels, total) and its frames' extents."""

    info: Info
    samples: np.ndarray
    blocks: list[tuple[int, int]]


def decode(raws: list[bytes]) -> list[Stream]:
    """Reads whole streams, all frames of all streams together, and verifies
    every checksum."""
    infos = [read_info(r) for r in raws]
    base = np.cumsum([0, *map(len, raws)]).tolist()
    whole = b"".join(raws)
    frames: list[Frame] = []
    for s, info in enumerate(infos):
        start = base[s] + info.first
        if _all_indexed(info):
            own = [_header(whole, start + offset, info, s) for _, offset, _ in info.points]
            if any(f.n != n or f.first != first for f, (first, _, n) in zip(own, info.points, strict=True)):
                raise FlacError("the seek table is wrong")
            frames += own
        else:  # each frame's end is known once it is read
            while start < base[s + 1]:
                frames.append(_header(whole, start, info, s))
                start = int(_frames(whole[: base[s + 1]], frames[-1:])[1][0])
    parts: list[list[np.ndarray]] = [[] for _ in raws]
    blocks: list[list[tuple[int, int]]] = [[] for _ in raws]
    last = [None] * len(raws)
    for own, got, ends in _in_runs(whole, frames):
        for f, x, end in zip(own, got, ends, strict=True):
            if last[f.stream] not in (None, f.start):
                raise FlacError("frames don't lie end to end")
            last[f.stream] = end
            parts[f.stream].append(np.stack(x).astype(np.int16 if infos[f.stream].bits <= 16 else np.int32))
            blocks[f.stream].append((f.first, f.n))
    out = []
    for s, info in enumerate(infos):
        if last[s] not in (None, base[s + 1]):
            raise FlacError("something follows the last frame")
        samples = np.concatenate(parts[s], 1) if parts[s] else np.zeros((info.channels, 0), np.int16)
        parts[s] = []
        if info.total and samples.shape[1] != info.total:
            raise FlacError("samples are missing")
        if any(info.md5) and hashlib.md5(pcm_bytes(samples, info.bits), usedforsecurity=False).digest() != info.md5:
            raise FlacError("the samples' MD5 is wrong")
        out.append(Stream(info, samples, blocks[s]))
    return out


def _in_runs(whole: bytes, frames: list[Frame]) -> Iterator[tuple[list[Frame], list, list[int]]]:
    """Frames, their samples and their ends, up to ``LANES`` at a time; only
    the bytes of those are unpacked."""
    for lo in range(0, len(frames), LANES):
        own = frames[lo : lo + LANES]
        a = own[0].start
        b = frames[lo + LANES].start if lo + LANES < len(frames) else len(whole)
        got, ends = _frames(whole[a:b], [replace(f, start=f.start - a, data=f.data - a) for f in own])
        yield own, got, (ends + a).tolist()


def decode_from(raw: bytes, sample: int) -> tuple[int, np.ndarray]:
    """One frame alone: the one that holds ``sample``, by the seek table.
    Returns its first sample and its samples."""
    info = read_info(raw)
    near = [p for p in info.points if p[0] <= sample]
    at, first = (near[-1][1], near[-1][0]) if near else (0, 0)
    at += info.first
    while at < len(raw):
        frame = _header(raw, at, info, 0)
        got, ends = _frames(raw, [frame])
        if frame.first <= sample < frame.first + frame.n:
            return frame.first, np.stack(got[0])
        at, first = int(ends[0]), frame.first
    raise IndexError(sample)


def pcm_bytes(samples: np.ndarray, bits: int) -> bytes:
    """Interleaved signed little-endian samples of whole bytes."""
    width = -(-bits // 8)
    flat = np.ascontiguousarray(samples.T).reshape(-1)
    if width == 1:
        return flat.astype(np.int8).tobytes()
    return flat.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
