"""A FLAC reader for 8-bit mono streams of any encoder, one bit field after the other.

`flac` reads the streams that it writes many frames at once; what is beyond its dialect comes here: any block size,
fixed or not, any order and precision, CONSTANT and VERBATIM subframes, wasted bits, both Rice codings with escapes, streams
with few or no seek points or with other metadata blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np

_SIZES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}


def _crc(data: bytes, poly: int, width: int) -> int:
    crc, top = 0, 1 << (width - 1)
    for x in data:
        crc ^= x << (width - 8)
        for _ in range(8):
            crc = (crc << 1) ^ poly if crc & top else crc << 1
        crc &= (1 << width) - 1
    return crc


class Reader:
    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.bit = data, 8 * at

    def field(self, width: int) -> int:
        first, last = self.bit >> 3, (self.bit + width + 7) >> 3
        if last > len(self.data):
            raise ValueError("FLAC stream ends inside a frame")
        value = int.from_bytes(self.data[first:last]) >> (8 * last - self.bit - width)
        self.bit += width
        return value & ((1 << width) - 1)

    def signed(self, width: int) -> int:
        value = self.field(width)
        return value - (1 << width) if width and value >> (width - 1) else value

    def zeros(self) -> int:
        n = 0
        while not self.field(1):
            n += 1
        return n


def _residuals(r: Reader, block: int, order: int) -> list[int]:
    method = r.field(2)
    if method > 1:
        raise ValueError("FLAC residual: reserved coding method")
    width, parts = (5 if method else 4), 1 << r.field(4)
    if block % parts:
        raise ValueError("FLAC residual: partitions do not divide the block")
    out: list[int] = []
    for p in range(parts):
        n, k = block // parts - (order if p == 0 else 0), r.field(width)
        if k == (1 << width) - 1:
            raw = r.field(5)
            out += [r.signed(raw) for _ in range(n)]
            continue
        for _ in range(n):
            u = r.zeros() << k | r.field(k)
            out.append(-(u >> 1) - 1 if u & 1 else u >> 1)
    return out


def _subframe(r: Reader, block: int, bits: int) -> list[int]:
    if r.field(1):
        raise ValueError("FLAC subframe: bad padding bit")
    kind = r.field(6)
    wasted = r.zeros() + 1 if r.field(1) else 0
    bits -= wasted
    if kind == 0:
        x = [r.signed(bits)] * block
    elif kind == 1:
        x = [r.signed(bits) for _ in range(block)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 31 if kind >= 32 else kind - 8
        if order > block:
            raise ValueError("FLAC subframe: the order exceeds the block")
        x = [r.signed(bits) for _ in range(order)]
        if kind >= 32:
            precision = r.field(4) + 1
            shift = r.signed(5)
            if precision == 16 or shift < 0:
                raise ValueError("FLAC subframe: bad precision or shift")
            by = [r.signed(precision) for _ in range(order)]
        else:
            by, shift = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])[order], 0
        for e in _residuals(r, block, order):
            x.append(e + (sum(c * x[-1 - j] for j, c in enumerate(by)) >> shift))
    else:
        raise ValueError("FLAC subframe: reserved type")
    return [v << wasted for v in x]


def _frame(r: Reader, data: bytes) -> list[int]:
    start = r.bit >> 3
    if r.field(15) != 0x7FFC:
        raise ValueError("FLAC frame: no sync code")
    r.field(1)
    size, rate, channels, depth = r.field(4), r.field(4), r.field(4), r.field(3)
    if r.field(1) or channels or depth not in (0, 1):
        raise ValueError("FLAC frame: only 8-bit mono is read")
    lead = r.field(8)
    for _ in range(0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()):
        r.field(8)
    block = r.field(8) + 1 if size == 6 else r.field(16) + 1 if size == 7 else _SIZES.get(size)
    if block is None:
        raise ValueError("FLAC frame: reserved block size")
    r.field({12: 8, 13: 16, 14: 16}.get(rate, 0))
    head = data[start : r.bit >> 3]
    if r.field(8) != _crc(head, 0x07, 8):
        raise ValueError("FLAC frame header: CRC-8 does not match")
    x = _subframe(r, block, 8)
    r.bit = (r.bit + 7) & ~7
    if r.field(16) != _crc(data[start : (r.bit >> 3) - 2], 0x8005, 16):
        raise ValueError("FLAC frame: CRC-16 does not match")
    return x


def read_stream(stream: bytes) -> tuple[bytes, np.ndarray]:
    """(payload, sample offsets of its blocks); checksums and seek points are verified."""
    if stream[:4] != b"fLaC" or stream[4] & 0x7F:
        raise ValueError("no FLAC stream")
    at, info, last, points = 4, b"", False, []
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4])
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            info = body
        elif kind == 3:
            points = np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]), size // 18).tolist()
        at += 4 + size
    shape = int.from_bytes(info[10:18])
    total, channels, depth = shape & ((1 << 36) - 1), (shape >> 41 & 7) + 1, (shape >> 36 & 31) + 1
    if (channels, depth) != (1, 8):
        raise ValueError("FLAC stream: only 8-bit mono is read")
    r, samples, offsets, places = Reader(stream, at), [], [], {}
    while r.bit >> 3 < len(stream):
        places[len(samples)] = (r.bit >> 3) - at
        offsets.append(len(samples))
        own = _frame(r, stream)
        places[offsets[-1]] = (places[offsets[-1]], len(own))
        samples += own
    if total and total != len(samples):
        raise ValueError("FLAC stream: sample count does not match")
    if any(places.get(s) != (o, n) for s, o, n in points if s != (1 << 64) - 1):
        raise ValueError("FLAC stream: the seek table does not match the frames")
    pcm = np.array(samples, np.int64)
    if len(pcm) and (pcm.min() < -128 or pcm.max() > 127):
        raise ValueError("FLAC stream: a sample has more than 8 bits")
    pcm = pcm.astype(np.int8)
    if any(info[18:34]) and hashlib.md5(pcm.tobytes()).digest() != info[18:34]:
        raise ValueError("FLAC stream: MD5 of the samples does not match")
    return (pcm.view(np.uint8) ^ 0x80).tobytes(), np.array(offsets, np.int64)
