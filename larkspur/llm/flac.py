"""Media columns as FLAC: payloads stored losslessly as 8-bit mono samples, read back, and summarised.

A stream is `fLaC`, STREAMINFO (with the MD5 of the samples), a SEEKTABLE that has one point for
every frame, and the frames. A frame is a CRC-8 guarded header, one subframe (fixed predictor of
order 0 to 2 or a quantised linear predictor with partitioned Rice residuals, a constant, or the samples
themselves, whichever is shortest), and a CRC-16. Streams of other encoders are read by `flac_plain`.

Frames are independent, so both directions work on many frames at once: the encoder computes all
residuals and bit positions as arrays; the decoder follows the Rice codes of all frames in
lockstep (a table of the next stop bit makes one step one look-up) and then runs the predictors
in lockstep too. Long streams are cut into runs of frames, so memory is bounded by the run. The PCM blocks that
are read back keep the sample offsets at which a reader may seek.

Defined results: a null text counts as empty; the payload of an empty text is 64 zero bytes; equal
payloads give equal streams; repeated rows each give a row, a null id as any other; an empty table gives no rows; extra
input columns are ignored; a damaged stream raises an error; beyond MOST_POINTS frames (0.9 GB) every second, third ...
frame has a seek point, and the plain reader takes over.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import flac_plain
from larkspur.llm.common import claim_worker, csr_take, slices

BLOCK = 1024  # samples in a frame; the last one of a stream may be shorter
UNIT = 64  # payloads are padded to a positive multiple of this
RATE = 8000
PARTITION_ORDER = 2
PARTS = 1 << PARTITION_ORDER
ORDER = 4  # highest predictor order
PRECISION, SHIFT = 12, 10  # of quantised predictor coefficients
RUN = 4096  # frames that are worked on at once
MOST_POINTS = ((1 << 24) - 1) // 18  # the length of a metadata block has 24 bits
CONSTANT, VERBATIM = 0, 1  # subframe types (fixed values of the format)
#: Coefficients of the fixed predictors by order (fixed values of the format).
FIXED = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [2, -1, 0, 0], [3, -3, 1, 0], [4, -6, 4, -1]], np.int64)


class Unsupported(ValueError):
    """The stream goes beyond what is read many frames at once."""


def _crc_table(poly: int, width: int, bits: int) -> np.ndarray:
    """CRC of every `bits`-bit word in front of zeros, for a CRC of `width` bits."""
    crc = np.arange(1 << bits, dtype=np.uint32) << (width - bits if width > bits else 0)
    top, mask = 1 << (width - 1), (1 << width) - 1
    for _ in range(bits):
        crc = np.where(crc & top, (crc << 1) ^ poly, crc << 1) & mask
    return crc


@lru_cache(1)
def _crc16_words() -> np.ndarray:
    return _crc_table(0x8005, 16, 16).astype(np.uint16)


@lru_cache(1)
def _crc8_bytes() -> list[int]:
    return _crc_table(0x07, 8, 8).tolist()


def crc8(data: bytes) -> int:
    table, crc = _crc8_bytes(), 0
    for x in data:
        crc = table[crc ^ x]
    return crc


def crc16_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges at once. Zeros in front change nothing, so ranges are aligned at their ends."""
    if not len(starts):
        return np.zeros(0, np.uint16)
    width = int(sizes.max())
    width += width & 1
    square = np.zeros((len(starts), width), np.uint8)
    inner = csr_take(width - sizes + np.arange(len(starts)) * width, sizes)
    square.ravel()[inner] = data[csr_take(starts, sizes)]
    words = np.ascontiguousarray(square.view(">u2").astype(np.uint16).T)
    table, crc = _crc16_words(), np.zeros(len(starts), np.uint16)
    for row in words:
        crc = table[crc ^ row]
    return crc


def _coded_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x20
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        if n < limit:
            break
        limit >>= 1
    lead = (0xFF00 >> (len(tail) + 1)) & 0xFF
    return bytes([lead | n, *reversed(tail)])


@lru_cache(1 << 16)
def frame_header(number: int, size: int) -> bytes:
    code, extra = (0b1010, b"") if size == BLOCK else (0b0111, struct.pack(">H", size - 1))
    head = bytes([0xFF, 0xF8, code << 4, 0b0000_001_0]) + _coded_number(number) + extra
    return head + bytes([crc8(head)])


@lru_cache(1 << 16)
def _read_header(head: bytes, number: int) -> int:
    """Block size of a checked header."""
    size = BLOCK if head[2] >> 4 == 0b1010 else struct.unpack(">H", head[-3:-1])[0] + 1
    if head != frame_header(number, size):
        raise Unsupported("FLAC frame header: bad sync code, number or CRC-8")
    return size


def _header_bytes(data: memoryview, at: int) -> bytes:
    lead = data[at + 4]
    coded = 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    return bytes(data[at : at + 5 + coded + (2 if data[at + 2] >> 4 == 0b0111 else 0)])


class _Bits:
    """Gathers fields of up to 17 bits at given bit positions; fields never overlap, so bytes are plain sums."""

    def __init__(self, n_bytes: int) -> None:
        self.sums = np.zeros(n_bytes + 2, np.int32)

    def put(self, at: np.ndarray, value: np.ndarray, width: np.ndarray | int) -> None:
        """Positions must not decrease."""
        if not len(at):
            return
        window = (value << (24 - (at & 7) - width)).astype(np.int32)
        byte = at >> 3
        edges = np.flatnonzero(np.diff(byte, prepend=-1))
        where = byte[edges]
        for i, part in enumerate((window >> 16, window >> 8 & 0xFF, window & 0xFF)):
            self.sums[where + i] += np.add.reduceat(part, edges)

    def data(self) -> np.ndarray:
        return self.sums[:-2].astype(np.uint8)


def _words(data: np.ndarray) -> np.ndarray:
    """The 24 bits from each byte on."""
    wide = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.int32)
    return np.append(wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:], np.int32(0))


@lru_cache(1)
def _leading_zeros() -> np.ndarray:
    """Zeros in front of the first one in each 16-bit word; 16 for none."""
    return (16 - np.ceil(np.log2(np.arange(1 << 16) + 1.0))).astype(np.uint8)


def _get(words: np.ndarray, at: np.ndarray, width: int, signed: bool = False) -> np.ndarray:
    """Fields of up to 17 bits at bit positions."""
    out = ((words[at >> 3] >> (24 - (at & 7) - width)) & ((1 << width) - 1)).astype(np.int64)
    return out - ((out >> (width - 1)) << width) if signed else out


def _predictors(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Quantised coefficients of a linear predictor of order ORDER for each row (Levinson-Durbin on autocorrelations)."""
    real = x.astype(np.float32)
    auto = np.stack([np.einsum("ij,ij->i", real[:, j:], real[:, : real.shape[1] - j], dtype=np.float64) for j in range(ORDER + 1)])
    error = auto[0] + 1e-9
    a = np.zeros((ORDER, len(x)))
    for i in range(ORDER):
        k = auto[i + 1] - (a[:i] * auto[i:0:-1]).sum(0) if i else auto[1]
        k = k / error
        a[:i], a[i] = a[:i] - k * a[:i][::-1], k
        error = np.maximum(error * (1 - k * k), 1e-9)
    most = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a.T * (1 << SHIFT)), -most, most).astype(np.int64)


def encode_frames(samples: np.ndarray, starts: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(frames as bytes, their byte offsets): frame i holds samples[starts[i]:starts[i]+sizes[i]]."""
    n = len(starts)
    x = np.zeros((n, BLOCK), np.int32)
    slots = csr_take(np.arange(n) * BLOCK, sizes)
    x.ravel()[slots] = samples[csr_take(starts, sizes)]
    inside = np.arange(BLOCK) < sizes[:, None]
    lpc = _predictors(x, sizes)

    def residual(coefficients: np.ndarray, shift: int, order: int) -> np.ndarray:
        guess = np.zeros_like(x)
        for j in range(order):
            guess[:, j + 1 :] += coefficients[:, j, None].astype(np.int32) * x[:, : BLOCK - j - 1]
        r = x - (guess >> shift)
        r[~inside] = 0
        r[:, :order] = 0
        return r

    best = residual(lpc, SHIFT, ORDER)
    best_cost = np.abs(best).sum(1, dtype=np.int64) + 8 * ORDER + ORDER * PRECISION // 4
    kind, order = np.full(n, 0b100000 | ORDER - 1, np.int64), np.full(n, ORDER, np.int64)
    for o in range(3):
        r = residual(np.broadcast_to(FIXED[o], (n, 4)), 0, o)
        cost = np.abs(r).sum(1, dtype=np.int64) + 8 * o
        better = cost < best_cost
        best[better], best_cost[better], kind[better], order[better] = r[better], cost[better], 0b001000 | o, o

    folded = np.where(best >= 0, 2 * best, -2 * best - 1)
    part = sizes // PARTS
    index = np.arange(BLOCK)
    coded = inside & (index >= order[:, None])
    partition = np.minimum(index // part[:, None], PARTS - 1)
    cell = (np.arange(n)[:, None] * PARTS + partition)[coded]
    u = folded[coded].astype(np.int64)
    count = np.bincount(cell, minlength=n * PARTS)
    mean = np.bincount(cell, weights=u, minlength=n * PARTS) / np.maximum(count, 1)
    k = np.clip(np.rint(np.log2(0.7 * mean + 0.5)), 0, 14).astype(np.int64)
    # A few huge residuals in an else quiet partition would make long unary codes.
    largest = np.zeros(n * PARTS, np.int64)
    np.maximum.at(largest, cell, u) if mean.size and (u > 64 * (mean[cell] + 1)).any() else None
    k = np.maximum(k, np.clip(np.ceil(np.log2(np.maximum(largest, 1) / 512.0)), 0, 14).astype(np.int64))

    own_k = k[cell]
    length = (u >> own_k) + 1 + own_k
    code_bits = np.bincount(cell, weights=length, minlength=n * PARTS).astype(np.int64).reshape(n, PARTS)
    constant = ((x == x[:, :1]) | ~inside).all(1)
    rice_bits = 8 * order + np.where(kind >= 0b100000, 9 + PRECISION * ORDER, 0) + 6 + 4 * PARTS + code_bits.sum(1)
    verbatim = ~constant & (rice_bits > 8 * sizes)
    plain = constant | verbatim
    if plain.any():
        kind[constant], kind[verbatim], order[plain], code_bits[plain] = CONSTANT, VERBATIM, 0, 0
        left = ~plain[cell // PARTS]
        cell, u, own_k, length = cell[left], u[left], own_k[left], length[left]
        count = np.bincount(cell, minlength=n * PARTS)
    rice = np.flatnonzero(~plain)
    headers = [frame_header(i, s) for i, s in zip(numbers.tolist(), sizes.tolist())]
    header = np.fromiter(map(len, headers), np.int64, n)
    is_lpc = kind >= 0b100000
    lead = 8 + 8 * order + np.where(is_lpc, 9 + PRECISION * ORDER, 0) + 6
    body = np.where(constant, 2, np.where(verbatim, 1 + sizes, -(-(lead + 4 * PARTS + code_bits.sum(1)) // 8)))
    frame = header + body + 2
    offsets = np.concatenate([[0], np.cumsum(frame)])

    bits = _Bits(int(offsets[-1]))
    sub = 8 * (offsets[:-1] + header)
    bits.put(sub, kind << 1, 8)
    for j in range(ORDER):
        has = np.flatnonzero(order > j)
        bits.put(sub[has] + 8 + 8 * j, x[has, j].astype(np.int64) & 0xFF, 8)
    l = np.flatnonzero(is_lpc)
    at = sub[l] + 8 + 8 * ORDER
    bits.put(at, np.full(len(l), (PRECISION - 1) << 5 | SHIFT), 9)
    for j in range(ORDER):
        bits.put(at + 9 + PRECISION * j, lpc[l, j] & ((1 << PRECISION) - 1), PRECISION)
    bits.put(sub[rice] + lead[rice] - 6, np.full(len(rice), PARTITION_ORDER), 6)
    code_bits = code_bits[rice]
    before = np.cumsum(code_bits + 4, axis=1) - code_bits - 4
    cell_at = ((sub + lead)[rice, None] + before).ravel()
    bits.put(cell_at, k.reshape(n, PARTS)[rice].ravel(), 4)
    # Codes lie one behind the other inside a cell, and cells in order, so only gaps between cells have to be added.
    gap = np.diff(cell_at + 4 - (np.cumsum(code_bits.ravel()) - code_bits.ravel()), prepend=0)
    ends = np.cumsum(length) + np.repeat(np.cumsum(gap), count.reshape(n, PARTS)[rice].ravel())
    bits.put(ends - own_k - 1, u & ((1 << own_k) - 1) | 1 << own_k, own_k + 1)
    data = bits.data()
    for rows, each in ((constant, np.ones(n, np.int64)), (verbatim, sizes)):
        to = np.flatnonzero(rows)
        data[csr_take((sub[to] >> 3) + 1, each[to])] = x.ravel()[csr_take(to * BLOCK, each[to])] & 0xFF
    data[csr_take(offsets[:-1], header)] = np.frombuffer(b"".join(headers), np.uint8)
    crc = crc16_of(data, offsets[:-1], frame - 2)
    data[offsets[1:] - 2], data[offsets[1:] - 1] = crc >> 8, crc & 0xFF
    return data.tobytes(), offsets


def decode_frames(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples, their offsets): the frames data[starts[i]:starts[i]+sizes[i]], with both checksums verified."""
    n = len(starts)
    if crc16_of(data, starts, sizes).any():
        raise ValueError("FLAC frame: CRC-16 does not match")
    used = csr_take(starts, sizes)
    data, starts = data[used], np.concatenate([[0], np.cumsum(sizes)])[:-1]
    raw = memoryview(data.tobytes())
    heads = [_header_bytes(raw, at) for at in starts.tolist()]
    block = np.array([_read_header(h, i) for h, i in zip(heads, numbers.tolist())], np.int64)
    sub = 8 * (starts + np.fromiter(map(len, heads), np.int64, n))
    bits, zeros = _words(data), _leading_zeros()
    kind = _get(bits, sub, 8) >> 1
    if (_get(bits, sub, 8) & 0x81).any():
        raise Unsupported("FLAC subframe: type not supported")
    is_lpc, fixed, plain = kind >= 0b100000, (kind >> 3) == 1, kind <= VERBATIM
    if not (is_lpc | fixed | plain).all():
        raise Unsupported("FLAC subframe: type not supported")
    if plain.any():
        return _with_plain(data, starts, sizes, block, sub, kind, numbers)
    order = np.where(is_lpc, (kind & 0b11111) + 1, kind & 0b111)
    if order.max(initial=0) > ORDER:
        raise Unsupported("FLAC subframe: order not supported")
    warm = np.zeros((ORDER, n), np.int64)
    for j in range(ORDER):
        has = np.flatnonzero(order > j)
        warm[j, has] = _get(bits, sub[has] + 8 + 8 * j, 8, signed=True)
    coefficients, shift = FIXED[np.where(is_lpc, 0, order)].copy(), np.zeros(n, np.int64)
    lead = 8 + 8 * order
    l = np.flatnonzero(is_lpc)
    if len(l):
        at = sub[l] + lead[l]
        if (_get(bits, at, 4) != PRECISION - 1).any():
            raise Unsupported("FLAC subframe: precision not supported")
        shift[l] = _get(bits, at + 4, 5, signed=True)
        for j in range(ORDER):
            has = order[l] > j
            coefficients[l[has], j] = _get(bits, at[has] + 9 + PRECISION * j, PRECISION, signed=True)
        lead[l] += 9 + PRECISION * order[l]
    if _get(bits, sub + lead, 2).any():
        raise Unsupported("FLAC residual: coding method not supported")
    partitions = 1 << _get(bits, sub + lead + 2, 4)

    # Rice codes of all frames in lockstep; frames with most residuals first, so that the active ones are a prefix.
    count = block - order
    rank = np.argsort(-count, kind="stable")
    pos = (sub + lead + 6)[rank]
    count_r, order_r, part_r, parts_r = count[rank], order[rank], (block // partitions)[rank], partitions[rank]
    events: dict[int, list[np.ndarray]] = {}
    most = int(parts_r.max(initial=1))
    for p in range(most):
        rows = np.flatnonzero(parts_r > p)
        step = np.maximum(0, p * part_r[rows] - order_r[rows])
        by = np.argsort(step, kind="stable")
        edges = np.flatnonzero(np.diff(step[by], prepend=-1))
        for i, group in zip(step[by][edges].tolist(), np.split(rows[by], edges[1:])):
            events.setdefault(i, []).append(group)
    steps = int(count.max(initial=0))
    stop, begin = np.zeros((steps, n), np.int32), np.zeros((steps, n), np.int32)
    ks = np.zeros((steps, n), np.uint8)
    k = np.zeros(n, np.int64)
    active = np.searchsorted(-count_r, -np.arange(steps), side="left")
    for i in range(steps):
        for rows in events.get(i, ()):
            k[rows] = _get(bits, pos[rows], 4)
            pos[rows] += 4
        a = active[i]
        here = pos[:a]
        begin[i, :a] = here
        zero = zeros[bits[here >> 3] >> (8 - (here & 7)) & 0xFFFF]
        found = here + zero
        while zero.max(initial=0) == 16:  # a run of zeros goes on behind the 16 bits
            far = np.flatnonzero(zero == 16)
            if (found[far] >> 3 >= len(bits) - 1).any():
                raise ValueError("FLAC residual: a code does not end")
            more = zeros[bits[found[far] >> 3] >> (8 - (found[far] & 7)) & 0xFFFF]
            found[far] += more
            zero = np.zeros_like(zero)
            zero[far] = more
        stop[i, :a] = found
        ks[i, :a] = k[:a]
        pos[:a] = found + k[:a] + 1
    at, own = stop + 1, ks.astype(np.int32)
    rest = (bits[at >> 3] >> (24 - (at & 7) - own)) & ((1 << own) - 1)
    folded = (stop - begin) << own | rest
    r = np.where(folded & 1, -(folded >> 1) - 1, folded >> 1)

    # Predictors in lockstep, over sample positions: warm-up samples stand in for residuals there.
    longest = int(block.max(initial=0))
    signal = np.zeros((ORDER + longest, n), np.int32)
    moved = np.zeros((longest, n), np.int32)
    for o in range(ORDER + 1):
        cols = np.flatnonzero(order_r == o)
        if len(cols):
            moved[o : o + min(steps, longest - o), cols] = r[: longest - o, cols]
            moved[:o, cols] = warm[:o, rank[cols]]
    c, s = np.ascontiguousarray(coefficients[rank].T.astype(np.int32)), shift[rank].astype(np.int32)
    for t in range(longest):
        guess = c[0] * signal[t + ORDER - 1]
        for j in range(1, ORDER):
            guess += c[j] * signal[t + ORDER - 1 - j]
        guess >>= s
        if t < ORDER:
            guess[order_r > t] = 0
        np.add(guess, moved[t], out=signal[t + ORDER])
    back = np.empty(n, np.int64)
    back[rank] = np.arange(n)
    rows = np.ascontiguousarray(signal[ORDER:].astype(np.int16).T)[back]
    return rows.ravel()[csr_take(np.arange(n) * longest, block)], np.concatenate([[0], np.cumsum(block)])


def _with_plain(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, block: np.ndarray, sub: np.ndarray, kind: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`decode_frames` where some frames have constant or verbatim subframes: those are copied, the rest is decoded as ever."""
    ends = np.cumsum(block)
    out = np.zeros(int(ends[-1]), np.int16)
    constant, verbatim, rest = (np.flatnonzero(x) for x in (kind == CONSTANT, kind == VERBATIM, kind > VERBATIM))
    body = np.where(kind == CONSTANT, 2, 1 + block)
    if (((sub >> 3) + body + 2 - starts != sizes) & (kind <= VERBATIM)).any():
        raise ValueError("FLAC subframe: its samples do not fill the frame")
    first = ends - block
    out[csr_take(first[constant], block[constant])] = np.repeat(data[(sub[constant] >> 3) + 1].view(np.int8), block[constant])
    out[csr_take(first[verbatim], block[verbatim])] = data[csr_take((sub[verbatim] >> 3) + 1, block[verbatim])].view(np.int8)
    if len(rest):
        out[csr_take(first[rest], block[rest])] = decode_frames(data, starts[rest], sizes[rest], numbers[rest])[0]
    return out, np.concatenate([[0], ends])


def padded(text: str | None) -> tuple[bytes, int]:
    """(payload, bytes of the text): zeros up to a positive multiple of UNIT."""
    data = ("" if text is None else text).encode()
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data)), len(data)


def write_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload."""
    sizes = np.fromiter(map(len, payloads), np.int64, len(payloads))
    frames = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(payloads)), frames)
    number = csr_take(np.zeros(len(payloads), np.int64), frames)
    samples = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128
    starts = (np.cumsum(sizes) - sizes)[owner] + number * BLOCK
    length = np.minimum(BLOCK, sizes[owner] - number * BLOCK)
    bodies: list[list[bytes]] = [[] for _ in payloads]
    frame_sizes = np.zeros(len(owner), np.int64)
    for at in range(0, len(owner), RUN):
        run = slice(at, at + RUN)
        data, offsets = encode_frames(samples, starts[run], length[run], number[run])
        frame_sizes[run] = np.diff(offsets)
        own = owner[run]
        edges = np.flatnonzero(np.diff(own, prepend=-1))
        for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(own)]):
            bodies[own[i]].append(data[offsets[i] : offsets[j]])
    out, first = [], 0
    pcm = samples.astype(np.int8).tobytes()
    at = 0
    for size, n, body in zip(sizes.tolist(), frames.tolist(), bodies):
        own, points = frame_sizes[first : first + n], np.zeros(n, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]))
        points["sample"], points["offset"], points["count"] = np.arange(n) * BLOCK, np.cumsum(own) - own, length[first : first + n]
        rate = RATE << 44 | 0 << 41 | 7 << 36 | size
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3) + int(own.max()).to_bytes(3) + rate.to_bytes(8) + hashlib.md5(pcm[at : at + size]).digest()
        points = points[:: -(-n // MOST_POINTS)]
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3) + info + b"\x83" + points.nbytes.to_bytes(3) + points.tobytes() + b"".join(body))
        first, at = first + n, at + size
    return out


def read_streams(streams: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """(payload, sample offsets of its blocks) of each stream; every checksum is verified."""
    try:
        return _read_many(streams)
    except Unsupported:
        if len(streams) > 1:
            return [x for s in streams for x in read_streams([s])]
        return [flac_plain.read_stream(streams[0])]


def _read_many(streams: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    starts, sizes, numbers, sums, points_of, base = [], [], [], [], [], 0
    for s in streams:
        if s[:4] != b"fLaC" or s[4] & 0x7F:
            raise ValueError("no FLAC stream")
        info = s[8 : 8 + int.from_bytes(s[5:8])]
        at, last, points = 8 + len(info), bool(s[4] & 0x80), None
        while not last:
            last, kind, size = bool(s[at] & 0x80), s[at] & 0x7F, int.from_bytes(s[at + 1 : at + 4])
            if kind == 3:
                points = np.frombuffer(s, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]), size // 18, at + 4)
            at += 4 + size
        if points is None:
            raise Unsupported("FLAC stream: no seek table")
        shape = int.from_bytes(info[10:18])
        if shape >> 36 & 0xFF != 7 or points["count"].sum(dtype=np.int64) != shape & (1 << 36) - 1:
            raise Unsupported("FLAC stream: not 8-bit mono, or a frame without a seek point")
        offset = points["offset"].astype(np.int64) + at
        starts.append(offset + base)
        sizes.append(np.diff(offset, append=len(s)))
        numbers.append(np.arange(len(points)))
        sums.append((int.from_bytes(info[10:18]) & (1 << 36) - 1, info[18:34]))
        points_of.append(points)
        base += len(s)
    data = np.frombuffer(b"".join(streams), np.uint8)
    start, size, number = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, sizes, numbers))
    runs = [decode_frames(data, start[i : i + RUN], size[i : i + RUN], number[i : i + RUN]) for i in range(0, len(start), RUN)]
    samples = np.concatenate([x for x, _ in runs]).astype(np.int8) if runs else np.zeros(0, np.int8)
    blocks = np.concatenate([np.diff(edges) for _, edges in runs]) if runs else np.zeros(0, np.int64)
    out, at, frame = [], 0, 0
    payload = (samples.view(np.uint8) ^ 0x80).tobytes()
    for (total, digest), points in zip(sums, points_of):
        if hashlib.md5(samples[at : at + total]).digest() != digest:
            raise ValueError("FLAC stream: MD5 of the samples does not match")
        own = blocks[frame : frame + len(points)]
        offsets = np.cumsum(own) - own
        if (points["count"] != own).any() or (points["sample"] != offsets).any():
            raise ValueError("FLAC stream: the seek table does not match the frames")
        out.append((payload[at : at + total], offsets))
        at, frame = at + total, frame + len(points)
    if at != len(samples):
        raise ValueError("FLAC stream: sample count does not match")
    return out


def features(payload: bytes) -> str:
    """Whole-number features of the signal, so that equal payloads give equal strings everywhere."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"samples={len(x)};sum={int(x.sum(dtype=np.int64))};energy={int((x * x).sum(dtype=np.int64))};peak={int(np.abs(x).max())};crossings={crossings}"


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """(id, n_bytes, media binary): the padded payload of every text as a FLAC stream."""
    names = [id_col, "n_bytes", "media"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("flac")
        for b in slices(batches, "_text", batch_bytes):
            payloads, sizes = zip(*map(padded, b.column("_text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(write_streams(list(payloads)), pa.binary())], names=names)

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"{id_col} long, n_bytes long, media binary")


def pcm_blocks(df: DataFrame, id_col: str = "doc_id", batch_bytes: int = 2 << 20) -> DataFrame:
    """(id, block, sample_offset, pcm binary): the decoded blocks of every stream; a reader may seek by sample_offset."""
    names = [id_col, "block", "sample_offset", "pcm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("flac")
        for b in slices(batches, "media", batch_bytes):
            ids, blocks, offsets, pcm = [], [], [], []
            for doc, (payload, points) in zip(b.column("_id").to_pylist(), read_streams(b.column("media").to_pylist())):
                edges = [*points.tolist(), len(payload)]
                ids += [doc] * len(points)
                blocks += range(len(points))
                offsets += edges[:-1]
                pcm += [payload[i:j] for i, j in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blocks, pa.int64()), pa.array(offsets, pa.int64()), pa.array(pcm, pa.binary())], names=names)

    return df.select(F.col(id_col).alias("_id"), "media").mapInArrow(run, f"{id_col} long, block long, sample_offset long, pcm binary")


def digests(media: bytes, payload: bytes, points: np.ndarray) -> tuple:
    """What `media_digests` gives for a stream, from its PCM blocks one after the other."""
    whole, tail, edges = hashlib.sha256(), b"", [*points.tolist(), len(payload)]
    for i, j in zip(edges, edges[1:]):
        whole.update(payload[i:j])
        tail = (tail + payload[i:j])[-UNIT:]
    return len(payload), whole.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), features(payload), edges[:-1]


def media_digests(df: DataFrame, id_col: str = "doc_id", batch_bytes: int = 2 << 20) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, block_offsets) from the stored bytes."""
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "block_offsets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("flac")
        for b in slices(batches, "media", batch_bytes):
            media = b.column("media").to_pylist()
            rows = [digests(m, p, points) for m, (p, points) in zip(media, read_streams(media))]
            columns = [pa.array(c) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([b.column("_id").cast(pa.int64()), b.column("n_bytes"), *columns], names=names)

    return df.select(F.col(id_col).alias("_id"), "n_bytes", "media").mapInArrow(run, f"{id_col} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, block_offsets array<long>")
