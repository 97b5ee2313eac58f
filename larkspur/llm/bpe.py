"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts become codepoint arrays, codepoints become class symbols, and every symbol is a
transition function of a small automaton. Functions compose associatively, so the state in
front of each character comes from a blocked prefix scan over function numbers, without any
regular expression. Piece boundaries follow from (state, symbol). The resulting slices feed
pair merging that is cached by piece; token offsets are kept, and decoding reads them back.

Defined results: a null text counts as the empty text; an empty text has no tokens and decodes
to no bytes; rows repeat as often as they come; extra input columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import claim_worker, csr_take, slices

# Symbols of the automaton. Look-ahead is folded into the symbol, so the automaton needs none.
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, SPACE_MORE, SPACE_LAST, BLANK_LAST, BREAK = range(9)
# States: what the current piece is.
NONE, IN_LETTER, IN_NUMBER, IN_OTHER, IN_SPACE, AFTER_BLANK, QUOTE_1_LEFT, QUOTE_2_LEFT = range(8)
STATES, SYMBOLS = 8, 9
#: Characters that `\s` matches (fixed values: Unicode White_Space).
WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def codepoint_classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, for every code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = 1
        elif kind == "N":
            out[c] = 2
    out[WHITE] = 3
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a piece starts at this character)"""
    if symbol == BREAK:
        return NONE, True
    if state == QUOTE_2_LEFT:
        return QUOTE_1_LEFT, False
    if state == QUOTE_1_LEFT:
        return NONE, False
    if symbol == LETTER:
        return IN_LETTER, state not in (IN_LETTER, AFTER_BLANK)
    if symbol == NUMBER:
        return IN_NUMBER, state not in (IN_NUMBER, AFTER_BLANK)
    if symbol == SPACE_MORE:
        return IN_SPACE, state != IN_SPACE
    if symbol == SPACE_LAST:
        return NONE, True
    if symbol == BLANK_LAST:
        return AFTER_BLANK, True
    if state in (IN_OTHER, AFTER_BLANK):  # an apostrophe inside such a run opens no contraction
        return IN_OTHER, False
    return {OTHER: IN_OTHER, QUOTE1: QUOTE_1_LEFT, QUOTE2: QUOTE_2_LEFT}[symbol], True


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function number of each symbol, compose[f, g] (f first), image[f, state], start[state, symbol]."""
    functions = {tuple(range(STATES)): 0}
    generators = [tuple(_step(s, x)[0] for s in range(STATES)) for x in range(SYMBOLS)]
    todo = list(functions)
    while todo:
        f = todo.pop()
        for g in generators:
            h = tuple(g[s] for s in f)
            if h not in functions:
                functions[h] = len(functions)
                todo.append(h)
    images = np.array(list(functions), np.uint8)
    compose = np.array([[functions[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
    start = np.array([[_step(s, x)[1] for x in range(SYMBOLS)] for s in range(STATES)], bool)
    return np.array([functions[g] for g in generators], np.uint16), compose, images, start


def _states_before(symbols: np.ndarray) -> np.ndarray:
    """State in front of each symbol: a two-level prefix scan under function composition."""
    of_symbol, compose, image, _ = _monoid()
    n, k = len(symbols), len(image)
    flat = compose.ravel()
    width = max(1, int(np.sqrt(n)) // 4)
    rows = -(-n // width)
    f = np.zeros(rows * width, np.uint16)
    f[:n] = of_symbol[symbols]
    f = np.ascontiguousarray(f.reshape(rows, width).T)  # one column of time steps per block
    prefix = np.zeros((width + 1, rows), np.uint16)
    for j in range(width):
        prefix[j + 1] = flat[prefix[j].astype(np.int32) * k + f[j]]
    entry = np.zeros(rows, np.uint16)
    for i in range(1, rows):
        entry[i] = flat[int(entry[i - 1]) * k + int(prefix[width, i - 1])]
    whole = flat[entry.astype(np.int32)[None, :] * k + prefix[:width]]
    return image[whole.T.ravel()[:n], NONE]


def piece_starts(codepoints: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Positions where a piece starts; `breaks` are positions of separators between texts."""
    if not len(codepoints):
        return np.zeros(0, np.int64)
    kind = codepoint_classes()[codepoints]
    space = kind == 3
    space[breaks] = False
    symbols = np.array([OTHER, LETTER, NUMBER, SPACE_MORE], np.uint8)[kind]
    after = np.ones(len(codepoints), bool)  # white space or an end follows
    after[:-1] = space[1:]
    after[np.asarray(breaks, np.int64)[np.asarray(breaks) > 0] - 1] = True
    last = np.flatnonzero(space & ~after)
    symbols[last] = np.where(codepoints[last] == 0x20, BLANK_LAST, SPACE_LAST)
    quotes = np.flatnonzero(codepoints == 0x27)
    if len(quotes):
        padded = np.concatenate([codepoints, np.zeros(2, codepoints.dtype)])
        padded[breaks] = 0
        one, two = padded[quotes + 1], padded[quotes + 2]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = np.zeros(len(quotes), bool)
        for a, b in ("re", "ve", "ll"):
            double |= (one == ord(a)) & (two == ord(b))
        symbols[quotes[single]] = QUOTE1
        symbols[quotes[double]] = QUOTE2
    symbols[breaks] = BREAK
    return np.flatnonzero(_monoid()[3][_states_before(symbols), symbols])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_pairs(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: merge the adjacent pair of lowest rank until none is left."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 64:
        return _merge_long(word, ranks)
    get, far = ranks.get, sys.maxsize
    scores = [get(a + b, far) for a, b in zip(parts, parts[1:])]
    while scores:
        low = min(scores)
        if low == far:
            break
        i = scores.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del scores[i]
        if i < len(scores):
            scores[i] = get(parts[i] + parts[i + 1], far)
        if i:
            scores[i - 1] = get(parts[i - 1] + parts[i], far)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for very long pieces, with a heap over a linked list: n log n."""
    import heapq

    n = len(word)
    end, after, before, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class _Pieces(dict):
    """Piece -> number; ids of piece p are ids[offset[p]:offset[p+1]]. Emptied between blocks once it is large."""

    LIMIT = 500_000

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks, self.offset, self.ids = ranks, array("q", [0]), array("i")

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.ids.extend(merge_pairs(piece.encode(), self.ranks))
        self.offset.append(len(self.ids))
        return number

    def trim(self) -> None:
        if len(self) > self.LIMIT:
            self.clear()
            self.offset, self.ids = array("q", [0]), array("i")


class Codec:
    """Encodes and decodes blocks of texts with one vocabulary."""

    def __init__(self, path: str) -> None:
        self.ranks = read_ranks(path)
        self.pieces = _Pieces(self.ranks)
        top = max(self.ranks.values()) + 1
        tokens = [b""] * top
        for token, i in self.ranks.items():
            tokens[i] = token
        lengths = np.array([len(t) for t in tokens], np.int64)
        self.token_offset, self.token_bytes = np.concatenate([[0], np.cumsum(lengths)]), np.frombuffer(b"".join(tokens), np.uint8)
        digits = [b"%d," % i for i in range(top)]
        self.digit_length = np.array([len(d) for d in digits], np.int64)
        self.digits = np.zeros((top, max(map(len, digits))), np.uint8)
        for i, d in enumerate(digits):
            self.digits[i, : len(d)] = np.frombuffer(d, np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets: text i has ids[offsets[i]:offsets[i+1]])"""
        self.pieces.trim()
        joined = "\0".join(texts)
        codepoints = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        breaks = (np.cumsum(lengths) + np.arange(len(texts)))[:-1]
        starts = piece_starts(codepoints, breaks)
        stops = np.append(starts[1:], len(joined)) if len(starts) else starts
        is_piece = np.ones(len(starts), bool)
        is_piece[np.searchsorted(starts, breaks)] = False  # a separator is a piece of its own
        starts, stops = starts[is_piece], stops[is_piece]
        number = np.fromiter(map(self.pieces.__getitem__, [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist())]), np.int64, len(starts))
        offset, ids = np.array(self.pieces.offset, np.int64), np.array(self.pieces.ids, np.int32)
        size = offset[number + 1] - offset[number]
        out = ids[csr_take(offset[number], size)]
        first = np.concatenate([[0], np.cumsum(size)])
        at = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]) if len(starts) else np.zeros(len(texts), np.int64)
        return out, np.append(first[at], len(out))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes of all texts, byte offsets of the texts)"""
        size = self.token_offset[ids + 1] - self.token_offset[ids] if len(ids) else np.zeros(0, np.int64)
        data = self.token_bytes[csr_take(self.token_offset[ids], size)].tobytes() if len(ids) else b""
        return data, np.concatenate([[0], np.cumsum(size)])[offsets]

    def decimal(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids as decimals with a comma behind each, and the offsets of the texts in it."""
        if not len(ids):
            return b"", np.zeros(len(offsets), np.int64)
        size = self.digit_length[ids]
        rows = self.digits[ids]
        data = rows[np.arange(rows.shape[1]) < size[:, None]].tobytes()
        return data, np.concatenate([[0], np.cumsum(size)])[offsets]


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """(id, ids array<int>, offsets array<int>): token ids of every text; offsets are the tokens' byte offsets in its UTF-8 form."""
    schema = pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("bpe", codec.cache_clear)
        c = codec(vocabulary)
        for b in slices(batches, "_text", block_bytes):
            ids, at = c.encode(_texts(b.column("_text")))
            size = c.token_offset[ids + 1] - c.token_offset[ids]
            ends = np.concatenate([[0], np.cumsum(size)])
            offsets = (ends[:-1] - np.repeat(ends[at[:-1]], np.diff(at))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for x in (ids, offsets)]
            yield pa.RecordBatch.from_arrays([b.column("_id").cast(pa.int64()), *lists], schema=schema)

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"{id_col} long, ids array<int>, offsets array<int>")


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """(id, data binary): the bytes that the ids of `encode` stand for."""
    schema = pa.schema([(id_col, pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("bpe", codec.cache_clear)
        c = codec(vocabulary)
        for b in batches:
            lists = b.column("ids")
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.concatenate([[0], np.cumsum([len(x) if x is not None else 0 for x in lists.to_pylist()])]).astype(np.int64)
            data, to = c.decode(ids, at)
            yield pa.RecordBatch.from_arrays([b.column("_id").cast(pa.int64()), pa.array([data[i:j] for i, j in zip(to[:-1], to[1:])], pa.binary())], schema=schema)

    return df.select(F.col(id_col).alias("_id"), "ids").mapInArrow(run, f"{id_col} long, data binary")


def round_trip_digests(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, round_trip): encodes, then decodes those ids, a block at a time."""
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("bpe", codec.cache_clear)
        c = codec(vocabulary)
        for b in slices(batches, "_text", block_bytes):
            texts = _texts(b.column("_text"))
            ids, at = c.encode(texts)
            text, to = c.decimal(ids, at)
            data, end = c.decode(ids, at)
            text, raw = memoryview(text), memoryview(data)
            comma = [hashlib.sha256(text[i : max(i, j - 1)]).hexdigest() for i, j in zip(to[:-1].tolist(), to[1:].tolist())]
            plain = [hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(end[:-1].tolist(), end[1:].tolist())]
            same = [raw[i:j] == t.encode() for t, i, j in zip(texts, end[:-1].tolist(), end[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("_id").cast(pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(comma, pa.string()), pa.array(plain, pa.string()), pa.array(same, pa.bool_())], names=names)

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
