"""Packing: concatenate and cut.

Pass 1 tokenises every document into a written table and records where it starts inside its
partition. The partitions' token totals (one row per partition) get a prefix sum, which gives
every document its global offset. Pass 2 cuts that one long token stream into fixed windows:
each window is a sequence, and each (document, window) overlap is a piece with boundary marks.
No document is sorted or shuffled, and only the last sequence can be short.

Defined results: a null text counts as empty; an empty text is the single end id; repeated rows
are packed as often as they come; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import claim_worker, csr_take, slices, written

#: White space beyond ASCII, and separators that str.split() takes for white space but the vocabulary does not.
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_SPLIT = re.compile("[ \t-\r]+")
_TAIL = ".,!?;:"


class _Numbers(dict):
    """Chunk -> number, given on first sight; `new` collects the chunks whose ids are still to be learnt."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        self.new.append(chunk)
        return number


class Words:
    """Token ids by white-space separated chunk, cached; new chunks are encoded by the tokenizer.

    Neither normalising nor pre-tokenising reaches across ASCII white space, so a text's ids are
    its chunks' ids. A chunk of Latin-1 letters with stop marks behind it is looked up by its
    lower-cased letters; new ones are encoded together and told apart by the word-end ids. When the
    cache is full, chunks that came once since the last time go first.
    """

    LIMIT = 450_000
    MOST_LETTERS = 200_000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # For lower-cased letters the vocabulary's own normalising and splitting change nothing; the plain splitter is faster.
        self.letter_tokenizer = Tokenizer(self.tokenizer.model)
        self.letter_tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = "x y,"
        self.by_chunk = bool(self.is_end.any()) and self._ids([probe])[0].tolist() == [*self._ids(["x"])[0], *self._ids(["y"])[0], *self._ids([","])[0]] == [*self._ids(["X"])[0], *self._ids(["y,"])[0]]
        self._clear()

    def _clear(self) -> None:
        self.number = _Numbers()
        self.letters: dict[str, bytes] = {}
        self.offset, self.ids, self.uses = array("q", [0]), array("I"), np.zeros(0, np.int64)

    def _trim(self) -> None:
        """Keep the more often used half of the cache at most."""
        least = 2
        while np.count_nonzero(self.uses >= least) > self.LIMIT // 2:
            least *= 2
        kept = np.flatnonzero(self.uses >= least)
        offset, ids = np.array(self.offset, np.int64), np.array(self.ids, np.uint32)
        size = offset[kept + 1] - offset[kept]
        chosen = (self.uses >= least).tolist()
        words_ = [w for w, keep in zip(self.number, chosen) if keep]
        uses = self.uses[kept] // 2  # older uses count for less
        letters = self.letters if len(self.letters) <= self.MOST_LETTERS else {}
        self._clear()
        self.letters = letters
        self.number.update(zip(words_, range(len(words_))))
        self.offset.frombytes(np.cumsum(size).tobytes())
        self.ids.frombytes(ids[csr_take(offset[kept], size)].tobytes())
        self.uses = uses

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, ids: list[bytes]) -> None:
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) // 4 + len(self.ids)
        self.offset.frombytes(ends.tobytes())
        self.ids.frombytes(b"".join(ids))

    def _learn(self, chunks: list[str], end: bytes) -> None:
        known, cores, tails, plain = self.letters, [], [], []
        for c in chunks:
            core = c.rstrip(_TAIL)
            if core.isalpha() and (core.isascii() or max(core) < "\u0100"):
                cores.append(core.lower())
                tails.append(c[len(core) :])
            else:
                cores.append(None)
                tails.append("")
                plain.append(c)
        new = [c for c in set(cores) if c is not None and c not in known]
        for at in range(0, len(new), 2000):
            part = new[at : at + 2000]
            ids = np.array(self.letter_tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.is_end[ids]) + 1
            if len(stops) != len(part):
                raise ValueError("a word has no single word-end id")
            data = ids.tobytes()
            edges = [0, *(4 * stops).tolist()]
            known.update(zip(part, [data[i:j] for i, j in zip(edges, edges[1:])]))
        known[""] = b""
        new = [t for t in set(tails) if t not in known]
        known.update(zip(new, [x.tobytes() for x in self._ids(new)]))
        other = iter([x.tobytes() for at in range(0, len(plain), 2000) for x in self._ids(plain[at : at + 2000])])
        rows = [next(other) if c is None else known[c] + known[t] for c, t in zip(cores, tails)]
        self._add([end if c == "\n" else x for c, x in zip(chunks, rows)] if "\n" in plain else rows)

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with `end` behind each, offsets of the texts)"""
        if not self.by_chunk:
            rows = [np.append(x, np.uint32(end)) for x in self._ids(texts)]
            return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        if len(self.number) > self.LIMIT:
            self._trim()
        chunks: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = t.split() if not _ODD.search(t) else [x for x in _SPLIT.split(t) if x]
            counts[i] = len(own)
            chunks += own
            chunks.append("\n")  # stands for the end id; no chunk has white space
        number = np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))
        if self.number.new:
            self._learn(self.number.new, np.array([end], np.uint32).tobytes())
            self.number.new = []
        seen = np.bincount(number, minlength=len(self.number))
        seen[: len(self.uses)] += self.uses
        self.uses = seen
        offset, ids = np.array(self.offset, np.int64), np.array(self.ids, np.uint32)
        size = offset[number + 1] - offset[number]
        stops = np.cumsum(size)
        return ids[csr_take(offset[number], size)], np.concatenate([[0], stops[np.cumsum(counts + 1) - 1]])


@lru_cache(2)
def words(path: str) -> Words:
    return Words(path)


def tokenise(df: DataFrame, tokenizer: str, end: int, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """Pass 1: (part, at, id, n, ids): `at` is the row's first token in its partition, ids are little-endian."""
    names = ["part", "at", id_col, "n", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim_worker("packing", words.cache_clear)
        part, at = TaskContext.get().partitionId(), 0
        w = words(tokenizer)
        kind = "<u2" if len(w.is_end) <= 1 << 16 else "<u4"
        for b in slices(batches, "_text", block_bytes):
            ids, edges = w.encode(["" if t is None else t for t in b.column("_text").to_pylist()], end)
            data, wide = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
            cut = (edges * wide).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part, np.int32)), pa.array(edges[:-1] + at), b.column("_id").cast(pa.int64()), pa.array(np.diff(edges)), pa.array([data[i:j] for i, j in zip(cut, cut[1:])], pa.binary())], names=names)
            at += int(edges[-1])

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"part int, at long, {id_col} long, n long, ids binary")


def pack(df: DataFrame, tokenizer: str, end: int = 2, length: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, block_bytes: int = 2 << 20) -> DataFrame:
    """Pieces of all documents in sequences of `length` tokens.

    (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, starts_document, ends_document,
    sequence_tokens, padded_tokens[, ids array<long>]). A sequence is padded to `length`, except where
    its own size is a power of two.
    """
    tokens = written(tokenise(df, tokenizer, end, id_col, text_col, block_bytes), "packing-tokens")
    # One row per partition of pass 1, so the window and the broadcast are bounded by its task count.
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = totals.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base"), F.sum("total").over(everything).alias("everything"))
    schema = f"{id_col} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, starts_document boolean, ends_document boolean, sequence_tokens long, padded_tokens long" + ", ids array<long>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for b in batches:
            rows: list[list] = [[] for _ in names]
            columns = (b.column(c).to_pylist() for c in ("_id", "n", "first", "everything", "ids"))
            for doc, n, first, total, data in zip(*columns):
                kind = "<u2" if len(data) == 2 * n else "<u4"
                ids = np.frombuffer(data, kind).astype("<u4")
                raw = memoryview(ids.tobytes())
                start = 0
                while start < n:
                    sequence, offset = divmod(first + start, length)
                    size = min(n - start, length - offset)
                    used = min(length, total - sequence * length)
                    padded = used if used & (used - 1) == 0 else length
                    row = (doc, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), n, sequence, offset, start == 0, start + size == n, used, padded)
                    for out, x in zip(rows, row):
                        out.append(x)
                    if with_ids:
                        rows[-1].append(ids[start : start + size].astype(np.int64))
                    start += size
            kinds = [pa.bool_() if x.startswith(("starts", "ends")) else pa.list_(pa.int64()) if x == "ids" else pa.int64() for x in names]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names=names)

    placed = tokens.join(F.broadcast(bases), "part").select(F.col(id_col).alias("_id"), "n", (F.col("base") + F.col("at")).alias("first"), "everything", "ids")
    return placed.mapInArrow(cut, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, document_starts): whole sequences from `pack(..., with_ids=True)`; a group holds `length` tokens at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "starts_document", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.flatten(F.col("parts.ids")).alias("ids"),
        F.transform(F.filter("parts", lambda p: p["starts_document"]), lambda p: p["offset"]).alias("document_starts"),
    )
