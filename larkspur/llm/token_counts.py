"""Token counts: batched sentencepiece encoding in Arrow functions that return lengths only.

Batches are balanced by bytes, not rows. Long texts are split at safe boundaries: a single
blank between two characters that are no blanks. No piece of the vocabulary has a word mark
behind another character (checked when it is loaded), so no merge crosses such a blank, and
the dummy prefix of the right part stands for the blank; the parts' counts add up exactly.
Where a vocabulary fails that check, texts are encoded whole.

Defined results: a null text counts as empty; an empty text has 0 bytes and 0 tokens; repeated
rows each give a row; extra input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import claim_worker, slices

MARK = "▁"


@lru_cache(2)
def processor(path: str):
    """(sentencepiece processor, whether cutting at lone blanks is safe)"""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (p.id_to_piece(i) for i in range(p.get_piece_size()))
    inner = any(MARK in piece.lstrip(MARK) for piece in pieces)
    probe = p.encode("a b\n c") == [*p.encode("a"), *p.encode("b\n c")]
    return p, probe and not inner


def safe_parts(text: str, part_chars: int) -> list[str]:
    """Parts of about `part_chars` characters; the blank at each cut is dropped, as the dummy prefix replaces it."""
    parts, start, n = [], 0, len(text)
    while n - start > part_chars:
        cut = text.find(" ", start + part_chars)
        while cut != -1 and cut + 1 < n and (text[cut - 1] in (" ", MARK) or text[cut + 1] in (" ", MARK)):
            cut = text.find(" ", cut + 1)
        if cut == -1 or cut + 1 >= n:
            break
        parts.append(text[start:cut])
        start = cut + 1
    parts.append(text[start:])
    return parts


def count_tokens(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, batch_bytes: int = 1 << 20, part_chars: int = 16_384) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; `over_limit` is n_tokens > `limit`."""
    names = [id_col, "n_bytes", "n_tokens", "over_limit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("token_counts")
        p, safe = processor(model)
        for b in slices(batches, "_text", batch_bytes):
            texts = ["" if t is None else t for t in b.column("_text").to_pylist()]
            parts: list[str] = []
            owner: list[int] = []
            for i, t in enumerate(texts):
                if safe and len(t) > part_chars:
                    cut = safe_parts(t, part_chars)
                    parts += cut
                    owner += [i] * len(cut)
                else:
                    parts.append(t)
                    owner.append(i)
            sizes = np.fromiter(map(len, p.encode(parts, num_threads=1)), np.int64, len(parts))
            tokens = np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64)
            n_bytes = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column("_id").cast(pa.int64()), pa.array(n_bytes), pa.array(tokens), pa.array(tokens > limit)], names=names)

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean")
