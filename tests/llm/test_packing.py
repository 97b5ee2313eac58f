import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from larkspur.llm import packing
from tests.llm.fixtures import documents, rows

PATH = P.path("word_bpe_49k.json")
REFERENCE = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*REFERENCE.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab'sDtÀé.,! \n\t\x1c\x85  1²İßªΣσ"), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=5))
def test_chunk_ids_equal_the_library(texts):
    w = packing.words(PATH)
    assert w.by_chunk
    ids, at = w.encode(texts, 2)
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [ids_of(t) for t in texts]


def test_special_strings():
    w = packing.words(PATH)
    for t in ("<|endoftext|>", "a<|endoftext|>b", "x <|startoftext|>."):
        assert w.encode([t], 2)[0].tolist() == ids_of(t)


def test_pieces_tile_documents_and_sequences(spark):
    length = 256
    df = packing.pack(documents(spark), PATH, length=length, with_ids=True, block_bytes=3000)
    pieces = df.collect()
    documents_, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        documents_[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    expected = defaultdict(list)
    for r in rows():
        expected[r[0]].append(ids_of(r[1]))
    for doc, own in documents_.items():
        found, current = [], []
        for p in sorted(own, key=lambda p: (p.sequence_id, p.offset)):
            assert p.starts_document == (p.start == 0) and p.start == len(current)
            current += p.ids
            if p.ends_document:
                assert len(current) == p.doc_tokens
                found.append(current)
                current = []
        assert sorted(found) == sorted(expected[doc])
    total = sum(p.length for p in pieces)
    assert sorted(sequences) == list(range(-(-total // length)))
    for i, own in sequences.items():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        used = sum(p.length for p in own)
        assert used == own[0].sequence_tokens == (length if i < len(sequences) - 1 else total - i * length)
        assert own[0].padded_tokens == (used if bin(used).count("1") == 1 else length)
    whole = {r.sequence_id: r for r in packing.sequences(df).collect()}
    assert all(whole[i].ids == [x for p in own for x in p.ids] for i, own in sequences.items())


def test_empty_table(spark):
    assert packing.pack(documents(spark).where("false"), PATH).count() == 0


def test_cache_keeps_what_is_used(monkeypatch):
    monkeypatch.setattr(packing.Words, "LIMIT", 6)
    w = packing.Words(PATH)
    for t in ("often often once twice twice, four five six seven", "often eight. nine ten eleven twice", "often once twice 12 13 14 15", "", "often Once"):
        ids, at = w.encode([t, t], 2)
        assert ids[: at[1]].tolist() == ids[at[1] :].tolist() == ids_of(t)
        assert "often" in w.number or not t
