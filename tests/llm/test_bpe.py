import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import bpe
from tests.llm.fixtures import documents, ordered, rows

PATH = P.path("byte_bpe_multi_50k.tiktoken")
CODEC = bpe.codec(PATH)
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab'sDtlrevm  \n\t\x1c\x85 1²,.!漢\0"), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=6))
def test_ids_equal_the_library(texts):
    ids, at = CODEC.encode(texts)
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [REFERENCE.encode_ordinary(t) for t in texts]
    data, to = CODEC.decode(ids, at)
    assert [data[i:j].decode() for i, j in zip(to, to[1:])] == texts


def test_long_pieces_and_merges_agree():
    for word in ("x" * 500, "abc" * 300, "é漢" * 200):
        assert bpe.merge_pairs(word.encode(), CODEC.ranks) == bpe._merge_long(word.encode(), CODEC.ranks) == REFERENCE.encode_ordinary(word)


def test_cache_is_emptied_between_blocks(monkeypatch):
    c = bpe.Codec(PATH)
    monkeypatch.setattr(bpe._Pieces, "LIMIT", 3)
    for t in ("one two three four five", "six seven one two", "one"):
        ids, _ = c.encode([t])
        assert ids.tolist() == REFERENCE.encode_ordinary(t)


def brute(text):
    ids = REFERENCE.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), True


def test_query_digests(spark):
    got = bpe.round_trip_digests(documents(spark), PATH, block_bytes=2000).collect()
    assert ordered(got) == ordered((r[0], *brute(r[1])) for r in rows())


def test_encode_then_decode(spark):
    df = documents(spark)
    encoded = bpe.encode(df, PATH, block_bytes=2000)
    for r in encoded.take(20):
        data = [CODEC.token_bytes[CODEC.token_offset[i] : CODEC.token_offset[i + 1]].tobytes() for i in r.ids]
        assert r.offsets == [int(x) for x in np.cumsum([0, *map(len, data)])[:-1]]
    back = bpe.decode(encoded, PATH).collect()
    assert ordered((r.doc_id, bytes(r.data)) for r in back) == ordered((r[0], (r[1] or "").encode()) for r in rows())


def test_empty_table(spark):
    assert bpe.round_trip_digests(documents(spark).where("false"), PATH).count() == 0
