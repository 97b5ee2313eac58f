import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import token_counts
from tests.llm.fixtures import documents, ordered, rows

PATH = P.path("piece_bpe_32k.model")
REFERENCE = sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab  \n▁é.漢<s>"), max_size=80), st.integers(1, 9))
def test_parts_add_up(text, size):
    assert sum(len(REFERENCE.encode(p)) for p in token_counts.safe_parts(text, size)) == len(REFERENCE.encode(text))


def test_counts(spark):
    got = token_counts.count_tokens(documents(spark), PATH, limit=50, batch_bytes=3000, part_chars=100).collect()
    assert ordered(got) == ordered((r[0], len((r[1] or "").encode()), n := len(REFERENCE.encode(r[1] or "")), n > 50) for r in rows())
    assert token_counts.processor(PATH)[1]
    assert token_counts.count_tokens(documents(spark).where("false"), PATH).count() == 0
