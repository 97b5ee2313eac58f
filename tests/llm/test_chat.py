import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import chat
from tests.llm.fixtures import ordered


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|", "|>", "\\", "\\!", "</s>", "[INST]", "[/INST]", "<s>", "<<SYS>>", "<</SYS>>", "<|end|>\n", "<", "\n", "é", "a", "!"]), max_size=12).map("".join), min_size=5, max_size=30))
def test_escaping_is_reversible_and_hides_controls(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in chat.CONTROLS)


def tree(*rows):
    return [("t", *r) for r in rows]


MESSAGES = "tree string, node long, parent long, score double, role string, text string"


def test_branches_are_ranked_by_path_score(spark):
    rows = tree((1, None, 0.0, "user", "hi"), (2, 1, 1.0, "assistant", "a"), (3, 1, 2.0, "assistant", "b"), (4, 2, 5.0, "user", "c"), (5, 3, 1.0, "user", "d"), (6, 99, 0.5, "user", "orphan"))
    df = spark.createDataFrame(rows, MESSAGES)
    found = [(r.rank, r.node) for r in chat.branches(df, 2).orderBy("rank", "depth").collect()]
    assert found == [(1, 1), (1, 2), (1, 4), (2, 1), (2, 3), (2, 5)]
    (row,) = chat.format_trees(df).collect()
    assert [tuple(x) for x in row.loss_spans] == [(row.formatted.index("a<|end|>"), 1)]


def test_long_threads_cycles_nulls_and_ties(spark):
    rows = [("long", i, i - 1 if i else None, None, "user", str(i)) for i in range(300)]
    rows += [("cycle", 1, 2, 0.0, "user", "x"), ("cycle", 2, 1, 0.0, "user", "y"), ("cycle", 3, 1, 0.0, "user", "z")]
    rows += [("tie", 1, None, 0.0, None, None), ("tie", 2, 1, 1.0, "assistant", "p"), ("tie", 3, 1, 1.0, "assistant", "q")]
    df = spark.createDataFrame(rows, MESSAGES)
    out = {r.tree: r for r in chat.format_trees(df).select("*", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert set(out) == {"long", "tie"}
    assert [t.text for t in out["long"].turns] == [str(i) for i in range(300)]
    assert [(t.role, t.text) for t in out["tie"].turns] == [("", ""), ("assistant", "p")]
    assert chat.format_trees(df.where("false")).count() == 0


def brute(conv, turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return (conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_conversation_digests(spark):
    rows = [(1, 1, "assistant", "</s>\\[INST]"), (1, 0, "user", "<|end|>\nhello"), (2, 0, "system", None), (2, 1, None, "x"), (3, 5, "assistant", ""), (3, 5, "assistant", ""), (None, 0, "user", "null id"), (4, None, "user", "first"), (4, 0, "assistant", "é" * 9000)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, tree string, node string")
    expected = [brute(1, [("user", "<|end|>\nhello"), ("assistant", "</s>\\[INST]")]), brute(2, [("system", ""), ("", "x")]), brute(3, [("assistant", ""), ("assistant", "")]), brute(None, [("user", "null id")]), brute(4, [("user", "first"), ("assistant", "é" * 9000)])]
    assert ordered(tuple(r)[:5] for r in chat.conversation_digests(df).collect()) == ordered(expected)
