"""Chat formatting: reply trees become one conversation per chosen branch, in DataFrame functions only.

Iterative self-joins double the reach of every message's pointer to its ancestors, so a thread of n
messages takes log2(n) joins. They give each message its depth and the score of its path; leaves are
ranked by that score, and the stored pointers, taken from the longest to the shortest, then list
the messages of each chosen root-to-leaf path.

The template marks turns with control strings and escapes every control string inside a text, so
that the text can be read back exactly. The loss mask is a list of code point spans.

Defined results: null texts and roles count as empty; a null tree id is a tree of its own; a parent
that does not exist makes its child a root; messages on or below a cycle have no root and are left
out; equal scores prefer the longer path, then the smaller leaf; several roots in a tree compete as
branches; extra input columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, TEXT, END = "<|start|>", "<|text|>\n", "<|end|>\n"
#: Strings that a text may not show to a tokenizer as they are. All markers of the template begin with the first.
CONTROLS = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    r"""Double each backslash, then put `\!` behind the first character of each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\!" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    r"""Inverse of `escape`: between doubled backslashes every `\!` is one that was put in."""
    parts = F.transform(F.split(text, r"\\\\"), lambda s: F.replace(s, F.lit("\\!"), F.lit("")))
    return F.array_join(parts, "\\")


def branches(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """(tree, leaf, node, depth, rank): the messages of the best `per_tree` root-to-leaf paths of each tree.

    `messages` has tree (not null), node (unique in its tree), parent and score.
    """
    m = messages.select("tree", "node", "parent", F.coalesce(F.col("score"), F.lit(0.0)).cast("double").alias("score")).checkpoint()
    known = m.select("tree", F.col("node").alias("parent"), F.lit(True).alias("found"))
    state = m.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("found"), F.col("parent")).alias("up"), F.when(F.col("found"), 1).otherwise(0).cast("long").alias("hops"), F.col("score").alias("total")
    ).checkpoint()
    parents = state.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    levels = []
    for _ in range(math.ceil(math.log2(max(2, m.count()))) + 1):
        reach = state.where("up is not null").select("tree", "node", "up")
        if reach.isEmpty():
            break
        levels.append(reach)
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"), F.col("total").alias("total2"))
        # Only messages that still have an ancestor ahead take part; all others keep what they have.
        moved = state.where("up is not null").join(above, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("hops") + F.col("hops2")).alias("hops"), (F.col("total") + F.col("total2")).alias("total"))
        state = moved.unionByName(state.where("up is null")).checkpoint()
    rooted = state.where("up is null").select("tree", "node", F.col("hops").alias("depth"), "total")
    order = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "node")
    leaves = rooted.join(parents, ["tree", "node"], "left_anti")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_tree).select("tree", F.col("node").alias("leaf"), "node", "rank").checkpoint()
    for reach in reversed(levels):
        chosen = chosen.unionByName(chosen.join(reach, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), "rank")).checkpoint()
    return chosen.join(rooted.select("tree", "node", "depth"), ["tree", "node"])


def format_paths(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per (tree, leaf): the formatted text and the spans (start, length; code points) under the loss mask.

    `turns` has tree, leaf, depth, role and text. A path is one output row, so its turns meet in one task.
    """
    role, body = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), role, F.lit(TEXT))
    shown = turns.select("tree", "leaf", "depth", head.alias("head"), body.alias("body"), F.coalesce(F.col("role") == learn, F.lit(False)).alias("learn"))
    shown = shown.withColumn("whole", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = shown.withColumn("at", F.coalesce(F.sum(F.length("whole")).over(before), F.lit(0)))
    path = F.sort_array(F.collect_list(F.struct("depth", "whole", (F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"), "learn")))
    spans = lambda p: F.transform(F.filter(p, lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return placed.groupBy("tree", "leaf").agg(path.alias("path")).select("tree", "leaf", F.array_join(F.col("path.whole"), "").alias("formatted"), spans(F.col("path")).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) from a formatted conversation."""
    turns = F.filter(F.split(formatted, r"\Q" + END + r"\E"), lambda t: t != "")
    mid = lambda t: F.instr(t, TEXT)
    return F.transform(turns, lambda t: F.struct(
        unescape(F.substr(t, F.lit(len(START) + 1), mid(t) - len(START) - 1)).alias("role"),
        unescape(F.substr(t, mid(t) + len(TEXT))).alias("text"),
    ))


def conversations_as_trees(df: DataFrame) -> DataFrame:
    """A conversation's rows, in the order of their turns, as a tree in which each row answers the one before."""
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = df.select(tree.alias("tree"), "conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def format_trees(messages: DataFrame, per_tree: int = 1, learn: str = "assistant") -> DataFrame:
    """(tree, leaf, formatted, loss_spans) of the best branches; `messages` has tree, node, parent, score, role, text."""
    paths = branches(messages, per_tree)
    turns = paths.join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    return format_paths(turns, learn)


def conversation_digests(df: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from the formatted text."""
    messages = conversations_as_trees(df).checkpoint()
    formatted = format_trees(messages).checkpoint()
    turns = read_back(F.col("formatted"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    figures = formatted.select("tree", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return figures.select(
        F.when(F.col("tree") != "null", F.col("tree").cast("long")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: DuckDB SQL of the query: the same digests from the rows themselves, and the template's length.
ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM c
), e AS (
  SELECT *, length({{escaped_role}}) + length({{escaped_text}}) + {len(START + TEXT + END)} AS shown FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '')) AS loss_sha256,
       sum(shown)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def _escaped(column: str) -> str:
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '!{c[1:]}')"
    return out


ORACLE = ORACLE.format(escaped_role=_escaped("role"), escaped_text=_escaped("text"))
