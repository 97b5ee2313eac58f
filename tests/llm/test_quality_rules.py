import re
from collections import Counter

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import quality_rules as Q
from tests.llm.fixtures import EXTRA, documents, ordered, rows, words

FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def repeated(own, width=8):
    windows = [tuple(own[i : i + width]) for i in range(len(own) - width + 1)]
    often = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(width)})


def fails(line):
    if not words(line):
        return False
    separators = len(re.findall(Q.SEPARATORS, line))
    return (
        not re.search(r"""[.!?…。！？]["')\]»”’]*(?:[ \t-\r]|$)""", line)
        or separators >= 3 and separators * 4 >= line.count(" ") + 1
        or len(line) < 200 and any(regex.search(rf"(?<![\p{{L}}\p{{N}}]){regex.escape(p)}(?![\p{{L}}\p{{N}}])", line.lower()) for p in Q.PHRASES)
        or len(re.findall(r"[#*$%&|<>{}\\^~=]", line)) * 10 > len(line)
    )


def brute(text):
    text = text or ""
    own, lines = words(text), text.split("\n")
    worded = [x for x in lines if words(x)]
    n = repeated(own)
    bad = len(own) < 20 or 100 * n > 30 * len(own)
    lost = sum(len(x) for x in lines if fails(x))
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(worded) - len(set(worded)), n, bad, not bad and lost * 100 <= len(text) * 50


def test_figures_equal_brute_force(spark):
    long = " ".join(f"w{i % 3700}" for i in range(9000))  # very long, most of it repeated
    given = [*rows(), (200, long + ".", "en", "s", 1), (201, long[:30_000] + "\nzum Inhalt springen.\nEnd.", "en", "s", 1)]
    got = Q.assess(documents(spark, given)).select("doc_id", *[f"rules.{c}" for c in FIGURES])
    assert ordered(got.collect()) == ordered((r[0], *brute(r[1])) for r in given)
    assert brute(given[-2][1])[4] > 3000


def test_input_columns_stay(spark):
    df = documents(spark)
    out = Q.assess(df, out_col="verdict")
    assert out.columns == [*df.columns, "verdict"] and set(EXTRA) <= set(out.columns)
    assert Q.assess(df.where("false"), out_col="verdict").count() == 0


def test_a_column_named_as_the_verdict_is_replaced(spark):
    for name in ("rules", "RULES"):
        df = spark.createDataFrame([("A good line of words, with an end. " * 3, "clash", "stays")], f"text string, {name} string, rules_ string")
        out = Q.assess(df)
        assert out.columns == ["text", "rules_", "rules"]
        row = out.select("rules.n_words", "rules_").first()
        assert tuple(row) == (24, "stays")


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n"), max_size=120), min_size=5, max_size=30))
def test_repeats(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    split = F.filter(F.split("t", "[ \t-\r]+"), lambda w: w != "")
    got = {r.i: r.n for r in df.select("i", Q.repeated_words(split, 3).alias("n")).collect()}
    assert got == {i: repeated(words(t), 3) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("line", "bad"), [("A sentence.", False), ("He said “so.” Then more", False), ("no end here", True), ("Home | About | News | Contact.", True), ("All Rights Reserved.", True), ("### $$$ %%% end.", True), ("   ", False), ("", False), ("19.37.233.111", True), ("He read the catalog in the library.", False), ("They design upgrades for it.", False), ("A blog in French.", False), ("Please log in.", True), ("Nach oben!", True), ("Tous droits réservés.", True), ("Conditions d'utilisation.", True), ("Haz clic aquí.", True), ("Leer máscaras.", False)])
def test_lines(spark, line, bad):
    assert spark.createDataFrame([(line,)], "l string").select(Q.line_fails(F.col("l")).alias("x")).first().x == bad == fails(line)


def test_cleaning_takes_failing_lines_out(spark):
    text = "A good line of words, with an end.\nHome | About | News | Contact\n" + "Words go on and on and they stop. " * 5
    row = Q.assess(spark.createDataFrame([(text,)], "text string")).select("rules.*").first()
    assert row.lines_removed == 1 and "Home" not in row.clean_text and row.clean_text.startswith("A good line")
