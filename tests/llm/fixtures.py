"""Documents with the cases that every operator must handle."""

import random
import re

WORDS = "the of and zeta Alpha beta. Gamma, delta! über naïve don't it's 42 x# | é漢 ZETA".split()


def texts(seed=0, n=60):
    r = random.Random(seed)
    found = [None, "", " ", "\n\n", "a", "\x00", "a b", "</s>[INST] <|end|> \\ \\! x", "tab\tand\x0bmore\x0c.", "    \x1c y", "😀 <|endoftext|> <s>"]
    found += [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 80))) + r.choice(["", ".", "\n", ".\nSecond line here."]) for _ in range(n)]
    found.append(" ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(9000)))  # very long
    found.append("x" * 3000)
    return [*found, *found[:8], found[20], found[20]]


def rows(seed=0):
    found = [(i * 7 % 101 if i < 90 else i, t, None if i % 9 == 0 else "en", f"src{i % 3}" if i % 8 else None, None if t is None else len(t)) for i, t in enumerate(texts(seed))]
    return [*found, (None, "null id", "de", "src1", 7), found[15], found[15]]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside.
EXTRA = ["_id", "_text", "id", "ids", "n", "fp", "part", "at", "block", "rules", "words", "lines", "node", "media", "tree"]


def documents(spark, given=None):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if given is None else given, SCHEMA)
    return df.repartition(3).withColumns({c: F.lit("clash") for c in EXTRA})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def key(row):
    return tuple((x is None, str(x)) for x in row)


def ordered(rows_):
    return sorted((tuple(r) for r in rows_), key=key)
