import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from larkspur.llm.common import table
from tests.llm.fixtures import EXTRA, SCHEMA, documents, rows, words
from tests.llm.test_cotraining import brute_scores
from tests.llm.test_packing import ids_of
from tests.llm.test_quality_rules import brute as brute_rules
from tests.llm.test_quality_rules import fails
from tests.llm.test_simhash import exact_components

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are missing")
def test_stages_and_run(spark, tmp_path):
    from larkspur.llm import quality_rules

    docs = table(spark, SF, "documents")
    columns, given, sizes = docs.columns, docs, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if k < 3:
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
            sizes.append(docs.count())
        if k == 0:
            assert docs.count() == quality_rules.assess(given).where("rules.kept").count()
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert docs.where("starts_document").count() == sizes[-1]
    again = corpus_pipeline.run(spark, SF)
    assert again.agg({"length": "sum"}).first()[0] == docs.agg({"length": "sum"}).first()[0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are missing")
def test_good_documents_are_kept(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    good = labels.where("quality = 1").join(docs, "doc_id").selectExpr("doc_id", "size(split(trim(text), '[ \t-\r]+')) as n").where("n >= 20")
    ruled = corpus_pipeline.quality_rules_stage(spark, docs, sf)
    kept = corpus_pipeline.quality_classifier_stage(spark, ruled, sf)
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.01 * good.count()
    bad = labels.where("quality = 0")
    assert bad.join(kept, "doc_id", "left_semi").count() <= 0.02 * bad.count()


def corpus():
    """Good and bad prose, with copies, pairs on both sides of a similarity of 0.8, lines to be removed, and nulls."""
    r = random.Random(12)
    given, labels = [], []
    for i in range(150):
        good = r.random() < 0.7
        own = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(r.randint(24, 60))]
        text = " ".join(own) + "." if good else " ".join(w + r.choice(["!", "?!", ";"]) for w in own) + "."
        if i % 7 == 0:
            text += "\nHome | About | News | Contact"
        source = f"src{r.randrange(3) + (0 if good else 2)}"
        given.append((i, text, "en", source, len(text)))
        if i % 3:
            labels.append((i, int(good)))
        if i % 4 == 0:  # a near copy: some of the last words differ
            k = (1, 2, 3, 5, 7, 9)[i // 4 % 6]
            lines = text.split("\n")
            other = " ".join([*lines[0].split()[:-k], *(f"changed{j}" for j in range(k))]) + "."
            given.append((1000 + i, "\n".join([other, *lines[1:]]), "en", source, len(text)))
        if i % 10 == 0:
            given.append((2000 + i, text, "en", source, len(text)))
    given += [(3000, None, None, None, None), (3001, "", "en", "src0", 0), (3002, "too short.", "en", "src0", 10)]
    return given, labels


def test_run_equals_brute_force(spark, tmp_path):
    given, labels = corpus()
    spark.createDataFrame(given, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    ruled = []
    for d, t, lang, source, _ in given:
        if brute_rules(t)[-1]:
            clean = "\n".join(x for x in t.split("\n") if not fails(x))
            ruled.append((d, clean, lang, source, len(clean)))
    known = [(i, y) for i, y in labels if i in {r[0] for r in ruled}]
    scores = brute_scores(ruled, known, 5, 1000, 0.95)
    assert min(abs(p - 0.5) for p in scores.values()) > 1e-4
    good = [r for r in ruled if scores[r[0]] >= 0.5]
    groups = exact_components(good)
    kept = {r[0]: ids_of(r[1]) for r in good if groups[r[0]] == r[0]}
    assert len(given) > len(ruled) > len(good) > len(kept) > 50
    near = [d for d, c in groups.items() if d != c]
    assert any(1000 <= d < 2000 for d in near) and any(1000 <= d < 2000 for d in kept) and any(d >= 2000 for d in near)

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    found = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        found.setdefault(p.doc_id, []).append(p)
    assert set(found) == set(kept)
    for d, own in found.items():
        assert sum(p.length for p in own) == own[0].doc_tokens == len(kept[d])
        assert [zlib.crc32(np.array(kept[d][p.start : p.start + p.length], "<u4").tobytes()) for p in own] == [p.ids_crc32 for p in own]
    assert len({p.sequence_id for p in pieces}) == -(-sum(map(len, kept.values())) // 4096)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_and_odd_rows(spark, tmp_path, k):
    """Nulls in any column, repeated rows, long texts, clashing columns and an empty table."""
    name, stage = corpus_pipeline.STAGES[k]
    spark.createDataFrame([(r[0], i % 2) for i, r in enumerate(rows())], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(spark).withColumnRenamed("rules", "RULES").selectExpr("*", "1 as rules_", "2 as text_")
    out = stage(spark, docs, str(tmp_path))
    assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    if k == 3:
        assert Counter(r.doc_id for r in out.where("starts_document").collect()) == Counter(r[0] for r in rows())
        return
    assert out.columns == docs.columns and out.schema["rules_"].dataType == docs.schema["rules_"].dataType
    got = out.collect()
    assert set(EXTRA) - {"rules"} <= set(out.columns) and all(r.rules_ == 1 and r.RULES == "clash" for r in got)
    if k == 0:
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows() if brute_rules(r[1])[-1])
    if k == 2:
        ids = [r.doc_id for r in got if r.doc_id is not None]
        assert len(ids) == len(set(ids)) and sum(r.doc_id is None for r in got) == 1
        assert sum(not words(r.text) for r in got) <= 1
