"""The corpus pipeline: quality rules, quality classifier, near-duplicate removal, packing.

`STAGES` lists (name, function) in order; each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next stage's `docs`. All stages but the
last return the columns of `documents`; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import cotraining, packing, quality_rules, simhash_similar
from larkspur.llm.common import discard, scratch_path, table, unused
from larkspur.llm.queries import tokenizer


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines are taken out of the texts; documents that the rules reject go.

    A null or empty text has too few words and goes; rows are judged one by one, so repeated ones share their fate and ids
    may be null; other columns stay whatever their names; an empty table stays empty.
    """
    rules = unused(docs, "rules")
    judged = quality_rules.assess(docs, out_col=rules).where(F.col(rules)["kept"])
    cleaned = judged.withColumn("text", F.col(rules)["clean_text"]).withColumn("n_chars", F.length("text").cast("long"))
    return cleaned.select(*docs.columns)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A classifier is co-trained on what came in; documents that it takes for bad go.

    Null texts have features of zero and null metadata is a value of its own; a repeated id trains once and each of its
    rows is judged; rows with a null id are judged and never train; of equally sure documents the smaller id is taught first;
    with labels of fewer than two classes all documents have the share of good labels as their score; an empty table stays empty.
    """
    return cotraining.filtered(docs, cotraining.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id: five-word shingles, similarity 0.8 or more.

    Null and wordless texts are one group; rows with a null id stay; a repeated id stays once (which of several
    texts under it stays is not defined); an empty table stays empty.
    """
    return simhash_similar.one_of_each(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null or empty text is its end token, repeated rows are packed as often as they come."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("simhash_near_dedup", near_duplicates_stage),
    ("packing", packing_stage),
]
#: No SQL: the classifier's fit is not expressible. tests/llm/test_pipeline.py holds run() against brute-force versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the table `documents`; all tables between but the last are deleted again."""
    docs, paths = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        paths.append(scratch_path(spark, f"pipeline-{name}"))
        stage(spark, docs, sf_dir).write.parquet(paths[-1])
        docs = spark.read.parquet(paths[-1])
    discard(spark, *paths[:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
