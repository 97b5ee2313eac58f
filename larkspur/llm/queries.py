"""The registered queries of the training-data operators, with production parameters, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import chat, quality_rules, warc
from larkspur.llm.common import scratch_dir, table


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm import cotraining

    documents = table(spark, sf_dir, "documents")
    model = cotraining.fit(documents, table(spark, sf_dir, "labels"))
    return cotraining.score(documents, model)


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm import ngram_lm

    return ngram_lm.score(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm import simhash

    scratch_dir(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch_dir(spark)
    # From a range and not from a list, which would start Python workers.
    extra = spark.range(2, numPartitions=1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.conversation_digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.assess(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm import bpe

    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm import token_counts

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm import flac

    return flac.media_digests(flac.store(table(spark, sf_dir, "documents")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch_dir(spark)
    folder, manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(folder, manifest).drop("target_uri")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cotraining": op1_cotraining,
    "op2_ngram_lm": op2_ngram_lm,
    "op3_simhash": op3_simhash,
    "op4_chat_format": op4_chat_format,
    "op5_quality_rules": op5_quality_rules,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_token_counts": op7_token_counts,
    "op8_flac": op8_flac,
    "op9_packing": op9_packing,
    "op10_warc": op10_warc,
}
ORACLES: dict[str, str] = {
    "op4_chat_format": chat.ORACLE,
    "op5_quality_rules": quality_rules.ORACLE,
    "op10_warc": warc.ORACLE,
}
