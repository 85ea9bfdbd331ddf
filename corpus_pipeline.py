"""The corpus pipeline: quality classifier, near-dedup, decontamination, mixing and token output over documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from verdict_lake.llm import decontam, mixing, quality_model, simhash, tokenfile
from verdict_lake.llm.store import stored, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    A null text is scored as an empty one; texts of any length are scored whole; repeated rows fare alike. An empty table
    stays empty; without labels of both kinds all documents have one score.
    """
    return quality_model.quality_kept(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: texts that share 0.8 or more of their 5-word shingles.

    The smallest doc_id stays (null is the largest), and of repeated rows one. All empty and null texts are one group.
    Very long texts are compared by their whole sets of shingles. An empty table stays empty.
    """
    return simhash.near_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Null and empty texts hold none and stay; whole texts are searched; repeated rows fare alike; null and empty items and
    an empty benchmark reject nothing.
    """
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null and empty texts have no words and are taken at their source's rate; a null source is a source; rows of one doc_id
    are taken alike, rows without one by their texts. An empty table stays empty.
    """
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files: doc_id, start, n_tokens, ids_crc32 of each document (each copy is one), read from them.

    Null and empty texts are the end id alone; texts are encoded whole; rows without a doc_id come first. An empty table
    gives no rows.
    """
    return tokenfile.token_report(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", classify), ("near_dedup", dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: No SQL gives these rows: the classifier is trained and the tokenizer is a library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: the token files' rows. Each stage but the last is written and read again; odd rows fare as the
    stages say."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
