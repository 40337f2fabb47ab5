"""The corpus pipeline: from raw documents to packed training sequences, stage by stage.

Every stage takes all its predecessor kept. All but the last return the columns of documents.
Near copies are documents whose sets of five-word shingles have a similarity of 0.8 or more;
repeated passages are windows of 20 words that start earlier in the corpus.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import exactdup, neardup, packing, quality, substrings
from tesserae.llm.common import forget, forget_since, saved, table, written
from tesserae.session import ship


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the largest id."""
    ship(spark)
    return exactdup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least id."""
    ship(spark)
    return neardup.drop_near_copies(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that start earlier in the corpus."""
    ship(spark)
    return substrings.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of at most 1024 tokens."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", remove_repeats),
    ("packing", pack),
]

#: SQL can't express the classifier or the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        begin, given = written(), docs
        docs = saved(stage(spark, given, sf_dir), name)
        forget_since(begin, docs)  # what the stage has made on its way
        forget(given)
    return STAGES[-1][1](spark, docs, sf_dir)
