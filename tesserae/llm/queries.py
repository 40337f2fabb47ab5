"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe, chat, exactdup, hmm, neardup, packing, pages, quality, substrings, vectors
from tesserae.llm.common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_probe(table(spark, sf_dir, "conversations"))
    return chat.digests(chat.read_chats(chat.format_chats(rows)))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(table(spark, sf_dir, "documents"), neardup.CONTRACT)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_groups(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_texts(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digests=True)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"), texts=False).withColumnRenamed("kept", "kept_sha256")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_html_extraction": op2_html_extraction,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_hmm_scoring": op10_hmm_scoring,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": chat.ORACLE,
    "op6_exact_dedup": exactdup.ORACLE,
    "op8_substring_dedup": substrings.ORACLE,
    "op9_embedding_near_dedup": vectors.ORACLE,
}
