"""The queries of the corpus operators, each over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, exact_dedup, lines, mixing, quality, sharding, simhash, substrings, webp
from .shared import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 16)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


#: Shares of tokens that the mixture shall have of each language.
MIXTURE = {"de": 0.15, "en": 0.55, "es": 0.15, "fr": 0.15}


def languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled documents with their language as domain."""
    return labels.select("doc_id").join(docs.select("doc_id", F.col("lang").alias("domain")), "doc_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, languages(docs, table(spark, sf_dir, "labels")), MIXTURE)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotate(table(spark, sf_dir, "conversations"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_sharding": op2_sharding,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op4_bpe": op4_bpe,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_mixing": op7_mixing,
        "op8_chat_formatting": op8_chat_formatting,
        "op9_media_columns": op9_media_columns,
        "op10_exact_dedup": op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_dedup": substrings.SQL, "op8_chat_formatting": chat_format.SQL, "op10_exact_dedup": exact_dedup.SQL}
