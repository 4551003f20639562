"""Queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, exact_dedup, hard_negatives, hot_join, jaccard, language, licenses, line_dedup, mixing, quality, toxicity, votes

#: The tokenizer file that query op7 and the pipeline read.
TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))
#: How often the mix may repeat a source.
REPEATS = 2.0
#: Pages that a line must stand on to be boilerplate: the texts of small hosts would go as a whole.
SHARED = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(_table(spark, sf_dir, "documents"), jaccard.Likeness(4, 85))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.digests(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.pages_report(_table(spark, sf_dir, "pages"), SHARED)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents"), REPEATS)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), TOKENIZER)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(_table(spark, sf_dir, "conversations"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_hot_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_join.report(_table(spark, sf_dir, "clicks"), _table(spark, sf_dir, "sales"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.report(_table(spark, sf_dir, "embeddings"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op7_bpe": op7_bpe,
    "op8_chat": op8_chat,
    "op9_mixing": op9_mixing,
    "op10_quality_rules": op10_quality_rules,
    "op11_hot_key_join": op11_hot_key_join,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_quality_classifier": op13_quality_classifier,
}

ORACLES: dict[str, str] = {"op3_exact_dedup": exact_dedup.ORACLE, "op6_line_dedup": line_dedup.ORACLE, "op8_chat": chat.ORACLE, "op11_hot_key_join": hot_join.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE}
