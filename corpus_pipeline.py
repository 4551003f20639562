"""From documents to token digests: quality rules, line dedup, near-duplicate removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

Columns of any name pass; an empty table stays empty. Documents with null or empty text fail the base rule and go in the
first stage. Rows that repeat a doc_id stay or go together where texts are alike; rows without one stay unless rules reject
them. Ties: of a near-duplicate group the smallest doc_id stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, jaccard, line_dedup, mixing, quality
from tidemark.llm.common import Scratch
from tidemark.llm.queries import REPEATS, TOKENIZER


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept_documents(docs, quality.learn(quality.labelled_measures(docs, labels)))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in too large a share of their source's documents, and in two at least, go; every document stays."""
    return line_dedup.clean_documents(docs, host="source", least=2)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five words, similarity 0.8)."""
    return jaccard.one_of_each_group(docs, jaccard.Likeness())


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated towards even weights, none more than REPEATS times; no document is lost."""
    return mixing.mixed_documents(docs, REPEATS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each row, as counts and digests."""
    return bpe.digests(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: SQL expresses neither the learned rules nor the encoding; a test checks which documents and lines each stage keeps.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir))
        if k:  # what the stage before wrote has been read
            scratch.drop(before)
    return docs
