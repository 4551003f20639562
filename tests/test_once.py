"""Dear steps stand once in a plan: each mention of an expression with lambdas would be evaluated again for every row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import evidence
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"


def _plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_original_texts_are_looked_for_once(spark):
    plan = _plan(catalogue.QUERIES["review_evidence"](spark, SF))
    assert plan.count("$.tags") == 1


def test_metadata_is_parsed_once(spark):
    plan = _plan(catalogue.QUERIES["evidence_fields"](spark, SF))
    assert plan.count("parseJson(") == 1
    plan = _plan(catalogue.QUERIES["request_payload"](spark, SF))
    assert plan.count("parseJson(") == 1


def test_last_of_equal_tags_counts_in_evidence_and_first_in_review(spark):
    rows = spark.createDataFrame([('{"tags": {"TIT2": "a", "tit2": "b", "YEAR": 1999}}',), ('{"tags": 5}',), ("[1]",), (None,)], "j string").select(evidence.parsed(F.col("j")).alias("v"))
    got = [tuple(r) for r in rows.select(evidence.metadata_evidence(F.col("v")), evidence.original_record(F.col("v"))["original_title"]).collect()]
    assert got == [('{"title": "b", "date": 1999}', "a"), ("{}", ""), ("[1]", ""), (None, "")]
