"""Bounded top-k and streaming folds: groups of any size, few rows a task."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds, library, link, manifest, review


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_digest_of_large_groups_streams_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        rows = spark.range(5000).selectExpr("case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else 'g' || id % 50 end as g", "string(id % 900) as v", "1 as digest")
        got = {r["g"]: (r["digest"], r["n"]) for r in manifest.content_digest(rows.repartition(5), "g", F.col("v")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    parts = {}
    for r in rows.collect():
        parts.setdefault(r["g"], []).append(hashlib.sha256(r["v"].encode()).hexdigest())
    assert got == {g: (hashlib.sha256("".join(sorted(p)).encode()).hexdigest(), len(p)) for g, p in parts.items()}
    assert manifest.content_digest(rows.limit(0), "g", F.col("v")).count() == 0


def test_identity_groups_in_path_order(spark):
    rows = spark.createDataFrame([("a", "t", "D:/B.mp3"), ("a", "t", "d:/a.mp3"), ("a", "u", "x"), ("", "t", "y"), ("a", "t", "D:\\b.mp3"), (None, "t", "z")], "normalized_artist string, normalized_title string, path string")
    got = {tuple(r)[:2]: (r["n"], r["paths"]) for r in library.identity_groups(rows).collect()}
    assert got == {("a", "t"): (3, "d:/a.mp3 | D:/B.mp3 | D:\\b.mp3"), ("a", "u"): (1, "x")}


def test_fold_of_keys_of_several_kinds(spark):
    rows = spark.createDataFrame([(1, 2.5, "b"), (1, 2.5, "a"), (None, 1.0, "x"), (None, 1.0, None)], "i int, d double, v string")
    got = sorted(map(tuple, folds.fold_sorted(rows, ["i", "d"], F.col("v"), [F.col("v")], folds.Joined).collect()), key=str)
    assert got == [(1, 2.5, 2, "a | b"), (None, 1.0, 2, " | x")]


@pytest.mark.parametrize("which", ["top", "last", "context", "changes"])
def test_few_rows_of_a_hot_group_leave_a_task(spark, which):
    rows = spark.range(3000).selectExpr("id div 3000 as item_id", "id as key", "double(id % 100) as score", "substring('f', 1 + int(id div 3000)) as field", "id as row_id", "true as accepted", "'Some Long Name' as title", "'C:/x/' || id || '.mp3' as source_path")
    made = {
        "top": lambda: link.top(rows),
        "last": lambda: manifest.last_lines(rows, "field", "key", 12),
        "context": lambda: manifest.context(rows),
        "changes": lambda: review.change_counts(rows),
    }[which]()
    assert "WindowGroupLimit" in _plan(made) and "Partial" in _plan(made)
    found = made.collect()
    if which == "top":
        assert [(r["key"], r["candidate_rank"]) for r in sorted(found, key=lambda r: r["candidate_rank"])] == [(99 + 100 * i, i + 1) for i in range(5)]
    if which == "last":
        assert sorted(r["key"] for r in found) == list(range(2988, 3000)) and set(made.columns) == set(rows.columns)
    if which == "context":
        assert len(found) == 15000 and {r["other_id"] for r in found} == set(range(6))
    if which == "changes":
        assert [(r["field"], r["n"], r["sample"]) for r in found] == [("f", 3000, list(range(20)))]


def test_callers_columns_stay(spark):
    rows = spark.createDataFrame([(1, "Song", "Band", "C:/in/1 - Song.mp3", "1", True, "mine", 5, 7)], "row_id int, title string, artist string, source_path string, s_artist string, needs_review boolean, __a string, __use int, review_reason int").withColumn("review_reason", F.lit(None).cast("string"))
    for done in (review.keep_numeric_artist(rows, "s_artist"), review.cover_performer(rows)):
        assert done.columns == rows.columns and done.first()["__a"] == "mine"
    batched = manifest.batches(rows.withColumns({"part": F.lit(1), "own": F.lit(2)}), 5)
    assert set(batched.columns) == {*rows.columns, "part", "own", "batch_id"} and batched.first()["own"] == 2
