"""Work that must be done by all cores, however few bytes a table is read from."""

from decimal import Decimal
from types import SimpleNamespace

from pyspark.sql import functions as F

from tidemark.functions import copies
from tidemark.operators import link
from tidemark.plans import catalogue, fixtures
from tidemark.sources.shared import TASKS


def test_pairs_of_rows_with_few_titles_are_made_by_all_cores(spark):
    items = spark.range(30).select(F.col("id").alias("item_id"), F.when(F.col("id") % 3 > 0, "red bolt").otherwise("blue ring").alias("title"))
    library = spark.range(4000).select(F.when(F.col("id") > 0, F.col("id")).alias("key"), F.when(F.col("id") % 4 > 0, "red ring").otherwise("tin cup").alias("title"))
    pairs = link.blocked(items, library.unionByName(library.where("key = 1")), ascii_only=True)
    assert pairs.rdd.getNumPartitions() >= TASKS * spark.sparkContext.defaultParallelism
    assert pairs.groupBy("shared").count().collect() == [(1, 30 * 3001)]
    assert pairs.where("key = 1").count() == 60 and pairs.distinct().count() == 30 * 3000


def test_tasks_hold_few_pairs_of_rows(spark):
    """What two lists are written out to is held until the next step takes it; lists meet in all tasks and not in one."""
    rows = spark.range(3000).select(F.when(F.col("id") > 0, F.col("id")).alias("key"), F.lit("red bolt").alias("c"))
    sizes = [r["n"] for r in link._lists(rows, "c", "key").select(F.size("keys").alias("n")).collect()]
    assert sum(sizes) == 3000 and max(sizes) ** 2 <= 200_000
    library = rows.withColumnRenamed("c", "title")
    pairs = link.blocked(library.select(F.col("key").alias("item_id"), "title").limit(700), library, ascii_only=True)
    assert pairs._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 2
    assert pairs.count() == 700 * 3000 and pairs.where("key is null").count() == 700


def test_rows_of_a_small_file_are_worked_on_by_all_cores(spark, tmp_path):
    spark.range(50).selectExpr("id as p_partkey", "'red bolt' as p_name", "'Brand#1' as p_brand", "'SMALL' as p_type", "cast(id as int) as p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    shares = TASKS * spark.sparkContext.defaultParallelism
    for rows in (fixtures.tracks, fixtures.dirty, catalogue._tagged, catalogue._tag_json):
        got = rows(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() >= shares and got.count() == 50


def test_types_that_a_text_does_not_tell():
    deep = lambda x, v: copies.bounded('{"a":' + x + "}", SimpleNamespace(toPython=lambda: {"a": v}), 500, 50, 0)
    assert deep("2", Decimal("2.00")) == '{"a":{"type":"float","value":"2"}}' and deep("2", 2) == '{"a":{"type":"int","value":"2"}}'
    assert deep('"Infinity"', float("inf")) == '{"a":{"type":"float","value":"\\"Infinity\\""}}' and deep('"Infinity"', "Infinity") == '{"a":{"type":"str","value":"Infinity"}}'
