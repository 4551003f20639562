"""Hot-key equi join against Spark's own joins and against real pairs in DuckDB."""

import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from tidemark.llm import hot_join
from tidemark.llm.common import Scratch

SMALL = 1 << 16


def _sides(spark):
    """A key with a third of all rows on both sides, copies of one row, nulls, keys of one side alone."""
    left = [(k, 7 if k % 3 == 0 else k % 90, "same" if k % 3 == 0 else f"l{k}") for k in range(400)] + [(900, None, "null"), (901, 5000, None)]
    right = [(k, 7 if k % 3 == 1 else k % 70, "copy" if k % 6 == 1 else f"r{k}") for k in range(300)] + [(900, None, "null"), (902, 6000, "")]
    return spark.createDataFrame(left, "id long, key long, text string"), spark.createDataFrame(right, "other long, key int, text string")


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_join_equals_sparks(spark, monkeypatch, how):
    monkeypatch.setattr(hot_join, "CELL", 20)
    left, right = _sides(spark)
    got = hot_join.join(left, right, "key", Scratch(spark, "t"), how, SMALL, share=8)
    assert got.columns == ["key", "id", "text", "other", "text_"]
    want = left.join(right.withColumnRenamed("text", "text_"), "key", how).select(*got.columns)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_equal_rows_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(hot_join, "CELL", 10)
    rows = spark.range(60).select(F.lit(1).alias("key"), F.lit("x").alias("v"))
    other = spark.range(25).select(F.lit(1).alias("key"), F.lit("y").alias("w"))
    assert hot_join.join(rows, other, "key", Scratch(spark, "t"), bits=SMALL).count() == 1500


def test_filters_have_no_false_negatives_and_merge(spark):
    rows = spark.range(5000).select((F.col("id") * 3).alias("k"))
    halves = [hot_join.bloom(rows.where(F.col("k") % 2 == r), F.col("k"), SMALL) for r in (0, 1)]
    whole = hot_join.bloom(rows, F.col("k"), SMALL)
    assert sorted(map(tuple, hot_join.merged(*halves).collect())) == sorted(map(tuple, whole.collect()))
    seen = hot_join.probed(spark.range(15000).select(F.col("id").alias("k")), F.col("k"), whole, SMALL)
    hits = {r["k"] for r in seen.where("maybe").collect()}
    assert {k for k in range(0, 15000, 3)} <= hits
    assert len(hits) < 15000  # some of the others are diverted
    with pytest.raises(ValueError):
        hot_join.bloom(rows, F.col("k"), 1000)


def test_false_positives_are_caught(spark):
    """65,536 bits for 30,000 keys: most that have no partner survive the filter."""
    left = spark.range(0, 30000, 2).select(F.col("id").alias("key"))
    right = spark.range(0, 30000, 3).select(F.col("id").alias("key"), F.lit(1).alias("n"))
    sides = hot_join.reduced(left, right, "key", SMALL)
    assert sides[0].where("maybe AND key % 3 <> 0").count() > 100
    got = hot_join.join(left, right, "key", Scratch(spark, "t"), "full", SMALL)
    want = left.join(right, "key", "full")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def _shop(spark):
    clicks = [(k, 1 if k % 3 == 0 else (None if k % 17 == 0 else k % 40), None if k % 13 == 0 else k * 1.015) for k in range(300)]
    clicks += clicks[:50] + [(5000, 77777, -3.005), (None, 1, 1.0)]
    sales = [(k, 1 if k % 3 == 1 else k % 55, None if k % 11 == 0 else k / 7) for k in range(200)] + [(5000, None, float("nan"))]
    return spark.createDataFrame(clicks, "click_id long, client_id long, value double, more string".replace(", more string", "")), spark.createDataFrame(sales, "sale_id long, client_id long, total double")


def test_report_equals_real_pairs(spark):
    clicks, sales = _shop(spark)
    got = {(r["side"], r["id"]): tuple(r)[2:] for r in hot_join.report(clicks, sales, SMALL, share=16).collect()}

    def key(ident, client):
        h = None if ident is None else zlib.crc32(str(ident).encode())
        return h // 10 % 7 if h is not None and h % 10 < 3 else client

    def crc(ident, x):
        cents = "" if x is None or x != x else str(int((100 * x + 0.5) // 1))
        return 0 if ident is None else zlib.crc32(f"{ident}:{cents}".encode())

    c, s = ([(r[0], key(r[0], r[1]), crc(r[0], r[2])) for r in t.collect()] for t in (clicks, sales))
    want = {}
    for side, own, other in (("click", c, s), ("sale", s, c)):
        for ident in {r[0] for r in own}:
            copies = [r for r in own if r[0] == ident]
            pairs = [(a, b) for a in copies for b in other if a[1] is not None and a[1] == b[1]]
            outer = len(pairs) + sum(1 for a in copies if not any(p[0] is a for p in pairs))
            want[side, ident] = (copies[0][1], len(copies), len(pairs), outer if side == "click" else len(pairs), outer, sum(b[2] for _, b in pairs))
    assert got == want


def test_report_of_empty_tables_and_oracle(spark):
    clicks, sales = _shop(spark)
    alone = hot_join.report(clicks, sales.limit(0), SMALL).collect()
    assert {r["side"] for r in alone} == {"click"} and all(r["inner_rows"] == 0 and r["full_rows"] == r["copies"] for r in alone)
    assert hot_join.report(clicks.limit(0), sales.limit(0), SMALL).count() == 0
    con = duckdb.connect()
    con.register("clicks", clicks.where("click_id IS NOT NULL").toPandas())
    con.register("sales", sales.toPandas())
    want = con.sql(hot_join.ORACLE).fetchall()
    got = hot_join.report(clicks.where("click_id IS NOT NULL"), sales, SMALL).collect()
    assert len(want) == len(got) > 400
