"""Readers and writers of files: one large array read by several tasks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import readers

NASTY = ['}', '{', '"', '\\', '\\"}', '[{]', "a\nb", "é\U0001f642", "}}}", "\\\\", '{"x": 1}', ",", "]"]


def _value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 4)
    if kind < 2:
        return "".join(rng.choice(NASTY) for _ in range(rng.randrange(5)))
    if kind < 4:
        return rng.choice([None, True, 1, -2.5, ""])
    if kind == 4:
        return [_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(NASTY) + str(i): _value(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("indent", [None, 2])
def test_one_array_by_several_tasks(spark, tmp_path, small_splits, indent):
    rng = random.Random(indent)
    wanted = []
    for name, n in (("a.json", 60), ("b.json", 0), ("c.json", 25)):
        rows = [{"source": f"{name} {i}", "x": _value(rng), "y": {}} for i in range(n)]
        (tmp_path / name).write_text(("﻿" if name == "c.json" else "") + json.dumps(rows, indent=indent, ensure_ascii=False), encoding="utf-8")
        wanted += rows
    found = readers.json_array(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [r["row_id"] for r in found] == list(range(85)) and all(r["whole"] for r in found)
    assert [json.loads(r["value"]) for r in found] == wanted
    raw = spark.read.option("lineSep", "}").text(str(tmp_path / "a.json"))
    assert raw.select(F.spark_partition_id()).distinct().count() > 5


def test_strict_and_lenient_manifests(spark, tmp_path, small_splits):
    rows = [{"source": f"{i}.mp3", "originalMetadata": {"tags": {"TIT2": "a}b"}}, "outputMetadata": {"title": f"T{i}", "trackNumber": i}} for i in range(40)]
    path = tmp_path / "m.json"
    path.write_text(json.dumps(rows))
    got = readers.manifest(spark, str(path)).orderBy("row_id").collect()
    assert [(r["row_id"], r["source_path"], r["title"], r["track_number"]) for r in got] == [(i, f"{i}.mp3", f"T{i}", i) for i in range(40)]
    assert json.loads(got[0]["original"]) == rows[0]["originalMetadata"]
    whole = json.dumps(rows)
    path.write_text(whole[: len(whole) // 2])  # the array breaks off
    assert readers.manifest(spark, str(path), strict=False).count() >= 18
    with pytest.raises(Exception, match="does not end"):
        readers.manifest(spark, str(path)).collect()
    path.write_text("[]")
    assert readers.manifest(spark, str(path)).count() == 0
