"""One batch in flight an endpoint, lost endpoints, split batches; components of stars and chains."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import infer, library


def _endpoint(folder):
    def answer(endpoint, items):
        busy = f"{folder}/{endpoint}.busy"
        os.close(os.open(busy, os.O_CREAT | os.O_EXCL))  # fails if a batch is in flight already
        try:
            with open(f"{folder}/{endpoint}.log", "a") as log:
                log.write(f"{len(items)}\n")
            if endpoint == "down":
                raise ConnectionError("refused")
            if endpoint == "flaky" and sum(1 for _ in open(f"{folder}/flaky.log")) % 3 == 1:
                raise ConnectionError("refused")
            if len(items) > 3:
                raise infer.ContextError("too long")
            if any(i == 5 for i, _ in items):
                raise ValueError("not JSON")
            return {i: f"{endpoint} {item}" for i, item in items if i != 7}
        finally:
            os.remove(busy)

    return answer


def _calls(folder, endpoint):
    path = f"{folder}/{endpoint}.log"
    return [int(x) for x in open(path)] if os.path.exists(path) else []


def test_schedule(spark, tmp_path):
    requests = spark.createDataFrame([(i, f"r{i}") for i in range(60)], "row_id long, item string").repartition(7)
    done = infer.scheduled(requests, _endpoint(str(tmp_path)), ["up", "down", "flaky"], lambda df: df.checkpoint(), size=5, wait=0.0)
    got = {r["row_id"]: r for r in done.collect()}
    assert len(got) == done.count() == 60
    assert got[5]["error"] == "ValueError: not JSON" and got[7]["error"] == "omitted"
    assert all(r["answer"] == f"{r['endpoint']} r{i}" and r["error"] is None for i, r in got.items() if i not in (5, 7))
    assert {r["endpoint"] for r in got.values()} == {"up", "flaky"}
    assert len(_calls(tmp_path, "down")) == infer.FAILURES  # then left alone
    assert max(_calls(tmp_path, "up")) <= 5
    before = len(_calls(tmp_path, "up"))
    done.count()
    assert len(_calls(tmp_path, "up")) == before  # rounds are written, and not asked for again


def test_no_endpoint_is_left(spark, tmp_path):
    requests = spark.createDataFrame([(i, "r") for i in range(9)], "row_id long, item string")
    got = infer.scheduled(requests, _endpoint(str(tmp_path)), ["down"], lambda df: df.checkpoint(), wait=0.0, failures=2).collect()
    assert len(got) == 9 and {r["error"] for r in got} == {"no endpoint"}


@pytest.mark.parametrize("few", [200_000, 0])
def test_components_of_chains_and_a_hot_key(spark, monkeypatch, few):
    monkeypatch.setattr(library, "FEW_LINKS", few)
    rng = random.Random(4)
    made = [(i, f"D:/{'hot' if i % 3 == 0 else rng.randrange(120)}.mp3", f"a{rng.randrange(150)}", "t") for i in range(200)]
    rows = spark.createDataFrame([*made, (900, "D:/x.mp3", "", ""), (901, "", "a1", "t"), (902, None, "a1", "t")], "row_id long, new_path string, artist string, title string")
    up = {i: i for i, *_ in made} | {900: 900}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for key in (lambda r: r[1], lambda r: r[2]):
        first = {}
        for r in made:
            a, b = root(first.setdefault(key(r), r[0])), root(r[0])
            up[max(a, b)] = min(a, b)
    assert {r["row_id"]: r["component"] for r in library.linked_rows(rows).collect()} == {i: root(i) for i in up}


def test_star_of_100_000(spark):
    rows = spark.range(100_000).select(F.col("id").alias("row_id"), F.lit("D:/one.mp3").alias("new_path"), F.lit("").alias("artist"), F.lit("").alias("title"))
    got = library.linked_rows(rows).agg(F.max("component").alias("most"), F.count("*").alias("n")).first()
    assert (got["most"], got["n"]) == (0, 100_000)
