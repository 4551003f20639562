"""Inverted lists with bounds against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import hard_negatives as hn
from tidemark.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int, id string"


def _brute(rows):
    """The contract in plain Python; rows of (vec_id, embedding, label)."""
    fine = {}
    for i, x, label in rows:
        if i is not None and x is not None and label is not None and all(v is not None and math.isfinite(v) for v in x):
            fine[i] = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(v))) for v in x])
    out = set()
    for a, (label, q) in fine.items():
        if a % 50:
            continue
        scores = sorted((-sum(s * t for s, t in zip(q, x)), i) for i, (_, x) in fine.items() if i != a)
        for p, i in [(-s, i) for s, i in scores if fine[i][0] == label][:5]:
            found = [(-s, j) for s, j in scores if fine[j][0] != label and 50 * p <= 100 * -s <= 95 * p][:3]
            out |= {(a, i, r, j, p, s) for r, (s, j) in enumerate(found, 1)}
    return out


def _rows(n, spread, seed=0, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((7, dim))
    return [(i, (centres[i % 7] + spread * rng.standard_normal(dim)).round(2).tolist(), int(rng.integers(3))) for i in range(n)]


def _got(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    found = [tuple(r) for r in hn.report(frame, **kw).collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("spread", [0.02, 0.3, 2.0])
def test_equals_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(hn, "SLICE", 40)
    monkeypatch.setattr(hn, "GROUP", 3)
    rows = _rows(420, spread)
    want = _brute(rows)
    assert want and _got(spark, rows, k=12) == want


def test_ties_and_a_hot_vector(spark, monkeypatch):
    """A third of the rows has one vector, and scores tie everywhere."""
    monkeypatch.setattr(hn, "SLICE", 25)
    rows = [(i, [1.0, 0.0] if i % 3 == 0 else [0.75 if i % 2 else 0.5, float(i % 4)], i % 2) for i in range(160)]
    assert _got(spark, rows, k=4) == _brute(rows)


def test_odd_rows(spark):
    rows = _rows(110, 0.5, seed=2)
    rows += [(200, None, 1), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (202, [float("nan")] * 6, 1), (203, [float("inf")] * 6, 1), (204, [1.0] * 6, None), (None, [1.0] * 6, 1), (250, [0.0] * 6, 2)]
    want = _brute(rows)
    assert _got(spark, rows) == want
    assert _got(spark, rows + rows[:30]) == want  # repeated ids count once
    assert _got(spark, []) == set()
    assert _got(spark, rows[:1]) == set()
    assert _got(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == _brute([(0, [], 1), (1, [], 1), (2, [], 2)])
    short = [(0, [1.0], 0), (1, [2.0, 5.0], 0), (2, [1.0, 7.0, 3.0], 1), (3, [], 1)]
    padded = [(i, x + [0.0] * (3 - len(x)), y) for i, x, y in short]
    assert _got(spark, short) == _brute(padded)


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(2**24 - i), float(-(i % 5))], i % 2) for i in range(60)]
    assert _got(spark, rows, k=3) == _brute(rows)


def test_bounds_hold_and_exclude(spark):
    """On clustered vectors most lists lie outside; a member never scores beyond its list's bounds."""
    rows = _rows(700, 0.02, seed=5)
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    index = hn.build(frame.select(F.col("vec_id").alias("id"), F.col("label").cast("long"), hn.scaled(F.col("embedding")).alias("vector")), Scratch(spark, "t"), 7)
    members = index.rows.collect()
    assert len(members) == 700
    q = np.stack([np.frombuffer(r["vector"], "<f8") for r in members if r["id"] % 50 == 0])
    least, most = index.bounds(q)
    excluded = 0
    for i, a in enumerate(q):
        best = sorted((float(a @ np.frombuffer(r["vector"], "<f8")) for r in members), reverse=True)[5]
        excluded += int((most[i] < best).sum())
        for r in members:
            s = float(a @ np.frombuffer(r["vector"], "<f8"))
            assert least[i, r["cluster"]] <= s <= most[i, r["cluster"]]
    assert excluded > 0.5 * len(q) * len(index.radii)
