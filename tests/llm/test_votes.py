"""Nearest-neighbour voting against plain Python, and held-out accuracy."""

import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from tidemark.llm import votes

DATA = Path("/root/testdata/sf0.001")


def _plain_terms(text):
    data = (text or "").encode("utf-8", "surrogatepass")
    shift = 32 - int(math.log2(votes.TERMS))
    counts = Counter((((data[i] << 16) + (data[i + 1] << 8) + data[i + 2]) * 2654435761 % 2**32) >> shift for i in range(len(data) - 2))
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    return counts, sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words) - 1)


TEXTS = [None, "", " ", "ab", "abc", "a a a b", "çé çé x\n\tx  y", "word " * 300, "x" * 5000, "no break no break", "\x0bv\x0cw\x0cw"]


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_terms_whole_texts_in_any_pieces(monkeypatch, piece):
    monkeypatch.setattr(votes, "PIECE", piece)
    for text in TEXTS:
        counts, repeats = _plain_terms(text)
        buckets, n, share = votes.terms(text)
        assert dict(zip(buckets.tolist(), n.tolist(), strict=True)) == counts
        assert share == pytest.approx(repeats)


def test_votes_equal_plain_python():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdef gh"), 80)) for _ in range(60)]
    found = [votes.terms(t) for t in texts]
    idf = rng.random(votes.TERMS).astype("float32") + 0.5
    labels = (rng.random(40) < 0.6).astype(float)
    voters = votes.Voters.fit(idf, found[:40], labels)

    def latent(f):
        w = [0.0] * (votes.TERMS + 2)
        for b, c in zip(f[0].tolist(), f[1].tolist(), strict=True):
            w[b] = math.log1p(c) * float(idf[b])
        norm = math.sqrt(sum(x * x for x in w))
        w = [x / norm for x in w]
        r = f[2]
        w[-2], w[-1] = votes.REPEATS * r / math.hypot(r, 1 - r), votes.REPEATS * (1 - r) / math.hypot(r, 1 - r)
        used = [(i, x) for i, x in enumerate(w) if x]
        v = [sum(x * float(voters.directions[i, k]) for i, x in used) for k in range(voters.directions.shape[1])]
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm for x in v]

    known = [latent(f) for f in found[:40]]
    got = voters.scores(found)
    for f, score in zip(found, got, strict=True):
        z = latent(f)
        weights = [max(0.0, sum(a * b for a, b in zip(z, v, strict=True))) ** votes.POWER for v in known]
        assert score == pytest.approx(sum(w * y for w, y in zip(weights, labels, strict=True)) / sum(weights), rel=1e-3)
    # The directions are the leading ones of the labelled rows.
    rows = np.stack([votes.weighted(idf, *f) for f in found[:40]]).astype("float64")
    exact = np.linalg.svd(rows, compute_uv=False)
    assert np.linalg.svd(rows @ voters.directions, compute_uv=False)[:10] == pytest.approx(exact[:10], rel=1e-3)


def test_frequencies_cover_every_document(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    n, seen = votes.frequencies(docs)
    want = Counter(b for t in TEXTS for b in _plain_terms(t)[0])
    assert n == len(TEXTS)
    assert {b: c for b, c in enumerate(seen.tolist()) if c} == want


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(str(DATA / f"{t}.parquet")) for t in ("documents", "labels"))
    got = votes.report(docs, labels)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == docs.count()
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    tried = [i for i in known if rows[i]["held_out"]]
    assert sum(rows[i]["predicted"] == known[i] for i in tried) >= 0.9 * len(tried)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())


def test_odd_rows(spark):
    good, bad = "the cat sat on the mat and ran off", "x### y$$$ z%%% q&&& r***"
    rows = [(i, good + f" {i}" if i % 2 else bad + f" {i}", "clash") for i in range(40)] + [(None, good, "n"), (1, good, "again"), (90, None, None), (91, "", None), (92, bad * 30000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = votes.report(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[None]["predicted"] == 1 and not by[None]["held_out"]
    assert by[92]["predicted"] == 0
    assert 0 < by[90]["score"] < 1 and by[90]["score"] == by[91]["score"]
    none = votes.report(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert votes.report(docs.limit(0), labels).count() == 0


def test_one_label_many_rows(spark):
    """A labelled doc_id with many rows sends one row to the driver."""
    docs = spark.range(50000).selectExpr("id % 2 as doc_id", "concat('text ', id % 3) as text").union(spark.createDataFrame([(5, "other words")], "doc_id long, text string"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, quality int")
    voters = votes.fit(docs, labels)
    assert len(voters.labels) <= 3


def test_labelled_rows_that_go_to_the_driver(spark):
    """A labelled doc_id with 50,000 rows counts once in the other classifiers' samples too."""
    from tidemark.llm import quality, toxicity

    docs = spark.range(50000).selectExpr("1L as doc_id", "concat('these are more than ten words of text in a row ', id % 5) as text")
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 1)], "doc_id long, quality int, toxic int")
    assert len(quality.labelled_measures(docs, labels)) == 1
    texts, y = toxicity.training_sample(docs, labels)
    assert len(texts) == len(y) <= 1
