"""Repairs of model output by its tags, on small rows with names of any script."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import link, manifest, plan, review

ROW = "title string, artist string, needs_review boolean, review_reason string, source_path string, s_title string, s_artist string, s_key string, s_album string"


def first(spark, f, *names, **values):
    row = {"needs_review": False, "source_path": "in/x.mp3", **values}
    return tuple(f(spark.createDataFrame([tuple(row.get(c.split()[0]) for c in ROW.split(", "))], ROW)).select(*names).first())


@pytest.mark.parametrize(
    "values, want",
    [
        ({"title": "9A", "artist": "9A", "needs_review": True, "s_title": "Real Name - 9A", "s_artist": "Someone"}, ("Real Name", "Someone", False)),
        ({"title": "9A", "artist": "x", "s_title": "Real Name", "s_artist": "Someone", "s_key": "9a"}, ("Real Name", "Someone", False)),
        ({"title": "9A", "artist": "x", "s_title": "Real Name", "s_artist": "Someone"}, ("9A", "x", False)),
        ({"title": "9A", "artist": "x", "s_title": "Track 2 - 9A", "s_artist": "Someone"}, ("9A", "x", False)),
        ({"title": "y", "s_title": "(Some Remix)", "s_artist": "Band - Song"}, ("Song (Some Remix)", "Band", False)),
        ({"title": "y", "artist": "Other", "s_title": "(Some Remix)", "s_artist": "Band - Song"}, ("y", "Other", False)),
        ({"title": "Песня", "artist": "Певец", "s_artist": "Певец - Другая", "s_title": "Другая"}, ("Песня", "Певец", False)),
        ({"title": "Radio", "artist": "A", "s_artist": None, "s_title": None}, ("Radio", "A", False)),
    ],
)
def test_misplaced(spark, values, want):
    assert first(spark, lambda r: review.split_misplaced(r, "s_artist", "s_title", "s_key"), "title", "artist", "needs_review", **values) == want


@pytest.mark.parametrize(
    "values, want",
    [
        ({"title": "Song", "s_title": "Song (Instrumental)"}, "Song (Instrumental)"),
        ({"title": "Song", "s_title": "Song", "source_path": "in/Song (Live)/Song.mp3"}, "Song (Live)"),
        ({"title": "Song (Remix)", "s_title": "Song (Remix) (feat. Guest)"}, "Song (Remix) (feat. Guest)"),
        ({"title": "Song (Remix)", "s_title": "Song (Live)"}, "Song (Remix)"),
        ({"title": "Песня", "s_title": "Другая (Remix)"}, "Песня"),
        ({"title": "(Remix)", "s_title": "(Live) (Remix)"}, "(Remix)"),
        ({"title": None, "s_title": "Song (Live)"}, None),
    ],
)
def test_context(spark, values, want):
    assert first(spark, lambda r: review.keep_context(r, ["s_title", "s_album"]), "title", artist="Band", **values) == (want,)


@pytest.mark.parametrize("path, want", [("in/1234/Album/1234 - Song.mp3", "1234"), ("in/1234/Album/12345 - Song.mp3", "x"), ("in/123/Album/1234 - Song.mp3", "x"), ("1234 - Song.mp3", "x")])
def test_numeric_artist(spark, path, want):
    assert first(spark, lambda r: review.keep_numeric_artist(r, "s_artist"), "artist", artist="x", s_artist="1234", source_path=path) == (want,)


@pytest.mark.parametrize(
    "path, want",
    [
        ("in/Band - Song (karaoke).mp3", ("Song (karaoke)", "Band", True)),
        ("in/Band - Song.mp3", ("Song", "Original", False)),
        ("in/karaoke Song.mp3", ("Song", "Original", False)),
    ],
)
def test_cover(spark, path, want):
    assert first(spark, review.cover_performer, "title", "artist", "needs_review", title="Song", artist="Original", source_path=path) == want


def test_error_kind(spark):
    rows = [(None, "refused"), (503, ""), (500, "Loading model"), (400, "exceeds the context"), (400, "no context"), (500, "exceeds the context"), (200, None)]
    got = spark.createDataFrame(rows, "s int, d string").select(manifest.error_kind(F.col("s"), F.col("d"))).collect()
    assert [r[0] for r in got] == ["unavailable"] * 3 + ["context", "other", "other", "other"]


def test_audit_is_applied_row_by_row(spark):
    planned = spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate([("a", "D:/a"), ("B", "D:/b"), ("b", "D:/b2"), ("c", "D:/c"), ("d", "D:/d"), ("e", "D:/e"), ("f", "D:/f"), ("g", "D:/g")])], "row_id long, source_path string, new_path string")
    said = [("A", "d:/A", "skip_existing", "x"), ("b", "D:/b", "skip_existing", "x"), ("c", "D:/other", "skip_existing", "x"), ("d", "D:/d", "resolve_collision", "x"), ("e", "D:/e", "skip_existing", " "), ("f", "D:/f", "skip_existing", "x"), ("F", "D:/f", "skip_existing", "x"), ("z", "D:/z", "skip_existing", "x")]
    audit = spark.createDataFrame(said, "source_path string, new_path string, recommendation string, existing string")
    got = {r["row_id"]: (r["new_path"], r["status"]) for r in plan.apply_skips(planned, audit).collect()}
    rules = {1: "plan source repeated", 2: "plan source repeated", 3: "destination changed", 4: "recommendation unresolved", 5: "no identity evidence", 6: "audit source repeated"}
    assert {i: s for i, (_, s) in got.items()} == {0: "skipped", 7: "planned", **rules}
    assert got[0][0] == "" and all(p for i, (p, _) in got.items() if i)
    assert {(r["key"], r["rule"]) for r in plan.audit_violations(planned, audit).collect()} == {("b", rules[1]), ("c", rules[3]), ("d", rules[4]), ("e", rules[5]), ("f", rules[6]), ("z", "audit source absent")}


def test_ratio_of_blank_texts(spark):
    assert spark.createDataFrame([("", "")], "a string, b string").select(link.ratio("a", "b")).first()[0] == 0.0
