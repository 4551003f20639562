"""The review table, retained feedback, tag whitelists and set algebra on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evidence, manifest, prepare, review

FIELDS = "row_id int, source_path string, title string, artist string, album_artist string, album string, date string, track_number int, disc_number int, genre string, compilation boolean, needs_review boolean, review_reason string, excluded boolean, new_path string, is_winner boolean, metadata string"


def _row(k, source, **more):
    row = {"row_id": k, "source_path": source, "title": "Track Name", "artist": "fixture artist", "album": None, "excluded": False, "needs_review": False, "compilation": None, "new_path": "D:/x.mp3", "is_winner": True, "metadata": None} | more
    return tuple(row.get(c.split()[0]) for c in FIELDS.split(", "))


@pytest.fixture(scope="module")
def items(spark):
    tags = '{"tags": {"TIT2": {"text": ["Track Name"]}, "TPE1": {"text": ["fixture artist"]}}}'
    rows = [
        _row(1, "in/Track Name-1.mp3", is_winner=False), _row(2, "in/Track Name.mp3", metadata=tags), _row(3, "in/out.wav", excluded=True),
        _row(4, "in/unknown.mp3", title=None, artist=None, needs_review=True, review_reason="Identity is unknown.", new_path=None, is_winner=False),
        _row(5, "in/track.mp3", title="unfinished_master", artist="Zed"), _row(6, "in/fine.mp3", artist="Fine Artist"), _row(7, "in/fine2.mp3", artist="Fine Artist", is_winner=None),
    ]
    return review.review_items(spark.createDataFrame(rows, FIELDS))


def test_excluded_rows_and_losers_are_no_review_items(items):
    assert {r["row_id"]: r["status"] for r in items.collect()} == {1: "duplicate", 2: "review", 4: "review", 5: "review", 7: "duplicate"}
    assert {r["name"]: r["n"] for r in review.review_totals(items).collect()} == {"High": 1, "Medium": 2, "excluded duplicate": 2}


def test_table_in_order_with_original_evidence(items):
    texts = evidence.original_texts(evidence.parsed(F.col("metadata")))
    rows = [r.asDict() for r in review.review_table(items, texts).collect()]
    assert [r["source_path"] for r in rows] == ["in/unknown.mp3", "in/Track Name.mp3", "in/track.mp3"]
    assert rows[0]["reasons"].startswith("needs review; missing title or artist") and rows[0]["planned_path"] == "" and rows[0]["needs_review"] == "true"
    assert rows[1]["original_title"] == "Track Name" and rows[1]["original_artist"] == "fixture artist" and rows[1]["original_key"] == ""
    assert "title contains underscore" in rows[2]["reasons"] and "title contains workflow or promo text" in rows[2]["reasons"]
    assert all(r["review_decision"] == "Pending" and r["compilation"] == "false" and r["track_number"] == "" for r in rows)


def test_retained_feedback(spark):
    rows = spark.createDataFrame([(0, "C:\\In\\A.mp3"), (1, " "), (2, "b"), (3, "c")], "row_id int, source_path string")
    said = [(0, True, "wrong"), (1, True, "x"), (2, True, "x"), (2, True, "y"), (3, False, "z"), (9, True, "x"), (None, True, "x"), (3, None, "x")]
    got = {r["id"]: (r["key"], r["rule"]) for r in review.retained(spark.createDataFrame(said, "id int, needs_revision boolean, feedback string"), rows).collect()}
    assert got == {0: ("c:/in/a.mp3", None), 1: (None, "no source path"), 2: (None, "track id repeated"), 9: (None, "track id out of range"), None: (None, "track id out of range")}


def test_tag_whitelist(spark):
    rows = [
        ("a.mp3", "ID3", ["TIT2", "TPE1", "APIC:cover", "TXXX:x", "TXXX:y"], None, "T", "A", "L", True),
        ("b.m4a", "mp4", ["©nam", "©ART", "©alb", "cpil"], ["APEv2"], "T", "A", "L", True),
        ("c.mp3", "id3", None, None, None, " ", None, False),
        ("d.xyz", None, ["x"], None, "T", None, None, None),
    ]
    files = spark.createDataFrame(rows, "path string, format string, tags array<string>, trailers array<string>, title string, artist string, album string, compilation boolean")
    assert sorted(map(tuple, prepare.tag_violations(files).collect())) == [
        ("a.mp3", "foreign tag", "TXXX"), ("a.mp3", "tag missing", "TALB"), ("a.mp3", "tag missing", "TCMP"), ("b.m4a", "other tag remains", "APEv2"), ("d.xyz", "format not supported", ""),
    ]


def test_set_parts(spark):
    one, two = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (3,), (None,)], "k int")
    assert {r["k"]: r["part"] for r in manifest.set_parts(one, two, "k").collect()} == {1: "left", 2: "both", 3: "right", None: "both"}
