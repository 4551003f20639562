import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import infer, library, link, manifest, plan, review
from tidemark.sources import readers, writers
from tidemark.streaming import status

PLAN = "row_id long, plan_id string, source_path string, new_path string, artist string, title string, size long"


def test_bundle_follows_chains(spark):
    rows = spark.createDataFrame([(1, "a", "x/1.mp3", "D:/p.mp3", "A", "T", 1), (2, "b", "x/2.flac", "D:/P.mp3", "B", "U", 1), (3, "c", "x/3.mp3", "D:/q.mp3", "b", "u", 1), (4, "c", "x/4.mp3", "D:/z.mp3", "", "", 1), (5, "c", "x/5.mp3", "", "A", "T", 1)], PLAN)
    parts = library.linked_rows(rows)
    assert {tuple(r) for r in parts.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    got = {r["row_id"]: (r["kept_row_id"], r["reason"]) for r in library.bundle(rows, parts).collect()}
    assert got == {1: (2, "same_destination"), 3: (2, "same_identity")}


def test_refresh(spark):
    old = spark.createDataFrame([("/A.mp3", 1, 1, "x", "y", None), ("/b.mp3", 1, 1, "x", "y", None), ("/c.mp3", 1, 1, "x", "y", None)], "path string, size long, mtime_ns long, artist string, title string, error string")
    now = spark.createDataFrame([("/a.mp3", 1, 1), ("/b.mp3", 2, 1), ("/d.mp3", 1, 1)], "path string, size long, mtime_ns long")
    read = spark.createDataFrame([("/a.mp3", "z", "y", None), ("/b.mp3", "x", "y", None), ("/d.mp3", None, None, "bad")], "path string, artist string, title string, error string")
    of = lambda t: {r["key"]: r["status"] for r in library.refresh(old, now, read, t).collect()}
    assert of(None) == {"/a.mp3": "reused", "/b.mp3": "reindexed", "/c.mp3": "removed", "/d.mp3": "reindexed"}
    assert of("forced")["/a.mp3"] == "drifted"
    assert library.refresh_stats(library.refresh(old, now, read, "forced")).first().asDict() == {"scanned": 3, "reused": 0, "reindexed": 3, "removed": 1, "unreadable": 1, "drifted": 1}


def test_tags(spark):
    rows = spark.createDataFrame([(1, json.dumps({"TIT2": "", "title": "Two", "TPE1": {"text": ["One"]}, "trkn": [["3/10"]]}))], "row_id long, tags string")
    tags = manifest.tag_rows(rows, "tags")
    assert manifest.alias_text(tags, ["TIT2", "title"]).first()["value"] == "Two"
    assert manifest.stored_value(tags, ["title", "TIT2"]).first()["value"] == ""
    assert manifest.alias_text(tags, ["tpe1"]).first()["value"] == "One"
    got = manifest.alias_text(tags, ["trkn"]).select(manifest.first_integer(F.col("value"))).first()[0]
    assert got == 3


def test_model_answers(spark):
    text = '<think>{"x":1}</think> here: {"items": [{"id": 1, "title": "a"}, {"id": 1, "title": "b"}, {"id": 9, "title": "c"}]}'
    answers = spark.createDataFrame([(0, text), (1, "no json")], "batch_id int, answer string")
    got = manifest.model_results(answers, spark.createDataFrame([(0, 1), (1, 2)], "batch_id int, id long")).collect()
    assert [(r["id"], r["item"]["title"]) for r in got] == [(1, "b")]


@pytest.mark.parametrize(
    "feedback, wanted",
    [
        ("The title should be 'Right' because the source tag says so.", True),
        ("The title should be 'Song!' per the source tag.", False),
        ("Keep the title as in the source tag.", False),
        ("Fix casing per source tag.", False),
        ("The genre is wrong per the source tag.", False),
        ("Remove unsupported albumArtist 'X'.", True),
        ("Wrong title.", False),
    ],
)
def test_feedback(spark, feedback, wanted):
    row = spark.createDataFrame([("Song", "Band", "X", False, "", feedback)], "title string, artist string, album_artist string, needs_review boolean, evidence string, f string")
    assert row.select(review.actionable(F.col("f"))).first()[0] is wanted


def test_constrained_revision(spark):
    row = spark.createDataFrame([("a", "b", "x", "y", "The title is wrong")], "o_title string, c_title string, o_genre string, c_genre string, f string")
    got = row.select(*[c.alias(f) for f, c in review.constrained(["title", "genre"], F.col("f")).items()]).first()
    assert (got["title"], got["genre"]) == ("b", "x")


def test_ratio_and_location(spark):
    rows = spark.createDataFrame([("abcd", "bcde"), ("", "x")], "a string, b string")
    assert [r[0] for r in rows.select(link.ratio("a", "b")).collect()] == [0.75, 0.0]
    renames = spark.createDataFrame([("D:/a b.mp3", "x"), ("D:/c.mp3", "y")], "old_path string, new_path string")
    places = spark.createDataFrame([(1, "file:///D:/a%20b.mp3")], "location_id long, location string")
    assert {r["old_path"]: r["location_id"] for r in link.located(renames, places).collect()} == {"D:/a b.mp3": 1, "D:/c.mp3": None}


def test_inference_splits_and_fails_over(spark):
    def answer(endpoint, items):
        if endpoint == "down":
            raise ConnectionError("refused")
        if len(items) > 2:
            raise infer.ContextError("too long")
        return {i: item.upper() for i, item in items if i != 3}

    rows = spark.createDataFrame([(i, f"r{i}") for i in range(5)], "row_id long, item string").coalesce(1)
    got = {r["row_id"]: (r["answer"], r["error"]) for r in infer.inferred(rows, answer, ["down", "up"], wait=0.0).collect()}
    assert got == {0: ("R0", None), 1: ("R1", None), 2: ("R2", None), 3: (None, "omitted"), 4: ("R4", None)}


def test_files(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text("﻿" + json.dumps([{"source": "a.mp3", "originalMetadata": {}, "outputMetadata": {"title": "T", "reviewReason": "why"}}]), encoding="utf-8")
    row = readers.manifest(spark, str(path)).first()
    assert (row["row_id"], row["title"], row["needs_review"]) == (0, "T", True)
    writers.delimited(readers.manifest(spark, str(path)), str(tmp_path / "csv"), ["title", "artist"])
    assert [tuple(r) for r in readers.delimited(spark, str(tmp_path / "csv"), ["title", "artist"], exact=True).fillna("").collect()] == [("T", "")]
    with pytest.raises(ValueError):
        readers.delimited(spark, str(tmp_path / "csv"), ["other"])
    path.write_text(json.dumps([{"source": "a.mp3", "originalMetadata": {}}]), encoding="utf-8")
    assert readers.manifest(spark, str(path), strict=False).first()["title"] is None
    with pytest.raises(Exception, match="no outputMetadata"):
        readers.manifest(spark, str(path)).collect()
    lines = spark.createDataFrame([(1, 0, "#a"), (1, 1, "b")], "row_id long, line_no int, line string")
    writers.playlist(lines, str(tmp_path / "list"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "list")).collect()) == ["#EXTM3U", "#a", "b"]
    events = spark.createDataFrame([("s", "done")], "source string, status string")
    writers.append_journal(events, str(tmp_path / "j"), "h1", spark)
    writers.append_journal(events, str(tmp_path / "j"), "h1", spark)
    assert spark.read.json(str(tmp_path / "j/events")).count() == 2
    with pytest.raises(ValueError):
        writers.append_journal(events, str(tmp_path / "j"), "h2", spark)


def test_property_list_entities(spark, tmp_path):
    path = tmp_path / "l.xml"
    path.write_text("<dict><key>Tracks</key><dict><key>7</key><dict><key>Name</key><string>A &#38; B &amp;lt; &#x1F642; &#38;lt; &quot;c&quot;</string></dict></dict><key>Playlists</key><array><dict><key>Name</key><string>P &amp; Q</string><key>Track ID</key><integer>7</integer></dict></array></dict>", encoding="utf-8")
    tracks, items = readers.property_list(spark, str(path))
    assert [tuple(r) for r in tracks.collect()] == [(7, "Name", 'A & B &lt; \U0001f642 &lt; "c"')]
    assert [tuple(r) for r in items.collect()] == [("P & Q", 0, 7)]


def test_hot_words_are_dealt(spark, monkeypatch):
    library = spark.createDataFrame([(f"k{i}", "love song" if i % 2 else "love") for i in range(40)] + [("none", None), ("blank", "")], "key string, title string")
    items = spark.createDataFrame([(1, "Love"), (2, "song"), (3, "other"), (4, None)], "item_id long, title string")
    wanted = {(1, f"k{i}", 1 if i % 2 else 2) for i in range(40)} | {(2, f"k{i}", 1) for i in range(1, 40, 2)}
    monkeypatch.setattr(link, "HOT", 5)
    assert sorted(tuple(r) for r in link.blocked(items, library).collect()) == sorted(wanted)


def test_status_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"run":"r","at":"2024-01-01T00:00:01Z","status":"ok"}\n{"run":"r","at":"2024-01-01T00:00:02Z","status":"ok"}\n')
    q = status.status_counts(status.journal_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").first()["n"] == 2


def test_empty_plan(spark):
    rows = spark.createDataFrame([], PLAN)
    assert library.linked_rows(rows).count() == 0
    with pytest.raises(ValueError):
        plan.require_empty(spark.createDataFrame([(1, "r")], "row_id long, rule string"), "contract")
