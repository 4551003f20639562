"""Rules that no other test runs by themselves: readiness, deterministic feedback, index roots, journals, inventories."""

from pyspark.sql import functions as F

from tidemark.operators import library, plan, review
from tidemark.sources import readers


def test_readiness(spark):
    rows = spark.createDataFrame([("T", "A", None, None), ("T", " ", False, False), (None, "A", False, True), ("T", "A", True, False), ("T", "A", False, True)], "title string, artist string, excluded boolean, needs_review boolean")
    got = [tuple(r) for r in rows.select(plan.is_ready(), plan.is_accepted(), plan.is_held(), plan.is_processed()).collect()]
    assert got == [(True, True, False, True), (False, False, False, False), (False, False, True, True), (False, False, False, False), (False, False, True, True)]


def test_album_artist_rules_without_a_model(spark):
    rows = spark.createDataFrame([("X", None, False), ("X", "x!", False), ("X", "Y", None), ("X", None, True), (None, "Y", False)], "album_artist string, s string, compilation boolean")
    said = [r[0] for r in rows.select(review.optional_feedback(F.col("s"))).collect()]
    assert said == ["Remove unsupported albumArtist 'X'; no source tag supports it.", None, "Replace albumArtist 'X' with source-tag value 'Y'.", None, None]
    rows = spark.createDataFrame([("X", said[0], None), ("X", said[2], "Y"), ("X", said[2], None), ("X", "The title is wrong", "Y")], "album_artist string, f string, s string")
    value, handled = review.deterministic_revision(F.col("f"), F.col("s"))
    assert [tuple(r) for r in rows.select(value, handled).collect()] == [(None, True), ("Y", True), ("X", False), ("X", False)]


def test_index_root(spark):
    meta = spark.createDataFrame([("schema_version", "3"), ("library_root", "d:/MUSIC"), ("other", "x")], "key string, value string")
    assert library.root_violations(meta, "3", "D:/Music").count() == 0
    assert {r["key"] for r in library.root_violations(meta, "4", "E:/Music").collect()} == {"schema_version", "library_root"}


def test_journal_and_inventory(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"event": "done", "source": "a.mp3", "status": "moved"}\nnot json\n\n{"event": "x"}\n')
    assert [tuple(r) for r in readers.journal(spark, str(tmp_path / "j.jsonl")).collect()] == [("done", "a.mp3", "moved"), ("x", None, None)]
    music = tmp_path / "music" / "deep"
    music.mkdir(parents=True)
    for name in ("a.MP3", "b.flac", "c.txt"):
        (music / name).write_bytes(b"x" * 5)
    found = readers.inventory(spark, str(tmp_path / "music"), [".mp3", ".flac"]).collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found) == ["a.MP3", "b.flac"] and all(r["size"] == 5 and r["mtime_ns"] > 10**18 for r in found)
