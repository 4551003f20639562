"""Import preparation: dry run, cleanup, actions, gates; resolutions and answers of all fields."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import manifest, plan, prepare, review

FILES = "path string, size long, artwork array<string>, title string, artist string"
ENTRIES = "row_id long, source_path string, new_path string, expected_artwork int, title string, artist string"
ROWS = (
    "row_id long, source_path string, title string, artist string, album_artist string, album string, date string, track_number int, disc_number int, "
    "genre string, compilation boolean, needs_review boolean, review_reason string, excluded boolean, exclusion_reason string, output_extension string, size long"
)


def found(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


def entries(spark):
    rows = [
        (1, "S:/a.mp3", "D:/a.mp3", 1, "T", "A"),
        (2, "S:/none.mp3", "D:/none.mp3", 0, "T", "A"),
        (3, "s:\\B.mp3", "D:/b.mp3", 2, "T", "A"),
        (4, "S:/c.mp3", "D:/c.mp3", 1, "T", "A"),
        (5, "S:/d.mp3", "D:/d.mp3", 1, "T", None),
        (6, "S:/gone.mp3", "D:/e.mp3", 0, "T", "A"),
        (7, "S:/none.mp3", "", 0, "T", "A"),
        (8, "S:/f.mp3", "D:/f.mp3", 1, "T", "A"),
    ]
    files = [("S:/a.mp3", 5, ["x"], "o", "o"), ("S:/b.mp3", 7, ["x"], "o", "o"), ("S:/c.mp3", 1, ["x"], "o", "o"), ("D:/C.mp3", 1, ["y"], "T", "A"), ("S:/d.mp3", 1, ["x"], "", ""), ("D:/d.mp3", 1, ["x"], "T", ""), ("D:/e.mp3", 1, None, "T", "A"), ("D:/e.mp3", 1, None, "T", "A"), ("S:/f.mp3", None, ["x"], None, None), ("D:/f.mp3", 3, ["x"], "T", "other")]
    return spark.createDataFrame(rows, ENTRIES), spark.createDataFrame(files, FILES)


def test_preflight(spark):
    rows, files = entries(spark)
    base = {(2, "source missing"), (3, "source artwork changed")}
    assert found(prepare.preflight_violations(rows, files), "row_id", "rule") == base | {(i, "destination exists") for i in (4, 5, 6, 8)}
    assert found(prepare.preflight_violations(rows, files, resume=True), "row_id", "rule") == base | {(4, "destination artwork differs"), (8, "destination tags differ")}
    assert tuple(prepare.preflight_totals(rows, files).first()) == (14, 4)
    assert prepare.preflight_violations(rows.limit(0), files).count() == 0


def test_actions(spark):
    rows, files = entries(spark)
    want = {1: "copied", 2: "failed", 3: "copied", 4: "resumed", 5: "resumed", 6: "resumed", 8: "resumed"}
    assert found(prepare.actions(rows, files), "row_id", "status", "deletes_source") == {(i, s, False) for i, s in want.items()}
    moved = {(i, s.replace("copied", "moved"), i not in (2, 6)) for i, s in want.items()}
    assert found(prepare.actions(rows, files, "move"), "row_id", "status", "deletes_source") == moved
    with pytest.raises(ValueError):
        prepare.actions(rows, files, "link")


def test_cleanup(spark):
    losers = [(1, "S:/a.mp3", "D:/w.mp3"), (2, "S:/deleted.mp3", "D:/w.mp3"), (3, "S:/missing.mp3", "D:/w.mp3"), (4, "S:/b.mp3", "D:/not.mp3"), (5, "S:/c.mp3", "D:/v.mp3"), (6, "S:/d.mp3", None), (7, "E:/e.mp3", "D:/w.mp3"), (8, "S:/e.mp3", "E:/w.mp3"), (9, "S:/f.mp3", "D:/w.mp3"), (10, "s:/F.mp3", "D:/w.mp3")]
    rows = spark.createDataFrame([(*x, "T", "A") for x in losers], "row_id long, source_path string, destination string, title string, artist string")
    there = ["S:/a.mp3", "S:/b.mp3", "S:/c.mp3", "S:/d.mp3", "E:/e.mp3", "S:/e.mp3", "S:/f.mp3", "D:/w.mp3", "E:/w.mp3"]
    files = spark.createDataFrame([(p, 1, [], "T", "A") for p in there] + [("D:/v.mp3", 1, [], "old", "A")], FILES)
    gone = spark.createDataFrame([("s:/deleted.mp3",), ("S:/deleted.mp3",)], "source_path string")
    want = {(3, "source missing"), (4, "winner missing"), (5, "winner tags differ"), (6, "no winner"), (7, "source outside root"), (8, "winner outside root"), (9, "source repeated"), (10, "source repeated")}
    assert found(prepare.cleanup_violations(rows, files, gone, "S:/", "D:/"), "row_id", "rule") == want


def record(i, source, title="Song", artist="Band", **other):
    base = dict(row_id=i, source_path=source, title=title, artist=artist, album_artist=None, album=None, date=None, track_number=None, disc_number=None, genre=None, compilation=False, needs_review=False, review_reason=None, excluded=False, exclusion_reason=None, output_extension=None, size=1)
    return tuple((base | other).values())


def test_prepared(spark):
    rows = spark.createDataFrame([record(1, "S:/in/1.mp3", "One Song"), record(2, "S:/in/2.flac", "One Song"), record(3, "S:/in/3.mp3", None, needs_review=True, review_reason="no title")], ROWS)
    index = spark.createDataFrame([], "key string, path string, artist string, title string, error string, normalized_artist string, normalized_title string")
    files = spark.createDataFrame([(f"S:/in/{n}", 1, [], None, None) for n in ("1.mp3", "2.flac", "3.mp3")], FILES)
    rows = rows.withColumn("expected_artwork", F.lit(0))
    run = lambda rows, index, **more: prepare.prepare_import(rows, index, files, "L:/lib", "W:/ready", materialise=lambda df: df, **more)
    held = run(rows, index)
    assert held.blocked == "review" and found(held.found, "row_id") == {(3,)}
    said = spark.createDataFrame([("s:/in/3.mp3", "tag", "Two Songs", False)], "source_path string, evidence string, title string, needs_review boolean")
    done = run(rows, index, resolutions=said)
    assert done.blocked is None
    assert found(done.actions, "row_id", "status") == {(2, "copied"), (3, "copied")}
    assert {r["line"] for r in done.playlist.where("line_no = 1").collect()} == {r["new_path"] for r in done.actions.collect()}
    assert all(r["new_path"].startswith("W:/ready/") for r in done.actions.collect())
    there = spark.createDataFrame([("l:/lib/x.mp3", "L:/lib/x.mp3", "BAND", "two songs", None, "band", "two songs")], index.schema)
    met = run(rows, there, resolutions=said)
    assert met.blocked == "collisions" and found(met.found, "row_id", "recommendation") == {(3, "skip_existing")}
    with pytest.raises(ValueError, match="resolutions"):
        run(rows, index, resolutions=said.withColumn("evidence", F.lit(" ")))
    with pytest.raises(ValueError, match="dry run"):
        run(rows.withColumn("expected_artwork", F.lit(1)), index, resolutions=said)


def test_resolutions(spark):
    rows = spark.createDataFrame([record(i, f"S:/{i}.mp3", needs_review=i < 8, review_reason="why" if i < 8 else None, album="Album", track_number=4) for i in range(1, 12)] + [record(20, "S:/twice.mp3", needs_review=True), record(21, "s:/TWICE.mp3", needs_review=True)], ROWS)
    schema = "source_path string, evidence string, changed array<string>, title string, artist string, album string, track_number int, needs_review boolean, review_reason string"
    ok = lambda i, changed, **v: (f"S:/{i}.mp3", v.pop("evidence", "tag"), changed, *[v.get(f) for f in ("title", "artist", "album", "track_number", "needs_review", "review_reason")])
    said = [
        ok(1, ["track_number", "needs_review"], track_number=9, needs_review=False),
        ok(2, ["album", "needs_review"], needs_review=False),
        ok(3, ["needs_review"], needs_review=False, evidence=" "),
        ok(4, [], needs_review=False),
        ok(5, ["title", "needs_review"], needs_review=False),
        ok(6, ["title"], title="New"),
        ok(7, ["excluded"], needs_review=False),
        ok(8, ["title"], title="Other Title"),
        ok(9, ["title"], title="Listed Title"),
        ok(10, ["needs_review", "review_reason"], needs_review=True, review_reason="doubt"),
        ok(11, ["needs_review"], needs_review=True),
        ok(99, ["title"], title="x"),
        ok("twice", ["needs_review"], needs_review=False),
    ]
    audited = spark.createDataFrame([("S:/9.mp3",)], "source_path string")
    done, broken = review.resolved(rows, spark.createDataFrame(said, schema), audited)
    want = {3: "no evidence", 4: "no changes", 5: "no title or artist", 6: "review not cleared", 7: "field not allowed", 8: "target not held", 11: "hold without a reason", 99: "unknown target", "twice": "manifest source repeated"}
    assert found(broken, "key", "rule") == {(f"s:/{k}.mp3", v) for k, v in want.items()}
    got = {r["row_id"]: r for r in done.collect()}
    assert len(got) == 13 and done.columns == rows.columns
    assert (got[1]["track_number"], got[1]["needs_review"], got[1]["album"]) == (9, False, "Album")
    assert (got[2]["track_number"], got[2]["album"], got[2]["needs_review"]) == (None, None, False)
    assert got[9]["title"] == "Listed Title" and (got[10]["needs_review"], got[10]["review_reason"]) == (True, "doubt")
    assert all((got[i]["title"], got[i]["track_number"]) == ("Song", 4) for i in (3, 4, 5, 6, 7, 8, 11))


def test_records_of_answers(spark):
    flat = {"id": "1", "title": "Song", "artist": "Band", "album": "Record", "trackNumber": 3, "compilation": True, "needsReview": True}
    nested = {"id": 2, "outputMetadata": {"title": "Tune", "artist": None, "needsReview": True, "reviewReason": "no artist"}}
    held = {"id": 3, "title": "Song", "artist": "Band", "reviewReason": " unsure "}
    answers = spark.createDataFrame([(0, json.dumps({"items": [flat, nested, held, {"id": "x"}, {"id": 8}]})), (1, "nothing")], "batch_id int, answer string")
    asked = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 4)], "batch_id int, id long")
    results = manifest.model_results(answers, asked)
    got = {r["id"]: r for r in manifest.cleaned_results(results).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1]["album"], got[1]["track_number"], got[1]["compilation"], got[1]["needs_review"]) == ("Record", 3, True, False)
    assert (got[2]["title"], got[2]["needs_review"], got[2]["review_reason"]) == ("Tune", True, "no artist")
    assert (got[3]["needs_review"], got[3]["review_reason"]) == (True, "unsure")
    assert found(manifest.unanswered(answers, results), "batch_id") == {(1,)}


def test_sanitised(spark):
    rows = spark.createDataFrame([(1, True, "a", True), (2, True, "b", None), (3, False, "c", False), (4, None, "d", True)], "row_id long, needs_revision boolean, feedback string, keeps boolean")
    out = review.sanitised(rows, F.col("keeps"))
    assert found(out, "row_id", "needs_revision", "feedback") == {(1, True, "a"), (2, False, None), (3, False, "c"), (4, None, "d")}
    assert tuple(review.sanitisation_summary(out).first()) == (2, 1, 1)


def test_playlist_labels(spark):
    rows = spark.createDataFrame([(1, "D:/a.mp3", " A ", "T"), (2, "D:/b.mp3", "", "T - "), (3, "d:/A.mp3", "x", "y")], "row_id long, new_path string, artist string, title string")
    got = [r["line"] for r in plan.playlist(rows).orderBy("row_id", "line_no").collect()]
    assert got == ["#EXTINF:-1,A - T", "D:/a.mp3", "#EXTINF:-1,T", "D:/b.mp3"]
