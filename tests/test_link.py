"""Bounded linkage by titles against every pair scored in plain Python."""

from difflib import SequenceMatcher
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.functions import fixed
from tidemark.operators import link

PART = Path("/root/testdata/sf0.001/part.parquet")


def _fold(x):
    return " ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in (x or "").lower()).split())


def _words(x):
    return {w for w in x.split() if w not in fixed.NOISE_WORDS}


def _score(s, c):
    (st, sa, sb), (ct, ca, cb) = s, c
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    core = lambda x: " ".join(w for w in x.split() if w not in fixed.VERSION_WORDS)
    wa, wb = _words(sa), _words(ca)
    title, album = ratio(st, ct), ratio(sb, cb)
    artist = max(ratio(sa, ca), len(wa & wb) / len(wa | wb) if wa and wb else 0.0)
    same = bool(core(st)) and core(st) == core(ct)
    vs, vc = _words(st) & set(fixed.VERSION_WORDS), _words(ct) & set(fixed.VERSION_WORDS)
    total = 65 * title + 25 * artist + 10 * album + 15 * same + 5 * bool(vs & vc) - 18 * bool(vs and vc and not vs & vc)
    return round(max(0, min(100, total)), 1), round(title, 3), round(artist, 3), round(album, 3), same, bool(vs and vc and not vs & vc)


def _brute(items, library, k):
    """{item: [(key, figures)]} over every pair that shares a word of three letters or the whole title."""
    out = {}
    for item, *texts in items:
        s = [_fold(x) for x in texts]
        found = []
        for key, *other in library:
            c = [_fold(x) for x in other]
            shared = {w for w in _words(s[0]) & _words(c[0]) if len(w) >= 3}
            if c[0] and (shared or s[0] == c[0]):
                got = _score(s, c)
                if got[1] >= 0.36 or got[4]:
                    found.append((-got[0], (other[0] or "").lower(), key, got))
        out[item] = [(key, got) for _, _, key, got in sorted(found)[:k]]
    return out


def _frames(spark, items, library):
    return spark.createDataFrame(items, "item_id long, title string, artist string, album string"), spark.createDataFrame(library, "key string, title string, artist string, album string")


def _got(frame):
    out = {}
    for r in frame.orderBy("item_id", "candidate_rank").collect():
        out.setdefault(r["item_id"], []).append((r["key"], tuple(r)[2:8]))
        assert r["candidate_rank"] == len(out[r["item_id"]])
    return out


ITEMS = [(1, "Blue Monday", "New Order", "Power"), (2, "Blue Monday (Radio Edit)", "New Order", None), (3, "the and", "x", None), (4, "", "y", ""), (5, None, "z", ""), (6, "Monday zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz", "New", "P"), (7, "Extended Mix", "A", "B"), (8, "Ünïcode Größe", "É", ""), (9, "Blue Monday", "New Order", "Power")]
LIBRARY = [(f"k{i:02}", t, a, b) for i, (t, a, b) in enumerate([("Blue Monday", "New Order", "Power"), ("blue monday", "NEW ORDER", "power"), ("Blue Monday", "Orgy", "Candyass"), ("Blue Monday Extended Mix", "New Order", ""), ("Blue Monday (Original Dub)", None, None), ("Monday", "q", "r"), ("Blue", "New Order", "Power"), ("Radio Mix", "A", "B"), ("the and", "x", None), ("", "New Order", "Power"), (None, "n", "n"), ("aaaaaaaaaaaaaaaaaaaaaaaaaaaa monday", "m", "n"), ("unicode grosse", "E", "")])] + [(f"m{i:03}", "Blue Monday", "New Order", "Power") for i in range(40)]


@pytest.mark.parametrize("k", [1, 2, 5])
def test_best_by_ratio_on_odd_rows(spark, k):
    frames = _frames(spark, ITEMS, LIBRARY)
    want = {i: v for i, v in _brute(ITEMS, LIBRARY, k).items() if v}
    got = _got(link.best_by_ratio(*frames, k=k, ascii_only=True))
    assert got == want
    assert "k12" in [key for key, _ in _got(link.best_by_ratio(*frames, k=k))[8]]  # accents are folded unless ASCII is promised


@pytest.fixture(scope="module")
def parts(spark):
    rows = [tuple(r) for r in spark.read.parquet(str(PART)).select("p_partkey", "p_name", "p_brand", "p_type").collect()]
    many = [(k + 1000 * j, f"{n} {('remix', 'live', 'club edit')[j]}" if j else n, b, t) for k, n, b, t in rows for j in range(3)]
    return [r for r in many if r[0] % 10 == 0], [(f"{r[0]:06}", *r[1:]) for r in many if r[0] % 10]


def test_best_by_ratio_equals_all_pairs(spark, parts):
    frames = _frames(spark, *parts)
    want = {i: v for i, v in _brute(*parts, 5).items() if v}
    assert len(want) > 50
    assert _got(link.best_by_ratio(*frames, ascii_only=True)) == want


def test_python_sees_few_pairs(spark):
    """Of the pairs of rows that share a word (0.01 of the tables), Python gets one in twenty."""
    part = spark.read.parquet(str(PART).replace("0.001", "0.01")).select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("album"))
    items = part.where("p_partkey % 10 = 0").withColumnRenamed("p_partkey", "item_id")
    library = part.where("p_partkey % 10 <> 0").withColumnRenamed("p_partkey", "key").withColumn("title", F.concat_ws(" ", "title", F.when(F.col("key") % 7 == 0, "Extended Mix")))
    every = link.blocked(items, library, ascii_only=True).count()
    _, _, found = link.ratio_pairs(items, library, ascii_only=True)
    seen = sum(found[field].count() for field in ("title", "artist", "album"))
    assert every > 80_000 and seen < 0.05 * every


def test_bound_is_above_every_ratio(spark):
    texts = ["abc", "cba", "blue monday", "monday blue", "aaaa", "aaab", "x", "", "blue monday 12"]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    bound = link.ratio_bound(F.col("a"), F.col("b"), link.letter_counts(F.col("a")), link.letter_counts(F.col("b")))
    for r in rows.select("a", "b", bound.alias("bound"), link.ratio("a", "b").alias("ratio")).collect():
        assert r["bound"] >= r["ratio"]
    assert rows.where(bound < 0.36).count() > 0


def test_title_pairs_once_and_with_hot_words(spark, monkeypatch):
    own = spark.createDataFrame([("blue red",), ("blue red",), ("red",), ("",)], "s string")
    theirs = spark.createDataFrame([(f"blue red {i}",) for i in range(30)] + [("red",), ("green",)], "c string")
    want = sorted(map(tuple, link.title_pairs(own, theirs).collect()))
    assert len(want) == len(set(want)) == 62 and ("red", "red", 2) in want
    monkeypatch.setattr(link, "HOT", 4)
    assert sorted(map(tuple, link.title_pairs(own, theirs).collect())) == want


def test_best_by_words_and_confidence(spark):
    items, library = _frames(spark, ITEMS, LIBRARY)
    got = {}
    for r in link.best_by_words(items, library, 3, ascii_only=True).orderBy("item_id", "candidate_rank").collect():
        got.setdefault(r["item_id"], []).append((r["key"], round(r["score"], 6)))
    want = {}
    for item, title, *_ in ITEMS:
        s = _fold(title)
        pairs = [(-len(_words(s) & _words(c)) / max(1, len(_words(s) | _words(c))), key) for key, t, *_ in LIBRARY if (c := _fold(t)) and ({w for w in _words(s) & _words(c) if len(w) >= 3} or s == c)]
        if pairs:
            want[item] = [(key, round(-x, 6)) for x, key in sorted(pairs)[:3]]
    assert got == want
    ranked = link.best_by_ratio(items, library, ascii_only=True)
    sure = {r["item_id"]: r["confidence"] for r in link.confidence(ranked, items).collect()}
    assert sure[1] == "high" and sure[4] == sure[5] == "unmatched" and set(sure) == {i[0] for i in ITEMS}


def test_renames_and_names_that_must_not_be_made(spark):
    renames = spark.createDataFrame([("D:/a.mp3", "D:/x.mp3"), ("d:\\A.mp3", "D:/y.mp3"), ("D:/b.mp3", "D:/X.mp3"), ("D:/c.mp3", "D:/b.mp3")], "old_path string, new_path string")
    files = spark.createDataFrame([("D:/A.mp3",), ("D:/b.mp3",)], "path string")
    places = spark.createDataFrame([(1, "D:/a.mp3"), (2, "file:///D:/b.mp3")], "location_id long, location string")
    got = sorted(map(tuple, link.rename_violations(renames, files, places).collect()))
    assert got == sorted([("D:/a.mp3", "source repeated"), ("D:/X.mp3", "destination repeated"), ("D:/b.mp3", "destination exists"), ("D:/c.mp3", "no stored location"), ("D:/c.mp3", "source missing")])
    names = spark.createDataFrame([("House",), ("HOUSE",), ("Techno",), ("Straße",)], "name string")
    there = spark.createDataFrame([("techno",), ("STRASSE",)], "name string")
    assert sorted(map(tuple, link.name_violations(names, there).collect())) == [("HOUSE", "name repeated"), ("Straße", "name exists"), ("Techno", "name exists")]
    assert link.name_violations(names.limit(0), there).count() == 0
