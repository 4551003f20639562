"""Evidence expressions against plain Python over nested values."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import fixed
from tidemark.functions import text as X
from tidemark.operators import evidence

TAGS = {"TIT2": {"encoding": 3, "text": ["Track"]}, "TPE1": {"text": ["Artist"]}, "TALB": "Album", "TDRC": {"text": [{"year": 2024, "month": 5, "day": 6}]}, "TRCK": [["1/10"]], "TKEY": "8A", "APIC:": {"exists": True, "byteLength": 12}, "PRIV": {"binaryBase64": "AA=="}}
VALUES = [
    None, True, 5, 2.5, "", " a \t b\u0001c ", "x" * 30, [], {}, [None, "", []], [[["deep"]]], ["a", ["b", "c"], 0, False],
    {"text": {"value": ["a", "b"]}}, {"value": 0}, {"text": None, "value": "unused"}, {"year": 1999}, {"year": 7, "month": 12}, {"year": 2001, "month": 2, "day": 3}, {"year": "x"}, {"month": 3},
    {"exists": True, "byteLength": 3}, {"exists": "true", "byteLength": 3, "text": "kept"}, {"exists": False, "byteLength": 3, "text": "kept"}, {"data": [{"binaryBase64": "x"}]}, [{"binaryBase64": "x"}, "y"],
    list(range(60)), {"covr": [1, 2], "cover_art": "text", "Attached  Picture": {"a": 1}, "other": {"apic": []}}, {f"k{i:03}": i for i in range(105)}, {'quo"te\\': 'q"\\/é'}, TAGS,
]
DEEP = "leaf"
for _ in range(15):
    DEEP = {"d": DEEP}
VALUES.append(DEEP)


def _cut(s, n):
    return s if len(s) <= n else f"{s[:n]}...[truncated {len(s) - n} chars]"


def _safe(v, hint="", depth=0, text=20, items=50):
    if depth > 12:
        return {"type": type(v).__name__, "value": _cut(json.dumps(v, separators=(",", ":")) if isinstance(v, (dict, list)) else str(v), text)}
    if isinstance(v, str):
        return _cut(v, text)
    if not isinstance(v, (dict, list)):
        return v
    if any(m in " ".join(hint.lower().replace("_", " ").split()) for m in fixed.IMAGE_KEYS):
        return {"exists": True, "count": max(1, len(v)) if isinstance(v, list) else 1}
    if isinstance(v, dict):
        return {k: _safe(x, k, depth + 1, text, items) for k, x in v.items()}
    more = [f"[{len(v) - items} additional values omitted]"] if len(v) > items else []
    return [_safe(x, hint, depth + 1, text, items) for x in v[:items]] + more


def _binary(v):
    if isinstance(v, dict):
        return (v.get("exists") is True and "byteLength" in v) or "binaryBase64" in v or any(map(_binary, v.values()))
    return isinstance(v, list) and any(map(_binary, v[:100]))


def _concise(v, most=20):
    if isinstance(v, dict):
        if _binary(v):
            return None
        for k in fixed.VALUE_WRAPPERS:
            if k in v:
                return _concise(v[k], most)
        parts = [v.get(k) for k in ("year", "month", "day")]
        if not isinstance(parts[0], int):
            return None
        out = f"{parts[0]:04}"
        for p in parts[1:]:
            if not isinstance(p, int):
                break
            out += f"-{p:02}"
        return out
    if isinstance(v, list):
        got = [x for x in (_concise(i, most) for i in v[:20]) if x is not None]
        return got[0] if len(got) == 1 else got or None
    if isinstance(v, str):
        return " ".join("".join(ch if ch > " " and ch != "\x7f" else " " for ch in v).split())[:most] or None
    return v


@pytest.fixture(scope="module")
def rows(spark):
    made = [(i, json.dumps(v)) for i, v in enumerate(VALUES)] + [(900, "no json"), (901, None)]
    return spark.createDataFrame(made, "i int, j string").withColumn("v", evidence.parsed(F.col("j"))).repartition(2).cache()


def _got(rows, column):
    return {r["i"]: r["x"] for r in rows.select("i", column.alias("x")).collect()}


def test_safe_json(rows):
    got = _got(rows, evidence.safe_json(F.col("v"), text=20))
    assert {i: json.loads(x) for i, x in got.items() if i < 900} == {i: _safe(v) for i, v in enumerate(VALUES)}
    assert got[900] is None and got[901] is None


def test_contains_binary(rows):
    got = _got(rows, evidence.contains_binary(F.col("v")))
    assert {i: x for i, x in got.items() if i < 900} == {i: _binary(v) for i, v in enumerate(VALUES)}


def test_concise_value(rows):
    got = _got(rows, evidence.concise_value(F.col("v"), 20))
    want = {i: _concise(v) for i, v in enumerate(VALUES)}
    want[VALUES.index(DEEP)] = None
    assert {i: None if x is None else json.loads(x) for i, x in got.items() if i < 900} == want
    assert got[VALUES.index(["a", ["b", "c"], 0, False])] == '["a", ["b", "c"], 0, false]'  # spaced, as lengths are counted


def test_compact_json(rows):
    got = {i: json.loads(x) for i, x in _got(rows, evidence.compact_json(F.col("v"), 10)).items() if i < 900}
    assert got[VALUES.index("x" * 30)] == "x" * 10 + "...[truncated 20 chars]"
    assert got[VALUES.index({"exists": True, "byteLength": 3})] == "[binary metadata omitted: 3 bytes]"
    assert got[VALUES.index([{"binaryBase64": "x"}, "y"])] == ["[binary metadata omitted: unknown bytes]", "y"]
    many = got[VALUES.index({f"k{i:03}": i for i in range(105)})]
    assert len(many) == 101 and many["omittedFields"] == 5
    assert got[VALUES.index(list(range(60)))][-1] == "[10 additional values omitted]"
    assert "[nested value omitted]" in json.dumps(got[VALUES.index(DEEP)])


def test_evidence_keeps_release_fields_within_its_budget(spark):
    said = {"title": "Track", "artist": "Artist", "album": "Album", "date": "2024-05-06", "trackNumber": "1/10"}
    tags = dict(TAGS, title="Track", Artists=["Artist"])
    whole = [{"tags": tags}, {"tags": {}}, {"tags": [1]}, {}, "plain", ["a"]]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(whole)], "i int, j string").withColumn("v", evidence.parsed(F.col("j")))
    got = {i: json.loads(x) for i, x in _got(rows, evidence.metadata_evidence(F.col("v"))).items()}
    assert got == {0: said, 1: {}, 2: {}, 3: {}, 4: "plain", 5: ["a"]}
    for most in (1, 2, 20, 21, 40, 60, 90, 104, 105):
        kept = dict(said)
        while kept and len(json.dumps(kept)) > most:
            kept.popitem()
        text = _got(rows.where("i = 0"), evidence.metadata_evidence(F.col("v"), most=most))[0]
        assert text == json.dumps(kept)


def test_original_texts_artwork_and_requests(spark):
    meta = json.dumps({"tags": {"tit2": {"text": [None, "", " unknown ", "Name"]}, "TPE1": {"value": "not text"}, "ARTIST": "Band", "initialkey": ["8A"], "covr": [1, 2, 3], "picture": "text"}})
    rows = spark.createDataFrame([(1, "C:\\a\\b\\c\\d.mp3", meta, '[{"id":2}]', 'say "x"'), (2, None, None, None, "")], "row_id long, source_path string, m string, context string, said string").withColumn("metadata", evidence.parsed(F.col("m")))
    texts = rows.select(*[c.alias(n) for n, c in evidence.original_texts(F.col("metadata")).items()]).collect()
    assert tuple(texts[0]) == ("Name", "Band", "", "", "8A") and tuple(texts[1]) == ("", "", "", "", "")
    assert [r[0] for r in rows.select(evidence.artwork_count(F.try_variant_get("metadata", "$.tags", "variant"))).collect()] == [3, 0]
    got = {r["row_id"]: json.loads(r["item"]) for r in evidence.request_items(rows, context="context", feedback="said").collect()}
    assert got[1]["source"] == "b\\c\\d.mp3" and got[1]["libraryContext"] == [{"id": 2}] and got[1]["auditFeedback"] == 'say "x"' and got[1]["originalMetadata"]["artist"] == ["Band", "not text"]
    assert set(got[2]) == {"id", "source", "originalMetadata"}


def test_cut_texts_and_keys(spark):
    rows = spark.createDataFrame([("abc",), ("abcdef",), ("a\n\tb",)], "s string")
    assert [r[0] for r in rows.select(X.truncated(F.col("s"), 4)).collect()] == ["abc", "abcd...[truncated 2 chars]", "a\n\tb"]
    keys = [r[0] for r in rows.select(X.safe_key(F.col("s"), 5, 1)).collect()]
    assert keys[0] == "abc" and keys[1].startswith("a...#") and len(keys[1]) == 6 and keys[2] == "a b"


def _inside(v, own, keys):
    got = own(v)
    if got is not None:
        return got
    for x in v if isinstance(v, list) else [v[k] for k in keys if k in v] if isinstance(v, dict) else []:
        if (got := _inside(x, own, keys)) is not None:
            return got
    return None


def _own_date(v):
    if isinstance(v, str) and (m := re.search(r"\b((?:19|20)\d{2}(?:-\d{2}(?:-\d{2})?)?)\b", v)):
        return m[1][:4] if m[1].endswith("-01-01") else m[1]
    if isinstance(v, dict) and isinstance(v.get("year"), int) and 1900 <= v["year"] <= 2099:
        month, day = ([v[k]] if isinstance(v.get(k), int) and 1 <= v[k] <= most else [] for k, most in (("month", 12), ("day", 31)))
        out = f"{v['year']}" + "".join(f"-{m:02}" + "".join(f"-{d:02}" for d in day) for m in month)
        return out[:4] if out.endswith("-01-01") else out
    return None


def _own_integer(v):
    if isinstance(v, bool):
        return None
    if isinstance(v, str):
        v = int(m[0]) if (m := re.search("[0-9]+", v)) else None
    return int(v) if isinstance(v, (int, float)) and v == int(v) and v > 0 else None


def _own_boolean(v):
    if isinstance(v, bool):
        return v
    word = str(v) if isinstance(v, int) else v.strip().lower() if isinstance(v, str) else None
    return True if word in ("1", "true", "yes") else False if word in ("0", "false", "no") else None


def test_nested_scalars(spark):
    values = VALUES[:-1] + ["from 1999-05-06 on", "1899", "2001-01-01", ["x", "2020"], {"year": 2001, "month": 13}, {"year": 2001, "day": 3}, {"text": {"year": 1999, "month": 4, "day": 9}}, 3.0, 3.5, -1, "7/12", "0", {"number": "9"}, {"value": [0, 4]}, " YES ", ["maybe", 0], {"value": True}, {"text": 2, "value": "no"}]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, None), (901, "{")], "i int, j string").withColumn("v", evidence.parsed(F.col("j")))
    for column, own, keys in ((evidence.nested_date, _own_date, ["text"]), (evidence.nested_integer, _own_integer, ["text", "value", "number"]), (evidence.nested_boolean, _own_boolean, ["text", "value"])):
        want = {i: _inside(v, own, keys) for i, v in enumerate(values)} | {900: None, 901: None}
        assert _got(rows, column(F.col("v"))) == want, column.__name__
