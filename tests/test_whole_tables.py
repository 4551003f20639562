"""Queries that once read a share of their table: all rows, held against plain Python."""

import re

from tidemark.operators import plan
from tidemark.plans import catalogue
from tidemark.plans.fixtures import dirty, tracks

SF = "/root/testdata/sf0.01"


def test_scalar_values_all_customers(spark):
    rows = {r["row_id"]: (r["number"], r["date"], r["tail"]) for r in catalogue.QUERIES["scalar_values"](spark, SF).collect()}
    keys = [r[0] for r in catalogue.table(spark, SF, "customer").select("c_custkey").collect()]
    dates = {0: "1999", 1: "1999-13", 2: "1999-01-02", 3: None}
    assert max(keys) > 999
    assert rows == {k: (None if k % 3 == 0 else k % 40 or None, dates[k % 4], f"{k:03d}") for k in keys}


def test_canonical_identity_all_titles(spark):
    fold = lambda x: re.sub("[^a-z0-9]+", " ", x.lower()).strip()
    wanted = {r["row_id"]: (fold(r["artist"].split(" feat. ")[0]), fold(r["title"])) for r in dirty(spark, SF).collect()}
    got = {r["row_id"]: (r["artist_key"], r["title_key"]) for r in catalogue.QUERIES["canonical_identity"](spark, SF).collect()}
    assert len(wanted) == 2000 and got == wanted


def test_audit_sanitised_all_rows(spark):
    got = {r["row_id"]: r["kept"] for r in catalogue.QUERIES["audit_sanitised"](spark, SF).collect()}
    assert got == {r["row_id"]: r["row_id"] % 2 == 0 for r in dirty(spark, SF).collect()} and len(got) == 2000


def test_identity_groups_all_tracks(spark):
    fold = lambda x: re.sub("[^a-z0-9]+", " ", x.lower()).strip()
    wanted = {}
    for r in plan.with_paths(tracks(spark, SF), catalogue.ROOT).collect():
        path = r["new_path"] or f"D:/library/held/{r['row_id']}.mp3"
        wanted.setdefault((fold(r["artist"]), fold(r["title"])), []).append(path)
    wanted = {k: (len(v), " | ".join(sorted(v, key=lambda p: (p.lower(), p)))) for k, v in wanted.items()}
    got = {(r["normalized_artist"], r["normalized_title"]): (r["n"], r["paths"]) for r in catalogue.QUERIES["identity_groups"](spark, SF).collect()}
    assert sum(n for n, _ in got.values()) == 2000 and got == wanted


def test_bundles_of_all_tracks(spark):
    fold = lambda x: re.sub("[^a-z0-9]+", " ", x.lower()).strip()
    rows = {r["row_id"]: r for r in plan.with_paths(tracks(spark, SF), catalogue.ROOT).collect() if r["new_path"]}
    at = {i: i for i in rows}

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    first = {}
    for i, r in rows.items():
        for key in (r["new_path"].lower(), (fold(r["artist"]), fold(r["title"]))):
            one, two = sorted((find(i), find(first.setdefault(key, i))))
            at[two] = one
    wanted = {i: find(i) for i in rows}
    got = {r["row_id"]: r["component"] for r in catalogue.QUERIES["bundle_components"](spark, SF).collect()}
    assert {i % 4 for i in got} == {0, 1, 2, 3} and got == wanted
    skips = catalogue.QUERIES["bundle_skips"](spark, SF).collect()
    kept = {r["component"]: r["kept_row_id"] for r in skips}
    groups = {c for c in wanted.values() if c not in kept}
    assert all(wanted[k] == c for c, k in kept.items())
    assert sorted(r["row_id"] for r in skips) == sorted(i for i, c in wanted.items() if c not in groups and i != kept[c])
    assert all(sum(c == g for c in wanted.values()) == 1 for g in groups)


def test_link_confidence_counts_unmatched(spark, tmp_path):
    rows = [(10, "Band", "same words here", "x"), (11, "Band", "same words here", "x"), (20, "Band", "zzzzz qqqqq", "x"), (30, "Other", "here " + "v" * 40, "y")]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["confidence"]: r["n"] for r in catalogue.QUERIES["link_confidence"](spark, str(tmp_path)).collect()}
    assert got == {"high": 1, "unmatched": 2}
