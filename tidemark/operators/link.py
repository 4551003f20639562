"""Record linkage: exact tiers, blocked candidates, similarity, ranking and confidence."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..sources.shared import spread
from .folds import first_of_each, join_facts


#: A title word of more library titles than this is dealt to several keys.
HOT = 10_000
#: Rows with one title stand together in lists of about so many. Spark holds the rows that it writes out of two lists until
#: the next task step takes them, so that the square of this, and not the table, is what a task holds.
SHARE = 300
#: The characters of a folded text.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
#: Writes a DataFrame that is read several times, such as a checkpoint in a shared folder.
Cut = Callable[[DataFrame], DataFrame]


@F.pandas_udf(T.DoubleType())
def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-block ratio of two texts; 0 if one is blank. Not symmetric, and not an edit distance."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right, strict=True)])


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def exact_link(items: DataFrame, library: DataFrame) -> DataFrame:
    """(item_id, key, tier, candidates): artist and title if they name one record, else a title that names one."""
    lib = library.select("key", X.link_key(F.col("artist"), True).alias("a"), X.link_key(F.col("title"), True).alias("t")).where("t <> ''")
    both = lib.groupBy("a", "t").agg(F.count("*").alias("n_both"), F.min("key").alias("k_both"))
    title = lib.groupBy("t").agg(F.count("*").alias("n_title"), F.min("key").alias("k_title"))
    rows = items.select("item_id", X.link_key(F.col("artist"), True).alias("a"), X.link_key(F.col("title"), True).alias("t"))
    rows = rows.join(both, ["a", "t"], "left").join(title, "t", "left")
    tier = F.when(F.col("n_both") == 1, "artist_title").when(F.col("n_title") == 1, "title")
    key = F.when(F.col("n_both") == 1, F.col("k_both")).when(F.col("n_title") == 1, F.col("k_title"))
    return rows.select("item_id", key.alias("key"), tier.alias("tier"), F.coalesce("n_both", F.lit(0)).alias("same_both"), F.coalesce("n_title", F.lit(0)).alias("same_title"))


def letter_counts(c: Column) -> Column:
    """How often each character that a folded text can have is in it."""
    return F.transform(F.array(*[F.lit(x) for x in LETTERS]), lambda x: F.length(c) - F.length(F.replace(c, x, F.lit(""))))


def ratio_bound(a: Column, b: Column, letters_a: Column, letters_b: Column) -> Column:
    """No matching-block ratio of two folded texts is greater: matched characters are in both."""
    shared = F.aggregate(F.zip_with(letters_a, letters_b, lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)
    return F.when((F.length(a) > 0) & (F.length(b) > 0), 2 * shared / (F.length(a) + F.length(b))).otherwise(0.0)


def title_pairs(own: DataFrame, theirs: DataFrame, least: int = 3, floor: float | None = None) -> DataFrame:
    """(s, c, shared): the folded titles of own(s) and theirs(c) that share a word of `least` letters, or are equal.

    Titles are made distinct first, so work follows the titles and not the rows that bear them. A pair is made once, at the
    first of its shared words. With a floor, pairs whose ratio cannot reach it (:func:`ratio_bound`) are dropped where they
    meet, unless their core titles are equal. Of a word of more than HOT library titles the titles are dealt to several
    keys, and the others with that word are sent to all of them."""

    def tokens(df: DataFrame, name: str) -> DataFrame:
        t = F.col(name)
        own_words = F.filter(X.words(t), lambda w: F.length(w) >= least)
        rows = df.select(name).where(t != "").distinct().select(name, F.array_distinct(F.concat(own_words, F.array(F.concat(F.lit("="), t)))).alias(f"{name}_tokens"), letter_counts(t).alias(f"{name}_letters"))
        return rows.withColumn("token", F.explode(f"{name}_tokens"))

    left, right = tokens(own, "s"), tokens(theirs, "c")
    hot = right.groupBy("token").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    right = right.join(hot, "token", "left").withColumn("part", F.pmod(F.xxhash64("c"), parts).cast("int")).drop("parts")
    left = left.join(hot, "token", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    both = left.join(right, ["token", "part"]).withColumn("both", F.array_intersect("s_tokens", "c_tokens")).where(F.get("both", 0) == F.col("token"))
    if floor is not None:
        both = both.where((ratio_bound(F.col("s"), F.col("c"), F.col("s_letters"), F.col("c_letters")) >= floor) | _title_facts()["core_equal"])
    return both.select("s", "c", F.size("both").cast("long").alias("shared"))


def _lists(rows: DataFrame, title: str, key: str) -> DataFrame:
    """(title, keys): the keys of the rows with a title, nulls and copies too, in lists of about SHARE."""
    sizes = rows.groupBy(title).agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64(key), F.ceil(F.col("n") / SHARE))
    lists = join_facts(rows, sizes, [title], "n").groupBy(title, part.alias("part")).agg(F.collect_list(F.struct(key)).alias(f"{key}s"))
    return lists.select(title, F.col(f"{key}s")[key].alias(f"{key}s"))


def blocked(items: DataFrame, library: DataFrame, least: int = 3, ascii_only: bool = False) -> DataFrame:
    """(item_id, key, shared): all pairs of rows whose titles are :func:`title_pairs`.

    Title pairs meet lists of rows, and are dealt to all cores before lists meet lists, and again before these are written
    out as pairs, so that only titles and lists are shuffled and a pair of rows exists in the result alone. Their number is
    quadratic in the rows."""
    own = items.select("item_id", X.folded(F.col("title"), ascii_only).alias("s"))
    theirs = library.select("key", X.folded(F.col("title"), ascii_only).alias("c"))
    met = spread(title_pairs(own, theirs, least).join(_lists(own, "s", "item_id"), "s").select("c", "shared", "item_ids"))
    pairs = met.join(_lists(theirs, "c", "key"), "c").select("shared", "item_ids", "keys")
    left = spread(pairs).select("shared", "keys", F.explode("item_ids").alias("item_id"))
    return left.select("item_id", "shared", F.explode("keys").alias("key")).select("item_id", "key", "shared")


def figures(rows: DataFrame) -> DataFrame:
    """Adds the similarity figures to rows with folded titles s and c, artists s_artist and c_artist, and the ratios title_r,
    artist_r and album_r."""
    rows = rows.withColumns({"artist_s": F.greatest("artist_r", jaccard(X.words(F.col("s_artist")), X.words(F.col("c_artist")))), **_title_facts()})
    total = _base() + 25 * F.col("artist_s") + 10 * F.col("album_r")
    figured = {"score": F.bround(_clipped(total), 1), "title_ratio": F.bround("title_r", 3), "artist_similarity": F.bround("artist_s", 3), "album_similarity": F.bround("album_r", 3), "core_title_equal": F.col("core_equal"), "version_conflict": F.col("conflict")}
    return rows.withColumns(figured).drop("title_r", "artist_r", "album_r", "artist_s", "core_equal", "overlap", "conflict")


def _title_facts() -> dict[str, Column]:
    """What two folded titles have in common besides their letters."""
    sv, cv, core = X.version_words(F.col("s")), X.version_words(F.col("c")), X.core_title(F.col("s"))
    overlap = F.size(F.array_intersect(sv, cv)) > 0
    return {"core_equal": (core != "") & (core == X.core_title(F.col("c"))), "overlap": overlap, "conflict": (F.size(sv) > 0) & (F.size(cv) > 0) & ~overlap}


def _base() -> Column:
    """What titles alone give."""
    return 65 * F.col("title_r") + F.when(F.col("core_equal"), 15).otherwise(0) + F.when(F.col("overlap"), 5).otherwise(0) - F.when(F.col("conflict"), 18).otherwise(0)


def _clipped(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))


def scored(pairs: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(item_id, key) of pairs with s_/c_ title, artist, album, and the similarity figures: three ratios a pair."""
    f = {k: X.folded(F.col(k), ascii_only) for k in ("s_title", "c_title", "s_artist", "c_artist", "s_album", "c_album")}
    rows = pairs.select("item_id", "key", *[v.alias(k) for k, v in f.items()]).withColumnsRenamed({"s_title": "s", "c_title": "c"})
    rows = rows.withColumns({"title_r": ratio(F.col("s"), F.col("c")), "artist_r": ratio(F.col("s_artist"), F.col("c_artist")), "album_r": ratio(F.col("s_album"), F.col("c_album"))})
    return figures(rows).drop("s", "c", "s_artist", "c_artist", "s_album", "c_album")


def ratio_pairs(items: DataFrame, library: DataFrame, k: int = 5, least: int = 3, floor: float = 0.36, ascii_only: bool = False, cut: Cut = lambda df: df) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """The pairs that can be among the k best of an item, as (texts of items, texts of library rows, ratios of text pairs).

    Items, and library rows, with the same folded texts score alike, so texts are paired, not rows; of library rows with the
    same texts the first k can rank. A title pair is kept when its ratio or core title passes the floor and when, with full
    marks for artist and album, it can still reach the k-th row of the title pairs before it. Ratios are computed once for
    each distinct pair of titles, artists and albums that is left: the frames in the last value are all that Python sees."""
    names = [X.folded(F.col(c), ascii_only).alias(n) for c, n in (("title", "s"), ("artist", "s_artist"), ("album", "s_album"))]
    own = cut(items.select("item_id", *names))
    names = [X.folded(F.col(c), ascii_only).alias(n) for c, n in (("title", "c"), ("artist", "c_artist"), ("album", "c_album"))]
    theirs = library.select("key", X.folded_case(F.coalesce("title", F.lit(""))).alias("c_name"), *names)
    theirs = cut(first_of_each(theirs, ["c", "c_artist", "c_album"], [F.col("c_name"), F.col("key")], k).drop("place"))
    titles = title_pairs(own, theirs, least, floor - 0.0006).withColumn("title_r", ratio(F.col("s"), F.col("c")))
    titles = cut(titles.withColumns(_title_facts()))
    passed = titles.where((F.bround("title_r", 3) >= floor) | F.col("core_equal")).withColumn("base", _base())
    held = theirs.groupBy("c").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("s").orderBy(F.col("base").desc(), "c").rowsBetween(Window.unboundedPreceding, 0)
    reach = passed.join(held, "c").withColumn("sum", F.sum("rows").over(before)).where(F.col("sum") >= k).groupBy("s").agg(F.max("base").alias("kth"))
    can = F.col("kth").isNull() | (_clipped(F.col("base") + 35) >= _clipped(F.col("kth")) - 0.11)
    kept = cut(passed.join(reach, "s", "left").where(can).select("s", "c", "title_r"))
    pairs = kept.join(own.select("s", "s_artist", "s_album").distinct(), "s").join(theirs.select("c", "c_artist", "c_album").distinct(), "c")
    parts = {"title": titles.select("s", "c", "title_r")}
    for field in ("artist", "album"):
        texts = [f"s_{field}", f"c_{field}"]
        parts[field] = cut(pairs.select(*texts).distinct().withColumn(f"{field}_r", ratio(*[F.col(c) for c in texts])))
        pairs = pairs.join(parts[field], texts)
    return own, theirs, parts | {"pairs": pairs}


def best_by_ratio(items: DataFrame, library: DataFrame, k: int = 5, least: int = 3, floor: float = 0.36, ascii_only: bool = False, cut: Cut = lambda df: df) -> DataFrame:
    """(item_id, key, figures, candidate_rank): the k best library rows of each item, as if every pair that shares a title
    word were scored; ties go to the first title, then key. `cut` writes what is used several times."""
    own, theirs, found = ratio_pairs(items, library, k, least, floor, ascii_only, cut)
    texts = ["s", "s_artist", "s_album"]
    rows = figures(found["pairs"]).join(theirs, ["c", "c_artist", "c_album"])
    rows = first_of_each(rows, texts, [F.col("score").desc(), F.col("c_name"), F.col("key")], k, "candidate_rank")
    return own.join(rows, texts).select("item_id", "key", "score", "title_ratio", "artist_similarity", "album_similarity", "core_title_equal", "version_conflict", "candidate_rank")


def best_by_words(items: DataFrame, library: DataFrame, k: int = 5, least: int = 3, ascii_only: bool = False) -> DataFrame:
    """(item_id, key, score, candidate_rank): the k library rows whose title words are nearest by Jaccard, ties by key.

    Titles are scored, not rows; of library rows with one title the first k can rank."""
    own = items.select("item_id", X.folded(F.col("title"), ascii_only).alias("s"))
    theirs = first_of_each(library.select("key", X.folded(F.col("title"), ascii_only).alias("c")), ["c"], [F.col("key")], k).drop("place")
    pairs = title_pairs(own, theirs, least).select("s", "c", jaccard(X.words(F.col("s")), X.words(F.col("c"))).alias("score"))
    best = first_of_each(pairs.join(theirs, "c"), ["s"], [F.col("score").desc(), F.col("key")], k, "candidate_rank")
    return own.join(best, "s").select("item_id", "key", "score", "candidate_rank")


def top(scored_rows: DataFrame, k: int = 5, tie: str = "key") -> DataFrame:
    return first_of_each(scored_rows, ["item_id"], [F.col("score").desc(), F.col(tie)], k, "candidate_rank")


def confidence(ranked: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, confidence) of all items from their two best candidates; those without any are unmatched."""
    w = Window.partitionBy("item_id").orderBy("candidate_rank")
    first = ranked.withColumn("gap", F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0))).where("candidate_rank = 1")
    clear = ~F.col("version_conflict")
    high = clear & (((F.col("title_ratio") >= 0.96) & (F.col("artist_similarity") >= 0.7)) | (F.col("core_title_equal") & (F.col("artist_similarity") >= 0.6) & (F.col("score") >= 80)))
    possible = clear & (F.col("score") >= 68) & (F.col("title_ratio") >= 0.6) & ((F.col("gap") >= 5) | (F.col("artist_similarity") >= 0.6))
    found = first.select("item_id", F.when(high, "high").when(possible, "possible").otherwise("review").alias("found"))
    return items.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("found", F.lit("unmatched")).alias("confidence"))


def chosen(memberships: DataFrame, linked: DataFrame) -> DataFrame:
    """Memberships with their best candidate by (plan, playlist, track_no); those without one are flagged."""
    best = linked.where("candidate_rank = 1").select("plan", "playlist", "track_no", F.col("key").alias("media_key"))
    return memberships.join(best, ["plan", "playlist", "track_no"], "left").withColumn("missing", F.col("media_key").isNull())


def located(renames: DataFrame, locations: DataFrame) -> DataFrame:
    """Each rename with its location: by exact path, else by a percent-encoded address; missing ones are flagged."""
    exact = locations.select(X.path_key(F.col("location")).alias("old_key"), F.col("location_id").alias("exact_id"))
    coded = locations.where(F.col("location").startswith("file://")).select(X.path_key(F.url_decode(F.regexp_replace("location", "^file:///?", ""))).alias("old_key"), F.col("location_id").alias("coded_id"))
    rows = renames.withColumn("old_key", X.path_key(F.col("old_path"))).join(exact, "old_key", "left").join(coded, "old_key", "left")
    return rows.select("old_path", "new_path", F.coalesce("exact_id", "coded_id").alias("location_id"), F.coalesce("exact_id", "coded_id").isNull().alias("missing"))


def rename_violations(renames: DataFrame, files: DataFrame, locations: DataFrame) -> DataFrame:
    """(path, rule) of renames(old_path, new_path) that must not be made: paths must be named once, by path key; the old file
    must be among files(path) and have a stored location, the new one must not be there."""
    rows = renames.select("old_path", "new_path", X.path_key(F.col("old_path")).alias("old_key"), X.path_key(F.col("new_path")).alias("new_key"))
    there = files.select(X.path_key(F.col("path")).alias("key")).distinct().withColumn("there", F.lit(True))
    twice = lambda side: rows.groupBy(f"{side}_key").agg(F.min(f"{side}_path").alias("path"), F.count("*").alias("n")).where("n > 1")
    old = rows.join(there.withColumnRenamed("key", "old_key"), "old_key", "left_anti").select(F.col("old_path").alias("path"), F.lit("source missing").alias("rule"))
    new = rows.join(there.withColumnRenamed("key", "new_key"), "new_key", "left_semi").select(F.col("new_path").alias("path"), F.lit("destination exists").alias("rule"))
    lost = located(renames.select("old_path", "new_path"), locations).where("missing").select(F.col("old_path").alias("path"), F.lit("no stored location").alias("rule"))
    parts = [twice("old").select("path", F.lit("source repeated").alias("rule")), twice("new").select("path", F.lit("destination repeated").alias("rule")), old, new, lost.distinct()]
    return reduce(DataFrame.unionByName, parts)


def name_violations(playlists: DataFrame, existing: DataFrame) -> DataFrame:
    """(name, rule) of playlists(name) that an import must not make: the name is there already, or asked for twice, by case
    folding."""
    asked = playlists.groupBy(X.folded_case(F.col("name")).alias("k")).agg(F.min("name").alias("name"), F.count("*").alias("n"))
    there = existing.select(X.folded_case(F.col("name")).alias("k")).distinct()
    twice = asked.where("n > 1").select("name", F.lit("name repeated").alias("rule"))
    return asked.join(there, "k", "left_semi").select("name", F.lit("name exists").alias("rule")).unionByName(twice)
