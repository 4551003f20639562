"""Destination planning: readiness, planned paths, one winner in every duplicate group, plan counts, contract checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X

WRITTEN = ["title", "artist", "album_artist", "album", "date", "track_number", "disc_number", "genre", "compilation"]


def has_text(c: Column) -> Column:
    return X.clean_text(c) != ""


def is_ready() -> Column:
    """Not excluded, not held for review, title and artist present."""
    held = F.coalesce(F.col("excluded"), F.lit(False)) | F.coalesce(F.col("needs_review"), F.lit(False))
    return ~held & has_text(F.col("title")) & has_text(F.col("artist"))


def is_accepted() -> Column:
    return is_ready()


def is_held() -> Column:
    return F.coalesce(F.col("needs_review"), F.lit(False))


def is_processed() -> Column:
    return is_accepted() | is_held()


def track_filename() -> Column:
    source = X.stem(F.col("source_path"))
    title = X.sanitize_component(F.col("title"), source)
    n, disc = X.positive_integer(F.col("track_number")), X.positive_integer(F.col("disc_number"))
    prefix = F.when(disc > 1, F.format_string("%d-%02d - ", disc, n)).otherwise(F.format_string("%02d - ", n))
    artist = X.sanitize_component(F.col("artist"), F.lit("Unknown Artist"))
    both = lambda t: X.sanitize_component(F.concat(artist, F.lit(" - "), t), t)
    title = X.let(title, lambda t: F.when(F.coalesce(F.col("compilation"), F.lit(False)), both(t)).otherwise(t))
    name = X.sanitize_component(F.concat(F.when(n.isNotNull(), prefix).otherwise(F.lit("")), title), X.stem(F.col("source_path")))
    return F.concat(name, X.output_extension(F.col("output_extension"), X.suffix(F.col("source_path"))))


def planned_path(root: Column) -> Column:
    """Null unless ready. No album: artist folder; compilation: Various Artists; else the album artist's album folder."""
    artist = X.sanitize_component(F.col("artist"), F.lit("Unknown Artist"))
    stem = X.stem(F.col("source_path"))
    single = F.concat(X.sanitize_component(F.concat(artist, F.lit(" - "), X.sanitize_component(F.col("title"), stem)), stem), X.output_extension(F.col("output_extension"), X.suffix(F.col("source_path"))))
    release = X.sanitize_component(F.coalesce(X.blank_to_null(F.col("album_artist")), F.col("artist")), artist)
    release = F.when(F.coalesce(F.col("compilation"), F.lit(False)), F.lit("Various Artists")).otherwise(release)
    path = F.when(~has_text(F.col("album")), F.concat_ws("/", root, artist, single)).otherwise(F.concat_ws("/", root, release, X.sanitize_component(F.col("album"), F.lit("Unknown Album")), track_filename()))
    return F.when(is_ready(), path)


def with_paths(rows: DataFrame, root: str) -> DataFrame:
    return rows.withColumn("new_path", planned_path(F.lit(root)))


def format_quality(path: Column) -> Column:
    scores = F.create_map(*[F.lit(x) for kv in fixed.FORMAT_QUALITY.items() for x in kv])
    return F.coalesce(scores[X.suffix(path)], F.lit(0))


def preference() -> list[Column]:
    """Order of the copies of one work: fewest copy marks, best format, largest, first by path."""
    p = F.col("source_path")
    return [X.copy_suffix_depth(X.stem(p)), -format_quality(p), -F.coalesce(F.col("size"), F.lit(0)), X.path_key(p), F.col("row_id")]


def preferred() -> Column:
    """:func:`preference` as one value; the smallest is the best."""
    return F.struct(*[c.alias(f"p{i}") for i, c in enumerate(preference())])


def one_winner(rows: DataFrame) -> DataFrame:
    """Per destination (whatever its format) the preferred row keeps its path; the others get is_winner = false.

    Winners are summed up before the shuffle and joined by row_id, so a destination that many rows name is no hot key.
    row_id must be unique."""
    named = rows.where(F.col("new_path").isNotNull()).withColumn("identity", X.destination_identity(F.col("new_path")))
    winners = named.groupBy("identity").agg(F.min(preferred()).alias("best")).select(F.col(f"best.p{len(preference()) - 1}").alias("row_id"), F.lit(True).alias("is_winner"))
    ranked = named.join(winners, "row_id", "left").withColumn("is_winner", F.coalesce("is_winner", F.lit(False))).select(*named.columns, "is_winner")
    rest = rows.where(F.col("new_path").isNull()).withColumns({"identity": F.lit(None).cast("string"), "is_winner": F.lit(False)})
    return ranked.unionByName(rest)


def plan_counts(ranked: DataFrame) -> DataFrame:
    return ranked.agg(F.count("*").alias("n_rows"), F.count_if("is_winner").alias("planned"), F.count_if(F.col("new_path").isNull()).alias("review_blanks"), F.count_if(F.col("new_path").isNotNull() & ~F.col("is_winner")).alias("duplicate_blanks"))


def space_estimate(rows: DataFrame, same_volume: bool, slack: int = 256 << 20) -> DataFrame:
    """Bytes needed: the largest file when files are moved on one volume, all of them otherwise, and some slack."""
    need = F.coalesce(F.max("size") if same_volume else F.sum("size"), F.lit(0))
    return rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"), (need + slack).alias("required"))


def repeated(rows: DataFrame, key: Column, rule: str) -> DataFrame:
    """Keys that occur more than once, as violations."""
    return rows.where(key.isNotNull()).groupBy(key.alias("detail")).agg(F.min("row_id").alias("row_id"), F.count("*").alias("n")).where("n > 1").select("row_id", F.lit(rule).alias("rule"), "detail")


def contract_violations(expected: DataFrame, actual: DataFrame, evidence: DataFrame, root: str) -> DataFrame:
    """(row_id, rule, detail) for every breach of a plan; empty if the plan holds.

    expected(row_id, source_path, new_path, written fields); actual likewise, as read back; evidence(source_path):
    rows whose path may be blank in actual. Only a path may differ, and only with evidence."""
    names = [c for c in [*WRITTEN, "source_path", "new_path"] if c in expected.columns]
    left = expected.select("row_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"e_{c}") for c in names])
    right = actual.select("row_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"a_{c}") for c in names]).withColumn("__here", F.lit(True))
    proof = evidence.select(X.path_key(F.col("source_path")).alias("__key")).distinct().withColumn("__proof", F.lit(True))
    both = left.withColumn("__there", F.lit(True)).join(right, "row_id", "full_outer")
    both = both.withColumn("__key", X.path_key(F.coalesce("e_source_path", "a_source_path"))).join(proof, "__key", "left")
    skipped = F.coalesce(F.col("__proof"), F.lit(False)) & (F.col("a_new_path") == "")
    rules = [F.when(F.col("__here").isNull(), F.struct(F.lit("row missing").alias("rule"), F.col("e_source_path").alias("detail"))), F.when(F.col("__there").isNull(), F.struct(F.lit("row not expected").alias("rule"), F.col("a_source_path").alias("detail")))]
    paired = F.col("__here") & F.col("__there")
    for c in names:
        differs = F.col(f"e_{c}") != F.col(f"a_{c}")
        if c == "new_path":
            differs = differs & ~skipped
        rules.append(F.when(paired & differs, F.struct(F.lit(f"{c} differs").alias("rule"), F.col(f"a_{c}").alias("detail"))))
    outside = paired & (F.col("a_new_path") != "") & ~X.is_within(F.col("a_new_path"), F.lit(root))
    rules.append(F.when(outside, F.struct(F.lit("destination outside root").alias("rule"), F.col("a_new_path").alias("detail"))))
    foreign = paired & (F.col("a_new_path") != "") & ~X.suffix(F.col("a_new_path")).isin(fixed.OUTPUT_EXTENSIONS)
    rules.append(F.when(foreign, F.struct(F.lit("extension not supported").alias("rule"), F.col("a_new_path").alias("detail"))))
    found = both.select("row_id", F.explode(F.array_compact(F.array(*rules))).alias("v")).select("row_id", "v.rule", "v.detail")
    active = actual.where(has_text(F.col("new_path")))
    unique = [repeated(actual, X.path_key(F.col("source_path")), "source repeated"), repeated(active, X.path_key(F.col("new_path")), "destination repeated"), repeated(active, X.destination_identity(F.col("new_path")), "identity repeated")]
    known = expected.select(X.path_key(F.col("source_path")).alias("__key"))
    blank = actual.where(~has_text(F.col("new_path"))).select(X.path_key(F.col("source_path")).alias("__key"))
    unused = proof.join(known, "__key", "left_semi").join(blank, "__key", "left_anti").select(F.lit(None).cast("long").alias("row_id"), F.lit("evidence not used").alias("rule"), F.col("__key").alias("detail"))
    strange = proof.join(known, "__key", "left_anti").select(F.lit(None).cast("long").alias("row_id"), F.lit("evidence unknown").alias("rule"), F.col("__key").alias("detail"))
    return reduce(DataFrame.unionByName, [*unique, unused, strange], found)


def require_empty(violations: DataFrame, what: str) -> None:
    """Raises if a check found anything."""
    first = violations.take(1)
    if first:
        raise ValueError(f"{what}: {first[0]}")


def skip_evidence(collisions: DataFrame, skips: DataFrame) -> DataFrame:
    """Evidence from both accepted layouts, one row a source; conflicting destinations and unsafe rows are flagged."""
    one = collisions.where(F.col("recommendation") == "skip_existing").select(F.col("source_path"), F.col("new_path").alias("destination"), F.lit("collision").alias("origin"))
    two = skips.select(F.col("skipped_source").alias("source_path"), F.col("skipped_destination").alias("destination"), F.when(F.col("reason").isin("same_destination", "same_identity", "same_destination+same_identity"), F.lit("bundle")).alias("origin"))
    every = one.unionByName(two).withColumn("key", X.path_key(F.col("source_path")))
    return every.groupBy("key").agg(F.min(X.path_key(F.col("destination"))).alias("destination"), F.count_distinct(X.path_key(F.col("destination"))).alias("n_destinations"), F.bool_or(F.col("origin").isNull() | (F.trim("source_path") == "") | (F.trim("destination") == "")).alias("unsafe"))


def playlist(ranked: DataFrame) -> DataFrame:
    """Two lines for each active row, the first of each destination in plan order."""
    active = ranked.where(has_text(F.col("new_path"))).withColumn("key", X.path_key(F.col("new_path")))
    first = active.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("row_id"))).where("k = 1")
    label = F.concat_ws(" - ", *[F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("artist", "title")])
    lines = F.array(F.concat(F.lit("#EXTINF:-1,"), F.btrim(label, F.lit(" -"))), F.col("new_path"))
    return first.select("row_id", F.posexplode(lines).alias("line_no", "line"))


def duplicate_losers(ranked: DataFrame) -> DataFrame:
    """Each row that lost its path with the winner of its destination."""
    kept = ranked.where("is_winner").select("identity", F.col("row_id").alias("winner_id"), F.col("source_path").alias("winner_source"))
    return ranked.where("not is_winner and new_path is not null").join(kept, "identity").select("row_id", "winner_id", "winner_source")


def _audited(plan: DataFrame, audit: DataFrame) -> DataFrame:
    """plan rows with one audit row of their source at most, and the first rule that this breaks (null if none)."""
    key = X.path_key(F.trim("source_path"))
    said = audit.select(key.alias("key"), X.path_key(F.trim("new_path")).alias("audited"), F.trim("recommendation").alias("recommendation"), F.coalesce(F.trim("existing"), F.lit("")).alias("evidence"))
    said = said.groupBy("key").agg(F.count("*").alias("n_audit"), *[F.min(c).alias(c) for c in ("audited", "recommendation", "evidence")])
    rows = plan.withColumn("key", key)
    often = rows.groupBy("key").agg(F.count("*").alias("n_plan"))
    joined = rows.join(often, "key").join(said, "key", "left")
    rules = [
        (F.col("key") == "", "plan source blank"),
        (F.col("n_plan") > 1, "plan source repeated"),
        (F.col("n_audit") > 1, "audit source repeated"),
        (~F.col("audited").eqNullSafe(X.path_key(F.coalesce("new_path", F.lit("")))) & F.col("n_audit").isNotNull(), "destination changed"),
        (~F.col("recommendation").eqNullSafe(F.lit("skip_existing")) & F.col("n_audit").isNotNull(), "recommendation unresolved"),
        ((F.col("evidence") == "") & F.col("n_audit").isNotNull(), "no identity evidence"),
    ]
    return joined.withColumn("rule", F.coalesce(*[F.when(F.coalesce(when, F.lit(False)), rule) for when, rule in rules]))


def audit_violations(plan: DataFrame, audit: DataFrame) -> DataFrame:
    """(key, rule): why an audit may not be applied to a plan; empty if it may. One row a source and rule."""
    found = _audited(plan, audit).where("rule is not null").select("key", "rule")
    known = plan.select(X.path_key(F.trim("source_path")).alias("key"))
    absent = audit.select(X.path_key(F.trim("source_path")).alias("key")).join(known, "key", "left_anti")
    return found.unionByName(absent.withColumn("rule", F.lit("audit source absent"))).distinct()


def apply_skips(plan: DataFrame, audit: DataFrame) -> DataFrame:
    """One row a plan row: an audited row that breaks no rule loses its path (skipped), the others keep theirs.

    status names the broken rule otherwise, or planned for rows that are not audited. To apply all or nothing, hold
    :func:`audit_violations` against :func:`require_empty` first."""
    status = F.coalesce(F.col("rule"), F.when(F.col("n_audit").isNotNull(), "skipped"), F.lit("planned"))
    done = _audited(plan, audit).withColumn("status", status)
    return done.select("row_id", "source_path", F.when(F.col("status") == "skipped", F.lit("")).otherwise(F.col("new_path")).alias("new_path"), "status")
