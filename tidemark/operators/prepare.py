"""Preparing an import: dry-run checks of a plan and of a cleanup as violations, actions with their status, all steps as one call."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from . import library, plan, review

#: What an inventory says of a file beside its path: size, digests of its pictures in order, and its tags.
FACTS = ["size", "artwork"]


def _files(files: DataFrame, prefix: str, tags: list[str]) -> DataFrame:
    """One row a file, by path key, its facts under a prefix; of rows that name one file the least path counts."""
    facts = F.struct(F.lit(True).alias("there"), *[c for c in [*FACTS, *tags] if c in files.columns])
    one = files.groupBy(X.path_key(F.col("path")).alias(f"{prefix}key")).agg(F.min_by(facts, "path").alias(prefix))
    return one


def _tags(files: DataFrame, rows: DataFrame) -> list[str]:
    return [c for c in plan.WRITTEN if c in files.columns and c in rows.columns]


def _differs(side: str, tags: list[str]) -> Column:
    """Whether a file's tags are not what the row says; blank and null are alike."""
    text = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.exists(F.array(F.lit(False), *[text(F.col(f"{side}.{c}")) != text(F.col(c)) for c in tags]), lambda x: x)


def _beside(rows: DataFrame, files: DataFrame, target: str) -> tuple[DataFrame, Column, Column, list[str]]:
    """rows with the files at their source (s) and target (d), and whether these exist."""
    tags = _tags(files, rows)
    here = rows.withColumns({"skey": X.path_key(F.col("source_path")), "dkey": X.path_key(F.col(target))})
    both = here.join(_files(files, "s", []), "skey", "left").join(_files(files, "d", tags), "dkey", "left")
    return both, F.col("s.there").isNotNull(), F.col("d.there").isNotNull(), tags


def preflight_violations(entries: DataFrame, files: DataFrame, resume: bool = False) -> DataFrame:
    """(row_id, rule, detail): the first rule that an entry breaks; empty if the plan may be applied.

    entries(row_id, source_path, new_path, expected_artwork, written fields), rows without a path are no entries;
    files(path, size, artwork, written fields as read) is the inventory of both roots."""
    both, source, target, tags = _beside(entries.where(plan.has_text(F.col("new_path"))), files, "new_path")
    pictures = F.coalesce(F.col("s.artwork"), F.array().cast("array<string>"))
    rules = [
        (~source & ~target, "source missing", "source_path"),
        (source & (F.size(pictures) != F.coalesce("expected_artwork", F.lit(0))), "source artwork changed", "source_path"),
        (target & F.lit(not resume), "destination exists", "new_path"),
        (target & _differs("d", tags), "destination tags differ", "new_path"),
        (target & source & ~pictures.eqNullSafe(F.coalesce(F.col("d.artwork"), F.array().cast("array<string>"))), "destination artwork differs", "new_path"),
    ]
    found = F.coalesce(*[F.when(when, F.struct(F.lit(rule).alias("rule"), F.col(at).alias("detail"))) for when, rule, at in rules])
    return both.select("row_id", found.alias("v")).where("v is not null").select("row_id", "v.rule", "v.detail")


def preflight_totals(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Bytes of the sources that exist, and how many destinations exist already."""
    both, source, target, _ = _beside(entries.where(plan.has_text(F.col("new_path"))), files, "new_path")
    return both.agg(F.coalesce(F.sum(F.when(source, F.col("s.size"))), F.lit(0)).alias("source_bytes"), F.count_if(target).alias("existing_destinations"))


def cleanup_violations(losers: DataFrame, files: DataFrame, deleted: DataFrame, source_root: str, destination_root: str) -> DataFrame:
    """(row_id, rule, detail): the first reason why a duplicate's source may not be deleted; empty if all may.

    losers(row_id, source_path, destination, written fields of the winner); destination is null without a winner.
    deleted(source_path): what an earlier run has deleted, which need not be there any more."""
    both, source, target, tags = _beside(losers, files, "destination")
    gone = deleted.select(X.path_key(F.col("source_path")).alias("skey")).distinct().withColumn("gone", F.lit(True))
    often = both.groupBy("skey").agg(F.count("*").alias("n"))
    both = both.join(often, "skey").join(gone, "skey", "left")
    rules = [
        (F.col("n") > 1, "source repeated", "source_path"),
        (~plan.has_text(F.col("destination")), "no winner", "source_path"),
        (~X.is_within(F.col("source_path"), F.lit(source_root)), "source outside root", "source_path"),
        (~X.is_within(F.col("destination"), F.lit(destination_root)), "winner outside root", "destination"),
        (~source & F.col("gone").isNull(), "source missing", "source_path"),
        (~target, "winner missing", "destination"),
        (_differs("d", tags), "winner tags differ", "destination"),
    ]
    found = F.coalesce(*[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.col(at).alias("detail"))) for when, rule, at in rules])
    return both.select("row_id", found.alias("v")).where("v is not null").select("row_id", "v.rule", "v.detail")


def actions(entries: DataFrame, files: DataFrame, action: str = "copy") -> DataFrame:
    """(row_id, source_path, new_path, status, deletes_source): what applying a checked plan does to each entry.

    A destination that is there already is resumed; a source that is not there fails."""
    if action not in ("copy", "move"):
        raise ValueError(f"unknown action {action}")
    both, source, target, _ = _beside(entries.where(plan.has_text(F.col("new_path"))), files, "new_path")
    status = F.when(target, "resumed").when(~source, "failed").otherwise("moved" if action == "move" else "copied")
    return both.select("row_id", "source_path", "new_path", status.alias("status"), (source & F.lit(action == "move")).alias("deletes_source"))


@dataclass
class Prepared:
    """How far a preparation came. blocked names the gate that held it (review or collisions); found are its rows."""

    blocked: str | None
    found: DataFrame | None = None
    planned: DataFrame | None = None
    actions: DataFrame | None = None
    playlist: DataFrame | None = None


def _kept(rows: DataFrame, root: str) -> DataFrame:
    """rows with the path that they keep: losers of a duplicate group have none."""
    ranked = plan.one_winner(plan.with_paths(rows, root))
    return ranked.withColumn("new_path", F.when(F.col("is_winner"), F.col("new_path")))


def prepare_import(
    rows: DataFrame,
    index: DataFrame,
    files: DataFrame,
    library_root: str,
    prepared_root: str,
    resolutions: DataFrame | None = None,
    materialise: Callable[[DataFrame], DataFrame] | None = None,
) -> Prepared:
    """Resolutions, review gate, plan against the library, collision gate, prepared plan, dry run, copies, playlist.

    A gate that finds rows stops the preparation and returns them; resolutions or a plan that break a rule raise. Nothing
    is written: actions say what copying does. Each plan is cut by a checkpoint, as several steps read it. Identities of
    duplicates depend on the root only by a prefix, so the winners of both plans are the same rows."""
    cut = materialise or (lambda df: df.checkpoint())
    if resolutions is not None:
        rows, broken = review.resolved(rows, resolutions)
        plan.require_empty(broken, "resolutions")
    rows = cut(rows)
    held = review.review_rows(rows)
    if not held.isEmpty():
        return Prepared("review", held)
    met = cut(library.collisions(_kept(rows, library_root), index))
    if not met.isEmpty():
        return Prepared("collisions", met)
    planned = cut(_kept(rows, prepared_root))
    plan.require_empty(preflight_violations(planned, files, resume=True), "dry run")
    return Prepared(None, None, planned, actions(planned, files), plan.playlist(planned))


def tag_violations(files: DataFrame) -> DataFrame:
    """(path, rule, detail) of rewritten files whose tags are not just those that the plan writes.

    files(path, format, tags, trailers, and the output fields): format is id3 or mp4, tags are the keys in the file,
    trailers the tags of other kinds that still stand in it. A key outside the format's list is foreign, a field with a
    value without its key is missing. Each row's keys are held against the lists where it lies; null arrays are empty."""
    kinds = {"id3": (fixed.ID3_FRAMES, fixed.ID3_FIELDS), "mp4": (fixed.MP4_KEYS, fixed.MP4_FIELDS)}
    empty = F.array().cast("array<string>")
    kind = F.lower(F.col("format"))
    keys = F.coalesce("tags", empty)
    keys = F.when(kind == "id3", F.transform(keys, lambda k: F.substring_index(k, ":", 1))).otherwise(keys)  # a frame's key may go on with its description
    written = {f: F.col(f) if dict(files.dtypes)[f] == "boolean" else plan.has_text(F.col(f).cast("string")) for f in fixed.ID3_FIELDS if f in files.columns}

    def wanted(names: dict[str, str]) -> Column:
        return F.array_compact(F.array(*[F.when(F.coalesce(w, F.lit(False)), F.lit(names[f])) for f, w in written.items()]))

    def found(rule: str, details: Column) -> Column:
        return F.transform(details, lambda d: F.struct(F.lit(rule).alias("rule"), d.alias("detail")))

    foreign, missing = F.when(F.lit(False), empty), F.when(F.lit(False), empty)
    for name, (allowed, fields) in kinds.items():
        foreign = foreign.when(kind == name, F.array_except(keys, F.array(*[F.lit(k) for k in allowed])))
        missing = missing.when(kind == name, F.array_except(wanted(fields), keys))
    unknown = F.when(kind.isin(*kinds), empty).otherwise(F.array(F.coalesce("format", F.lit(""))))
    every = F.concat(found("format not supported", unknown), found("foreign tag", F.coalesce(foreign, empty)), found("tag missing", F.coalesce(missing, empty)), found("other tag remains", F.array_distinct(F.coalesce("trailers", empty))))
    return files.select("path", F.inline(every))
