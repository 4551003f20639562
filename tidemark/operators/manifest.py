"""Manifests: comparison, seeding, pending work, batches, context, tags, status, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from .folds import Digest, first_of_each, fold_sorted


def _comparable(c: Column, kind: str) -> Column:
    return X.folded_case(X.clean_text(c)) if kind == "string" else c.cast("string")


def field_exact(reference: DataFrame, candidate: DataFrame, weights: dict[str, float] | None = None, key: str = "row_id") -> DataFrame:
    """(field, weight, n, equal, percent): matching rows by key; texts are compared without case and spacing."""
    weights = weights or fixed.FIELD_WEIGHTS
    kinds = dict(reference.dtypes)
    names = [f for f in weights if f in kinds]
    both = reference.select(key, *[F.col(f).alias(f"e_{f}") for f in names]).join(candidate.select(key, *[F.col(f).alias(f"a_{f}") for f in names]), key)
    flags = [F.struct(F.lit(f).alias("field"), F.lit(weights[f]).alias("weight"), (F.col(f"e_{f}").isNull() & F.col(f"a_{f}").isNull() | F.coalesce(_comparable(F.col(f"e_{f}"), kinds[f]) == _comparable(F.col(f"a_{f}"), kinds[f]), F.lit(False)) & F.col(f"e_{f}").isNotNull() & F.col(f"a_{f}").isNotNull()).alias("same")) for f in names]
    return both.select(F.explode(F.array(*flags)).alias("x")).groupBy("x.field", "x.weight").agg(F.count("*").alias("n"), F.count_if("x.same").alias("equal")).select("field", "weight", "n", "equal", F.bround(100 * F.col("equal") / F.col("n"), 3).alias("percent"))


def regressions(reference: DataFrame, candidate: DataFrame, weights: dict[str, float] | None = None, key: str = "row_id") -> DataFrame:
    """(key, field, expected, actual): the weighted fields of matching rows that differ, by the rule of :func:`field_exact`."""
    kinds = dict(reference.dtypes)
    names = [f for f in weights or fixed.FIELD_WEIGHTS if f in kinds]
    both = reference.select(key, *[F.col(f).alias(f"e_{f}") for f in names]).join(candidate.select(key, *[F.col(f).alias(f"a_{f}") for f in names]), key)
    same = lambda f: F.when(F.col(f"e_{f}").isNotNull(), _comparable(F.col(f"e_{f}"), kinds[f])).eqNullSafe(F.when(F.col(f"a_{f}").isNotNull(), _comparable(F.col(f"a_{f}"), kinds[f])))
    found = [F.when(~same(f), F.struct(F.lit(f).alias("field"), F.col(f"e_{f}").cast("string").alias("expected"), F.col(f"a_{f}").cast("string").alias("actual"))) for f in names]
    return both.select(key, F.inline(F.array_compact(F.array(*found))))


def weighted_score(per_field: DataFrame) -> DataFrame:
    return per_field.agg(F.bround(100 * F.sum(F.col("weight") * F.col("equal")) / F.sum(F.col("weight") * F.col("n")), 3).alias("score"))


def canonical(fields: list[str]) -> Column:
    """A digest of the fields as key-sorted JSON."""
    return F.sha2(F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def seeded(prior: DataFrame, current: DataFrame, fields: list[str], key: str = "row_id") -> DataFrame:
    """(key, status): unchanged rows keep their review, changed and new ones are checked again."""
    old = prior.select(key, F.col("source_path").alias("o_path"), canonical(fields).alias("old"))
    new = current.select(key, "source_path", canonical(fields).alias("new")).join(old, key, "left")
    return new.select(key, F.when(F.col("old").isNull(), "new").when(F.col("o_path") != F.col("source_path"), "source mismatch").when(F.col("old") == F.col("new"), "seeded").otherwise("changed").alias("status"))


def batches(rows: DataFrame, size: int, order: str = "row_id", groups: int | None = None) -> DataFrame:
    """rows with batch_id: runs of `size` rows in order.

    Numbered by range: each range counts its rows, the counts are summed, and numbers are given within ranges, so no
    task orders all rows. Without `groups` the ranges are as many as the session's shuffle partitions."""
    part, own, start = (X.free_name(n, rows.columns) for n in ("part", "own", "start"))
    ranged = (rows.repartitionByRange(groups, order) if groups else rows.repartitionByRange(order)).withColumn(part, F.spark_partition_id())
    ranged = ranged.checkpoint(eager=True)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(part).agg(F.count("*").alias(own)).withColumn(start, F.coalesce(F.sum(own).over(before), F.lit(0))).drop(own)
    place = F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1
    return ranged.withColumn(own, place).join(F.broadcast(starts), part).withColumn("batch_id", F.floor((F.col(start) + F.col(own)) / size)).drop(part, own, start)


def pending(rows: DataFrame, processed: Column, held: Column, suspicious: Column, feedback: DataFrame, limit: int | None = None, again: bool = False, held_too: bool = False) -> DataFrame:
    """Rows to work on: not processed, suspicious, or with feedback; held ones and all if asked. A limit takes the first."""
    mark = X.free_name("named", rows.columns)
    named = feedback.select("row_id").distinct().withColumn(mark, F.lit(True))
    want = F.lit(again) | ~processed | (F.lit(held_too) & held) | suspicious | F.col(mark).isNotNull()
    out = rows.join(named, "row_id", "left").where(want).drop(mark)
    return out.orderBy("row_id").limit(limit) if limit else out


def not_yet(rows: DataFrame, done: DataFrame, key: str = "row_id") -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def set_parts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, part) of the distinct keys of both sides: `left` or `right` if one alone has it, else `both`. left is a subset of
    right if no key is `left`. Keys are summed up before they meet; null is a key like others."""
    sides = left.select(key, F.lit(1).alias("side")).unionByName(right.select(key, F.lit(2).alias("side")))
    part = F.get(F.array(F.lit("left"), F.lit("right"), F.lit("both")), F.bit_or("side") - 1)
    return sides.groupBy(key).agg(part.alias("part"))


def same_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose sources differ by position; empty if one manifest can resume the other."""
    both = a.select("row_id", F.col("source_path").alias("x")).join(b.select("row_id", F.col("source_path").alias("y")), "row_id", "full_outer")
    return both.where(~F.col("x").eqNullSafe(F.col("y")))


def context(rows: DataFrame, k: int = 5) -> DataFrame:
    """For each row the first k accepted rows with its context key and another file name.

    Each key's first 2k rows by name and order suffice: the row's own name leaves k of another."""
    keyed = rows.withColumns({"key": X.context_key(F.col("title")), "name": X.folded_case(X.file_name(F.col("source_path")))}).where("key is not null")
    accepted = keyed.where("accepted").select("key", F.col("row_id").alias("other_id"), F.col("name").alias("other_name"))
    first = first_of_each(accepted, ["key", "other_name"], [F.col("other_id")], k)
    first = first_of_each(first.drop("place"), ["key"], [F.col("other_id")], 2 * k).drop("place")
    found = keyed.select("row_id", "key", "name").join(first, "key").where("name <> other_name")
    return first_of_each(found, ["row_id"], [F.col("other_id")], k, "rank").select("row_id", "other_id", "rank")


def _normal_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9©]", "")


def tag_rows(rows: DataFrame, json: str) -> DataFrame:
    """(row_id, pos, key, value): the entries of a JSON object, in stored order."""
    values = F.from_json(F.to_json(F.try_variant_get(F.try_parse_json(json), "$", "variant")), "map<string,string>")
    entries = X.let(values, lambda m: F.transform(F.json_object_keys(json), lambda k: F.struct(k.alias("key"), F.element_at(m, k).alias("value"))))
    return rows.select("row_id", F.posexplode(entries).alias("pos", "e")).select("row_id", "pos", "e.key", "e.value")


def first_text(value: Column) -> Column:
    """The first text inside a scalar, a list, a list of lists or an object with text."""
    v = F.try_parse_json(F.when(value.rlike(r"^\s*[\[{\"]"), value).otherwise(F.to_json(F.array(value))))
    paths = ["$[0][0]", "$[0].text[0]", "$[0].text", "$[0]", "$.text[0]", "$.text", "$.value", "$"]
    found = [F.try_variant_get(v, p, "string") for p in paths]
    return F.coalesce(*[F.when((F.trim(x) != "") & ~x.rlike(r"^[\[{]"), F.trim(x)) for x in found])


def alias_text(tags: DataFrame, aliases: list[str]) -> DataFrame:
    """(row_id, value): the first alias, in the order of the list, that has text."""
    rank = F.array_position(F.array(*[F.lit(a.lower()) for a in aliases]), F.lower("key"))
    text = first_text(F.col("value"))
    return tags.where((rank > 0) & text.isNotNull()).groupBy("row_id").agg(F.min_by(text, F.struct(rank, F.col("pos"))).alias("value"))


def stored_value(tags: DataFrame, aliases: list[str]) -> DataFrame:
    """(row_id, value): the first stored tag among the aliases, even if it is empty."""
    return tags.where(F.lower("key").isin([a.lower() for a in aliases])).groupBy("row_id").agg(F.min_by("value", "pos").alias("value"))


def first_integer(c: Column) -> Column:
    return F.regexp_extract(c, "([0-9]+)", 1).try_cast("int")


def first_boolean(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("1", "true", "yes")


def first_date(c: Column) -> Column:
    """A date of 19xx or 20xx at the precision it has; a first of January is a year only."""
    day = F.regexp_extract(c, r"((?:19|20)\d{2}-\d{2}-\d{2})", 1)
    month = F.regexp_extract(c, r"((?:19|20)\d{2}-\d{2})", 1)
    year = F.regexp_extract(c, r"((?:19|20)\d{2})", 1)
    return F.when((day != "") & ~day.endswith("-01-01"), day).when(day != "", F.left(day, F.lit(4))).when(month != "", month).when(year != "", year)


def numbered_keys(tags: DataFrame) -> DataFrame:
    """Repeated keys of a row get #2, #3 and so on."""
    n = F.row_number().over(Window.partitionBy("row_id", "key").orderBy("pos"))
    return tags.withColumn("n", n).select("row_id", F.when(F.col("n") > 1, F.concat(F.col("key"), F.lit("#"), F.col("n").cast("string"))).otherwise(F.col("key")).alias("key"), "value")


def json_object(c: Column) -> Column:
    """The JSON object inside a model's answer: thoughts are taken out, else the widest braces count."""
    bare = F.trim(F.regexp_replace(c, "(?s)<think>.*?</think>", ""))
    wide = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(F.when(bare.startswith("{"), bare)), F.try_parse_json(X.blank_to_null(wide)))


#: Fields of a record in a model's answer, as they are named there, and what they are called here.
ANSWERED = {"title": "title", "artist": "artist", "albumArtist": "album_artist", "album": "album", "date": "date", "trackNumber": "track_number", "discNumber": "disc_number", "genre": "genre", "compilation": "compilation", "needsReview": "needs_review", "reviewReason": "review_reason"}


def model_results(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """(batch_id, id, item): the records of each answer with a known id, the last of an id wins.

    A record is nested under outputMetadata, or lies flat; then a reason alone says that it needs review. Fields are
    text, flags apart, as :func:`cleaned_results` takes them."""
    fields = ",".join(f"{f}:string" for f in ANSWERED)
    items = F.from_json(F.to_json(F.try_variant_get(json_object(F.col("answer")), "$.items", "variant")), f"array<struct<id:string,{fields},outputMetadata:struct<{fields}>>>")
    rows = answers.select("batch_id", F.posexplode(items).alias("pos", "i")).withColumn("id", F.col("i.id").try_cast("bigint"))
    nested, why = F.col("i.outputMetadata").isNotNull(), X.clean_optional(F.col("i.reviewReason"), False)
    flags = {"compilation": None, "needsReview": why.isNotNull()}
    record = []
    for f, name in ANSWERED.items():
        flat = flags.get(f)
        flat = F.col(f"i.{f}") if flat is None else flat
        record.append(F.when(nested, F.col(f"i.outputMetadata.{f}").try_cast("boolean") if f in flags else F.col(f"i.outputMetadata.{f}")).otherwise(flat.try_cast("boolean") if f in flags else flat).alias(name))
    known = rows.join(allowed.select("batch_id", "id"), ["batch_id", "id"], "left_semi")
    return known.withColumn("item", F.struct(*record)).groupBy("batch_id", "id").agg(F.max_by("item", "pos").alias("item"))


def cleaned_results(results: DataFrame) -> DataFrame:
    """(batch_id, id, fields): the records of :func:`model_results` cleaned as a whole."""
    flat = results.select("batch_id", "id", "item.*").withColumns({"excluded": F.lit(False), "exclusion_reason": F.lit(None).cast("string")})
    return X.cleaned(flat).drop("excluded", "exclusion_reason")


def unanswered(answers: DataFrame, results: DataFrame) -> DataFrame:
    """(batch_id): answers that hold no record which was asked for."""
    return answers.select("batch_id").distinct().join(results.select("batch_id").distinct(), "batch_id", "left_anti")


def error_kind(status: Column, details: Column) -> Column:
    """Why a request failed. status is the HTTP status, null if there was no connection at all."""
    said = lambda term: F.contains(X.folded_case(F.coalesce(details, F.lit(""))), F.lit(term))
    away = status.isNull() | (status == 503) | said("loading model")
    return F.when(away, "unavailable").when((status == 400) & said("exceed") & said("context"), "context").otherwise("other")


def run_status(rows: DataFrame, run: str) -> DataFrame:
    """Per run: rows, accepted (title and artist present, review state ignored) and held ones."""
    accepted = (X.clean_text(F.col("title")) != "") & (X.clean_text(F.col("artist")) != "")
    return rows.groupBy(run).agg(F.count("*").alias("tracks"), F.count_if(accepted).alias("accepted"), F.count_if("needs_review").alias("reviewed"))


def latest(lines: DataFrame, group: str, order: str, line: str, starting: str | None = None) -> DataFrame:
    some = lines.where(F.col(line).startswith(starting)) if starting else lines
    return some.groupBy(group).agg(F.max_by(line, order).alias("line"), F.max(order).alias("at"))


def last_lines(lines: DataFrame, group: str, order: str, n: int = 12) -> DataFrame:
    place = X.free_name("place", lines.columns)
    return first_of_each(lines, [group], [F.col(order).desc()], n, place).drop(place)


def content_digest(rows: DataFrame, group: str, parts: Column) -> DataFrame:
    """A digest of each group's sorted part digests, for groups of any size."""
    digest = F.sha2(parts, 256)
    return fold_sorted(rows, [group], digest, [digest], Digest)


def endpoint_totals(batches_: DataFrame) -> DataFrame:
    return batches_.groupBy("endpoint").agg(F.count("*").alias("batches"), F.sum("tracks").alias("tracks"), F.sum("seconds").alias("seconds"), F.count_if("failed").alias("failures"), F.avg("seconds").alias("mean_seconds"))


def short_rows(rows: DataFrame, least: float = 30.0) -> DataFrame:
    """Rows shorter than a duration, and those that could not be read."""
    return rows.where(F.col("error").isNull() & (F.col("duration") < least)).withColumn("kind", F.lit("short")).unionByName(rows.where(F.col("error").isNotNull()).withColumn("kind", F.lit("error")))


def cue_rows(cues: DataFrame) -> DataFrame:
    """Cue seconds to milliseconds, not below 0; slot letters to numbers from A."""
    return cues.select("row_id", (F.ascii("slot") - 65).alias("slot"), "label", F.greatest(F.lit(0), F.round(F.col("seconds") * 1000)).cast("long").alias("position_ms"))


def members(tracks: DataFrame, items: DataFrame) -> DataFrame:
    """Playlist items with their track, if there is one."""
    return items.join(tracks, "track_id", "left")
