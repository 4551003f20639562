"""Readers of catalogue files: manifests, delimited plans, property lists, model answers, directory inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

OUTPUT = "struct<title string, artist string, albumArtist string, album string, date string, trackNumber int, discNumber int, genre string, compilation boolean, needsReview boolean, reviewReason string, excluded boolean, exclusionReason string>"
ROW = f"struct<source string, originalMetadata string, outputExtension string, outputMetadata {OUTPUT}>"


def _before(rows: DataFrame, value: Column, name: str, inclusive: bool = False) -> DataFrame:
    """rows(file, start, n, ...) with the sum of value over the file's rows before, by (start, n). Each split is summed where
    it lies; only the splits' totals, a row each, are ordered within their file."""
    own = Window.partitionBy("file", "start").orderBy("n").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    splits = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("file", "start").agg(F.sum(value).alias("total"))
    totals = totals.select("file", "start", F.coalesce(F.sum("total").over(splits), F.lit(0)).alias("ahead"))
    return rows.withColumn(name, F.coalesce(F.sum(value).over(own), F.lit(0))).join(totals, ["file", "start"]).withColumn(name, F.col(name) + F.col("ahead")).drop("ahead")


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, file, value, whole) of the objects in JSON arrays: their text, numbered by file and position over all files.

    A file is read by as many tasks as it has splits: it is cut behind every closing brace, wherever that stands. Whether a
    piece begins inside a string follows from the quotes before it, its depth from the brackets before it, and the piece
    that comes back to the array's own depth ends an object; all three are sums over the pieces before. Pieces of an object
    are then put together. What is left behind the last object makes a row with whole = false, unless it ends the array."""
    raw = spark.read.option("lineSep", "}").text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), "value").repartition("file", "start")
    count = lambda c, mark: F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # a closing brace is never escaped, so no escape is cut
    rows = rows.withColumn("bare", bare).withColumn("odd", count(F.col("bare"), '"') % 2)

    def depth(text: Column) -> Column:
        plain = F.regexp_replace(text, r'(?s)"[^"]*(?:"|$)', "")
        return count(plain, "{") + count(plain, "[") - count(plain, "]")

    rows = rows.select("file", "start", "n", "value", "odd", depth(F.col("bare")).alias("outside"), depth(F.concat(F.lit('"'), "bare")).alias("inside"))
    rows = _before(rows, F.col("odd"), "quotes")
    within = F.col("quotes") % 2 == 1
    closes = (F.col("quotes") + F.col("odd")) % 2 == 0  # the brace behind the piece is no part of a string
    rows = rows.withColumns({"closes": closes, "step": F.when(within, F.col("inside")).otherwise(F.col("outside")) - closes.cast("int")})
    rows = _before(rows, F.col("step"), "depth", inclusive=True)
    rows = rows.withColumn("ends", (F.col("closes") & (F.col("depth") == 1)).cast("int"))
    rows = _before(rows, F.col("ends"), "no")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("start", "n", "value"))), lambda x: x["value"])
    found = rows.groupBy("file", "no").agg(F.array_join(pieces, "}").alias("text"), F.max("ends").alias("ends"))
    text = F.regexp_replace("text", "^[\\s,\\[\\uFEFF]+", "")
    whole = F.col("ends") == 1
    found = found.select("file", "no", F.when(whole, F.concat(text, F.lit("}"))).otherwise(text).alias("value"), whole.alias("whole")).where(F.col("whole") | ~F.col("value").rlike(r"^\]\s*$"))
    files = found.groupBy("file").agg(F.count("*").alias("rows")).withColumn("first", F.coalesce(F.sum("rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return found.join(files, "file").select((F.col("first") + F.col("no")).alias("row_id"), "file", "value", "whole")


def manifest(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Rows of JSON arrays, numbered by file and position; a byte order mark is allowed, a file is read by several tasks.

    Strict: a row without source or outputMetadata is an error, and so is an array that does not end; needs_review
    defaults to whether a reason stands where title or artist is missing."""
    rows = json_array(spark, path).select("row_id", "whole", F.from_json("value", ROW, {"mode": "FAILFAST" if strict else "PERMISSIVE", "primitivesAsString": "false"}).alias("r"))
    rows = rows.where("whole") if not strict else rows.withColumn("row_id", F.when(F.col("whole"), F.col("row_id")).otherwise(F.raise_error(F.lit("a manifest does not end as an array of objects"))))
    out = F.col("r.outputMetadata")
    held = F.coalesce(out["needsReview"], out["reviewReason"].isNotNull() & (out["title"].isNull() | out["artist"].isNull()))
    rows = rows.select(
        out.isNotNull().alias("described"), F.col("row_id").cast("long").alias("row_id"), F.col("r.source").alias("source_path"), F.col("r.originalMetadata").alias("original"), F.col("r.outputExtension").alias("output_extension"),
        out["title"].alias("title"), out["artist"].alias("artist"), out["albumArtist"].alias("album_artist"), out["album"].alias("album"), out["date"].alias("date"),
        out["trackNumber"].alias("track_number"), out["discNumber"].alias("disc_number"), out["genre"].alias("genre"), F.coalesce(out["compilation"], F.lit(False)).alias("compilation"),
        held.alias("needs_review"), out["reviewReason"].alias("review_reason"), F.coalesce(out["excluded"], F.lit(False)).alias("excluded"), out["exclusionReason"].alias("exclusion_reason"),
    )
    if strict:
        why = F.when(F.col("source_path").isNull(), "a manifest row has no source").when(~F.col("described"), "a manifest row has no outputMetadata")
        rows = rows.withColumn("source_path", F.when(why.isNotNull(), F.raise_error(why)).otherwise(F.col("source_path")))
    return rows.drop("described")


def delimited(spark: SparkSession, path: str, required: list[str], exact: bool = False) -> DataFrame:
    """A CSV file as text columns. Its header must hold the required names, or be exactly these in this order."""
    head = [c.removeprefix("﻿") for c in spark.read.option("header", True).csv(path).columns]
    if head != required if exact else not set(required) <= set(head):
        raise ValueError(f"{path}: the header {head} does not fit {required}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in head])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def inventory(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """(path, size, mtime_ns) of the files below a folder with one of the extensions; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
    return files.where(X.suffix(F.col("path")).isin(extensions))


def _plain(column: str) -> Column:
    """Character data with its entities decoded; the ampersand comes last, so nothing is decoded twice."""
    out = F.col(column)

    def decoded(mark: str, base: int):
        def one(text: Column, n: Column) -> Column:
            char = F.decode(F.unhex(F.lpad(F.conv(n, base, 16), 8, "0")), "UTF-32")
            # U+0000 can't stand in such a file; it keeps a decoded ampersand apart until the end.
            return F.replace(text, F.concat(F.lit(mark), n, F.lit(";")), F.when(char == "&", F.lit("\0")).otherwise(char))

        return one

    for mark, base, digit in (("&#", 10, "[0-9]"), ("&#x", 16, "[0-9a-fA-F]")):
        out = F.aggregate(F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(f"{mark}({digit}+);"), F.lit(1))), out, decoded(mark, base))
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.replace(out, F.lit("\0"), F.lit("&"))


def property_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tracks, items) of a property-list library: tracks(track_id, field, value), items(playlist, position, track_id)."""
    text = spark.read.text(path, wholetext=True)
    track = r"(?s)<key>(\d+)</key>\s*<dict>(.*?)</dict>"
    body = F.regexp_extract("value", r"(?s)<key>Tracks</key>\s*<dict>(.*?)</dict>\s*<key>Playlists</key>", 1)
    ids, dicts = F.regexp_extract_all(body, F.lit(track), F.lit(1)), F.regexp_extract_all(body, F.lit(track), F.lit(2))
    pair = r"(?s)<key>([^<]*)</key>\s*<(?:string|integer|date)>([^<]*)<"
    rows = text.select(F.explode(F.arrays_zip(ids.alias("id"), dicts.alias("body"))).alias("t")).select(F.col("t.id").cast("long").alias("track_id"), F.col("t.body").alias("body"))
    fields = rows.select("track_id", F.explode(F.arrays_zip(F.regexp_extract_all("body", F.lit(pair), F.lit(1)).alias("field"), F.regexp_extract_all("body", F.lit(pair), F.lit(2)).alias("value"))).alias("f"))
    lists = F.split(F.regexp_extract("value", r"(?s)<key>Playlists</key>(.*)", 1), r"<key>Name</key>")
    named = text.select(F.explode(F.slice(lists, 2, F.size(lists))).alias("p"))
    items = named.select(F.regexp_extract("p", "<string>([^<]*)<", 1).alias("playlist"), F.posexplode(F.regexp_extract_all("p", F.lit(r"<key>Track ID</key>\s*<integer>(\d+)<"), F.lit(1))).alias("position", "id"))
    return fields.select("track_id", _plain("f.field").alias("field"), _plain("f.value").alias("value")), items.select(_plain("playlist").alias("playlist"), "position", F.col("id").cast("long").alias("track_id"))


def journal(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an append-only journal; lines that are not JSON are left out."""
    lines = spark.read.text(path).select(F.try_parse_json("value").alias("v")).where("v is not null")
    return lines.select(F.try_variant_get("v", "$.event", "string").alias("event"), F.try_variant_get("v", "$.source", "string").alias("source_path"), F.try_variant_get("v", "$.status", "string").alias("status"))
