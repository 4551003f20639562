"""Adapters that give the driver's tables the shapes of a catalogue, each as DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import dealt

ROOT = "D:/library"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TRACKS_SQL = r"""tracks AS (
  SELECT p_partkey AS row_id, p_name AS title, p_brand AS artist, CASE WHEN p_partkey % 4 > 0 THEN p_type END AS album,
    p_size % 20 AS track_number, p_partkey % 3 AS disc_number, p_partkey % 13 = 0 AS compilation,
    p_partkey % 17 = 0 AS needs_review, p_partkey % 19 = 0 AS excluded, p_partkey * 37 % 1000 AS size,
    CASE p_partkey % 5 WHEN 0 THEN '.flac' WHEN 1 THEN '.mp3' WHEN 2 THEN '.m4a' WHEN 3 THEN '.wav' ELSE '.ogg' END AS ext,
    'C:\in\' || p_brand || '\' || p_name || CASE WHEN p_partkey % 11 = 0 THEN ' (1) - 2' WHEN p_partkey % 7 = 0 THEN ' (1)' ELSE '' END
      || CASE p_partkey % 5 WHEN 0 THEN '.flac' WHEN 1 THEN '.mp3' WHEN 2 THEN '.m4a' WHEN 3 THEN '.wav' ELSE '.ogg' END AS source_path
  FROM part)"""

PATHS_SQL = (
    TRACKS_SQL
    + r""", paths AS (
  SELECT *, CASE WHEN needs_review OR excluded THEN NULL
    WHEN album IS NULL THEN 'D:/library/' || artist || '/' || artist || ' - ' || title || ext
    ELSE 'D:/library/' || CASE WHEN compilation THEN 'Various Artists' ELSE artist END || '/' || album || '/'
      || CASE WHEN track_number > 0 THEN CASE WHEN disc_number > 1 THEN printf('%d-%02d - ', disc_number, track_number)
         ELSE printf('%02d - ', track_number) END ELSE '' END
      || CASE WHEN compilation THEN artist || ' - ' ELSE '' END || title || ext END AS new_path
  FROM tracks), ranked AS (
  SELECT *, lower(regexp_replace(new_path, '\.[^./]*$', '')) AS identity,
    CASE WHEN row_id % 11 = 0 THEN 2 WHEN row_id % 7 = 0 THEN 1 ELSE 0 END AS depth,
    CASE ext WHEN '.flac' THEN 8 WHEN '.wav' THEN 7 WHEN '.m4a' THEN 5 WHEN '.ogg' THEN 4 ELSE 3 END AS quality
  FROM paths), winners AS (
  SELECT *, new_path IS NOT NULL AND row_number() OVER (PARTITION BY identity
    ORDER BY depth, -quality, -size, lower(replace(source_path, '\', '/')), row_id) = 1 AS is_winner FROM ranked)"""
)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    ext = F.get(F.array(*[F.lit(e) for e in (".flac", ".mp3", ".m4a", ".wav", ".ogg")]), (key % 5).cast("int"))
    copy = F.when(key % 11 == 0, " (1) - 2").when(key % 7 == 0, " (1)").otherwise("")
    none = F.lit(None).cast("string")
    return dealt(table(spark, sf_dir, "part")).select(
        key.alias("row_id"), F.concat(F.lit("C:\\in\\"), "p_brand", F.lit("\\"), "p_name", copy, ext).alias("source_path"),
        F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), none.alias("album_artist"), F.when(key % 4 > 0, F.col("p_type")).alias("album"),
        none.alias("date"), (F.col("p_size") % 20).alias("track_number"), (key % 3).alias("disc_number"), none.alias("genre"), (key % 13 == 0).alias("compilation"),
        (key % 17 == 0).alias("needs_review"), (key % 19 == 0).alias("excluded"), none.alias("output_extension"), (key * 37 % 1000).alias("size"),
    )


#: Dirty names over part, without letters or patterns that the two regex dialects read differently.
DIRTY_SQL = r"""dirty AS (
  SELECT p_partkey AS row_id, CASE p_partkey % 6 WHEN 0 THEN p_name || ' (Free Download)' WHEN 1 THEN p_name || ' [320 kbps] [HQ]'
    WHEN 2 THEN 'www.tunes.com ' || p_name || ' - 128 BPM' WHEN 3 THEN p_name || '_mp3' WHEN 4 THEN p_name || ' ( ) - promo' ELSE p_name END AS title,
    CASE WHEN p_partkey % 5 = 0 THEN p_brand || ' feat. ' || p_type ELSE p_brand END AS artist FROM part)"""


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.col("p_partkey"), F.col("p_name")
    title = F.when(key % 6 == 0, F.concat(name, F.lit(" (Free Download)"))).when(key % 6 == 1, F.concat(name, F.lit(" [320 kbps] [HQ]"))).when(key % 6 == 2, F.concat(F.lit("www.tunes.com "), name, F.lit(" - 128 BPM")))
    title = title.when(key % 6 == 3, F.concat(name, F.lit("_mp3"))).when(key % 6 == 4, F.concat(name, F.lit(" ( ) - promo"))).otherwise(name)
    artist = F.when(key % 5 == 0, F.concat("p_brand", F.lit(" feat. "), "p_type")).otherwise(F.col("p_brand"))
    return dealt(table(spark, sf_dir, "part")).select(key.alias("row_id"), title.alias("title"), artist.alias("artist"))
