"""Sinks: delimited files, playlists, journals. Spark's commit protocol makes each write whole or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def delimited(rows: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a fixed order of fields; nulls are written as empty text."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
    rows.select(*texts).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def playlist(lines: DataFrame, path: str) -> None:
    """(row_id, line_no, line) as text in order, below the header of the format; an empty playlist is an error."""
    if lines.isEmpty():
        raise ValueError("no active rows for the playlist")
    header = lines.sparkSession.createDataFrame([("#EXTM3U",)], "line string").select(F.lit(None).cast("long").alias("row_id"), F.lit(0).alias("line_no"), "line")
    ordered = header.unionByName(lines.select(F.col("row_id").cast("long"), "line_no", "line")).orderBy(F.col("row_id").asc_nulls_first(), "line_no").select("line")
    ordered.write.mode("overwrite").text(path)


def append_journal(events: DataFrame, path: str, header: str, spark: SparkSession) -> None:
    """Appends JSON lines below a folder whose header must be the same as before."""
    known = f"{path}/header"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(known)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        if [r[0] for r in spark.read.text(known, wholetext=True).take(1)] != [header + "\n"]:
            raise ValueError("the journal was begun with another header")
    else:
        spark.createDataFrame([(header,)], "value string").coalesce(1).write.text(known)
    events.write.mode("append").json(f"{path}/events")
