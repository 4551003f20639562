"""An extra beside the batch operators: the run status as a stream over journal lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOURNAL = "run string, at timestamp, status string"


def journal_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(JOURNAL).json(folder)


def status_counts(lines: DataFrame, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Lines of each run, status and window; state of windows older than the watermark is dropped."""
    return lines.withWatermark("at", late).groupBy(F.window("at", window), "run", "status").agg(F.count("*").alias("n"))
