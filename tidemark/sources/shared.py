"""The folder that the driver and all executors share, for checkpoints and tables between steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which is trusted to be shared. Where that is unset: the checkpoint folder of
    the session, else one beside the warehouse, which becomes it; a local folder is refused then, unless the executors run
    on this machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    known = sc.getCheckpointDir()
    own = known or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if own.startswith(("file:", "/")) and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not known:
        sc.setCheckpointDir(own)
    return own


def cut(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Writes a DataFrame to the shared folder and reads it again, so that steps after it do not hang on those before."""
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return lambda df: df.checkpoint()


#: Tasks for each core, so that a slow one does not keep the others waiting.
TASKS = 3


def spread(rows: DataFrame) -> DataFrame:
    """rows in equal shares for all cores, however few bytes they are."""
    return rows.repartition(TASKS * rows.sparkSession.sparkContext.defaultParallelism)


def dealt(rows: DataFrame) -> DataFrame:
    """rows of a table in equal shares for all cores. Spark reads a file by its bytes: a few megabytes of narrow, compressed
    columns hold a million rows, and one task would do all the work on them. What is read in more tasks stays."""
    enough = TASKS * rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= enough else spread(rows)
