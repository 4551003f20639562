"""Pieces that the operators of this subpackage share: word splitting, scratch tables, hot-key joins."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: The white space of all word rules here: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: A relation is broadcast only when it was counted and has no more rows than this.
BROADCAST_ROWS = 500_000
#: At most so many hot keys get the map-side way in :func:`join_by_hot_key`.
HOT_KEYS = 4096
#: A key is hot from so many rows on.
HOT_ROWS = 2000


class Scratch:
    """Tables written to the shared folder, so that no result hangs on one executor's disk.

    A table that a returned DataFrame still reads stays; :meth:`drop` removes the others early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: set[str] = set()

    def write(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.base}/{self._n}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        self._paths.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self._paths = {p for p in self._paths if p != path.toString()}

    def drop(self, df: DataFrame) -> None:
        self._delete(df._scratch_path)

    def keep_only(self, *tables: DataFrame) -> None:
        """Removes all tables but these; to be called when nothing that is still to be computed reads the others."""
        for path in sorted(self._paths - {t._scratch_path for t in tables}):
            self._delete(path)


#: What Spark collects of rows of whole texts before it hands them to a Python worker. Its own bound of 64 MB is held in Arrow
#: vectors by the JVM and again by the worker, for each of a machine's tasks at once.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def small_batches(spark: SparkSession) -> None:
    """Sets BATCH for the session, unless the session has a value of its own. Rows and results are the same."""
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)


def give_back() -> None:
    """Returns what a Python worker has freed to the system: later stages use the same workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def packed(rows: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as a struct, column row, and the given columns: names inside row can't clash with others. Its columns
    come back by select("row.*")."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    return rows.select(whole, *[c.alias(name) for name, c in columns.items()])


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores behind it until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(c: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), rf"[{SPACE}]+"), lambda w: w != "")


def keep_ids(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", n: int | None = None) -> DataFrame:
    """Rows whose key is among ids (or not, with left_anti). The ids are broadcast only when they were counted
    and are few; else both sides are shuffled by the key."""
    n = ids.count() if n is None else n
    return rows.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids.hint("shuffle_merge"), key, how)


def join_by_hot_key(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of many rows with one fact row a key, where a key may hold a third of all rows.

    facts carries the key's number of rows in `count`. The HOT_KEYS largest keys with HOT_ROWS rows or more are
    broadcast and joined where the rows lie; the rest has bounded groups and is shuffled."""
    hot = facts.where(F.col(count) >= HOT_ROWS).orderBy(F.col(count).desc(), F.col(key)).limit(HOT_KEYS)
    names = facts.columns
    tagged = rows.join(F.broadcast(hot.select(key, *[F.col(c).alias(f"__hot_{c}") for c in names if c != key])), key, "left")
    found = F.col(f"__hot_{count}").isNotNull()
    fast = tagged.where(found).select(*rows.columns, *[F.col(f"__hot_{c}").alias(c) for c in names if c != key])
    rest = facts.join(F.broadcast(hot.select(key)), key, "left_anti")
    slow = tagged.where(~found).select(*rows.columns).join(rest, key)
    return fast.unionByName(slow.select(*fast.columns))
