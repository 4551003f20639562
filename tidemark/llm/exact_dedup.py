"""Exact duplicate removal with a heavy-hitter split.

1. Each text is reduced to its SHA-256 once; the digests go to a scratch table.
2. A Misra-Gries summary of each partition, merged by sum, names every digest that holds more than one row in
   COUNTERS + 1 of some partition. Of these the HEAVY largest are candidates.
3. A second pass over the digests counts the candidates exactly and finds their winners (the verified heavy
   hitters). That table has at most HEAVY rows; it is broadcast, and heavy rows are resolved where they lie.
4. All other digests are shuffled: winners are summed up by digest, partly before the shuffle, and joined to the rows.
   No task gathers a group.

Texts are hashed whole; other columns are not read, so their names can't clash. Null texts count as empty. The row with the largest doc_id of a group stays; a null doc_id is smaller than any
other, and of rows with the same doc_id exactly one stays. Every row yields one row. Empty input: empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Counters of a partition's summary, and most heavy digests that are broadcast (about 100 bytes each).
COUNTERS, HEAVY = 512, 1024
#: A digest with fewer rows in the merged summary goes the ordinary way.
LEAST = 16


def misra_gries(keys: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """(key, n): for each partition at most `counters` keys with a lower bound n of their rows there."""

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            held.update(Counter(bytes(x) for x in batch[key]))
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = Counter({k: n - cut for k, n in held.items() if n > cut})
        yield pd.DataFrame({key: list(held), "n": list(held.values())})

    return keys.select(key).mapInPandas(summary, f"{key} binary, n long")


def exact_groups(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """For each row: id_col, keep_id, group_size, kept and the digest (binary) of `text`."""
    scratch = Scratch(docs.sparkSession, "exact")
    rows = scratch.write(docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("digest"), F.monotonically_increasing_id().alias("row")))
    heavy = misra_gries(rows, "digest").groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).orderBy(F.col("n").desc(), "digest").limit(HEAVY).select("digest")
    winner = F.max(F.struct("id", "row")).alias("w")
    verified = scratch.write(rows.join(F.broadcast(heavy), "digest", "left_semi").groupBy("digest").agg(winner, F.count("*").alias("size")))
    tagged = rows.join(F.broadcast(verified), "digest", "left")
    rest = tagged.where(F.col("size").isNull()).select("id", "row", "digest")
    rest = rest.join(rest.groupBy("digest").agg(winner, F.count("*").alias("size")), "digest")
    both = tagged.where(F.col("size").isNotNull()).select(*rest.columns).unionByName(rest)
    return both.select(F.col("id").alias(id_col), F.col("w.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("w.row")).alias("kept"), "digest")


def digests(docs: DataFrame) -> DataFrame:
    groups = exact_groups(docs.select("doc_id", "text"), "doc_id", F.col("text"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
