"""Mixing sources to target weights by temperature.

Weights are the sources' token shares to the power of an exponent in [0, 1] (1: as they are, 0: even). The exponent
is bisected so that the mix reaches a target entropy, or so that no source is repeated more often than a limit. The
weights are then realised within a token budget: whole epochs of a source first, and of the last epoch as many
documents as its budget holds, taken in the order of a block permutation (a keyed hash deals documents to blocks,
another orders the blocks, a third the documents of a block).

Without a budget, the budget is the least one that uses every source whole, so no document is lost.

A source may hold a third of all rows: totals are summed before the shuffle, cumulative sums run over blocks, and only
the one block of a source where its budget ends is put in order, about BLOCK documents. What decides about a document
is then one row for its source. That table is broadcast when it was counted and is small, else joined by shuffle.

A null source counts as the empty name; null and empty texts have no tokens and follow their source; a source without
tokens keeps its rows once. Equal rows (same id and text) are taken or left together, also those without an id.
Documents keep columns of any name. Empty input: empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, free_name, packed, words_of

BLOCK, SEED = 4096, 17
#: Up to so many sources are bisected on the driver; more by a Spark aggregate for each step.
DRIVER_SOURCES = 100_000
STEPS = 60


def _bisect(fits: Callable[[float], bool]) -> float:
    """The largest number in [0, 1] that fits, where all smaller ones fit too (0 if none does)."""
    if fits(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return low


def _figures(totals: DataFrame) -> Callable[[float], tuple[float, float, float]]:
    """exponent -> (sum of share^exponent, entropy of the weights, largest repetition over the least budget)."""
    some = totals.where(F.col("tokens") > 0)
    if totals.count() <= DRIVER_SOURCES:
        sizes = [float(r[0]) for r in some.select("tokens").collect()]
        whole = sum(sizes)
        shares = sorted(s / whole for s in sizes)

        def own(a: float) -> tuple[float, float, float]:
            powers = [s**a for s in shares]
            z = sum(powers)
            return z, -sum(p / z * math.log(p / z) for p in powers), (shares[-1] / shares[0]) ** (1 - a) if shares else 1.0

        return own
    whole = some.agg(F.sum("tokens")).first()[0]
    share = F.col("tokens") / whole

    def spread(a: float) -> tuple[float, float, float]:
        p = F.pow(share, F.lit(a))
        z, pl, low, high = some.agg(F.sum(p), F.sum(p * F.log(p)), F.min(share), F.max(share)).first()
        return z, math.log(z) - pl / z, (high / low) ** (1 - a)

    return spread


def exponent(totals: DataFrame, entropy: float | None = None, repeats: float | None = None) -> float:
    """The exponent for a target entropy (nats, at least) or for a limit of repetition; one of the two is given."""
    if (entropy is None) == (repeats is None):
        raise ValueError("give a target entropy or a repetition limit")
    if totals.where(F.col("tokens") > 0).isEmpty():
        return 1.0
    of = _figures(totals)
    if entropy is not None:  # as near to the natural shares as the entropy allows
        return _bisect(lambda a: of(a)[1] >= entropy)
    return 1.0 - _bisect(lambda b: of(1.0 - b)[2] <= repeats)  # as even as the limit allows


def _keys(docs: DataFrame, source: str, text: str, id_col: str) -> DataFrame:
    return packed(docs, __source=F.coalesce(F.col(source).cast("string"), F.lit("")), __tokens=F.size(words_of(F.col(text))).cast("long"), __key=F.xxhash64(F.col(id_col), F.col(text)))


def _visit(n_blocks: Column) -> tuple[Column, Column]:
    """(order of the document's block, order within it), both keyed by source and epoch."""
    block = F.pmod(F.xxhash64("__key", F.lit(SEED), "epochs"), n_blocks)
    return F.xxhash64("__source", block, F.lit(SEED + 1), "epochs"), F.xxhash64("__key", F.lit(SEED + 2), "epochs")


def plan(docs: DataFrame, source: str, text: str, id_col: str, entropy: float | None = None, repeats: float | None = None, budget: float | None = None) -> DataFrame:
    """One row a source: __source, epochs (whole ones), n_blocks, last_block (order of the block where the budget ends)
    and last_doc (order of the last document taken from it); null orders take nothing."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.write(_keys(docs, source, text, id_col).select("__source", "__tokens", "__key"))
    totals = scratch.write(rows.groupBy("__source").agg(F.sum("__tokens").alias("tokens"), F.count("*").alias("docs")))
    a = exponent(totals, entropy, repeats)
    power = F.pow(F.col("tokens").cast("double"), F.lit(a))
    some = totals.where(F.col("tokens") > 0)
    z, least = some.agg(F.sum(power), F.max(F.col("tokens") / power)).first()
    quota = power / F.lit(float(z or 1)) * F.lit(float(budget if budget is not None else (least or 0) * (z or 1)))
    ratio = F.round(quota / F.col("tokens"), 9)
    sources = totals.select("__source", F.when(F.col("tokens") > 0, F.floor(ratio)).otherwise(1).alias("epochs"), F.when(F.col("tokens") > 0, (ratio - F.floor(ratio)) * F.col("tokens")).otherwise(0.0).alias("rest"), F.ceil(F.col("docs") / BLOCK).alias("n_blocks"))
    sources = scratch.write(sources)
    small = sources.count() <= BROADCAST_ROWS
    facts = F.broadcast(sources) if small else sources
    partial = rows.join(facts, "__source").where(F.col("rest") > 0)
    block, order = _visit(F.col("n_blocks"))
    partial = partial.select("__source", "__tokens", "rest", block.alias("block"), order.alias("doc"))
    blocks = partial.groupBy("__source", "block").agg(F.sum("__tokens").alias("n"), F.first("rest").alias("rest"))
    up_to = Window.partitionBy("__source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = blocks.withColumn("before", F.coalesce(F.sum("n").over(up_to), F.lit(0))).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest")))
    ends = scratch.write(ends.select("__source", F.col("block").alias("last_block"), (F.col("rest") - F.col("before")).alias("left")))
    inside = partial.join(F.broadcast(ends) if small else ends, "__source").where(F.col("block") == F.col("last_block"))
    running = Window.partitionBy("__source").orderBy("doc").rowsBetween(Window.unboundedPreceding, -1)
    taken = inside.withColumn("before", F.coalesce(F.sum("__tokens").over(running), F.lit(0))).where(F.col("before") < F.col("left"))
    cuts = taken.groupBy("__source").agg(F.first("last_block").alias("last_block"), F.max("doc").alias("last_doc"))
    out = scratch.write(sources.join(cuts, "__source", "left").select("__source", "epochs", "n_blocks", "last_block", "last_doc"))
    scratch.keep_only(out)
    return out


def _taken(docs: DataFrame, source: str, text: str, id_col: str, entropy: float | None, repeats: float | None, budget: float | None) -> DataFrame:
    """(row, tokens, epoch, order): each row as often as the mix takes it, with its place in the permutation."""
    sources = plan(docs, source, text, id_col, entropy, repeats, budget)
    small = sources.count() <= BROADCAST_ROWS
    rows = _keys(docs, source, text, id_col).join(F.broadcast(sources) if small else sources, "__source")
    block, order = _visit(F.col("n_blocks"))
    more = F.coalesce((block < F.col("last_block")) | ((block == F.col("last_block")) & (order <= F.col("last_doc"))), F.lit(False))
    rows = rows.withColumn("__copies", (F.col("epochs") + more.cast("int")).cast("int")).where("__copies > 0")
    out = rows.select("row", F.col("__tokens").alias("tokens"), "__key", F.explode(F.sequence(F.lit(1), "__copies")).alias("epoch"))
    return out.withColumn("order", F.xxhash64("__key", "epoch", F.lit(SEED + 3))).drop("__key")


def mixed(docs: DataFrame, source: str = "source", text: str = "text", id_col: str = "doc_id", entropy: float | None = None, repeats: float | None = None, budget: float | None = None) -> DataFrame:
    """docs with each row as often as the mix takes it: all columns, and mix_tokens, mix_epoch, mix_order (a key to shuffle
    by). Where docs has such a column, the new one's name ends with an underscore more."""
    done = _taken(docs, source, text, id_col, entropy, repeats, budget)
    return done.select("row.*", *[F.col(c).alias(free_name(f"mix_{c}", docs.columns)) for c in ("tokens", "epoch", "order")])


def mixed_documents(docs: DataFrame, repeats: float) -> DataFrame:
    """The mix with the columns of docs."""
    return _taken(docs, "source", "text", "doc_id", None, repeats, None).select("row.*")


def report(docs: DataFrame, repeats: float) -> DataFrame:
    done = _taken(docs.select("doc_id", "text", "source"), "source", "text", "doc_id", None, repeats, None)
    return done.select("row.doc_id", "row.source", F.col("tokens").alias("n_tokens"), F.col("epoch").cast("long").alias("epoch"), F.col("order").alias("mix_order"))
