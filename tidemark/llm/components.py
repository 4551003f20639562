"""Connected components of a list of links, by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _order(c: Column, step: int) -> Column:
    """A fresh pseudo-random order for each step: a chain then shrinks by a constant share in each."""
    return F.struct(F.xxhash64(c, F.lit(step)), c.alias("id"))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every id in links(a, b): component is the smallest id that can be reached.

    Each step every id joins its least neighbour (or itself) in a pseudo-random order, links are rewritten to the
    joined ids, and links inside one are dropped. Each step's tables are written, so a lost executor costs one step."""
    links = scratch.write(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = scratch.write(links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct().withColumn("at", F.col("id")))
    step = 0
    while not links.isEmpty():
        step += 1
        both = links.union(links.select("b", "a"))
        near = both.groupBy(F.col("a").alias("id")).agg(F.min(_order(F.col("b"), step)).alias("n"))
        to = scratch.write(near.select("id", F.least(F.col("n"), _order(F.col("id"), step))["id"].alias("to")))
        new = links.join(to.withColumnRenamed("id", "a"), "a").select(F.col("to").alias("a"), "b").join(to.withColumnRenamed("id", "b"), "b").select("a", F.col("to").alias("b"))
        new = scratch.write(new.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        moved = scratch.write(labels.join(to.select(F.col("id").alias("at"), "to"), "at", "left").select("id", F.coalesce("to", "at").alias("at")))
        for old in (links, labels, to):
            scratch.drop(old)
        links, labels = new, moved
    least = labels.groupBy("at").agg(F.min("id").alias("component"))
    return scratch.write(labels.join(least, "at").select("id", "component"))
