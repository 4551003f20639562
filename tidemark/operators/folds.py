"""Folds over sorted groups of any size: rows stream past, and a task keeps the state of one group."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Fold(Protocol):
    """What becomes of a group: add() gets its values in order, row() is asked once at its end."""

    def add(self, value: Any) -> None: ...

    def row(self) -> tuple: ...


class Digest:
    """SHA-256 of all values one after the other, and their number; constant memory."""

    schema = "digest string, n long"

    def __init__(self) -> None:
        self.hash, self.n = hashlib.sha256(), 0

    def add(self, value: str | None) -> None:
        self.hash.update((value or "").encode())
        self.n += 1

    def row(self) -> tuple:
        return self.hash.hexdigest(), self.n


class Joined:
    """Number of values, and all of them in one text; keeps no more than that text."""

    schema = "n long, joined string"

    def __init__(self) -> None:
        self.parts: list[str] = []

    def add(self, value: str | None) -> None:
        self.parts.append(value or "")

    def row(self) -> tuple:
        return len(self.parts), " | ".join(self.parts)


def fold_sorted(rows: DataFrame, by: list[str], value: Column, order: list[Column], fold: Callable[[], Fold]) -> DataFrame:
    """(by, columns of fold.schema): one row a group, folded over its values in order.

    Spark deals the groups to tasks and sorts them there, spilling where it must; Python carries a group's state from batch
    to batch. One task reads a group, as the folds here cannot be split; null keys are a group of their own."""
    keys = [f"k{i}" for i in range(len(by))]
    orders = [f"o{i}" for i in range(len(order))]
    named = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], value.alias("value"), *[c.alias(o) for c, o in zip(order, orders, strict=True)])
    ready = named.repartition(*keys).sortWithinPartitions(*keys, *orders).select(*keys, "value")
    kinds = ready.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        state: Fold | None = None
        types: list[pa.DataType] = []

        def made(done: list[tuple]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*done, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, types[i] if i < len(types) else None) for i, c in enumerate(columns)], names)

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            done = []
            columns = [batch.column(k).to_pylist() for k in (*keys, "value")]
            for *key, x in zip(*columns, strict=True):
                if state is None or tuple(key) != now:
                    if state is not None:
                        done.append((*now, *state.row()))
                    now, state = tuple(key), fold()
                state.add(x)
            if done:
                yield made(done)
        if state is not None:
            yield made([(*now, *state.row())])

    out = fold.schema
    names = [*keys, *[c.split()[0] for c in out.split(", ")]]
    schema = ", ".join(f"{k} {kinds[k].dataType.simpleString()}" for k in keys) + ", " + out
    return ready.mapInArrow(work, schema).withColumnsRenamed(dict(zip(keys, by, strict=True)))


def first_of_each(rows: DataFrame, by: list[str], order: list[Column], k: int, place: str = "place") -> DataFrame:
    """The first k rows of each group with their place from 1. The plan limits each task to k rows a group before the shuffle
    (WindowGroupLimit), so a hot group sends k rows a task and not all of them."""
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(place) <= k)


#: So many of the largest keys are joined where their rows lie; any other holds less than one part in so many of all rows.
HOT_KEYS = 1024


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows with the columns of facts, which has one row a key and the key's number of rows in `count`; an inner join that
    holds where a key has a third of all rows. The HOT_KEYS largest keys are broadcast, the rest is shuffled."""
    hot = F.broadcast(facts.where(F.col(count) > 1).orderBy(F.col(count).desc(), *keys).limit(HOT_KEYS))
    few = hot.select(*keys)
    rest = rows.join(F.broadcast(few), keys, "left_anti").join(facts.join(F.broadcast(few), keys, "left_anti"), keys)
    return rows.join(hot, keys).unionByName(rest)
