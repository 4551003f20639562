"""The inference stage: batches of rows through an injected function, with retries, splits and endpoints."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, groupby, islice

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Answers of a batch of JSON items from an endpoint: id -> JSON. Raises ContextError or ConnectionError.
Infer = Callable[[str, list[tuple[int, str]]], dict[int, str]]


class ContextError(ValueError):
    """The request was too large."""


def _answered(infer: Infer, endpoints: list[str], items: list[tuple[int, str]], tries: int, wait: float, first: int = 0) -> Iterator[tuple[int, str | None, str | None]]:
    """Begins with endpoint number `first`. A batch that is too large is halved; lost endpoints are tried in turn; omitted items go once more alone."""
    todo: list[tuple[list[tuple[int, str]], int]] = [(items, 0)]
    while todo:
        batch, tried = todo.pop()
        try:
            got = infer(endpoints[(first + tried) % len(endpoints)], batch)
        except ContextError as e:
            if len(batch) > 1:
                todo += [(batch[: len(batch) // 2], tried), (batch[len(batch) // 2 :], tried)]
            else:
                yield batch[0][0], None, f"context: {e}"
            continue
        except (ConnectionError, ValueError) as e:
            if tried + 1 < tries * len(endpoints):
                time.sleep(min(wait * 2**tried, 30))
                todo.append((batch, tried + 1))
            else:
                yield from ((i, None, f"{type(e).__name__}: {e}") for i, _ in batch)
            continue
        for i, item in batch:
            if i in got:
                yield i, got[i], None
            elif len(batch) > 1 or tried + 1 < tries:
                todo.append(([(i, item)], tried + 1))
            else:
                yield i, None, "omitted"


def inferred(requests: DataFrame, infer: Infer, endpoints: list[str], size: int = 5, tries: int = 2, wait: float = 1.0) -> DataFrame:
    """(row_id, answer, error) of requests(row_id, item); rows of a partition go in batches of `size`.

    Tasks and their batches begin with one endpoint after the other, so all endpoints share the load."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId()
        for part in parts:
            pairs = list(zip(part["row_id"].tolist(), part["item"].tolist(), strict=True))
            rows = [r for k in range(0, len(pairs), size) for r in _answered(infer, endpoints, pairs[k : k + size], tries, wait, at + k // size)]
            at += -(-len(pairs) // size)
            yield pd.DataFrame({"row_id": pd.Series([r[0] for r in rows], dtype="int64"), "answer": pd.Series([r[1] for r in rows], dtype=object), "error": pd.Series([r[2] for r in rows], dtype=object)})

    return requests.select("row_id", "item").mapInPandas(work, "row_id long, answer string, error string")


#: A lost endpoint is tried again after at most so many seconds, and left alone after so many failures in a row.
LONGEST_WAIT, FAILURES = 30.0, 5
_RESULT = "row_id long, item string, answer string, error string, endpoint string, lost boolean"


def _served(infer: Infer, endpoint: str, items: Iterator[tuple[int, str]], size: int, tries: int, wait: float, failures: int) -> Iterator[tuple[int, str, str | None, str | None, bool]]:
    """Answers of one endpoint, one batch at a time. Too large batches and invalid output are split; when the endpoint fails
    too often in a row, what is left comes back as lost."""
    todo: list[tuple[list[tuple[int, str]], int]] = []
    failed = 0
    while todo or (batch := list(islice(items, size))):
        part, tried = todo.pop() if todo else (batch, 0)
        try:
            got = infer(endpoint, part)
        except (ContextError, ValueError) as e:
            if len(part) > 1:
                todo += [(part[len(part) // 2 :], tried), (part[: len(part) // 2], tried)]
            elif isinstance(e, ContextError) or tried + 1 >= tries:
                yield (*part[0], None, f"{'context' if isinstance(e, ContextError) else type(e).__name__}: {e}", False)
            else:
                todo.append((part, tried + 1))
            continue
        except ConnectionError:
            failed += 1
            todo.append((part, tried))
            if failed >= failures:
                yield from ((i, item, None, None, True) for i, item in chain(*[p for p, _ in todo], items))
                return
            time.sleep(min(wait * 2**failed, LONGEST_WAIT))
            continue
        failed = 0
        for i, item in part:
            if i in got:
                yield i, item, got[i], None, False
            elif len(part) > 1 or tried + 1 < tries:
                todo.append(([(i, item)], tried + 1))
            else:
                yield i, item, None, "omitted", False


def scheduled(requests: DataFrame, infer: Infer, endpoints: list[str], cut: Callable[[DataFrame], DataFrame], size: int = 5, tries: int = 2, wait: float = 1.0, failures: int = FAILURES) -> DataFrame:
    """(row_id, answer, error, endpoint) of requests(row_id, item), with one batch in flight for each endpoint.

    Work is dealt to endpoints by a hash of the row, and one task serves an endpoint. An endpoint that cannot be reached is
    tried again after a growing pause; after `failures` in a row it gets no more work, and its rows are dealt to the others
    in a round of their own. Rows that no endpoint is left for have the error `no endpoint`. `cut` writes each round, so that
    no request is sent twice but by a task that is run again."""
    alive, todo, done = list(endpoints), requests.select("row_id", "item"), []
    while alive:
        now = list(alive)

        def work(parts: Iterator[pd.DataFrame], now: list[str] = now) -> Iterator[pd.DataFrame]:
            rows = (r for part in parts for r in zip(part["slot"].tolist(), part["row_id"].tolist(), part["item"].tolist(), strict=True))
            for slot, group in groupby(rows, key=lambda r: r[0]):
                served = _served(infer, now[slot], ((i, item) for _, i, item in group), size, tries, wait, failures)
                while some := list(islice(served, 1000)):
                    columns = [pd.Series(list(c), dtype="int64" if k == 0 else object) for k, c in enumerate(zip(*some, strict=True))]
                    yield pd.DataFrame({"row_id": columns[0], "item": columns[1], "answer": columns[2], "error": columns[3], "endpoint": now[slot], "lost": columns[4].astype(bool)})

        dealt = todo.withColumn("slot", F.pmod(F.xxhash64("row_id", F.lit(len(done))), F.lit(len(now))).cast("int"))
        result = cut(dealt.repartition(len(now), "slot").sortWithinPartitions("slot", "row_id").mapInPandas(work, _RESULT))
        done.append(result.where("not lost").select("row_id", "answer", "error", "endpoint"))
        gone = {r["endpoint"] for r in result.where("lost").select("endpoint").distinct().collect()}  # a row an endpoint at most
        if not gone:
            break
        alive, todo = [e for e in alive if e not in gone], result.where("lost").select("row_id", "item")
    else:
        none = F.lit(None).cast("string")
        done.append(todo.select("row_id", none.alias("answer"), F.lit("no endpoint").alias("error"), none.alias("endpoint")))
    return reduce(DataFrame.unionByName, done)
