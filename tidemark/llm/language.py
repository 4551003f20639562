"""Language of web pages by Bayesian fusion of four kinds of evidence.

- text: log likelihoods of character trigrams under one model a language, tempered to EVIDENCE trigrams at most, since
  neighbouring trigrams are far from independent;
- the language that the markup declares, right with probability DECLARED;
- the address's suffix, if it stands for a language, right with probability SUFFIX;
- a prior for the page's host, smoothed towards its domain's, which is smoothed towards that of all pages. These come
  from grouped sums of the other evidence's posteriors over all pages, less the page's own share.

The trigram models are fitted on a bounded sample: at most SAMPLE labelled texts, in the order of a hash of their id, of
at most MAX_CHARS characters each; of rows that share an id one counts, and rows without one don't. All else covers every row. Sums by host and domain are partial before the shuffle; the
host table is counted and broadcast up to BROADCAST_ROWS rows, else joined by shuffle.

A null or empty text, no declaration and a neutral suffix are no evidence; a page without any gets the prior. A null
address has the empty host. Without labelled texts the language is null. Of equally probable languages the first by name
is taken. Texts are read whole. Repeated rows are pages of their own; other columns are not read; empty input: empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch
from .line_dedup import page_host, page_lines

SAMPLE, MAX_CHARS = 4000, 20_000
TABLE, EVIDENCE = 1 << 15, 200
DECLARED, SUFFIX = 0.9, 0.8
#: Pages that a level of the prior hierarchy weighs as much as.
STRENGTH = 5.0
#: Country suffixes whose pages are mostly in one language.
SUFFIXES = {"at": "de", "de": "de", "es": "es", "fr": "fr", "it": "it", "mx": "es", "nl": "nl", "pl": "pl", "pt": "pt", "uk": "en", "us": "en"}
#: Labels that registries put before a country.
HOLDERS = ("ac", "co", "com", "edu", "gob", "gov", "net", "org")


def trigrams(text: str) -> np.ndarray:
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64")
    mixed = code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:] * np.uint64(0x165667B19E3779F9)
    return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(TABLE)).astype("int64")


class TextModel:
    """Log probabilities of trigrams, a column for each language."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        counts = np.full((TABLE, len(self.langs)), 0.1)
        for text, lang in zip(texts, langs, strict=True):
            counts[:, self.langs.index(lang)] += np.bincount(trigrams(text), minlength=TABLE)
        self.log = np.log(counts / counts.sum(0)).astype("float32")

    def likelihoods(self, text: str | None) -> list[float]:
        if not text or not text.strip():
            return [0.0] * len(self.langs)
        seen = trigrams(text)
        return (self.log[seen].mean(0, dtype="float64") * min(len(seen), EVIDENCE)).tolist()


def fit(docs: DataFrame) -> TextModel:
    """From documents with a language."""
    labelled = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull())
    n = labelled.count()
    # Ids first, and only those with a small hash: few leave a task, and no text that is not in the sample.
    low = math.ceil(min(1.0, 1.5 * SAMPLE / max(n, 1)) * (1 << 32))
    order = F.xxhash64("doc_id")
    chosen = labelled.where(F.shiftrightunsigned(order, 32) < low).select("doc_id").distinct().orderBy(order, "doc_id").limit(SAMPLE)
    cut = F.struct("lang", F.substring("text", 1, MAX_CHARS).alias("text"))
    rows = labelled.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(cut).alias("r")).select("doc_id", "r.*").collect()
    rows = sorted((r["doc_id"], r["lang"], r["text"]) for r in rows)
    return TextModel([r[2] for r in rows], [r[1] for r in rows])


def _agrees(named: Column, lang: str, n: int, sure: float) -> Column:
    """Log likelihood of a declaration, if there is one."""
    wrong = (1 - sure) / max(1, n - 1)
    return F.when(named.isNull(), 0.0).when(named == lang, float(np.log(sure))).otherwise(float(np.log(wrong)))


def _normal(logs: Column) -> Column:
    """Log weights to probabilities."""
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def domain_of(host: Column) -> Column:
    """The last two labels of a host, or three where the second last stands for a kind of holder below a country."""
    return F.when(host.rlike(rf"(^|\.)(?:{'|'.join(HOLDERS)})\.[a-z]{{2}}$"), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def identify(pages: DataFrame, model: TextModel) -> DataFrame:
    """(page_id, host, lang, confidence, posterior): posterior follows the order of model.langs."""
    spark, langs = pages.sparkSession, model.langs
    host = page_host(F.col("url"))
    if not langs:
        return pages.select("page_id", host.alias("host"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.array().cast("array<double>").alias("posterior"))
    said = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"""(?i)<html[^>]*?\slang\s*=\s*["']?([a-z]+)""", 1))
    suffix = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])[F.substring_index(host, ".", -1)]
    rows = pages.select("page_id", host.alias("host"), F.when(said.isin(langs), said).alias("said"), F.when(suffix.isin(langs), suffix).alias("suffix"), F.array_join(page_lines(F.col("html")), "\n").alias("text"))
    sent = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text_log=[sent.value.likelihoods(t) for t in batch["text"]]).drop(columns="text")

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = rows.mapInPandas(work, f"page_id {kind}, host string, said string, suffix string, text_log array<double>")
    own = F.array(*[F.get("text_log", i) + _agrees(F.col("said"), lang, len(langs), DECLARED) + _agrees(F.col("suffix"), lang, len(langs), SUFFIX) for i, lang in enumerate(langs)])
    scratch = Scratch(spark, "language")
    rows = scratch.write(rows.select("page_id", "host", own.alias("logs")).withColumn("own", _normal(F.col("logs"))))
    sums = [F.sum(F.get("own", i)).alias(f"s{i}") for i in range(len(langs))]
    hosts = scratch.write(rows.groupBy("host").agg(*sums).withColumn("domain", domain_of(F.col("host"))))
    domains = hosts.groupBy("domain").agg(*[F.sum(f"s{i}").alias(f"d{i}") for i in range(len(langs))])
    every = domains.agg(*[F.sum(f"d{i}").alias(f"g{i}") for i in range(len(langs))])
    levels = hosts.join(domains, "domain").join(F.broadcast(every)).select("host", *[F.array(*[F.col(f"{k}{i}") for i in range(len(langs))]).alias(k) for k in "sdg"])
    facts = F.broadcast(levels) if hosts.count() <= BROADCAST_ROWS else levels
    rows = rows.join(facts, "host")

    def without(level: str) -> list[Column]:
        return [F.greatest(F.get(level, i) - F.get("own", i), F.lit(0.0)) for i in range(len(langs))]

    prior: list[Column] = [F.lit(1.0 / len(langs))] * len(langs)
    for level in "gds":
        counts = without(level)
        total = sum(counts[1:], counts[0])
        names = [f"__{level}{i}" for i in range(len(langs))]
        rows = rows.withColumns({n: (c + STRENGTH * p) / (total + STRENGTH) for n, c, p in zip(names, counts, prior, strict=True)})
        prior = [F.col(n) for n in names]
    logs = F.array(*[F.get("logs", i) + F.log(p) for i, p in enumerate(prior)])
    done = rows.select("page_id", "host", _normal(logs).alias("posterior"))
    best = F.array_max("posterior")
    names = F.array(*[F.lit(x) for x in langs])
    return done.select("page_id", "host", F.get(names, (F.array_position("posterior", best) - 1).cast("int")).alias("lang"), best.alias("confidence"), "posterior")


def report(pages: DataFrame, docs: DataFrame) -> DataFrame:
    return identify(pages, fit(docs)).select("page_id", "host", "lang", F.round("confidence", 6).alias("confidence"))
