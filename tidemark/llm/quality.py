"""Quality rules: a base rule and a decision list learned from labelled rows, both as Spark expressions.

Measures of a text come from array and string functions of each row alone: nothing is exploded or shuffled.
A decision list is learned by sequential covering: a rule is grown on two thirds of the labelled statistics, one
threshold at a time by information gain, then pruned on the other third, and the rows it covers are set aside.
Rules name low quality; what no rule covers is kept. The list becomes one ordered CASE expression.

Labelled statistics are the measures of at most MAX_LABELLED labelled documents, chosen by a hash of doc_id (the
bound of the fit; all else covers every row). Without labels, or with one class only, the list has no rules.

Null and empty texts have no words, and fail the base rule. Rows are independent: repeated rows get repeated
results, a null doc_id passes through, empty input gives an empty result. Documents keep columns of any name. A document
with several labels counts with the least one; equal gains go to the first measure and cut. Words are compared by a 64-bit hash of five
words inside one text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, packed, words_of

#: Most labelled documents whose measures the learner sees.
MAX_LABELLED = 20_000
WINDOW = 5
#: Base rule: fewer words, or a larger share (in percent) of words in repeated windows, fails.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: The ratios that rules may use.
MEASURES = ("word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "digit_share", "distinct_share", "words")
#: A rule must be this pure on the pruning rows, and cover so many of the growing rows.
LEAST_PURITY, LEAST_COVER, MOST_RULES, MOST_CONDITIONS, CUTS = 0.95, 8, 12, 3, 32


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    cut: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.measure] > self.cut if self.above else row[self.measure] <= self.cut

    def column(self) -> Column:
        c = F.col(f"__m_{self.measure}")
        return c > self.cut if self.above else c <= self.cut

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _without(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def measured(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with the base counts and the ratios of MEASURES as columns that begin with __m_."""
    t = F.col("__m_text")
    space = " \t\n\v\f\r"
    out = rows.withColumn("__m_text", F.coalesce(F.col(text), F.lit("")))
    lines = F.filter(F.split(t, "\n"), lambda x: _without(x, space) != "")
    out = out.withColumns({"__m_w": words_of(t), "__m_lines": lines})
    window = F.transform(F.sequence(F.lit(0), F.size("__m_w") - WINDOW), lambda i: F.xxhash64(*[F.get("__m_w", i + k) for k in range(WINDOW)]))
    none = F.array().cast("array<bigint>")
    out = out.withColumns({"__m_n_words": F.size("__m_w").cast("long"), "__m_distinct": F.size(F.array_distinct("__m_w")), "__m_h": F.when(F.size("__m_w") >= WINDOW, window).otherwise(none)})
    out = out.drop("__m_w")
    twice = F.size("__m_h") > F.size(F.array_distinct("__m_h"))
    out = out.withColumn("__m_s", F.when(twice, F.sort_array(F.transform("__m_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.filter("__m_s", lambda s, k: F.coalesce(F.get("__m_s", k - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(F.get("__m_s", k + 1)["h"] == s["h"], F.lit(False)))
    out = out.drop("__m_h").withColumn("__m_p", F.sort_array(F.transform(again, lambda s: s["i"])))
    reach = F.transform("__m_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__m_p", k + 1) - p, F.lit(WINDOW))))
    out = out.withColumns({
        "__m_n_repeat_words": F.coalesce(F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")),
        "__m_word_chars": F.length(_without(t, space)).cast("long"),
        "__m_n_symbols": (F.length(t) - F.length(_without(t, "#*$%&|<>"))).cast("long"),
        "__m_n_dup_lines": (F.size("__m_lines") - F.size(F.array_distinct("__m_lines"))).cast("long"),
        "__m_n_lines": F.size("__m_lines"),
        "__m_upper": F.length(t) - F.length(_without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        "__m_marks": F.length(t) - F.length(_without(t, "!?;:\"'()[]{}=_/\\~^`@+")),
        "__m_digits": F.length(t) - F.length(_without(t, "0123456789")),
    }).drop("__m_s", "__m_p", "__m_lines", "__m_text")
    chars, n = F.greatest(F.col("__m_word_chars"), F.lit(1)), F.greatest(F.col("__m_n_words"), F.lit(1))
    return out.withColumns({
        "__m_word_length": F.col("__m_word_chars") / n,
        "__m_symbol_share": F.col("__m_n_symbols") / chars,
        "__m_dup_line_share": F.col("__m_n_dup_lines") / F.greatest(F.col("__m_n_lines"), F.lit(1)),
        "__m_repeat_share": F.col("__m_n_repeat_words") / n,
        "__m_upper_share": F.col("__m_upper") / chars,
        "__m_mark_share": F.col("__m_marks") / chars,
        "__m_digit_share": F.col("__m_digits") / chars,
        "__m_distinct_share": F.col("__m_distinct") / n,
        "__m_words": F.col("__m_n_words").cast("double"),
        "__m_row": F.monotonically_increasing_id(),
    })


def only(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows of :func:`measured` that meet a condition. The row number, which is not deterministic, keeps the filter
    above the measures: pushed below them it would repeat their whole expressions inside each other."""
    return rows.where(condition & (F.col("__m_row") >= 0))


def base_failed() -> Column:
    n = F.col("__m_n_words")
    return (n < LEAST_WORDS) | (100 * F.col("__m_n_repeat_words") > MOST_REPEATED * n)


def labelled_measures(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_LABELLED) -> list[tuple[dict[str, float], int]]:
    """(measures, label) of at most `limit` labelled documents that pass the base rule; fixed order. Of a document's several
    labels the least counts, of its rows that with the least measures: one row an id goes to the driver."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = measured(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    each = only(rows, ~base_failed()).groupBy("doc_id", "y").agg(F.min(F.struct(*[f"__m_{m}" for m in MEASURES])).alias("m"))
    got = sorted(each.select("doc_id", "y", "m.*").collect(), key=tuple)
    return [({m: float(r[f"__m_{m}"]) for m in MEASURES}, int(r["y"])) for r in got]


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information gain of narrowing a rule from p0 low and n0 good rows to p and n."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def _grow(rows: list[tuple[dict[str, float], int]]) -> Rule:
    rule: list[Condition] = []
    while len(rule) < MOST_CONDITIONS:
        p0, n0 = sum(y == 0 for _, y in rows), sum(y != 0 for _, y in rows)
        if not p0 or not n0:
            break
        best: tuple[float, Condition] | None = None
        for m in MEASURES:
            ordered = sorted((x[m], y) for x, y in rows)
            low_at = [0]
            for _, y in ordered:
                low_at.append(low_at[-1] + (y == 0))
            low = sorted(v for v, y in ordered if y == 0)
            # Edges of the low class's quantiles; a cut lies halfway to the next value.
            for q in sorted({low[min(len(low) - 1, k * len(low) // CUTS)] for k in range(CUTS + 1)}):
                for after in (True, False):
                    k = next((i for i, (v, _) in enumerate(ordered) if v > q), len(ordered)) if after else next(i for i, (v, _) in enumerate(ordered) if v >= q)
                    if not 0 < k < len(ordered):
                        continue
                    cut = (ordered[k - 1][0] + ordered[k][0]) / 2
                    for above in (True, False):
                        p = p0 - low_at[k] if above else low_at[k]
                        n = (len(ordered) - k if above else k) - p
                        if p + n >= LEAST_COVER and (g := _gain(p, n, p0, n0)) > 1e-9 and (best is None or g > best[0]):
                            best = g, Condition(m, above, cut)
        if best is None:
            break
        rule.append(best[1])
        rows = [r for r in rows if best[1].holds(r[0])]
    return tuple(rule)


def _value(rule: Rule, rows: list[tuple[dict[str, float], int]]) -> tuple[float, float, int]:
    """(worth, purity, rows) of a rule on rows: worth is (low - good) / covered."""
    covered = [y for x, y in rows if all(c.holds(x) for c in rule)]
    low = sum(y == 0 for y in covered)
    return ((2 * low - len(covered)) / len(covered), low / len(covered), len(covered)) if covered else (-1.0, 0.0, 0)


def learn(rows: list[tuple[dict[str, float], int]]) -> list[Rule]:
    """An ordered list of rules for low quality (label 0)."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    rules: list[Rule] = []
    while len(rules) < MOST_RULES and any(y == 0 for _, y in grow):
        rule = _grow(grow)
        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _value(r, prune)[0])
        _, purity, seen = _value(rule, prune)
        _, own, cover = _value(rule, grow)
        if not seen or min(purity, own) < LEAST_PURITY or cover < LEAST_COVER:
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not all(c.holds(r[0]) for c in rule)] for part in (grow, prune))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for what no rule covers; conditions in the order of the list."""
    out = None
    for rule in rules:
        covers = rule[0].column()
        for c in rule[1:]:
            covers = covers & c.column()
        out = F.when(covers, False) if out is None else out.when(covers, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with the columns of :func:`measured`, __m_base_failed and __m_kept."""
    return measured(docs).withColumn("__m_base_failed", base_failed()).withColumn("__m_kept", ~F.col("__m_base_failed") & verdict(rules))


def kept_documents(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that the rules keep, with the columns of docs."""
    return only(judged(packed(docs, text=F.col("text")), rules), F.col("__m_kept")).select("row.*")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rules = learn(labelled_measures(docs, labels))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged(docs.select("doc_id", "text"), rules).select("doc_id", *[F.col(f"__m_{n}").alias(n) for n in names])
