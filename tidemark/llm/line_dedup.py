"""Boilerplate lines by site-relative frequency.

For each host, the pages that hold a line are divided by the host's pages; a line over RATIO is boilerplate there and
goes from every page of that host, however few pages it has: on a host of fewer than 1 / RATIO pages every line goes, unless
`least` asks for lines of several pages, as the query and the pipeline do: a line of one page is no copy. Other lines stay,
in order.

Lines are compared by a 64-bit hash within their host. Counting sums before the shuffle, so neither a host nor a line
that holds a third of all rows meets in one task. The boilerplate set (at most lines-a-page / RATIO for each host) is
counted; up to BROADCAST_ROWS it is broadcast by host, beyond that the lines are joined by (host, line, salt).

A null host counts as the empty host, a null text as empty (and stays null if nothing is dropped from it). Blank lines
are never boilerplate. Repeated rows are pages of their own. A page whose lines all go stays with an empty text. A share
of exactly RATIO stays. Texts of any length are read whole. Columns of any name pass unchanged. Empty input gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, join_by_hot_key, packed

#: Largest share of a host's pages that a line may stand on; pages that make a line shared at all.
RATIO, LEAST = 0.1, 1
SALTS = 16
SPACES = " \t\n\x0b\x0c\r"


def _hashes(lines: Column) -> Column:
    """The hash of each line; blank lines have none (null)."""
    return F.transform(lines, lambda x: F.when(F.translate(x, SPACES, "") != "", F.xxhash64(x)))


def boilerplate(pages: DataFrame, host: Column, lines: Column, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """(host, line): hashes of the lines that go."""
    rows = pages.select(F.coalesce(host, F.lit("")).alias("host"), F.array_distinct(_hashes(lines)).alias("lines"))
    seen = rows.select("host", F.explode("lines").alias("line")).where(F.col("line").isNotNull()).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    return join_by_hot_key(seen, totals, "host", "pages").where(F.col("n") > ratio * F.col("pages")).select("host", "line")


def without_boilerplate(pages: DataFrame, host: Column, lines: Column, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """(row, lines, kept, n_dropped): each page as a struct, its lines, those that stay, and how many went."""
    scratch = Scratch(pages.sparkSession, "lines")
    gone = scratch.write(boilerplate(pages, host, lines, ratio, least))
    full = packed(pages, host=F.coalesce(host, F.lit("")), lines=lines)
    if gone.count() <= BROADCAST_ROWS:
        by_host = gone.groupBy("host").agg(F.collect_set("line").alias("gone"))
        found = full.join(F.broadcast(by_host), "host", "left")
        found = found.withColumn("here", F.array_intersect(F.array_compact(_hashes(F.col("lines"))), F.col("gone")))
    else:
        full = scratch.write(full.withColumn("at", F.monotonically_increasing_id()))
        salted = full.select("at", "host", F.explode(F.array_distinct(_hashes(F.col("lines")))).alias("line"), F.pmod("at", F.lit(SALTS)).alias("salt"))
        keys = gone.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        here = salted.join(keys, ["host", "line", "salt"]).groupBy("at").agg(F.collect_set("line").alias("here"))
        found = full.join(here, "at", "left")
    stays = F.filter("lines", lambda x: ~F.coalesce(F.array_contains("here", F.xxhash64(x)), F.lit(False)))
    some = F.col("here").isNotNull() & (F.size("here") > 0)
    found = found.withColumn("kept", F.when(some, stays).otherwise(F.col("lines")))
    return found.select("row", "lines", "kept", (F.size("lines") - F.size("kept")).alias("n_dropped"))


def clean_documents(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """docs with boilerplate lines removed from their texts; same columns, n_chars follows if there is one."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    done = without_boilerplate(docs, F.col(host).cast("string"), lines, ratio, least)
    changed, new = F.col("n_dropped") > 0, F.array_join("kept", "\n")

    def column(name: str) -> Column:
        own = F.col("row")[name]
        if name == text:
            return F.when(changed, new).otherwise(own)
        return F.when(changed, F.length(new).cast(docs.schema[name].dataType)).otherwise(own) if name == "n_chars" else own

    return done.select(*[column(c).alias(c) for c in docs.columns])


def page_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)", 1))


def page_lines(html: Column) -> Column:
    """Stretches of text between tags, without scripts, styles and comments."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "\n")
    return F.filter(F.transform(F.split(text, r"(?s)<[^>]*>|\n"), lambda x: F.btrim(x, F.lit(SPACES))), lambda x: x != "")


def pages_report(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """For each page: its host, number of lines, dropped lines and the remaining text."""
    rows = pages.select("page_id", page_host(F.col("url")).alias("host"), page_lines(F.col("html")).alias("lines"))
    rows = Scratch(pages.sparkSession, "pages").write(rows)  # both passes read the lines, and splitting costs the most
    done = without_boilerplate(rows, F.col("host"), F.col("lines"), least=least)
    return done.select("row.page_id", "row.host", F.size("lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)', 1)) AS host,
    list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(html, ''),
      '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', chr(10), 'g'), '(?s)<[^>]*>|\n'),
      lambda x: regexp_replace(x, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')), lambda x: x <> '') AS lines
  FROM pages),
seen AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY 1, 2),
gone AS (SELECT seen.host, line FROM seen JOIN (SELECT host, count(*) AS pages FROM p GROUP BY 1) t USING (host)
  WHERE n >= 2 AND n > 0.1 * pages),
by_host AS (SELECT host, list(line) AS gone FROM gone GROUP BY 1),
kept AS (SELECT p.*, list_filter(lines, lambda x: NOT coalesce(list_contains(gone, x), false)) AS kept FROM p LEFT JOIN by_host USING (host))
SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped, array_to_string(kept, chr(10)) AS text FROM kept
"""
