"""Queries over the driver's tables, one or more for each operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..operators import evidence, library, link, manifest, plan, prepare, review
from ..sources.shared import cut, dealt
from .fixtures import DIRTY_SQL, PATHS_SQL, ROOT, TRACKS_SQL, dirty, table, tracks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    """All tracks with their destinations, written: a plan that uses them several times would make each name several times."""
    return cut(spark)(plan.with_paths(tracks(spark, sf), ROOT))


def _planned(spark: SparkSession, sf: str) -> DataFrame:
    return plan.one_winner(_paths(spark, sf))


NORM = "trim(regexp_replace(replace(lower(coalesce({0}, '')), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))"


@query(f"WITH {PATHS_SQL} SELECT row_id, new_path FROM paths")
def plan_paths(spark: SparkSession, sf: str) -> DataFrame:
    return plan.with_paths(tracks(spark, sf), ROOT).select("row_id", "new_path")


@query(f"WITH {PATHS_SQL} SELECT row_id, identity, is_winner FROM winners")
def plan_winner(spark: SparkSession, sf: str) -> DataFrame:
    return _planned(spark, sf).select("row_id", "identity", "is_winner")


@query(f"""WITH {PATHS_SQL} SELECT count(*) AS n_rows, count(*) FILTER (is_winner) AS planned,
  count(*) FILTER (new_path IS NULL) AS review_blanks, count(*) FILTER (new_path IS NOT NULL AND NOT is_winner) AS duplicate_blanks FROM winners""")
def plan_counts(spark: SparkSession, sf: str) -> DataFrame:
    return plan.plan_counts(_planned(spark, sf))


@query(f"""WITH {PATHS_SQL} SELECT l.row_id, w.row_id AS winner_id, w.source_path AS winner_source FROM winners l
  JOIN winners w ON l.identity = w.identity AND w.is_winner WHERE NOT l.is_winner AND l.new_path IS NOT NULL""")
def duplicate_losers(spark: SparkSession, sf: str) -> DataFrame:
    return plan.duplicate_losers(_planned(spark, sf))


@query(f"""WITH {PATHS_SQL}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(new_path) ORDER BY row_id) AS k
  FROM paths WHERE new_path IS NOT NULL) WHERE k = 1)
  SELECT row_id, 0 AS line_no, '#EXTINF:-1,' || artist || ' - ' || title AS line FROM f UNION ALL SELECT row_id, 1, new_path FROM f""")
def playlist_lines(spark: SparkSession, sf: str) -> DataFrame:
    return plan.playlist(plan.with_paths(tracks(spark, sf), ROOT))


@query(f"WITH {TRACKS_SQL} SELECT CAST(sum(size) AS BIGINT) AS total, max(size) AS largest, CAST(sum(size) + 268435456 AS BIGINT) AS required FROM tracks")
def space_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return plan.space_estimate(tracks(spark, sf), same_volume=False)


@query(f"""SELECT p_partkey AS row_id, {NORM.format("p_brand")} AS artist_key, {NORM.format("p_name")} AS title_key FROM part
  UNION ALL SELECT c_custkey, {NORM.format("c_name")}, {NORM.format("c_mktsegment")} FROM customer""")
def identity_norm(spark: SparkSession, sf: str) -> DataFrame:
    one = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), X.normalize_identity(F.col("p_brand")).alias("artist_key"), X.normalize_identity(F.col("p_name")).alias("title_key"))
    return one.union(table(spark, sf, "customer").select("c_custkey", X.normalize_identity(F.col("c_name")), X.normalize_identity(F.col("c_mktsegment"))))


def _whole_index(rows: DataFrame) -> DataFrame:
    """All tracks as a library, with their destinations as paths; every fifth unreadable."""
    path = F.coalesce("new_path", F.concat(F.lit(ROOT + "/held/"), F.col("row_id").cast("string"), F.lit(".mp3")))
    rows = rows.select("row_id", path.alias("path"), "artist", "title", F.when(F.col("row_id") % 5 == 0, "unreadable").alias("error"))
    return rows.withColumns({"key": X.path_key(F.col("path")), "normalized_artist": X.normalize_identity(F.col("artist")), "normalized_title": X.normalize_identity(F.col("title"))})


def _index(rows: DataFrame) -> DataFrame:
    """Every third track as the library that the others are planned into."""
    return _whole_index(rows).where("row_id % 3 = 0")


WHOLE_INDEX_SQL = (
    PATHS_SQL
    + f""", idx AS (SELECT row_id, coalesce(new_path, 'D:/library/held/' || row_id || '.mp3') AS path, artist, title,
  CASE WHEN row_id % 5 = 0 THEN 'unreadable' END AS error, {NORM.format("artist")} AS na, {NORM.format("title")} AS nt FROM paths WHERE true),
  grp AS (SELECT na, nt, count(*) AS n, string_agg(path, ' | ' ORDER BY lower(path), path) AS paths FROM idx WHERE na <> '' AND nt <> '' GROUP BY 1, 2)"""
)
INDEX_SQL = WHOLE_INDEX_SQL.replace("WHERE true", "WHERE row_id % 3 = 0")


@query(f"WITH {WHOLE_INDEX_SQL} SELECT na AS normalized_artist, nt AS normalized_title, n, paths FROM grp")
def identity_groups(spark: SparkSession, sf: str) -> DataFrame:
    return library.identity_groups(_whole_index(plan.with_paths(tracks(spark, sf), ROOT)))


COLLISION_SQL = (
    INDEX_SQL
    + f""", lib AS (SELECT lower(path) AS key, min(path) AS path, min(na) AS na, min(nt) AS nt, min(error) AS error FROM idx GROUP BY 1),
  col AS (SELECT p.row_id, p.source_path, p.new_path, l.path IS NOT NULL AS destination_exists,
    coalesce(g.paths, CASE WHEN l.path IS NOT NULL AND l.error IS NULL AND {NORM.format("p.artist")} = l.na AND {NORM.format("p.title")} = l.nt THEN l.path END) AS existing
  FROM (SELECT * FROM paths WHERE new_path IS NOT NULL AND row_id % 3 <> 0) p
  LEFT JOIN grp g ON g.na = {NORM.format("p.artist")} AND g.nt = {NORM.format("p.title")} LEFT JOIN lib l ON l.key = lower(p.new_path))"""
)


def _collisions(rows: DataFrame) -> DataFrame:
    return library.collisions(rows.where("row_id % 3 <> 0"), _index(rows).drop("row_id"))


@query(f"WITH {COLLISION_SQL} SELECT *, CASE WHEN existing IS NOT NULL THEN 'skip_existing' ELSE 'resolve_collision' END AS recommendation FROM col WHERE destination_exists OR existing IS NOT NULL")
def import_collisions(spark: SparkSession, sf: str) -> DataFrame:
    return _collisions(_paths(spark, sf)).drop("artist", "title")


def _audited(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A plan, some sources of which occur twice, and its audit with rows of every kind that must not be applied."""
    rows = _paths(spark, sf)
    planned = rows.where("new_path is not null and row_id % 3 <> 0")
    found, k = cut(spark)(_collisions(rows)), F.col("row_id")
    moved = F.when(k % 7 == 0, F.lit("D:/library/elsewhere.mp3")).otherwise(F.col("new_path"))
    found = found.withColumns({"new_path": moved, "existing": F.when(k % 11 == 0, " ").otherwise(F.col("existing"))})
    return planned, found.unionByName(found.where("row_id % 13 = 0").withColumn("source_path", F.when(F.col("row_id") % 26 == 0, "C:/in/absent.mp3").otherwise(F.col("source_path"))))


AUDIT_SQL = (
    COLLISION_SQL
    + r""", f AS (SELECT row_id, lower(replace(source_path, '\', '/')) AS key, lower(CASE WHEN row_id % 7 = 0 THEN 'D:/library/elsewhere.mp3' ELSE new_path END) AS audited,
    existing IS NOT NULL AS sure, CASE WHEN row_id % 11 = 0 THEN '' ELSE coalesce(existing, '') END AS evidence FROM col WHERE destination_exists OR existing IS NOT NULL),
  a AS (SELECT * FROM f UNION ALL SELECT row_id, CASE WHEN row_id % 26 = 0 THEN 'c:/in/absent.mp3' ELSE key END, audited, sure, evidence FROM f WHERE row_id % 13 = 0),
  one AS (SELECT key, count(*) AS n, min(audited) AS audited, bool_and(sure) AS sure, min(evidence) AS evidence FROM a GROUP BY key),
  p AS (SELECT row_id, source_path, new_path, lower(replace(source_path, '\', '/')) AS key, count(*) OVER (PARTITION BY lower(replace(source_path, '\', '/'))) AS k FROM paths WHERE new_path IS NOT NULL AND row_id % 3 <> 0),
  held AS (SELECT p.row_id, p.source_path, p.new_path, p.key, CASE WHEN k > 1 THEN 'plan source repeated' WHEN n > 1 THEN 'audit source repeated' WHEN audited <> lower(p.new_path) THEN 'destination changed'
    WHEN NOT sure THEN 'recommendation unresolved' WHEN evidence = '' THEN 'no identity evidence' END AS rule, one.key IS NOT NULL AS said FROM p LEFT JOIN one USING (key))"""
)


@query(f"WITH {AUDIT_SQL} SELECT row_id, source_path, CASE WHEN said AND rule IS NULL THEN '' ELSE new_path END AS new_path, coalesce(rule, CASE WHEN said THEN 'skipped' ELSE 'planned' END) AS status FROM held")
def apply_skips(spark: SparkSession, sf: str) -> DataFrame:
    return plan.apply_skips(*_audited(spark, sf))


@query(f"WITH {AUDIT_SQL} SELECT DISTINCT key, rule FROM held WHERE rule IS NOT NULL UNION SELECT key, 'audit source absent' FROM one WHERE key NOT IN (SELECT key FROM p)")
def audit_violations(spark: SparkSession, sf: str) -> DataFrame:
    return plan.audit_violations(*_audited(spark, sf))


@query(f"""WITH {PATHS_SQL}, s AS (SELECT lower(replace(source_path, '\\', '/')) AS key, lower(new_path) AS destination, row_id % 23 = 0 AS bad FROM paths WHERE new_path IS NOT NULL)
  SELECT key, min(destination) AS destination, count(DISTINCT destination) AS n_destinations, bool_or(bad) AS unsafe FROM s GROUP BY key""")
def skip_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = plan.with_paths(tracks(spark, sf), ROOT).where("new_path is not null")
    one = rows.where("row_id % 2 = 0 and row_id % 23 <> 0").select("source_path", "new_path", F.lit("skip_existing").alias("recommendation"))
    two = rows.where("row_id % 2 = 1 or row_id % 23 = 0").select(F.col("source_path").alias("skipped_source"), F.col("new_path").alias("skipped_destination"), F.when(F.col("row_id") % 23 == 0, "").otherwise("same_identity").alias("reason"))
    return plan.skip_evidence(one, two)


@query(f"""WITH {DIRTY_SQL} SELECT row_id, {NORM.format("regexp_extract(artist, '^(.*?)( feat[.] .*)?$', 1)")} AS artist_key, {NORM.format("title")} AS title_key FROM dirty""")
def canonical_identity(spark: SparkSession, sf: str) -> DataFrame:
    a, t = X.canonical_release(F.col("artist"), F.concat("title", F.lit(" (feat. Someone Else)")))
    return dirty(spark, sf).select("row_id", a.alias("artist_key"), t.alias("title_key"))


def _refreshed(spark: SparkSession, sf: str, trigger: str | None) -> DataFrame:
    docs = table(spark, sf, "documents").where("doc_id is not null")
    path = F.concat(F.lit("/lib/"), F.col("source"), F.lit("/Doc "), F.col("doc_id").cast("string"), F.lit(".mp3"))
    rows = docs.select("doc_id", path.alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") * 1000).alias("mtime_ns"), F.col("source").alias("artist"), F.col("lang").alias("title"), F.lit(None).cast("string").alias("error"))
    old = rows.where("doc_id % 10 <> 1").withColumn("size", F.when(F.col("doc_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size"))).withColumn("title", F.when(F.col("doc_id") % 9 == 0, "old").otherwise(F.col("title")))
    now = rows.where("doc_id % 10 <> 2")
    read = now.withColumn("error", F.when(F.col("doc_id") % 31 == 0, "bad file")).select("path", "artist", "title", "error")
    return library.refresh(old.drop("doc_id"), now.select("path", "size", "mtime_ns"), read, trigger)


REFRESH_SQL = """r AS (SELECT '/lib/' || source || '/Doc ' || doc_id || '.mp3' AS path, doc_id, doc_id % 10 <> 1 AS was, doc_id % 10 <> 2 AS is_,
  doc_id % 7 <> 0 AS same, doc_id % 9 = 0 OR doc_id % 31 = 0 AS moved, doc_id % 31 = 0 AS bad FROM documents WHERE doc_id IS NOT NULL),
  s AS (SELECT *, CASE WHEN NOT is_ THEN 'removed' WHEN was AND same THEN {0} ELSE 'reindexed' END AS status FROM r WHERE was OR is_)"""
REUSE, FORCED = REFRESH_SQL.format("'reused'"), REFRESH_SQL.format("CASE WHEN moved THEN 'drifted' ELSE 'reindexed' END")


@query(f"WITH {REUSE} SELECT path, status FROM s")
def index_refresh_status(spark: SparkSession, sf: str) -> DataFrame:
    return _refreshed(spark, sf, None).select("path", "status")


STATS_SQL = """SELECT count(*) FILTER (status <> 'removed') AS scanned, count(*) FILTER (status = 'reused') AS reused, count(*) FILTER (status IN ('reindexed', 'drifted')) AS reindexed,
  count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status IN ('reindexed', 'drifted') AND bad) AS unreadable, count(*) FILTER (status = 'drifted') AS drifted FROM s"""


@query(f"WITH {REUSE} {STATS_SQL}")
def index_refresh_stats(spark: SparkSession, sf: str) -> DataFrame:
    return library.refresh_stats(_refreshed(spark, sf, None))


@query(f"WITH {FORCED} {STATS_SQL}")
def index_verify_stats(spark: SparkSession, sf: str) -> DataFrame:
    return library.refresh_stats(_refreshed(spark, sf, library.verify_reason(False, 0, 8 * library.DAY_NS)))


def _bundle(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).withColumn("plan_id", F.concat(F.lit("plan "), (F.col("row_id") % 3).cast("string")))


BUNDLE_SQL = (
    PATHS_SQL.replace("WITH ", "")
    + f""", act AS (SELECT row_id, lower(new_path) AS d, {NORM.format("artist")} || '|' || {NORM.format("title")} AS i FROM paths WHERE new_path IS NOT NULL),
  star AS (SELECT row_id AS x, min(row_id) OVER (PARTITION BY d) AS y FROM act UNION SELECT row_id, min(row_id) OVER (PARTITION BY i) FROM act),
  edge AS (SELECT x, y FROM star UNION SELECT y, x FROM star),
  walk AS (SELECT row_id AS x, row_id AS c FROM act UNION SELECT e.y, w.c FROM walk w JOIN edge e ON e.x = w.x WHERE w.c < e.y),
  comp AS (SELECT x AS row_id, min(c) AS component FROM walk GROUP BY 1)"""
)


def _skips(spark: SparkSession, sf: str) -> DataFrame:
    rows = _bundle(spark, sf)
    return library.bundle(rows, library.linked_rows(rows, cut(spark)))


@query(f"WITH RECURSIVE {BUNDLE_SQL} SELECT row_id, component FROM comp")
def bundle_components(spark: SparkSession, sf: str) -> DataFrame:
    rows = plan.with_paths(tracks(spark, sf), ROOT)
    return library.linked_rows(rows, cut(spark))


@query(f"""WITH RECURSIVE {BUNDLE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY depth, -quality, -size, lower(replace(source_path, '\\', '/')), row_id) AS k FROM ranked JOIN comp USING (row_id))
  SELECT l.component, 'plan ' || l.row_id % 3 AS plan_id, l.row_id, l.new_path AS skipped_destination, w.row_id AS kept_row_id, w.new_path AS kept_destination,
    array_to_string(list_filter([CASE WHEN lower(l.new_path) = lower(w.new_path) THEN 'same_destination' END, CASE WHEN l.artist = w.artist AND l.title = w.title THEN 'same_identity' END], lambda z: z IS NOT NULL), '+') AS reason
  FROM r l JOIN r w ON l.component = w.component AND w.k = 1 WHERE l.k > 1""")
def bundle_skips(spark: SparkSession, sf: str) -> DataFrame:
    return _skips(spark, sf)


@query(f"""WITH RECURSIVE {BUNDLE_SQL}, n AS (SELECT component, count(*) - 1 AS lost FROM comp GROUP BY 1) SELECT CAST(sum(lost) AS BIGINT) AS duplicates, sum(lost) = 0 AS passed FROM n""")
def bundle_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return library.verdict(_skips(spark, sf))


@query("""WITH e AS (SELECT o_orderkey AS row_id, 'C:/in/' || o_orderkey || '.mp3' AS source_path, 'D:/library/' || o_orderkey || '.mp3' AS new_path, o_orderpriority AS title, o_orderstatus AS artist FROM orders),
  a AS (SELECT row_id, source_path, CASE WHEN row_id % 50 = 0 THEN '' WHEN row_id % 51 = 0 THEN 'E:/else/' || row_id || '.mp3' WHEN row_id % 53 = 0 THEN 'D:/library/' || row_id || '.txt' ELSE new_path END AS new_path,
    CASE WHEN row_id % 52 = 0 THEN 'edited' ELSE title END AS title, artist FROM e WHERE row_id % 60 <> 0),
  p AS (SELECT e.row_id, e.source_path, e.new_path AS en, a.new_path AS an, a.row_id IS NOT NULL AS here, e.title AS et, a.title AS at_, e.row_id % 100 = 0 AS proof FROM e LEFT JOIN a USING (row_id))
  SELECT row_id, 'row missing' AS rule, source_path AS detail FROM p WHERE NOT here
  UNION ALL SELECT row_id, 'title differs', at_ FROM p WHERE here AND et <> at_
  UNION ALL SELECT row_id, 'new_path differs', an FROM p WHERE here AND en <> an AND NOT (an = '' AND proof)
  UNION ALL SELECT row_id, 'destination outside root', an FROM p WHERE here AND an LIKE 'E:%'
  UNION ALL SELECT row_id, 'extension not supported', an FROM p WHERE here AND an LIKE '%.txt'
  UNION ALL SELECT NULL, 'evidence not used', lower(source_path) FROM p WHERE proof AND NOT here""")
def contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    name = lambda root, e=".mp3": F.concat(F.lit(root), key.cast("string"), F.lit(e))
    orders = table(spark, sf, "orders")
    e = orders.select(key.alias("row_id"), name("C:/in/").alias("source_path"), name("D:/library/").alias("new_path"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("artist"))
    k = F.col("row_id")
    moved = F.concat(F.lit("E:/else/"), k.cast("string"), F.lit(".mp3"))
    odd = F.concat(F.lit("D:/library/"), k.cast("string"), F.lit(".txt"))
    a = e.where("row_id % 60 <> 0").withColumns({"new_path": F.when(k % 50 == 0, "").when(k % 51 == 0, moved).when(k % 53 == 0, odd).otherwise(F.col("new_path")), "title": F.when(k % 52 == 0, "edited").otherwise(F.col("title"))})
    return plan.contract_violations(e, a, e.where("row_id % 100 = 0").select("source_path"), ROOT)


@query("SELECT min(l_orderkey * 10 + l_linenumber) AS row_id, 'destination repeated' AS rule, l_suppkey || '/' || l_shipmode AS detail FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem) GROUP BY 3 HAVING count(*) > 1")
def unique_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return plan.repeated(rows, F.concat_ws("/", F.col("l_suppkey").cast("string"), "l_returnflag"), "destination repeated")


def _reviewed(spark: SparkSession, sf: str) -> DataFrame:
    rows = dirty(spark, sf).withColumns({"album_artist": F.lit(None).cast("string"), "album": F.lit("An Album (part"), "genre": F.lit("Other"), "needs_review": F.col("row_id") % 17 == 0, "source_path": F.col("row_id").cast("string")})
    return review.review_rows(rows.withColumn("title", F.initcap("title")), cut(spark))


REVIEW_SQL = (
    DIRTY_SQL
    + r""", t AS (SELECT row_id, artist, array_to_string(list_transform(string_split(title, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title, row_id % 17 = 0 AS held FROM dirty),
  f AS (SELECT row_id, artist, title, list_filter([CASE WHEN held THEN {'reason': 'needs review', 'rank': 3} END,
    CASE WHEN regexp_matches(title, '(?i)www\.') THEN {'reason': 'title contains a URL or domain', 'rank': 3} END,
    CASE WHEN title LIKE '%\_%' ESCAPE '\' THEN {'reason': 'title contains underscore', 'rank': 2} END,
    CASE WHEN regexp_matches(title, '(?i)\b(free\s*(d/?l|download)|promo(tional)?|\d{2,3}(\.\d+)?\s*bpm)\b') THEN {'reason': 'title contains workflow or promo text', 'rank': 2} END,
    CASE WHEN regexp_matches(artist, '(?i)\b(promo(tional)?)\b') THEN {'reason': 'artist contains workflow or promo text', 'rank': 2} END,
    {'reason': 'album has unbalanced brackets', 'rank': 3},
    CASE WHEN regexp_matches(title, '(^|[^A-Za-z$@#])[a-z]{2}') AND len(regexp_extract_all(title, '[A-Za-z]+')) > 1 THEN {'reason': 'title casing', 'rank': 1} END,
    {'reason': 'album casing', 'rank': 1}], lambda x: x IS NOT NULL) AS found FROM t)"""
)


@query(f"WITH {REVIEW_SQL} SELECT row_id, array_to_string(list_transform(list_filter(found, lambda x: x.reason NOT LIKE '%casing'), lambda x: x.reason), '; ') AS reasons, list_max(list_transform(found, lambda x: x.rank)) AS rank FROM f")
def review_findings(spark: SparkSession, sf: str) -> DataFrame:
    kept = F.filter(F.split("reasons", "; "), lambda r: ~r.endswith("casing"))
    return _reviewed(spark, sf).select("row_id", F.array_join(kept, "; ").alias("reasons"), "rank")


@query(f"WITH {REVIEW_SQL}, r AS (SELECT list_max(list_transform(found, lambda x: x.rank)) AS rank FROM f) SELECT CASE rank WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS priority, count(*) AS n FROM r GROUP BY 1")
def review_priorities(spark: SparkSession, sf: str) -> DataFrame:
    return review.priority_counts(_reviewed(spark, sf))


@query(f"WITH {REVIEW_SQL} SELECT row_id, artist, title FROM f ORDER BY list_max(list_transform(found, lambda x: x.rank)) DESC, lower(artist), lower(title), CAST(row_id AS VARCHAR), row_id LIMIT 50")
def review_sorted_top(spark: SparkSession, sf: str) -> DataFrame:
    return _reviewed(spark, sf).orderBy(*review.review_order()).limit(50).select("row_id", "artist", "title")


@query(f"WITH {DIRTY_SQL} SELECT row_id, regexp_replace(regexp_replace(title, ' \\(Free Download\\)$| \\[320 kbps\\] \\[HQ\\]$| - 128 BPM$|_mp3$| \\( \\) - promo$', ''), '^www.tunes.com ', '') AS title, true AS settled FROM dirty")
def noise_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    return dirty(spark, sf).select("row_id", X.remove_noise(F.col("title")).alias("title"), X.noise_settled(F.col("title")).alias("settled"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


@query("SELECT p_brand AS artist, sha256(string_agg(h, '' ORDER BY h)) AS digest, count(*) AS n FROM (SELECT p_brand, sha256(p_partkey || '|' || p_name) AS h FROM part) GROUP BY 1")
def content_digest(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name")
    return manifest.content_digest(table(spark, sf, "part").withColumnRenamed("p_brand", "artist"), "artist", parts)


def _two_manifests(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    one = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("artist"), (F.col("o_custkey") % 20).alias("track_number"), (F.col("o_custkey") % 3 == 0).alias("needs_review"))
    k = F.col("row_id")
    two = one.withColumns({"title": F.when(k % 5 == 0, "other").otherwise(F.concat(F.lit("  "), F.upper("title"))), "artist": F.when(k % 8 == 0, F.lit(None)).otherwise(F.col("artist")), "track_number": F.col("track_number") + (k % 9 == 0).cast("int")})
    return one, two


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.field_exact(*_two_manifests(spark, sf))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS title, o_orderstatus AS artist, o_custkey % 20 AS n FROM orders)
  SELECT k AS row_id, 'title' AS field, title AS expected, 'other' AS actual FROM o WHERE k % 5 = 0 UNION ALL SELECT k, 'artist', artist, NULL FROM o WHERE k % 8 = 0
  UNION ALL SELECT k, 'track_number', CAST(n AS VARCHAR), CAST(n + 1 AS VARCHAR) FROM o WHERE k % 9 = 0""")
def score_regressions(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.regressions(*_two_manifests(spark, sf))


SCORE_SQL = """s AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 5 <> 0) AS t, count(*) FILTER (o_orderkey % 8 <> 0) AS a, count(*) FILTER (o_orderkey % 9 <> 0) AS k FROM orders),
  f AS (SELECT 'title' AS field, 4.0 AS weight, n, t AS equal FROM s UNION ALL SELECT 'artist', 4.0, n, a FROM s UNION ALL SELECT 'track_number', 0.5, n, k FROM s UNION ALL SELECT 'needs_review', 1.0, n, n FROM s)"""


@query(f"WITH {SCORE_SQL} SELECT field, CAST(weight AS DOUBLE) AS weight, n, equal, round_even(100.0 * equal / n, 3) AS percent FROM f")
def field_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _compared(spark, sf)


@query(f"WITH {SCORE_SQL} SELECT round_even(100.0 * sum(CAST(weight AS DOUBLE) * equal) / sum(CAST(weight AS DOUBLE) * n), 3) AS score FROM f")
def weighted_score(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.weighted_score(_compared(spark, sf))


@query("SELECT c_custkey AS row_id, CASE WHEN c_custkey % 11 = 0 THEN 'new' WHEN c_custkey % 13 = 0 THEN 'source mismatch' WHEN c_custkey % 7 = 0 THEN 'changed' ELSE 'seeded' END AS status FROM customer")
def seeded_rows(spark: SparkSession, sf: str) -> DataFrame:
    now = table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_name").alias("source_path"), F.col("c_mktsegment").alias("title"), F.col("c_acctbal").alias("artist"))
    k = F.col("row_id")
    old = now.where("row_id % 11 <> 0").withColumns({"source_path": F.when(k % 13 == 0, "moved").otherwise(F.col("source_path")), "title": F.when(k % 7 == 0, "was").otherwise(F.col("title"))})
    return manifest.seeded(old, now, ["title", "artist"])


def _link(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf, "part")
    items = part.where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"), F.col("p_type").alias("album"))
    return items, part.where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("artist"), F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 7 == 0, "Extended Mix")).alias("title"), F.col("p_type").alias("album"))


FOLD = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
LINK_SQL = """items AS (SELECT p_partkey AS item_id, p_brand AS artist, p_name AS title FROM part WHERE p_partkey % 10 = 0),
  lib AS (SELECT p_partkey AS key, p_brand AS artist, p_name || CASE WHEN p_partkey % 7 = 0 THEN ' Extended Mix' ELSE '' END AS title FROM part WHERE p_partkey % 10 <> 0),
  it AS (SELECT item_id, unnest(list_distinct(list_filter(string_split(lower(title), ' '), lambda w: length(w) >= 3 AND w NOT IN ('feat', 'featuring', 'the', 'and', 'with')) || ['=' || lower(title)])) AS token FROM items),
  lt AS (SELECT key, unnest(list_distinct(list_filter(string_split(lower(title), ' '), lambda w: length(w) >= 3 AND w NOT IN ('feat', 'featuring', 'the', 'and', 'with')) || ['=' || lower(title)])) AS token FROM lib),
  pairs AS (SELECT item_id, key, count(*) AS shared FROM it JOIN lt USING (token) GROUP BY 1, 2)"""


@query(f"""WITH {LINK_SQL}, b AS (SELECT {FOLD.format("artist")} AS a, {FOLD.format("title")} AS t, count(*) AS n, min(key) AS k FROM lib GROUP BY 1, 2), o AS (SELECT {FOLD.format("title")} AS t, count(*) AS n, min(key) AS k FROM lib GROUP BY 1)
  SELECT item_id, CASE WHEN b.n = 1 THEN b.k WHEN o.n = 1 THEN o.k END AS key, CASE WHEN b.n = 1 THEN 'artist_title' WHEN o.n = 1 THEN 'title' END AS tier, coalesce(b.n, 0) AS same_both, coalesce(o.n, 0) AS same_title
  FROM items i LEFT JOIN b ON b.a = {FOLD.format("i.artist")} AND b.t = {FOLD.format("i.title")} LEFT JOIN o ON o.t = {FOLD.format("i.title")}""")
def exact_link(spark: SparkSession, sf: str) -> DataFrame:
    return link.exact_link(*_link(spark, sf))


@query(f"WITH {LINK_SQL} SELECT * FROM pairs")
def link_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return link.blocked(*_link(spark, sf))


@query(f"""WITH {LINK_SQL}, w AS (SELECT item_id, key, list_distinct(string_split(lower(i.title), ' ')) AS a, list_distinct(string_split(lower(l.title), ' ')) AS b FROM pairs JOIN items i USING (item_id) JOIN lib l USING (key)),
  j AS (SELECT item_id, key, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS score FROM w)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, key) AS candidate_rank FROM j) WHERE candidate_rank <= 5""")
def link_jaccard_topk(spark: SparkSession, sf: str) -> DataFrame:
    return link.best_by_words(*_link(spark, sf))


@query()
def link_ratio_score(spark: SparkSession, sf: str) -> DataFrame:
    return link.best_by_ratio(*_link(spark, sf), cut=cut(spark))


@query()
def link_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return link.confidence(link_ratio_score(spark, sf), _link(spark, sf)[0]).groupBy("confidence").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, (row_number() OVER (ORDER BY conv_id * 1000 + turn) - 1) // 5 AS batch_id FROM conversations")
def batch_ids(spark: SparkSession, sf: str) -> DataFrame:
    cut(spark)  # numbering checkpoints its ranges
    rows = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"))
    return manifest.batches(rows, 5).select("conv_id", "turn", "batch_id")


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS row_id, role = 'assistant' AS done, length(text) < 30 AS odd FROM conversations)
  SELECT row_id FROM t WHERE NOT done OR odd OR row_id % 97 = 0""")
def pending_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").withColumn("row_id", F.col("conv_id") * 1000 + F.col("turn"))
    return manifest.pending(rows, F.col("role") == "assistant", F.lit(False), F.length("text") < 30, rows.where("row_id % 97 = 0")).select("row_id")


@query("SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return manifest.not_yet(c.select("conv_id").distinct(), c.where("role = 'system'"), "conv_id")


@query("SELECT event_type, count(*) AS tracks, count(*) FILTER (trim(event_type) <> '') AS accepted, count(*) FILTER (value > 50) AS reviewed FROM events GROUP BY 1")
def run_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_type", F.col("event_type").alias("title"), F.lit("a").alias("artist"), (F.col("value") > 50).alias("needs_review"))
    return manifest.run_status(rows, "event_type")


@query("SELECT user_id, arg_max(event_type, event_id) AS line, max(event_id) AS at FROM events GROUP BY 1")
def latest_event(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.latest(table(spark, sf, "events"), "user_id", "event_id", "event_type")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 12")
def last_events(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.last_lines(table(spark, sf, "events"), "user_id", "event_id").select("user_id", "event_id")


@query("SELECT 'server ' || user_id % 4 AS endpoint, count(*) AS batches, sum(event_id % 5) AS tracks, sum(value) AS seconds, count(*) FILTER (value < 1) AS failures, avg(value) AS mean_seconds FROM events GROUP BY 1")
def endpoint_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.concat(F.lit("server "), (F.col("user_id") % 4).cast("string")).alias("endpoint"), (F.col("event_id") % 5).alias("tracks"), F.col("value").alias("seconds"), (F.col("value") < 1).alias("failed"))
    return manifest.endpoint_totals(rows)


@query("SELECT event_id AS row_id, CASE WHEN event_id % 40 = 0 THEN 'error' ELSE 'short' END AS kind FROM events WHERE event_id % 40 = 0 OR value < 30")
def short_audio(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("event_id").alias("row_id"), F.col("value").alias("duration"), F.when(F.col("event_id") % 40 == 0, "bad").alias("error"))
    return manifest.short_rows(rows).select("row_id", "kind")


@query("SELECT event_id AS row_id, CAST(ascii(CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'C' END) - 65 AS INT) AS slot, event_type AS label, CAST(greatest(0, round((value - 10) * 1000)) AS BIGINT) AS position_ms FROM events")
def cue_proposals(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("event_id").alias("row_id"), F.when(F.col("user_id") % 2 == 0, "A").otherwise("C").alias("slot"), F.col("event_type").alias("label"), (F.col("value") - 10).alias("seconds"))
    return manifest.cue_rows(rows)


@query("""WITH k AS (SELECT p_partkey AS row_id, lower(p_name) AS key, p_partkey % 2 = 0 AS accepted, lower(p_name) || p_size || '.mp3' AS name FROM part WHERE length(p_name) >= 5),
  a AS (SELECT key, row_id AS other_id, name FROM k WHERE accepted),
  j AS (SELECT k.row_id, other_id, row_number() OVER (PARTITION BY k.row_id ORDER BY other_id) AS rank FROM k JOIN a ON a.key = k.key AND a.name <> k.name)
  SELECT * FROM j WHERE rank <= 5""")
def context_lookup(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("C:\\in\\"), F.col("p_name"), F.col("p_size").cast("string"), F.lit(".mp3"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("title"), name.alias("source_path"), (F.col("p_partkey") % 2 == 0).alias("accepted"))
    return manifest.context(rows)


@query("""WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 503 WHEN 2 THEN 400 WHEN 3 THEN 500 ELSE 200 END AS status,
    CASE user_id % 4 WHEN 0 THEN 'Request EXCEEDS the context size' WHEN 1 THEN 'Loading model' WHEN 2 THEN 'no context given' ELSE event_type END AS details FROM events)
  SELECT event_id AS row_id, CASE WHEN status IS NULL OR status = 503 OR details ILIKE '%loading model%' THEN 'unavailable'
    WHEN status = 400 AND details ILIKE '%exceed%' AND details ILIKE '%context%' THEN 'context' ELSE 'other' END AS kind FROM e""")
def error_kinds(spark: SparkSession, sf: str) -> DataFrame:
    k, u = F.col("event_id") % 5, F.col("user_id") % 4
    status = F.when(k == 1, 503).when(k == 2, 400).when(k == 3, 500).when(k == 4, 200)
    details = F.when(u == 0, "Request EXCEEDS the context size").when(u == 1, "Loading model").when(u == 2, "no context given").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select(F.col("event_id").alias("row_id"), manifest.error_kind(status, details).alias("kind"))


@query("SELECT c_custkey AS row_id, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 40 > 0 THEN c_custkey % 40 END AS number, CASE c_custkey % 4 WHEN 0 THEN '1999' WHEN 1 THEN '1999-13' WHEN 2 THEN '1999-01-02' END AS date, lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(3, length(CAST(c_custkey AS VARCHAR))) AS INT), '0') AS tail FROM customer")
def scalar_values(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, "x").otherwise((k % 40).cast("string"))
    date = F.when(k % 4 == 0, "1999").when(k % 4 == 1, " 1999-13 ").when(k % 4 == 2, "1999-01-02").otherwise("1999/1")
    digits = k.cast("string")
    tail = F.lpad(digits, F.greatest(F.length(digits), F.lit(3)), F.lit("0"))
    return table(spark, sf, "customer").select(k.alias("row_id"), X.positive_integer(raw).alias("number"), X.clean_date(date).alias("date"), tail.alias("tail"))


@query("""WITH p AS (SELECT event_id AS row_id, props FROM events UNION ALL SELECT -1 - click_id, props FROM (SELECT DISTINCT click_id, props FROM clicks WHERE json_valid(props))),
  k AS (SELECT row_id, props, unnest(json_keys(props)) AS key FROM p), v AS (SELECT row_id, key, CASE key WHEN 'items' THEN '[' || array_to_string(list_transform(CAST(json_extract(props, '$.items') AS JSON[]), lambda x: '{"qty":' || (x->>'qty') || ',"sku":' || (x->>'sku') || '}'), ',') || ']' ELSE json_extract_string(props, '$."' || key || '"') END AS value FROM k)
  SELECT row_id, key, value FROM v UNION ALL SELECT row_id, key || '#2', value FROM v WHERE row_id % 3 = 0""")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    """Every key of every object; each third row has its tags twice."""
    rows = dealt(table(spark, sf, "events")).select(F.col("event_id").alias("row_id"), "props")
    clicks = dealt(table(spark, sf, "clicks")).where(F.try_parse_json("props").isNotNull()).select((-1 - F.col("click_id")).alias("row_id"), "props").distinct()
    tags = manifest.tag_rows(rows.unionByName(clicks), "props")
    return manifest.numbered_keys(tags.unionByName(tags.where("row_id % 3 = 0").withColumn("pos", F.col("pos") + 1000)))


@query("""SELECT click_id AS row_id, CASE WHEN json_valid(props) THEN '{' || array_to_string(list_filter([CASE WHEN json_exists(props, '$.device') THEN '"device":' || json_extract(props, '$.device') END,
    CASE WHEN json_exists(props, '$.items') THEN '"items":[' || array_to_string(list_transform(CAST(json_extract(props, '$.items') AS JSON[]), lambda x: '{"qty":' || (x->>'qty') || ',"sku":' || (x->>'sku') || '}'), ',') || ']' END,
    CASE WHEN json_exists(props, '$.k') THEN '"k":' || json_extract(props, '$.k') END, CASE WHEN json_exists(props, '$.tags') THEN '"tags":' || json_extract(props, '$.tags') END], lambda x: x IS NOT NULL), ',') || '}' END AS value FROM clicks
  UNION ALL SELECT -1 - p_partkey, '{"APIC:":' || CASE WHEN p_partkey % 3 = 0 THEN '{"exists":true,"count":2}' ELSE '{"exists":true,"count":1}' END || ',"list":[' || array_to_string(list_transform(range(50), lambda i: i), ',') || ',"[' || 1 + p_partkey % 7 || ' additional values omitted]"],"n":null,"text":"'
    || CASE WHEN length(p_name) * 60 > 500 THEN repeat(p_name, 60)[:500] || '...[truncated ' || length(p_name) * 60 - 500 || ' chars]' ELSE repeat(p_name, 60) END || '","x":' || repeat('{"x":', 12) || CASE WHEN p_partkey % 2 = 0 THEN '{"type":"str","value":"deep"}' ELSE '{"type":"float","value":"2.5"}' END || repeat('}', 13) FROM part""")
def safe_props(spark: SparkSession, sf: str) -> DataFrame:
    """The props of all clicks, and for each part a nested tag with a picture, a long list, a long text and a deep value."""
    clicks = dealt(table(spark, sf, "clicks")).select(F.col("click_id").alias("row_id"), "props")
    made = dealt(table(spark, sf, "part")).selectExpr("-1 - p_partkey as row_id", """concat('{"n": null, "APIC:": ', if(p_partkey % 3 = 0, '[{"a": 1}, "b"]', '{"a": 1}'), ', "text": "', repeat(p_name, 60), '", "list": ', to_json(sequence(0, 50 + p_partkey % 7)),
        ', "x": ', repeat('{"x": ', 12), if(p_partkey % 2 = 0, '"deep"', '2.50'), repeat('}', 13)) as props""")
    return clicks.unionByName(made).select("row_id", evidence.safe_json(evidence.parsed(F.col("props"))).alias("value"))


#: Tags of a part as JSON, in an expression that both engines read.
TAG_JSON = """'{"TIT2": ' || CASE k % 4 WHEN 0 THEN '{"encoding": 3, "text": ["' || name || '"]}' WHEN 1 THEN '["' || name || '", "", "' || brand || '"]' WHEN 2 THEN '{"exists": true, "byteLength": 9}' ELSE '"  ' || name || '  "' END
  || ', "title": "' || name || '", "TPE1": {"text": [["' || brand || '"]]}, "artists": ' || CASE k % 3 WHEN 0 THEN '5' WHEN 1 THEN '"' || brand || '"' ELSE '{"text": [{"binaryBase64": "AA=="}]}' END
  || ', "TDRC": {"year": ' || (1990 + k % 30) || CASE WHEN k % 2 = 0 THEN ', "month": ' || (1 + k % 12) || CASE WHEN k % 5 = 0 THEN ', "day": 7' ELSE '' END ELSE '' END || '}, "TKEY": [8, "' || (k % 12) || 'A"], "TALB": {"text": null, "other": "x"}, "covr": ' || CASE k % 3 WHEN 0 THEN '[1, 2, 3]' WHEN 1 THEN '{}' ELSE '"none"' END
  || ', "TRCK": [["' || (k % 12) || '/12"]], "TCMP": true, "GENRE": ["a", 1.50, null, false], "x": [' || k || ']}'"""


def _tag_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = dealt(table(spark, sf, "part")).selectExpr("p_partkey as k", "p_name as name", "p_brand as brand")
    return rows.selectExpr("k as row_id", f"{TAG_JSON} as tags", "name", "brand", r"'C:\\in\\' || brand || '\\' || name || '.mp3' as source_path")


TAG_SQL = """p AS (SELECT p_partkey AS k, p_name AS name, p_brand AS brand FROM part), v AS (SELECT k, name, brand,
  CASE k % 4 WHEN 0 THEN '"' || name || '"' WHEN 1 THEN '["' || name || '", "' || brand || '"]' WHEN 3 THEN '"' || name || '"' END AS tit2, CASE k % 3 WHEN 0 THEN '5' WHEN 1 THEN '"' || brand || '"' END AS artists,
  '"' || 1990 + k % 30 || CASE WHEN k % 2 = 0 THEN '-' || lpad(CAST(1 + k % 12 AS VARCHAR), 2, '0') || CASE WHEN k % 5 = 0 THEN '-07' ELSE '' END ELSE '' END || '"' AS tdrc FROM p)"""


@query("""SELECT p_partkey AS row_id, CASE p_partkey % 6 WHEN 0 THEN '1999-05' WHEN 1 THEN '2001' WHEN 2 THEN CAST(1990 + p_partkey % 30 AS VARCHAR) || '-07-0' || 1 + p_partkey % 9 WHEN 3 THEN '2010' WHEN 4 THEN NULL ELSE '2020-02-03' END AS date,
  CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey % 12 > 0 THEN CAST(p_partkey % 12 AS INT) END WHEN 1 THEN 7 WHEN 2 THEN 3 END AS number, CASE p_partkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'true' WHEN 3 THEN 'false' END AS flag FROM part""")
def nested_scalars(spark: SparkSession, sf: str) -> DataFrame:
    rows = dealt(table(spark, sf, "part")).selectExpr("p_partkey as k").selectExpr(
        "k as row_id", """case k % 6 when 0 then '["x", {"text": ["on 1999-05 ok"]}]' when 1 then '"2001-01-01"' when 2 then '[{"year": ' || (1990 + k % 30) || ', "month": 7, "day": ' || (1 + k % 9) || '}]' when 3 then '{"year": 2010, "month": 1, "day": 1}' when 4 then '{"year": 3000, "other": "1999"}' else '{"text": {"year": 2020, "month": 2, "day": 3}}' end as d""",
        """case k % 4 when 0 then '"' || (k % 12) || '/12"' when 1 then '[true, {"value": 7.0}]' when 2 then '{"number": [0, "no 3"]}' else '[false, -1, "x"]' end as n""",
        """case k % 5 when 0 then '[" YES "]' when 1 then '{"value": 0}' when 2 then '{"text": [null, 5, true]}' when 3 then '"no"' else '[2, "x"]' end as f""")  # fmt: skip
    return rows.select("row_id", evidence.nested_date(evidence.parsed(F.col("d"))).alias("date"), evidence.nested_integer(evidence.parsed(F.col("n"))).alias("number"), evidence.nested_boolean(evidence.parsed(F.col("f"))).cast("string").alias("flag"))


@query(f"""WITH {TAG_SQL}, u AS (SELECT k, unnest(['GENRE', 'TALB', 'TCMP', 'TDRC', 'TIT2', 'TKEY', 'TPE1', 'TRCK', 'artists', 'covr', 'title', 'x']) AS key,
    unnest(['["a", 1.5, false]', NULL, 'true', tdrc, tit2, '[8, "' || k % 12 || 'A"]', '"' || brand || '"', '"' || k % 12 || '/12"', artists, CASE k % 3 WHEN 0 THEN '[1, 2, 3]' WHEN 2 THEN '"none"' END, '"' || name || '"', CAST(k AS VARCHAR)]) AS value FROM v)
  SELECT k AS row_id, key, value FROM u""")
def tag_values(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.explode(F.map_entries(F.try_variant_get(evidence.parsed(F.col("tags")), "$", "map<string,variant>")))
    rows = _tag_json(spark, sf).select("row_id", tags.alias("e"))
    return rows.select("row_id", F.col("e.key").alias("key"), evidence.concise_value(F.col("e.value")).alias("value"))


EVIDENCE_SQL = (
    TAG_SQL
    + """, f AS (SELECT *, list_filter(['"title": ' || CASE WHEN k % 4 = 1 THEN '["' || name || '", ["' || name || '", "' || brand || '"]]' ELSE '"' || name || '"' END,
    '"artist": ' || CASE k % 3 WHEN 0 THEN '[5, "' || brand || '"]' ELSE '"' || brand || '"' END, '"date": ' || tdrc, '"trackNumber": "' || k % 12 || '/12"', '"genre": ["a", 1.5, false]', '"compilation": true'], lambda x: true) AS parts FROM v),
  b AS (SELECT *, list_max(list_transform(range(1, 7), lambda n: CASE WHEN length('{' || array_to_string(parts[1:n], ', ') || '}') <= 90 THEN n ELSE 0 END)) AS fit FROM f)"""
)


@query(f"""WITH {EVIDENCE_SQL} SELECT k AS row_id, '{{' || array_to_string(parts[1:fit], ', ') || '}}' AS evidence FROM b""")
def evidence_fields(spark: SparkSession, sf: str) -> DataFrame:
    """With a budget of 90 characters, which drops the last fields of many rows."""
    whole = F.concat(F.lit('{"tags": '), "tags", F.lit("}"))
    return _tag_json(spark, sf).select("row_id", evidence.metadata_evidence(evidence.parsed(whole), most=90).alias("evidence"))


@query(f"""WITH {TAG_SQL} SELECT k AS row_id, name AS original_title, brand AS original_artist, '' AS original_album_artist, '' AS original_album, k % 12 || 'A' AS original_key, CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS artwork FROM v""")
def review_evidence(spark: SparkSession, sf: str) -> DataFrame:
    tags = evidence.parsed(F.col("tags"))
    whole = evidence.parsed(F.concat(F.lit('{"tags": '), "tags", F.lit("}")))
    rows = _tag_json(spark, sf).select("row_id", evidence.original_record(whole).alias("original"), evidence.artwork_count(tags).alias("artwork"))
    return rows.select("row_id", *[F.col(f"original.{n}").alias(n) for n in fixed.REVIEW_ALIASES], "artwork")


@query(f"""WITH {EVIDENCE_SQL} SELECT k AS row_id, '{{"id":' || k || ',"source":"in\\\\' || brand || '\\\\' || name || '.mp3","originalMetadata":{{' || array_to_string(parts, ', ') || '}}' || CASE WHEN k % 4 = 0 THEN ',"libraryContext":[{{"title":"' || name || '"}}]' ELSE '' END || CASE WHEN k % 5 = 0 THEN ',"auditFeedback":"say \\"' || brand || '\\""' ELSE '' END || '}}' AS item FROM b""")
def request_payload(spark: SparkSession, sf: str) -> DataFrame:
    rows = _tag_json(spark, sf).withColumns({"metadata": evidence.parsed(F.concat(F.lit('{"tags": '), "tags", F.lit("}"))), "context": F.when(F.col("row_id") % 4 == 0, F.concat(F.lit('[{"title":"'), "name", F.lit('"}]'))), "said": F.when(F.col("row_id") % 5 == 0, F.concat(F.lit('say "'), "brand", F.lit('"')))})
    return evidence.request_items(rows, context="context", feedback="said")


@query("""SELECT p_partkey AS row_id, k AS actionable, k AS conservative FROM (SELECT p_partkey, p_partkey % 4 = 1 AND p_partkey % 8 <> 1 OR p_partkey % 4 = 2 AND p_partkey % 6 <> 2 AND p_partkey % 7 > 0 AS k FROM part)""")
def feedback_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Feedback that keeps, that names an album artist which is there or not, that names the title as it is or another (some rows
    are under review), and that speaks of a genre."""
    k = F.col("row_id")
    rows = dirty(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("name")), "row_id")
    rows = rows.withColumns({"title": F.when(k % 6 == 2, F.col("name")).otherwise(F.col("title")), "album_artist": F.when(k % 8 != 1, "Various"), "needs_review": (k % 7 == 0) & (k % 4 == 2), "evidence": F.lit("source tag Remix"), "compilation": F.lit(False)})
    named = F.concat(F.lit("The title should be '"), "name", F.lit("' because the source tag TIT2 says so."))
    said = F.when(k % 4 == 0, "Keep it.").when(k % 4 == 1, "Remove unsupported albumArtist 'Various'.").when(k % 4 == 2, named).otherwise("The genre should be House.")
    rows = rows.withColumn("feedback", said)
    return rows.select("row_id", review.actionable(F.col("feedback")).alias("actionable"), review.conservative(F.col("feedback")).alias("conservative"))


@query(f"""WITH {DIRTY_SQL} SELECT row_id, regexp_replace(regexp_replace(title, ' \\(Free Download\\)$| \\[320 kbps\\] \\[HQ\\]$| - 128 BPM$|_mp3$| \\( \\) - promo$', ''), '^www.tunes.com ', '') AS title, regexp_replace(artist, ' PROMO$', '') AS artist,
  CASE WHEN row_id % 3 = 1 THEN 'Some Band' END AS album_artist, CASE WHEN row_id % 3 > 0 THEN 'Night Songs' END AS album, CASE WHEN row_id % 4 > 0 THEN '2001-02' END AS date, CASE WHEN row_id % 3 > 0 AND row_id % 5 > 0 THEN CAST(row_id % 5 AS INT) END AS track_number, CAST(NULL AS INT) AS disc_number,
  'House' AS genre, row_id % 3 > 0 AND row_id % 2 = 0 AS compilation, row_id % 11 = 0 AND row_id % 13 > 0 AS needs_review, CASE WHEN row_id % 13 = 0 THEN NULL WHEN row_id % 22 = 0 THEN 'Odd tags.' WHEN row_id % 11 = 0 THEN 'Material metadata ambiguity requires human review.' END AS review_reason,
  row_id % 13 = 0 AS excluded, CASE WHEN row_id % 13 = 0 THEN 'Intentionally excluded by user.' END AS exclusion_reason FROM dirty""")
def clean_fields(spark: SparkSession, sf: str) -> DataFrame:
    k, none = F.col("row_id"), F.lit(None).cast("string")
    out = {"title": F.col("title"), "artist": F.col("artist"), "album_artist": F.when(k % 3 == 1, "  Some   Band "), "album": F.when(k % 3 > 0, "Night Songs.mp3").otherwise("Unknown Album"), "date": F.when(k % 4 > 0, "2001-02").otherwise("2001/02"), "track_number": (k % 5).cast("string"), "disc_number": F.lit("x"), "genre": F.lit("House House"), "compilation": k % 2 == 0, "needs_review": k % 11 == 0, "review_reason": F.when(k % 22 == 0, "Odd tags."), "excluded": k % 13 == 0, "exclusion_reason": none}
    return X.cleaned(dirty(spark, sf).select("row_id", *[c.alias(f) for f, c in out.items()]))


@query(f"WITH {DIRTY_SQL} SELECT 'title' AS field, count(*) AS n FROM dirty WHERE row_id % 6 <> 5")
def field_changes(spark: SparkSession, sf: str) -> DataFrame:
    rows = dirty(spark, sf)
    changes = review.changed_fields(rows, {"title": F.col("title")}, {"title": X.remove_noise(F.col("title"))})
    return review.change_counts(changes).select("field", "n")


@query("SELECT l_orderkey, l_linenumber, p_name AS title FROM (SELECT *, CASE WHEN l_partkey % 9 = 0 THEN -1 ELSE l_partkey END AS k FROM lineitem) LEFT JOIN part ON p_partkey = k")
def track_membership(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 9 == 0, -1).otherwise(F.col("l_partkey")).alias("track_id"))
    return manifest.members(table(spark, sf, "part").select(F.col("p_partkey").alias("track_id"), F.col("p_name").alias("title")), items).drop("track_id")


@query("""SELECT p_partkey AS row_id, CASE WHEN p_partkey % 8 = 0 AND p_partkey % 5 <> 0 AND p_partkey % 17 = 0 THEN 'Fixed' ELSE p_name END AS title,
  p_partkey % 17 = 0 AND NOT (p_partkey % 8 = 0 AND p_partkey % 5 <> 0) AS needs_review FROM part""")
def review_resolutions(spark: SparkSession, sf: str) -> DataFrame:
    rows = tracks(spark, sf).withColumn("source_path", F.concat(F.lit("C:\\in\\"), F.col("row_id").cast("string")))
    said = rows.where("row_id % 8 = 0").select("source_path", F.lit("Fixed").alias("title"), F.lit(None).cast("string").alias("artist"), F.lit(False).alias("needs_review"), F.when(F.col("row_id") % 5 == 0, " ").otherwise("tag").alias("evidence"))
    return review.resolved(rows, said)[0].select("row_id", "title", "needs_review")


@query(f"""WITH {PATHS_SQL} SELECT new_path AS old_path, 'x' AS new_path, CASE WHEN row_id % 3 > 0 THEN row_id END AS location_id, row_id % 3 = 0 AS missing FROM paths
  WHERE new_path IS NOT NULL AND row_id IN (SELECT min(row_id) FROM paths GROUP BY lower(new_path))""")
def rename_locations(spark: SparkSession, sf: str) -> DataFrame:
    rows = plan.with_paths(tracks(spark, sf), ROOT).where("new_path is not null")
    rows = rows.join(rows.groupBy(X.path_key(F.col("new_path"))).agg(F.min("row_id").alias("row_id")).select("row_id"), "row_id", "left_semi")
    coded = F.concat(F.lit("file:///"), F.replace(F.replace(F.col("new_path"), F.lit(" "), F.lit("%20")), F.lit("#"), F.lit("%23")))
    there = rows.where("row_id % 3 > 0").select(F.col("row_id").alias("location_id"), F.when(F.col("row_id") % 3 == 1, F.col("new_path")).otherwise(coded).alias("location"))
    return link.located(rows.select(F.col("new_path").alias("old_path"), F.lit("x").alias("new_path")), there)


@query("""WITH r AS (SELECT p_partkey AS k, 'D:/in/' || CASE WHEN p_partkey % 9 = 0 THEN 'Same' || p_partkey // 100 ELSE CAST(p_partkey AS VARCHAR) END || '.mp3' AS old, 'D:/out/' || CASE WHEN p_partkey % 7 = 0 THEN 'One' || p_partkey // 70 ELSE CAST(p_partkey AS VARCHAR) END || '.mp3' AS new FROM part),
  f AS (SELECT DISTINCT lower(old) AS key FROM r WHERE k % 5 > 0 UNION SELECT lower(new) FROM r WHERE k % 11 = 0), l AS (SELECT DISTINCT lower(old) AS key FROM r WHERE k % 6 > 0)
  SELECT min(old) AS path, 'source repeated' AS rule FROM r GROUP BY lower(old) HAVING count(*) > 1 UNION ALL SELECT min(new), 'destination repeated' FROM r GROUP BY lower(new) HAVING count(*) > 1
  UNION ALL SELECT old, 'source missing' FROM r WHERE lower(old) NOT IN (SELECT key FROM f) UNION ALL SELECT new, 'destination exists' FROM r WHERE lower(new) IN (SELECT key FROM f)
  UNION ALL SELECT DISTINCT old, 'no stored location' FROM r WHERE lower(old) NOT IN (SELECT key FROM l)""")
def rename_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").selectExpr("p_partkey as k", "concat('D:/in/', if(p_partkey % 9 = 0, concat('Same', p_partkey div 100), string(p_partkey)), '.mp3') as old_path", "concat('D:/out/', if(p_partkey % 7 = 0, concat('One', p_partkey div 70), string(p_partkey)), '.mp3') as new_path")
    files = rows.where("k % 5 > 0").selectExpr("upper(old_path) as path").unionByName(rows.where("k % 11 = 0").selectExpr("new_path as path"))
    places = rows.where("k % 6 > 0").groupBy("old_path").agg(F.min("k").alias("location_id")).select("location_id", F.col("old_path").alias("location"))
    return link.rename_violations(rows, files, places)


@query("""SELECT CASE WHEN c_custkey % 10 = 0 THEN upper(c_name) ELSE c_name END AS name, 'name exists' AS rule FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT min(c_name), 'name repeated' FROM (SELECT c_name FROM customer UNION ALL SELECT upper(c_name) FROM customer WHERE c_custkey % 10 = 0) GROUP BY lower(c_name) HAVING count(*) > 1""")
def playlist_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"))
    asked = rows.select("name").unionByName(rows.where("c_custkey % 10 = 0").select(F.upper("name").alias("name")))
    return link.name_violations(asked, rows.where("c_custkey % 4 = 0").select(F.lower("name").alias("name")))


@query("""SELECT o_orderkey AS track_no, CASE WHEN o_orderkey % 6 > 0 THEN o_custkey END AS media_key, o_orderkey % 6 = 0 AS missing FROM orders""")
def playlist_choice(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.lit("p").alias("plan"), F.col("o_orderstatus").alias("playlist"), F.col("o_orderkey").alias("track_no"), F.col("o_custkey").alias("key"), F.lit(1).alias("candidate_rank"))
    return link.chosen(rows.drop("key", "candidate_rank"), rows.where("track_no % 6 > 0")).select("track_no", "media_key", "missing")


@query("SELECT p_partkey AS row_id, p_partkey % 2 = 0 AS kept FROM part")
def audit_sanitised(spark: SparkSession, sf: str) -> DataFrame:
    rows = dirty(spark, sf).withColumns({"album_artist": F.lit(None).cast("string"), "needs_review": F.lit(False), "evidence": F.lit(""), "title": F.lit("Song (Remix)")})
    said = F.when(F.col("row_id") % 2 == 0, "The title is junk: source tag TIT2 reads 'Other Song'.").otherwise("Remove the Remix from the title, source tag TIT2.")
    return rows.select("row_id", review.conservative(said).alias("kept"))


@query("""SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'left' WHEN a.id IS NULL THEN 'right' ELSE 'both' END AS part
  FROM (SELECT DISTINCT o_custkey AS id FROM orders) a FULL JOIN (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey % 3 > 0) b ON a.id = b.id""")
def set_algebra(spark: SparkSession, sf: str) -> DataFrame:
    orders, customers = table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return manifest.set_parts(orders, customers.where("id % 3 > 0"), "id")


def _review_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = _planned(spark, sf).withColumns({"title": F.when(F.col("row_id") % 3 == 0, F.initcap("title")).otherwise(F.col("title")), "review_reason": F.when(F.col("needs_review"), "unsure")})
    return review.review_items(rows, cut(spark))


ITEMS_SQL = (
    PATHS_SQL
    + """, items AS (SELECT *, CASE WHEN NOT needs_review AND NOT is_winner THEN 'duplicate' WHEN needs_review OR row_id % 3 > 0 OR album = 'PROMO' THEN 'review' END AS status,
    array_to_string(list_filter([CASE WHEN needs_review THEN 'needs review' END, CASE WHEN album = 'PROMO' THEN 'album contains workflow or promo text' END, CASE WHEN row_id % 3 > 0 THEN 'title casing' END], lambda x: x IS NOT NULL), '; ') AS reasons, CASE WHEN needs_review THEN 'High' WHEN album = 'PROMO' THEN 'Medium' ELSE 'Low' END AS priority FROM winners WHERE NOT excluded)"""
)


@query(f"""WITH {ITEMS_SQL} SELECT priority, reasons, 'Pending' AS review_decision, '' AS review_notes, source_path, CASE WHEN is_winner THEN coalesce(new_path, '') ELSE '' END AS planned_path,
  CASE WHEN row_id % 3 = 0 THEN array_to_string(list_transform(string_split(title, ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE title END AS title, artist, '' AS album_artist, coalesce(album, '') AS album, '' AS date, CAST(track_number AS VARCHAR) AS track_number, CAST(disc_number AS VARCHAR) AS disc_number,
  '' AS genre, CASE WHEN compilation THEN 'true' ELSE 'false' END AS compilation, CASE WHEN needs_review THEN 'true' ELSE 'false' END AS needs_review, CASE WHEN needs_review THEN 'unsure' ELSE '' END AS review_reason FROM items WHERE status = 'review'""")
def review_table(spark: SparkSession, sf: str) -> DataFrame:
    return review.review_table(_review_items(spark, sf))


@query(f"WITH {ITEMS_SQL} SELECT CASE WHEN status = 'duplicate' THEN 'excluded duplicate' ELSE priority END AS name, count(*) AS n FROM items WHERE status IS NOT NULL GROUP BY 1")
def review_totals(spark: SparkSession, sf: str) -> DataFrame:
    return review.review_totals(_review_items(spark, sf))


@query("""WITH f AS (SELECT CASE WHEN l_partkey % 31 = 0 THEN -1 - l_partkey WHEN l_partkey % 37 = 0 THEN NULL ELSE l_partkey END AS id, CASE WHEN l_partkey % 5 = 0 THEN ' ' ELSE 'say ' || l_partkey END AS feedback FROM lineitem WHERE l_linenumber % 7 = 1 AND l_returnflag = 'A'),
  g AS (SELECT id, count(*) AS k, min(feedback) AS feedback FROM f GROUP BY 1)
  SELECT g.id, CASE WHEN rule IS NULL THEN 'c:/in/' || p_partkey || '.mp3' END AS key, feedback, rule FROM (SELECT g.*, p_partkey, CASE WHEN p_partkey IS NULL THEN 'track id out of range' WHEN k > 1 THEN 'track id repeated' WHEN p_partkey % 11 = 0 THEN 'no source path' WHEN trim(feedback) = '' THEN 'no feedback' END AS rule FROM g LEFT JOIN part ON p_partkey = g.id) g""")
def retained_feedback(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_partkey")
    said = table(spark, sf, "lineitem").select(F.when(k % 31 == 0, -1 - k).when(k % 37 == 0, F.lit(None)).otherwise(k).alias("id"), ((F.col("l_linenumber") % 7 == 1) & (F.col("l_returnflag") == "A")).alias("needs_revision"), F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("say "), k.cast("string"))).alias("feedback"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.concat(F.lit("C:\\in\\"), F.col("p_partkey").cast("string"), F.lit(".mp3"))).alias("source_path"))
    return review.retained(said, rows)


@query("""WITH t AS (SELECT p_partkey AS k FROM part) SELECT 'D:/library/' || k || '.x' AS path, rule, detail FROM (
  SELECT k, 'foreign tag' AS rule, unnest(CASE WHEN k % 3 = 0 AND k % 4 = 0 THEN ['TXXX', 'PRIV'] WHEN k % 3 = 1 AND k % 4 = 0 THEN ['----:com'] ELSE [] END) AS detail FROM t
  UNION ALL SELECT k, 'tag missing', CASE WHEN k % 3 = 0 THEN 'TALB' ELSE '©alb' END FROM t WHERE k % 3 < 2 AND k % 5 = 0
  UNION ALL SELECT k, 'tag missing', CASE WHEN k % 3 = 0 THEN 'TCMP' ELSE 'cpil' END FROM t WHERE k % 3 < 2 AND k % 7 = 0
  UNION ALL SELECT k, 'format not supported', 'vorbis' FROM t WHERE k % 3 = 2 UNION ALL SELECT k, 'other tag remains', 'APEv2' FROM t WHERE k % 13 = 0)""")
def tag_violations(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "part").selectExpr("p_partkey as k", "p_name as title", "p_brand as artist", "p_type as album").selectExpr(
        "concat('D:/library/', k, '.x') as path", "case k % 3 when 0 then 'ID3' when 1 then 'mp4' else 'vorbis' end as format", "title", "artist", "if(k % 5 = 0 or k % 2 = 0, album, null) as album", "k % 7 = 0 as compilation", "cast(null as int) as track_number",
        "case k % 3 when 0 then concat(array('TIT2', 'TPE1', 'APIC:front'), if(k % 5 > 0, array('TALB'), array()), if(k % 4 = 0, array('TXXX:a', 'PRIV:x', 'TXXX:b'), array())) else concat(array('©nam', '©ART', 'covr'), if(k % 5 > 0, array('©alb'), array()), if(k % 4 = 0, array('----:com'), array())) end as tags",
        "if(k % 13 = 0, array('APEv2', 'APEv2'), null) as trailers")
    return prepare.tag_violations(files)


def _tagged(spark: SparkSession, sf: str, **columns: str) -> DataFrame:
    """part as rows of a manifest with their tags; columns are expressions over k, name and brand, the others null."""
    texts = ["title", "artist", "album_artist", "album", "date", "genre", "review_reason", "exclusion_reason", "source_path", *(f"s_{x}" for x in ("title", "artist", "key", "album", "album_artist", "genre", "track", "disc", "date", "compilation"))]
    kinds = {**dict.fromkeys(texts, "string"), **dict.fromkeys(["track_number", "disc_number"], "int"), **dict.fromkeys(["compilation", "needs_review", "excluded"], "boolean")}
    rows = dealt(table(spark, sf, "part")).selectExpr("p_partkey as k", "p_name as name", "p_brand as brand")
    return rows.selectExpr("k as row_id", *[f"cast({columns.get(c, 'false' if kind == 'boolean' else 'null')} as {kind}) as {c}" for c, kind in kinds.items()])


PART_SQL = "p AS (SELECT p_partkey AS k, p_name AS name, p_brand AS brand FROM part)"


@query(f"""WITH {PART_SQL} SELECT k AS row_id, CASE k % 5 WHEN 0 THEN name WHEN 1 THEN name || ' (Club Mix)' WHEN 2 THEN 'Песня' WHEN 3 THEN 'Radio' ELSE '8A' END AS title,
  CASE WHEN k % 5 = 2 THEN 'Певец' ELSE brand END AS artist, k % 5 <> 0 AS needs_review FROM p""")
def misplaced_titles(spark: SparkSession, sf: str) -> DataFrame:
    rows = _tagged(spark, sf, title="case k % 5 when 0 then '8A' when 1 then 'x' when 2 then 'Песня' when 3 then 'Radio' else '8A' end", artist="case when k % 5 = 2 then 'Певец' else brand end", needs_review="true", source_path="'C:/in/' || name || '.mp3'",
                   s_title="case k % 5 when 0 then name || ' - 8A' when 1 then '(Club Mix)' when 2 then 'Другая' when 3 then '(Dub)' else name end", s_artist="case k % 5 when 1 then brand || ' - ' || name when 2 then 'Певец - Другая' when 3 then 'Other - ' || name else brand end")
    return review.split_misplaced(rows, "s_artist", "s_title", "s_key").select("row_id", "title", "artist", "needs_review")


@query(f"""WITH {PART_SQL} SELECT k AS row_id, CASE k % 6 WHEN 0 THEN name || ' (Live)' WHEN 1 THEN name || ' (Dub Mix)' WHEN 2 THEN 'Песня' WHEN 3 THEN name || ' (Remix)' WHEN 4 THEN 'Песня (Remix)' ELSE name || ' (Demo)' END AS title FROM p""")
def context_titles(spark: SparkSession, sf: str) -> DataFrame:
    rows = _tagged(spark, sf, title="case k % 6 when 2 then 'Песня' when 3 then name || ' (Remix)' when 4 then 'Песня' else name end", artist="'Band'", source_path="'C:/in/Folder/' || case when k % 6 = 5 then name || ' (Demo)' else 'file' end || '.mp3'",
                   s_title="case k % 6 when 0 then name || ' (Live)' when 2 then 'Другая (Remix)' when 3 then name || ' (Live)' when 4 then 'Песня (Remix)' else name end", s_album="case when k % 6 = 1 then name || ' (Dub Mix)' else 'An Album' end")
    return review.keep_context(rows, ["s_title", "s_album"]).select("row_id", "title")


@query(f"WITH {PART_SQL} SELECT k AS row_id, CASE WHEN k % 4 = 0 THEN CAST(k AS VARCHAR) ELSE 'Other' END AS artist FROM p")
def numeric_artists(spark: SparkSession, sf: str) -> DataFrame:
    rows = _tagged(spark, sf, artist="'Other'", s_artist="case when k % 4 = 3 then 'a' || k else string(k) end", source_path="'C:/in/' || case when k % 4 = 1 then 'x' else '' end || k || '/Album/' || k || case when k % 4 = 2 then '4' else '' end || ' - ' || name || '.mp3'")
    return review.keep_numeric_artist(rows, "s_artist").select("row_id", "artist")


@query(f"""WITH {PART_SQL} SELECT k AS row_id, CASE WHEN k % 4 < 2 THEN name || CASE k % 4 WHEN 0 THEN ' (karaoke)' ELSE ' (Originally Performed by Someone)' END ELSE name END AS title,
  CASE WHEN k % 4 < 2 THEN 'Cover Band' ELSE 'Original' END AS artist, k % 4 < 2 AS needs_review FROM p""")
def cover_performers(spark: SparkSession, sf: str) -> DataFrame:
    rows = _tagged(spark, sf, title="name", artist="'Original'", source_path="'C:/in/' || case when k % 4 = 3 then 'karaoke ' else 'Cover Band - ' end || name || case k % 4 when 0 then ' (karaoke)' when 1 then ' (Originally Performed by Someone)' else '' end || '.mp3'")
    return review.cover_performer(rows).select("row_id", "title", "artist", "needs_review")


GROUNDED = {"title": "name", "artist": "brand", "needs_review": "k % 9 = 0", "album": "case k % 5 when 0 then null when 1 then 'Night Songs' when 2 then 'Something Else' else 'Night Song' end", "compilation": "k % 7 = 0", "date": "case when k % 2 = 0 then '1990' end",
            "track_number": "case when k % 4 > 0 then 1 end", "s_album": "case when k % 5 = 3 then null else 'Night Song' end", "s_album_artist": "case when k % 3 > 0 then brand end", "s_track": "(k % 12) || '/12'", "s_disc": "'x'", "s_date": "'2001-01-01'", "s_genre": "'House House'", "s_compilation": "case when k % 11 = 0 then 'Yes' end"}
GROUND_SQL = (
    PART_SQL
    + """, a AS (SELECT *, CASE WHEN k % 5 = 3 OR (k % 9 = 0 AND k % 5 = 0) THEN NULL WHEN k % 5 = 1 THEN 'Night Songs' ELSE 'Night Song' END AS album FROM p),
  g AS (SELECT k, name, brand, album, album IS NOT NULL AND (k % 7 = 0 OR k % 11 = 0) AS compilation FROM a),
  f AS (SELECT *, CASE WHEN compilation THEN 'Various Artists' WHEN album IS NOT NULL AND k % 3 > 0 THEN brand END AS album_artist,
    CASE WHEN album IS NOT NULL AND NOT (k % 9 = 0 AND k % 4 = 0) AND k % 12 > 0 THEN CAST(k % 12 AS INT) END AS track_number,
    CASE WHEN NOT (k % 9 = 0 AND k % 2 = 1) THEN '2001' END AS date, CASE WHEN k % 9 <> 0 THEN 'House' END AS genre FROM g)"""
)


@query(f"WITH {GROUND_SQL} SELECT k AS row_id, album, compilation, album_artist, track_number, CAST(NULL AS INT) AS disc_number, date, genre FROM f")
def grounded_fields(spark: SparkSession, sf: str) -> DataFrame:
    return review.ground(_tagged(spark, sf, **GROUNDED)).select("row_id", "album", "compilation", "album_artist", "track_number", "disc_number", "date", "genre")


@query(f"""WITH {GROUND_SQL}, h AS (SELECT * REPLACE (album IS NOT NULL AND (k % 7 = 0 AND k % 5 <> 0 OR k % 11 = 0) AS compilation) FROM f),
  w AS (SELECT * REPLACE (compilation OR album IS NOT NULL AND k % 3 > 0 AS album_artist), CASE k % 5 WHEN 1 THEN 'Night Songs' WHEN 2 THEN 'Something Else' WHEN 0 THEN NULL ELSE 'Night Song' END AS w_album, k % 7 = 0 AS w_comp,
    CASE WHEN k % 2 = 0 THEN '1990' END AS w_date, CASE WHEN k % 4 > 0 THEN 1 END AS w_track FROM h),
  r AS (SELECT k, array_to_string(list_filter([CASE WHEN album_artist THEN 'albumArtist' END, CASE WHEN w_album IS DISTINCT FROM album THEN 'album' END, CASE WHEN w_date IS DISTINCT FROM date THEN 'date' END,
    CASE WHEN w_track IS DISTINCT FROM track_number THEN 'trackNumber' END, CASE WHEN genre IS NOT NULL THEN 'genre' END,
    CASE WHEN w_comp <> compilation THEN 'compilation' END, CASE WHEN k % 9 = 0 THEN 'reviewReason' END, 'title casing'], lambda x: x IS NOT NULL), '; ') AS reasons FROM w)
  SELECT k AS row_id, reasons FROM r WHERE reasons <> ''""")
def suspicious_outputs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _tagged(spark, sf, **(GROUNDED | {"title": "'some words here'", "source_path": "'C:/in/' || name || '.mp3'", "s_title": "'some words here'", "s_artist": "brand"}))
    return review.suspicious(rows, cut=cut(spark)).select("row_id", F.array_join("reasons", "; ").alias("reasons"))


def _entries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """An entry for each order, and an inventory in which sources and destinations are missing, changed or there."""
    k = F.col("row_id")
    path = lambda root: F.concat(F.lit(root), k.cast("string"), F.lit(".mp3"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("artist"))
    entries = rows.withColumns({"source_path": path("C:/in/"), "new_path": path("D:/library/"), "expected_artwork": (k % 3).cast("int")})
    pictures = lambda n: F.transform(F.sequence(F.lit(0), n), lambda x: x.cast("string"))
    there = F.slice(pictures(k % 3), 1, (k % 3).cast("int"))
    sources = entries.where("row_id % 7 <> 0").select(F.upper("source_path").alias("path"), (k % 100).alias("size"), F.when(k % 11 == 0, pictures(F.lit(5))).otherwise(there).alias("artwork"), F.lit("old").alias("title"), F.lit("old").alias("artist"))
    made = entries.where("row_id % 5 = 0").select(F.col("new_path").alias("path"), F.lit(1).cast("long").alias("size"), F.when(k % 13 == 0, pictures(F.lit(7))).otherwise(there).alias("artwork"), F.when(k % 17 == 0, "old").otherwise(F.col("title")).alias("title"), "artist")
    return entries, sources.unionByName(made)


@query("""SELECT row_id, rule, CASE WHEN rule LIKE 'source%' THEN 'C:/in/' || row_id || '.mp3' ELSE 'D:/library/' || row_id || '.mp3' END AS detail FROM (SELECT o_orderkey AS row_id,
  CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0 THEN 'source missing' WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0 THEN 'source artwork changed'
  WHEN o_orderkey % 5 = 0 AND o_orderkey % 17 = 0 THEN 'destination tags differ' WHEN o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 13 = 0 THEN 'destination artwork differs' END AS rule FROM orders) WHERE rule IS NOT NULL""")
def preflight_violations(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.preflight_violations(*_entries(spark, sf), resume=True)


@query("SELECT CAST(sum(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 100 END) AS BIGINT) AS source_bytes, count(*) FILTER (o_orderkey % 5 = 0) AS existing_destinations FROM orders")
def preflight_totals(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.preflight_totals(*_entries(spark, sf))


@query("""SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 5 = 0 THEN 'resumed' WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'moved' END AS status, o_orderkey % 7 <> 0 AS deletes_source FROM orders""")
def entry_actions(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.actions(*_entries(spark, sf), "move").select("row_id", "status", "deletes_source")


@query("""SELECT row_id, rule FROM (SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 19 = 0 THEN 'no winner' WHEN o_orderkey % 23 = 0 THEN 'winner outside root' WHEN o_orderkey % 7 = 0 AND o_orderkey % 2 = 1 THEN 'source missing'
  WHEN o_orderkey % 5 <> 0 THEN 'winner missing' WHEN o_orderkey % 17 = 0 THEN 'winner tags differ' END AS rule FROM orders) WHERE rule IS NOT NULL""")
def cleanup_violations(spark: SparkSession, sf: str) -> DataFrame:
    entries, files = _entries(spark, sf)
    k = F.col("row_id")
    losers = entries.withColumn("destination", F.when(k % 19 == 0, F.lit(None)).when(k % 23 == 0, F.concat(F.lit("E:/"), k.cast("string"))).otherwise(F.col("new_path")))
    return prepare.cleanup_violations(losers, files, entries.where("row_id % 2 = 0").select("source_path"), "C:/in", ROOT).select("row_id", "rule")


@query("""SELECT count(*) FILTER (l_linenumber % 2 = 1) AS input_flagged, count(*) FILTER (l_linenumber % 2 = 1 AND l_returnflag = 'A') AS retained_flagged,
  count(*) FILTER (l_linenumber % 2 = 1 AND l_returnflag <> 'A') AS rejected_count FROM lineitem""")
def sanitisation_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_linenumber") % 2 == 1).alias("needs_revision"), F.lit("said").alias("feedback"))
    return review.sanitisation_summary(review.sanitised(rows, F.col("l_returnflag") == "A"))
