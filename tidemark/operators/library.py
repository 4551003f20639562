"""The identity index: incremental refresh with drift, identity groups, collisions with planned rows, linked bundles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import plan
from .folds import Joined, fold_sorted, join_facts

DAY_NS = 86_400_000_000_000
READ = ["artist", "title", "error"]


def verify_reason(force: bool, last_ns: int | None, now_ns: int, days: int = 7) -> str | None:
    """Why a refresh must read every file again, if it must."""
    if force:
        return "forced"
    if last_ns is None:
        return "new index"
    return "age" if now_ns - last_ns >= days * DAY_NS else None


def refresh(index: DataFrame, inventory: DataFrame, read: DataFrame, trigger: str | None = None) -> DataFrame:
    """The next snapshot with a status for each path: reused, reindexed, drifted or removed.

    index(path, size, mtime_ns, artist, title, error); inventory(path, size, mtime_ns); read(path, artist, title,
    error): what the files say now. Unchanged files are reused unless a trigger asks for all to be read."""
    key = X.path_key(F.col("path")).alias("key")
    old = index.select(key, *[F.col(c).alias(f"o_{c}") for c in ["path", "size", "mtime_ns", *READ]])
    new = inventory.select(key, "path", "size", "mtime_ns").join(read.select(key, *[F.col(c).alias(f"r_{c}") for c in READ]), "key", "left")
    both = old.join(new, "key", "full_outer")
    same = (F.col("o_size") == F.col("size")) & (F.col("o_mtime_ns") == F.col("mtime_ns"))
    changed = F.lit(False)
    for c in READ:
        changed = changed | ~F.col(f"o_{c}").eqNullSafe(F.col(f"r_{c}"))
    same = F.coalesce(same, F.lit(False))
    status = F.when(F.col("path").isNull(), "removed")
    status = status.when(same & changed, "drifted").when(F.lit(True), "reindexed") if trigger else status.when(same, "reused").otherwise("reindexed")
    out = both.withColumn("status", status)
    fresh = F.col("status").isin("reindexed", "drifted")
    kept = {c: F.when(fresh, F.col(f"r_{c}")).otherwise(F.col(f"o_{c}")) for c in READ}
    return out.select("key", F.coalesce("path", "o_path").alias("path"), F.coalesce("size", "o_size").alias("size"), *[v.alias(c) for c, v in kept.items()], X.normalize_identity(kept["artist"]).alias("normalized_artist"), X.normalize_identity(kept["title"]).alias("normalized_title"), "status")


def refresh_stats(refreshed: DataFrame) -> DataFrame:
    """Counts of a refresh; unreadable counts the whole table, drifted rows are also reindexed."""
    s = F.col("status")
    return refreshed.agg(F.count_if(s != "removed").alias("scanned"), F.count_if(s == "reused").alias("reused"), F.count_if(s.isin("reindexed", "drifted")).alias("reindexed"), F.count_if(s == "removed").alias("removed"), F.count_if((s != "removed") & F.col("error").isNotNull()).alias("unreadable"), F.count_if(s == "drifted").alias("drifted"))


def root_violations(meta: DataFrame, version: str, root: str) -> DataFrame:
    """Metadata rows (key, value) that do not fit this engine or library; roots are compared by case folding."""
    other = (F.col("key") == "schema_version") & (F.col("value") != F.lit(version))
    return meta.where(other | ((F.col("key") == "library_root") & (X.folded_case(F.col("value")) != X.folded_case(F.lit(root)))))


def identity_groups(index: DataFrame) -> DataFrame:
    """(normalized_artist, normalized_title) with their paths in path order; blank identities are left out."""
    some = index.where("normalized_artist <> '' and normalized_title <> ''")
    folded = fold_sorted(some, ["normalized_artist", "normalized_title"], F.col("path"), [X.path_key(F.col("path")), F.col("path")], Joined)
    return folded.withColumnRenamed("joined", "paths")


def collisions(planned: DataFrame, index: DataFrame) -> DataFrame:
    """Planned rows whose identity, or else whose destination with the same release, is in the library already."""
    groups = identity_groups(index).withColumnRenamed("paths", "identity_paths").drop("n")
    rows = planned.where(plan.has_text(F.col("new_path"))).withColumns({"normalized_artist": X.normalize_identity(F.col("artist")), "normalized_title": X.normalize_identity(F.col("title")), "key": X.path_key(F.col("new_path"))})
    rows = rows.join(groups, ["normalized_artist", "normalized_title"], "left")
    file = F.struct(F.col("path").alias("there"), F.col("artist").alias("t_artist"), F.col("title").alias("t_title"), F.col("error").alias("t_error"))
    there = index.groupBy("key").agg(F.min_by(file, "path").alias("file")).select("key", "file.*")  # several rows may name one file
    rows = rows.join(there, "key", "left")
    (pa, pt), (ta, tt) = X.canonical_release(F.col("artist"), F.col("title")), X.canonical_release(F.col("t_artist"), F.col("t_title"))
    same = F.col("there").isNotNull() & F.col("t_error").isNull() & (pa != "") & (pt != "") & (pa == ta) & (pt == tt)
    existing = F.coalesce("identity_paths", F.when(same, F.col("there")))
    out = rows.select("row_id", "source_path", "new_path", "artist", "title", F.col("there").isNotNull().alias("destination_exists"), existing.alias("existing"))
    return out.where("destination_exists or existing is not null").withColumn("recommendation", F.when(F.col("existing").isNotNull(), "skip_existing").otherwise("resolve_collision"))


#: Links that are left are followed in one task when they are no more than this.
FEW_LINKS = 200_000


def _followed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, to) of a bounded number of links(x, y): to is the least id that id hangs together with."""
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while up.setdefault(i, i) != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for part in parts:
        for x, y in zip(part["x"].tolist(), part["y"].tolist(), strict=True):
            a, b = root(x), root(y)
            up[max(a, b)] = min(a, b)
    yield pd.DataFrame({"id": list(up), "to": [root(i) for i in up]}, dtype="int64")


def linked_rows(rows: DataFrame, materialise: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(row_id, component) of active rows of several plans that share a destination or a whole identity.

    Rows hang on the least row of each key (a star, not all pairs); stars are contracted: each step every component
    joins the least one that it meets, by a fresh pseudo-random order, so chains shrink by a constant share. Each
    step is cut by a checkpoint. FEW_LINKS links or less are followed to their ends in one task. Keys of any size
    pass: the largest are joined where their rows lie."""
    cut = materialise or (lambda df: df.checkpoint())
    active = cut(rows.where(plan.has_text(F.col("new_path"))).select("row_id", X.path_key(F.col("new_path")).alias("d"), X.normalize_identity(F.col("artist")).alias("a"), X.normalize_identity(F.col("title")).alias("t")))

    def star(rows: DataFrame, *key: str) -> DataFrame:
        least = rows.groupBy(*key).agg(F.min("row_id").alias("other"), F.count("*").alias("n")).where("n > 1")
        return join_facts(rows.select("row_id", *key), least, list(key), "n").select("row_id", "other")

    links = cut(star(active, "d").unionByName(star(active.where("a <> '' and t <> ''"), "a", "t")).where("row_id <> other").select(F.col("row_id").alias("x"), F.col("other").alias("y")).distinct())
    labels, step = active.select("row_id", F.col("row_id").alias("at")), 0
    while n := links.count():
        step += 1
        if n <= FEW_LINKS:
            to = cut(links.coalesce(1).mapInPandas(_followed, "id long, to long"))
            labels = labels.join(to.withColumnRenamed("id", "at"), "at", "left").select("row_id", F.coalesce("to", "at").alias("at"))
            break
        order = lambda c, step=step: F.struct(F.xxhash64(c, F.lit(step)), F.col(c).alias("id"))
        near = links.union(links.select("y", "x")).groupBy("x").agg(F.min(order("y")).alias("least"), F.count("*").alias("n"))
        to = cut(near.select(F.col("x").alias("id"), F.least("least", order("x"))["id"].alias("to"), "n"))
        moved = join_facts(links, to.withColumnRenamed("id", "x"), ["x"], "n").select(F.col("to").alias("x"), "y")
        moved = join_facts(moved, to.withColumnRenamed("id", "y"), ["y"], "n").select("x", F.col("to").alias("y"))
        links = cut(moved.where("x <> y").distinct())
        labels = cut(labels.join(to.select(F.col("id").alias("at"), "to"), "at", "left").select("row_id", F.coalesce("to", "at").alias("at")))
    least = labels.groupBy("at").agg(F.min("row_id").alias("component"), F.count("*").alias("n"))
    return join_facts(labels, least, ["at"], "n").select("row_id", "component")


def bundle(rows: DataFrame, components: DataFrame) -> DataFrame:
    """Each row of a component of several with the winner by the plan's preference, and why it yields to it.

    The reason compares with the winner only: a row linked through others may have an empty one."""
    joined = rows.join(components, "row_id")
    facts = ["row_id", "source_path", "new_path", "artist", "title"]
    best = F.min_by(F.struct(*facts), plan.preferred()).alias("best")
    kept = joined.groupBy("component").agg(best, F.count("*").alias("n")).where("n > 1").select("component", *[F.col(f"best.{c}").alias(f"kept_{c}") for c in facts])
    rest = joined.join(kept, "component").where("row_id <> kept_row_id")
    identity = lambda p: F.struct(X.normalize_identity(F.col(f"{p}artist")), X.normalize_identity(F.col(f"{p}title")))
    reason = F.array_join(F.array_compact(F.array(F.when(X.path_key(F.col("new_path")) == X.path_key(F.col("kept_new_path")), F.lit("same_destination")), F.when(identity("") == identity("kept_"), F.lit("same_identity")))), "+")
    return rest.select("component", "plan_id", "row_id", F.col("new_path").alias("skipped_destination"), "kept_row_id", F.col("kept_new_path").alias("kept_destination"), reason.alias("reason"))


def verdict(skips: DataFrame) -> DataFrame:
    """One row: how many active duplicates the plans still have across one another, and whether they pass."""
    return skips.agg(F.count("*").alias("duplicates")).withColumn("passed", F.col("duplicates") == 0)
