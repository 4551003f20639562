"""Jaccard join of shingle sets by T-occurrence search (DivideSkip), and its connected components.

Two documents link when percent * |union| <= 100 * |intersection|. Sets are 64-bit hashes of `size` words in a row.

1. Documents with equal sets form a class; only its smallest doc_id goes on.
2. Inverted lists. A list for every shingle would make documents meet by chance, and the more documents, the more
   often. So a set is dealt by hash to m segments, and a list's key is a whole segment. m follows from the size class
   (:func:`schemes`): a linked pair differs in at most d shingles, hence in at most d segments. A document of a smaller
   class posts in the next one too, if a partner can be there. In a global order that puts nearly empty segments last,
   each document posts its first d + t segments; a linked pair then shares at least t of these.
3. Postings are shuffled by key. The shuffle's sorted runs are heap-merged, so every list streams by once, and lists
   of one document vanish. Pairs of the short lists (up to LONG) are counted; longer lists are set aside.
   A segment that is frequent within one task is dealt to several tasks with a salt before the shuffle.
4. A document that is on fewer than t long lists must meet each partner on t - (its long lists) short ones. Pairs that
   reach this overlap are verified by binary probes of one sorted set in the other.
5. Documents on t long lists or more (dense ones) may meet on long lists only. There the documents of a list are
   searched together on their shingles (:func:`searched`): each one's short inverted lists are merged and counted, its long ones
   are binary-probed for what the merge leaves, and it links where the exact overlap is reached. Lists of many shingles
   are split to chunks, and each pair of chunks is a group of its own.

Groups of near copies are not expanded to pairs. Before 4 and 5, each document is held against its best partner and
against the most central document of its long lists (the one with the least share of segments of its own); what links
becomes one component, and lists inside one component cost nothing. A search returns at most one link a document,
as links inside a component that it has found add nothing. So no link between components is missed.

Document ids are broadcast only up to BROADCAST_ROWS counted rows, else joined by shuffle.

Null, empty and wordless texts have no shingles and link with nothing. Texts of fewer words than `size` are one shingle.
Rows that repeat a doc_id are one document with several sets; each row is returned. Rows without a doc_id are returned
with a null component. Of equal overlaps, the partner with the larger doc_id is tried first, which changes no component.
Texts of any length are read whole. Other columns are not read, so their names can't clash. Empty input: empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, give_back, join_by_hot_key, keep_ids, small_batches
from .components import components
from .hashing import coded, distinct, joined, mixed

#: Longest short list; rows of a posting task's slice that make a segment hot, and the tasks it is dealt to.
LONG, SALTS = 32, 16
#: Shingles in a chunk of a long list; partners in a salted group of a verification.
CHUNK_SHINGLES, PARTNERS = 500_000, 1000
#: A search merges so large a part of the lists that it could set aside: more merging leaves fewer documents to probe.
MERGED = 4
SLICE_CHARS = 4_000_000
#: In percent of the segments that may differ: those that need not be posted, and t - 1.
UNPOSTED, SPARE = 35, 15


@dataclass(frozen=True)
class Likeness:
    """Shingles of `size` words; linked from `percent` on."""

    size: int = 5
    percent: int = 80

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        out = []
        # Of bytes, lower() and split() know just A-Z and the white space of WORD.
        for text in texts:
            codes = coded((text or "").encode("utf-8", "surrogatepass").lower().split())
            if len(codes) >= self.size:
                out.append(distinct(joined(codes, self.size)))
            else:
                out.append(mixed(joined(codes, len(codes)) + np.uint64(len(codes))) if len(codes) else np.zeros(0, "uint64"))
        return out

    def linked(self, common, a, b):
        return 100 * common >= self.percent * (a + b - common)

    def apart(self, both):
        """The largest symmetric difference of linked sets whose sizes sum to `both`."""
        return (100 - self.percent) * both // (100 + self.percent)

    def overlap(self, both: int) -> int:
        """The least intersection of linked sets whose sizes sum to `both`."""
        return -(-self.percent * both // (100 + self.percent))


@functools.lru_cache(8)
def schemes(like: Likeness) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each size class: its first size, its largest size, its number of segments, its t.

    A class spans two steps of 100 / percent, so the partners of a document lie in its own class and one neighbour."""
    first = [1]
    while first[-1] < 1 << 40:
        first.append(first[-1] * 10_000 // like.percent**2 + 1)
    first, last = np.array(first[:-1], "int64"), np.array(first[1:], "int64") - 1
    most = like.apart(2 * last)
    return first, last, most + 1 + -(-most * UNPOSTED // 100), 1 + most * SPARE // 100


def segments(ids: np.ndarray, sets: list[np.ndarray], like: Likeness) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, id, n, scheme) of what the documents post."""
    first, last, room, spare = schemes(like)
    size = np.fromiter(map(len, sets), "int64", len(sets))
    own = np.searchsorted(first, size, "right") - 1
    reach = np.searchsorted(first, 100 * size // like.percent, "right") - 1
    out = []
    for scheme, larger in ((own, False), (reach, True)):
        differ = like.apart(size + np.minimum(last[scheme], 100 * size // like.percent))
        some = np.flatnonzero((size > 0) & (differ > 0) & ((scheme != own) | (not larger)))
        if not len(some):
            continue
        n, k, m = size[some], scheme[some], room[scheme[some]]
        flat, off = np.concatenate([sets[i] for i in some]), np.cumsum(m) - m
        doc = np.repeat(np.arange(len(some)), n)
        salt = mixed((k + 1).astype("uint64"))[doc]
        slot = off[doc] + (mixed(flat + salt) % m[doc].astype("uint64")).astype("int64")
        total = np.zeros(int(m.sum()), "uint64")
        np.add.at(total, slot, mixed(flat ^ salt))
        held = np.bincount(slot, minlength=len(total))
        owner = np.repeat(np.arange(len(some)), m)
        key = mixed(mixed(total + (np.arange(len(total)) - off[owner]).astype("uint64")) + k[owner].astype("uint64"))
        order = np.lexsort((key, -np.minimum(held, 3), owner))
        posted = np.arange(len(total)) - off[owner] < (differ[some] + spare[k])[owner]
        key, owner = key[order][posted], owner[posted]
        out.append((key.view("int64"), ids[some][owner], n[owner], k[owner]))
    if not out:
        return tuple(np.zeros(0, "int64") for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _slices(batches: Iterator[pd.DataFrame], column: str = "text") -> Iterator[pd.DataFrame]:
    for whole in batches:
        size = whole[column].str.len().fillna(0).to_numpy().cumsum()
        at = 0
        while at < len(whole):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_CHARS, "right")))
            yield whole.iloc[at:end]
            at = end


def _described(rows: DataFrame, like: Likeness) -> DataFrame:
    """id, n and the digest of each row's set."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _slices(batches):
            sets = like.sets(part["text"].tolist())
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pd.DataFrame({"id": part["id"].array, "n": [len(s) for s in sets], "digest": digest})
        give_back()

    return rows.mapInPandas(work, "id long, n long, digest binary")


def _postings(rows: DataFrame, like: Likeness) -> DataFrame:
    """(key, salt, id, n, scheme). Keys that a slice holds more than LONG times are salted, and a row of size 0 with salt 0
    says so."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _slices(batches):
            key, doc, n, k = segments(part["id"].to_numpy("int64"), like.sets(part["text"].tolist()), like)
            salt = np.zeros(len(key), "int32")
            if len(part) > LONG:
                keys, at, count = np.unique(key, return_inverse=True, return_counts=True)
                hot = count[at] > LONG
                salt[hot] = 1 + mixed(doc[hot].astype("uint64")) % np.uint64(SALTS)
                keys = keys[count > LONG]
                key, salt, doc, n, k = (np.concatenate([c, np.full(len(keys), x)]) for c, x in ((key, 0), (salt, 0), (doc, 0), (n, 0), (k, 0)))
                key[len(key) - len(keys) :] = keys
            yield pd.DataFrame({"key": key, "salt": salt.astype("int32"), "id": doc, "n": n, "scheme": k.astype("int32")})
        give_back()

    return rows.mapInPandas(work, "key long, salt int, id long, n long, scheme int")


#: What :func:`_merged` tells: a posting of a long list (key, id, n, scheme), lists that a pair shares (a, b, scheme, number), or
#: shared lists of a document (id, number).
POSTING, PAIR, SHARED = 0, 1, 2


def _merged(postings: DataFrame, like: Likeness) -> DataFrame:
    """(kind, a, b, n, scheme) from the merged lists. Lists stream by in order; of one list at most LONG rows are held."""

    def near(rows: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """(a, b, scheme) of rows on the same list, for all distances at once."""
        for off in range(1, LONG):
            same = at[off:] == at[:-off]
            if not same.any():
                return
            x, y = rows[:-off][same], rows[off:][same]
            fits = (100 * np.minimum(x[:, 3], y[:, 3]) >= like.percent * np.maximum(x[:, 3], y[:, 3])) & (x[:, 2] != y[:, 2])
            x, y = x[fits], y[fits]
            yield np.stack([np.minimum(x[:, 2], y[:, 2]), np.maximum(x[:, 2], y[:, 2]), x[:, 4]], 1)

    def given(rows: np.ndarray, at: np.ndarray, long: np.ndarray) -> pd.DataFrame:
        """Of whole short lists, and of rows of long ones."""
        real = rows[:, 3] > 0
        rows, at, long = rows[real], at[real], long[real]
        far, out = rows[long], []
        out.append(np.stack([np.full(len(far), POSTING), far[:, 0], far[:, 2], far[:, 3], far[:, 4]], 1))
        found = [*near(rows[~long], at[~long])]
        if found:
            pairs, n = np.unique(np.concatenate(found), axis=0, return_counts=True)
            out.append(np.stack([np.full(len(n), PAIR), pairs[:, 0], pairs[:, 1], n, pairs[:, 2]], 1))
        doc, n = np.unique(rows[:, 2], return_counts=True)
        out.append(np.stack([np.full(len(n), SHARED), doc, doc, n, np.zeros(len(n), "int64")], 1))
        return pd.DataFrame(np.concatenate(out), columns=["kind", "a", "b", "n", "scheme"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.zeros((0, 5), "int64")
        held, known = none, None  # rows of an open list that may be short; the open list if it is known to be long
        for part in batches:
            if not len(part):
                continue
            rows = np.concatenate([held, part[["key", "salt", "id", "n", "scheme"]].to_numpy("int64")])
            starts = np.append(0, np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1)
            length = np.diff(np.append(starts, len(rows)))
            long = (length > LONG) | (rows[starts, 1] > 0) | (np.minimum.reduceat(rows[:, 3], starts) == 0)
            long[0] |= known == (rows[0, 0], rows[0, 1])
            last = (rows[-1, 0], rows[-1, 1])
            if long[-1]:
                held, known = none, last
                end = len(rows)
            else:
                held, known = rows[starts[-1] :], None
                end = starts[-1]
            take = np.repeat((length > 1) | long, length)
            take[end:] = False
            at = np.repeat(np.arange(len(starts)), length)
            if take.any():
                yield given(rows[take], at[take], np.repeat(long, length)[take])
        if len(held) > 1:
            yield given(held, np.zeros(len(held), "int64"), np.zeros(len(held), bool))
        give_back()

    # The rows of size 0 come first on their list, so it is known to be long from its first row on.
    runs = postings.repartition("key", "salt").sortWithinPartitions("key", "salt", "n")
    return runs.mapInPandas(work, "kind int, a long, b long, n long, scheme int")


def _verified(pairs: DataFrame, docs: DataFrame, like: Likeness) -> DataFrame:
    """Those pairs (a, b) that link. Each a's text comes first in its group, the texts of its b stream by; texts are sent
    and not sets, as they take less than half of the room."""
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("k"))
    few = pairs.count() <= BROADCAST_ROWS
    roles = load.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"))
    roles = roles.unionByName(pairs.join(load, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("salt"), "b"))
    sent = docs.join(F.broadcast(roles) if few else roles, "id").select("a", "salt", "b", "text")

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for part in _slices(batches):
            a, b = [], []
            for key, salt, other, s in zip(part["a"], part["salt"], part["b"], like.sets(part["text"].tolist()), strict=True):
                if (key, salt) != at:
                    at, held = (key, salt), []
                if pd.isna(other):
                    held.append(s)
                    continue
                if any(like.linked(_common(first, s), len(first), len(s)) for first in held if len(first) and len(s)):
                    a.append(key)
                    b.append(int(other))
            yield pd.DataFrame({"a": np.array(a, "int64"), "b": np.array(b, "int64")})
        give_back()

    return sent.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInPandas(probe, "a long, b long")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets that are not empty, by binary probes of the smaller one."""
    few, many = (a, b) if len(a) < len(b) else (b, a)
    return int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())


def searched(sets: list[np.ndarray], parts: list[int], sides: list[int] | None, like: Likeness) -> list[tuple[int, int]]:
    """Links (places in sets) that connect all linked sets of different parts, by DivideSkip on their shingles.

    With sides, only sets of different sides are held against each other. Partners of a set are those of its size or
    larger, so it needs T = overlap(twice its size) of their shingles. Of its lists all but the T - T // MERGED - 1 longest
    are merged and counted; what is met T - (lists set aside) times is probed for the others."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    size = np.array([len(sets[i]) for i in order], "int64")
    side = None if sides is None else np.array([sides[i] for i in order])
    root = {p: p for p in parts}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    if len(root) < 2:
        return []
    keys, code, length = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    docs = np.repeat(np.arange(len(order)), size)[np.argsort(code, kind="stable")]  # the lists, each in order of size
    begin, ends = np.cumsum(length) - length, np.cumsum(size)
    reach = np.searchsorted(size, 100 * size // like.percent, "right")
    links = []
    for i, at in enumerate(order):
        n = int(size[i])
        own = code[ends[i] - n : ends[i]]
        own = own[np.argsort(length[own], kind="stable")]
        need = like.overlap(2 * n)
        short, aside = np.split(own, [n - need + 1 + need // MERGED])
        runs = [docs[begin[c] : begin[c] + length[c]] for c in short[length[short] > 1].tolist()]
        if not runs:
            continue
        met = np.bincount(np.concatenate(runs), minlength=reach[i])[i + 1 : reach[i]]
        least = -(-like.percent * (n + size[i + 1 : reach[i]]) // (100 + like.percent))
        ok = (met > 0) & (met >= least - len(aside))
        if side is not None:
            ok &= side[i + 1 : reach[i]] != side[i]
        aside = keys[aside]
        for j in np.flatnonzero(ok).tolist():
            other = order[i + 1 + j]
            if find(parts[at]) != find(parts[other]):
                many = sets[other]
                probed = int((many[np.minimum(np.searchsorted(many, aside), len(many) - 1)] == aside).sum())
                if met[j] + probed >= least[j]:
                    root[find(parts[at])] = find(parts[other])
                    links.append((at, other))
    return links


def _searched_lists(lists: DataFrame, docs: DataFrame, like: Likeness, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect the linked documents of different parts on each list of lists(key, id, n, part)."""
    ids = scratch.write(lists.select("id").distinct())

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _slices(batches):
            sets = like.sets(part["text"].tolist())
            yield pd.DataFrame({"id": part["id"].array, "shingles": [s.tobytes() for s in sets]})
        give_back()

    sets = scratch.write(keep_ids(docs, ids, "id").mapInPandas(shingled, "id long, shingles binary"))
    load = lists.groupBy("key").agg(F.ceil(F.sum("n") / CHUNK_SHINGLES).cast("int").alias("k"))
    small = load.count() <= BROADCAST_ROWS
    rows = lists.join(F.broadcast(load) if small else load, "key").withColumn("chunk", F.pmod(F.xxhash64("id"), "k").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("key", "id", "part", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    rows = scratch.write(rows)
    few = rows.count() <= BROADCAST_ROWS
    sent = sets.join(F.broadcast(rows) if few else rows, "id")

    def found(rows: list[tuple]) -> list[tuple[int, int]]:
        sides = [r[3] for r in rows] if rows[0][4] != rows[0][5] else None
        links = searched([np.frombuffer(r[6], "uint64") for r in rows], [r[2] for r in rows], sides, like)
        return [(rows[i][1], rows[j][1]) for i, j in links]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, links = [], []
        for batch in batches:
            links = []
            for row in batch[["key", "id", "part", "chunk", "low", "high", "shingles"]].itertuples(index=False, name=None):
                if held and (held[0][0], held[0][4], held[0][5]) != (row[0], row[4], row[5]):
                    links += found(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")
        if held:
            yield pd.DataFrame(found(held), columns=["a", "b"], dtype="int64")
        give_back()

    return sent.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInPandas(work, "a long, b long")


def _in_parts(rows: DataFrame, parts: DataFrame | None, n_parts: int, *names: str) -> DataFrame:
    """rows with the component of each id column as part_<name>; without one an id is its own."""
    for name in names:
        if parts is None:
            rows = rows.withColumn(f"part_{name}", F.col(name))
            continue
        own = parts.select(F.col("id").alias(name), F.col("component").alias(f"part_{name}"))
        rows = rows.join(F.broadcast(own) if n_parts <= BROADCAST_ROWS else own, name, "left")
        rows = rows.withColumn(f"part_{name}", F.coalesce(f"part_{name}", name))
    return rows


def _first_tries(pairs: DataFrame, far: DataFrame, shared: DataFrame, like: Likeness) -> DataFrame:
    """(a, b): each document b with its best partner on short lists, and with its best leader on long ones."""
    best = F.max(F.struct("c", "a")).alias("best")
    tries = pairs.groupBy("b").agg(best)
    # The leader of a list is its document with the largest share of shared segments. One row a list.
    ranked = far.join(keep_ids(shared, far.select("id").distinct(), "id"), "id").select("key", F.struct((F.col("c") / F.col("n")).alias("share"), F.xxhash64("id").alias("tie"), "n", "id").alias("r"))
    leaders = ranked.groupBy("key").agg(F.max("r").alias("r")).select("key", F.col("r.id").alias("a"), F.col("r.n").alias("size"))
    led = far.join(F.broadcast(leaders) if leaders.count() <= BROADCAST_ROWS else leaders, "key")
    led = led.where((F.col("a") != F.col("id")) & (100 * F.least("n", "size") >= like.percent * F.greatest("n", "size")))
    led = led.groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("c")).groupBy("b").agg(best)
    return tries.unionByName(led).select("best.a", "b").distinct()


def joined_documents(docs: DataFrame, like: Likeness, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, links): for each row of docs id_col, n_shingles and component_id; and verified links (a, b) between
    class representatives, which connect every pair of linked documents but need not name each pair of a component."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    some_rows = rows.where("id is not null")
    each = scratch.write(_described(rows, like))
    classes = scratch.write(each.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("n").alias("n")))
    reps = scratch.write(classes.select(F.col("rep").alias("id")).distinct())
    merged = scratch.write(_merged(_postings(keep_ids(some_rows, reps, "id"), like), like), partition_by="kind")
    far = merged.where(F.col("kind") == POSTING).select(F.col("a").alias("key"), F.col("b").alias("id"), "n", "scheme")
    pairs = merged.where(F.col("kind") == PAIR).groupBy("a", "b", "scheme").agg(F.sum("n").alias("c"))
    pairs = scratch.write(pairs)
    shared = merged.where(F.col("kind") == SHARED).groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("c"))

    # Classes that share a document (its rows differ) belong together.
    own = each.where("n > 0 and id is not null").select("id", "digest").distinct().groupBy("id").agg(F.count("*").alias("k"), F.collect_list("digest").alias("digests")).where("k > 1").select("id", F.explode("digests").alias("digest"))
    ties = own.join(classes.select("digest", "rep"), "digest").groupBy("id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("b")).select("a", F.explode("b").alias("b")).where("a <> b")
    tries = scratch.write(_first_tries(pairs, far, shared, like))
    links = scratch.write(ties.unionByName(_verified(tries, some_rows, like)))
    parts = components(links, scratch) if not links.isEmpty() else None
    n_parts = parts.count() if parts is not None else 0

    # Long lists that still hold different components, and on how many of them a document is.
    far = _in_parts(far, parts, n_parts, "id").withColumnRenamed("part_id", "part")
    ends = far.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    far = scratch.write(keep_ids(far, scratch.write(ends), "key"))
    t = F.element_at(F.lit(schemes(like)[3].tolist()), F.col("scheme") + 1)
    on = scratch.write(far.groupBy("id", "scheme").agg(F.count("*").alias("d")))
    n_on = on.count()
    left = _in_parts(pairs, parts, n_parts, "a", "b").where("part_a <> part_b")
    for x in "ab":
        side = on.select(F.col("id").alias(x), "scheme", F.col("d").alias(f"d_{x}"))
        left = left.join(F.broadcast(side) if n_on <= BROADCAST_ROWS else side, [x, "scheme"], "left")
    d = F.least(F.coalesce("d_a", F.lit(0)), F.coalesce("d_b", F.lit(0)))
    left = left.where(F.col("c") >= F.when(d < t, t - d).otherwise(t)).select("a", "b").distinct()
    left = scratch.write(left.join(tries, ["a", "b"], "left_anti"))
    dense = on.where(F.col("d") >= t).select("id", "scheme")
    dense = far.join(F.broadcast(dense) if n_on <= BROADCAST_ROWS else dense, ["id", "scheme"], "left_semi")
    both = dense.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    dense = scratch.write(keep_ids(dense, scratch.write(both), "key").select("key", "id", "n", "part"))
    more = _verified(left, some_rows, like)
    if not dense.isEmpty():
        more = more.unionByName(_searched_lists(dense, some_rows, like, scratch))
    links = scratch.write(links.unionByName(more))
    parts = components(links, scratch) if not links.isEmpty() else None

    whole = classes if parts is None else classes.join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    whole = scratch.write(whole.select("digest", "size", (F.coalesce("component", "rep") if parts is not None else F.col("rep")).alias("component_id")))
    some = join_by_hot_key(each.where("n > 0 and id is not null"), whole, "digest", "size")
    rest = each.where("n = 0 or id is null").withColumn("component_id", F.col("id"))
    names = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"]
    out = scratch.write(some.select(*names).unionByName(rest.select(*names)))
    scratch.keep_only(out, links)
    return out, links


def report(docs: DataFrame, like: Likeness) -> DataFrame:
    return joined_documents(docs, like)[0]


def one_of_each_group(docs: DataFrame, like: Likeness) -> DataFrame:
    """The rows of docs without those whose group has a smaller doc_id; one row stays of each group.

    Of rows that repeat a doc_id all stay or go together, and rows without a doc_id stay."""
    rows, _ = joined_documents(docs, like)
    goes = rows.where("component_id < doc_id").select("doc_id").distinct()
    goes = Scratch(docs.sparkSession, "groups").write(goes)
    return keep_ids(docs, goes, "doc_id", "left_anti").select(*docs.columns)
