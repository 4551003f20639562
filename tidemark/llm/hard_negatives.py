"""Hard negatives by inverted lists: k-means clusters with stored radii, visited by Cauchy-Schwarz bounds.

A list holds the vectors nearest to one centroid, with the largest distance of a member as its radius. For an anchor q no
member of a list can score more than q.c + |q| * radius, nor less than q.c - |q| * radius. Lists are visited in the order of
the upper bound, some in each round (FIRST, then four times as many each time); a list outside an anchor's windows is skipped,
and an anchor stops when the bound falls strictly below its k-th score so far. Results are exact: what is skipped cannot
count. Where vectors have no clusters, bounds exclude little and most lists are visited.

A round's visits are shuffled to the lists they ask for. A list of any size is cut into slices of about SLICE rows, and the
anchors that visit it into groups of about GROUP, so a task multiplies two bounded blocks, and no list is gathered in one
place. The best rows of each block are cut to k by a window whose limit is applied before its shuffle.

Bounds: centroids are fitted to at most SAMPLE vectors, chosen by a hash of the id; every vector is in a list. The driver and
broadcasts hold CENTROIDS rows.

Odd input: rows without an id or label, without a vector, or with a component that is null or not finite take no part. A
repeated id counts once, with the smallest label, then vector. Shorter vectors are filled up with zeros. Ties go to the
smaller id. Other columns are not read. Scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Centroids, and vectors they are fitted to, at most.
CENTROIDS, SAMPLE, ITERATIONS = 64, 8192, 8
#: Lists that an anchor visits in the first round.
FIRST = 8
#: Rows of a list, and anchors, that are multiplied with one another in one task; anchors of a block in it.
SLICE, GROUP, BLOCK = 8192, 4096, 256


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as doubles; null if a component is null or not finite."""
    whole = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # floor() of a double gives a long: x - x mod 1 keeps the double.
    return F.when(fine, F.transform(whole, lambda x: x * scale - F.pmod(x * scale, F.lit(1.0))))


def _matrix(column: pa.Array) -> np.ndarray:
    """Binary vectors as rows of doubles."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), len(values[0]) // 8) if values else np.zeros((0, 0))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: doubles can add them up unless they pass 2^53."""
    most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * a.shape[1]
    return (a @ b.T).astype("int64") if most < 2**53 else a.astype("int64") @ b.astype("int64").T


@dataclass
class Index:
    """Inverted lists: rows are (cluster, slice, id, label, vector); centroids and radii go to every task."""

    rows: DataFrame
    centroids: np.ndarray
    radii: np.ndarray
    slices: list[int]

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible score of each list's members, for each row of q; rounding is allowed for."""
        mid = q @ self.centroids.T
        wide = np.linalg.norm(q, axis=1, keepdims=True) * self.radii
        spare = 1e-9 * (np.abs(mid) + wide) + 1e-6
        return mid - wide - spare, mid + wide + spare


def fitted(sample: np.ndarray, k: int = CENTROIDS, iterations: int = ITERATIONS) -> np.ndarray:
    """Lloyd's centroids from the first k distinct vectors of the sample; one that loses its members stays where it is."""
    centroids = np.unique(sample, axis=0)
    centroids = centroids[np.random.default_rng(3).permutation(len(centroids))[:k]].astype("float64")
    for _ in range(iterations if len(centroids) else 0):
        near = nearest(sample, centroids)[0]
        count = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return centroids


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, and how far it is."""
    near = ((centroids**2).sum(1) - 2 * vectors @ centroids.T).argmin(1)
    return near, np.linalg.norm(vectors - centroids[near], axis=1)


def build(vectors: DataFrame, scratch: Scratch, k: int = CENTROIDS, sample: int = SAMPLE) -> Index:
    """The index of vectors(id long, label long, vector array<double>)."""
    known = vectors.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    once = known.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector")
    once = scratch.write(once)
    width = once.agg(F.max(F.size("vector"))).first()[0] or 0
    chosen = once.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()
    some = np.zeros((len(chosen), width))
    for row, r in zip(some, chosen, strict=True):
        row[: len(r[0])] = r[0]
    centroids = fitted(some, k)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = batch.column(2), batch.column(2).offsets.to_numpy()
            all_values = flat.values.to_numpy(zero_copy_only=False)
            whole = np.zeros((batch.num_rows, width))
            for row, at, end in zip(whole, ends, ends[1:], strict=False):
                row[: end - at] = all_values[at:end]
            near, far = nearest(whole, centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in whole], pa.binary()), pa.array(near, pa.int32()), pa.array(far, pa.float64())], ["id", "label", "vector", "cluster", "far"])

    if not len(centroids):
        empty = once.select("id", "label", F.lit(b"").alias("vector"), F.lit(0).alias("cluster"), F.lit(0).alias("slice"))
        return Index(empty, np.zeros((0, width)), np.zeros(0), [])
    placed = scratch.write(once.select("id", "label", "vector").mapInArrow(work, "id long, label long, vector binary, cluster int, far double"))
    scratch.drop(once)
    sizes = {r["cluster"]: r for r in placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    radii = np.array([sizes[c]["far"] if c in sizes else -1.0 for c in range(len(centroids))])
    slices = [-(-sizes[c]["n"] // SLICE) if c in sizes else 0 for c in range(len(centroids))]
    cut = F.get(F.array(*[F.lit(max(1, n)) for n in slices]), F.col("cluster"))
    return Index(placed.select("id", "label", "vector", "cluster", F.pmod(F.xxhash64("id"), cut).cast("int").alias("slice")), centroids, radii, slices)


def _best(scores: np.ndarray, ids: np.ndarray, floor: float, top: float, k: int) -> np.ndarray:
    """Places of the k best scores from floor to top; ties go to smaller ids."""
    there = np.flatnonzero((scores >= floor) & (scores <= top))
    if len(there) > k:
        least = np.partition(scores[there], len(there) - k)[len(there) - k]
        there = there[scores[there] >= least]
    return there[np.lexsort((ids[there], -scores[there]))[:k]]


_VISIT = "cluster int, anchor_id long, label long, vector binary, slots array<int>, floors array<double>, tops array<double>"


def search(anchors: DataFrame, index: Index, scratch: Scratch, k: int, same: bool, first: int = FIRST) -> DataFrame:
    """(anchor_id, slot, rank, score, id): the k best rows of each window of each anchor, exact.

    anchors(anchor_id, label, vector binary, windows array of (slot, low, high)): rows of the anchor's label count if same,
    else those of other labels; never those with the anchor's id."""
    spark = anchors.sparkSession
    n = anchors.count()
    groups = max(1, -(-n // GROUP))
    best = scratch.write(spark.createDataFrame([], "anchor_id long, slot int, rank int, score long, id long"))
    if not n or not len(index.centroids):
        return best
    sent = spark.sparkContext.broadcast((index.centroids, index.radii))
    slices = F.get(F.array(*[F.lit(s) for s in index.slices]), F.col("cluster"))
    lists = index.rows.withColumn("dealt", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def visits(low: int, high: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            where = Index(None, *sent.value, [])
            for whole in batches:
                for at in range(0, whole.num_rows, BLOCK):
                    batch = whole.slice(at, BLOCK)
                    least, most = where.bounds(_matrix(batch.column("vector")))
                    order = np.lexsort((np.broadcast_to(np.arange(most.shape[1]), most.shape), -most))[:, low:high]
                    out = []
                    for i, (windows, kth) in enumerate(zip(batch.column("windows").to_pylist(), batch.column("kth").to_pylist(), strict=True)):
                        reached = {x["slot"]: x["score"] for x in kth or ()}
                        asked = [(w["slot"], max(w["low"], reached.get(w["slot"], w["low"])), w["high"]) for w in windows]
                        for c in order[i].tolist():
                            use = [w for w in asked if where.radii[c] >= 0 and most[i, c] >= w[1] and least[i, c] <= w[2]]
                            if use:
                                out.append((c, i, *map(list, zip(*use, strict=True))))
                    rows = pa.array([r[1] for r in out], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in out], pa.int32()), *[batch.column(c).take(rows) for c in ("anchor_id", "label", "vector")], pa.array([r[2] for r in out], pa.list_(pa.int32())), *[pa.array([r[j] for r in out], pa.list_(pa.float64())) for j in (3, 4)]],
                        ["cluster", "anchor_id", "label", "vector", "slots", "floors", "tops"],
                    )

        return work

    def scored(asking: pa.Table, members: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if asking.num_rows and members.num_rows:
            ids, labels, vectors = members["id"].to_numpy(), members["label"].to_numpy(), _matrix(members["vector"])
            for at in range(0, asking.num_rows, BLOCK):
                part = asking.slice(at, BLOCK)
                own, kinds = part["anchor_id"].to_numpy(), part["label"].to_numpy()
                products = _products(_matrix(part["vector"]), vectors)
                for i, (slots, floors, tops) in enumerate(zip(part["slots"].to_pylist(), part["floors"].to_pylist(), part["tops"].to_pylist(), strict=True)):
                    counts = np.flatnonzero(((labels == kinds[i]) == same) & (ids != own[i]) & (products[i] >= min(floors)))
                    for slot, floor, top in zip(slots, floors, tops, strict=True):
                        found = counts[_best(products[i][counts], ids[counts], floor, top, k)]
                        out[0] += [own[i]] * len(found)
                        out[1] += [slot] * len(found)
                        out[2] += products[i][found].tolist()
                        out[3] += ids[found].tolist()
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["anchor_id", "slot", "score", "id"])

    low, high = 0, first
    by_score = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "id")
    while low < len(index.centroids):
        kth = best.where(F.col("rank") == k).groupBy("anchor_id").agg(F.collect_list(F.struct("slot", "score")).alias("kth"))
        state = anchors.join(kth, "anchor_id", "left").select("anchor_id", "label", "vector", "windows", "kth")
        asked = state.mapInArrow(visits(low, high), _VISIT).withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).withColumn("dealt", F.pmod(F.xxhash64("anchor_id"), F.lit(groups)).cast("int"))
        pairs = asked.groupBy("cluster", "slice", "dealt").cogroup(lists.groupBy("cluster", "slice", "dealt"))
        found = pairs.applyInArrow(scored, "anchor_id long, slot int, score long, id long")
        every = best.select("anchor_id", "slot", "score", "id").unionByName(found)
        best = scratch.write(every.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("anchor_id", "slot", "rank", "score", "id"))
        low, high = high, 4 * high
    return best


def mine(index: Index, anchors: Column, scratch: Scratch, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the index's rows that anchors holds for.

    A positive's negatives are the best rows of another label whose score is from low to high (fractions) of the positive's."""
    inf = float("inf")
    own = index.rows.where(anchors).select(F.col("id").alias("anchor_id"), "label", "vector")
    window = F.array(F.struct(F.lit(0).alias("slot"), F.lit(-inf).alias("low"), F.lit(inf).alias("high")))
    near = search(own.withColumn("windows", window), index, scratch, positives, True)
    # The first whole number from low on and the last up to high: no rounding.
    p = F.col("score")
    least = F.expr(f"-((-{low[0]} * score - pmod(-{low[0]} * score, {low[1]}L)) div {low[1]}L)")
    most = F.expr(f"({high[0]} * score - pmod({high[0]} * score, {high[1]}L)) div {high[1]}L")
    asked = near.where(p >= 0).groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("rank").alias("slot"), least.cast("double").alias("low"), most.cast("double").alias("high"))).alias("windows"))
    found = search(own.join(asked, "anchor_id"), index, scratch, negatives, False)
    pos = near.select("anchor_id", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(pos, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def report(embeddings: DataFrame, k: int = CENTROIDS) -> DataFrame:
    """The first three hard negatives of the first five positives of every fiftieth vector."""
    scratch = Scratch(embeddings.sparkSession, "hard_negatives")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label")).cast("long")
    index = build(embeddings.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), scaled(F.col("embedding")).alias("vector")), scratch, k)
    return mine(index, F.col("id") % 50 == 0, scratch)


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score FROM v a JOIN v ON a.vec_id % 50 = 0 AND a.vec_id <> v.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT * FROM n WHERE rank <= 3
"""
