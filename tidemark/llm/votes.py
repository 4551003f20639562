"""Quality by nearest-neighbour voting: every document against the latent-semantic vectors of labelled ones.

A text's terms are its byte trigrams, hashed to TERMS buckets and weighted by log count and inverse document frequency, and
the share of its words that repeat the word before. A truncated singular value decomposition of the labelled documents'
weights gives LATENT directions; labelled vectors in them are broadcast (LABELLED rows of LATENT numbers at most). Every
document is multiplied with all of them, block by block, and their labels are averaged with weights of cosine to a power:
near neighbours decide, and a document without a near one gets the mean of those that are least far.

Bounds: labels are learnt from at most LABELLED documents outside the held-out fifth, chosen by a hash of doc_id; all else,
document frequencies too, covers every document and whole texts. Texts are read in pieces of PIECE bytes.

Odd input: null and empty texts have no terms and get the labelled documents' mean. Of several labels of a document the
largest counts, of several texts of a labelled doc_id that with the smallest terms; rows without a doc_id are scored and
never learnt from. Without labels every score is 0.5. Repeated rows are scored each. Columns are named by parameter; others
never clash, as only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of byte trigrams, a power of two.
TERMS = 8192
#: Labelled documents that vote, at most; directions kept.
LABELLED, LATENT = 3000, 64
#: Weight of the repetition share beside the trigrams; power of a cosine in the vote, a power of two.
REPEATS, POWER = 0.5, 32
#: Bytes of a text read at once, and documents multiplied at once.
PIECE, BLOCK = 1 << 20, 256

_SPACE = bytes(range(9, 14)) + b" "
_TO_BLANK = bytes.maketrans(_SPACE, b" " * len(_SPACE))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets of the text's byte trigrams, their counts, and the share of words that equal the word before."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = np.zeros(TERMS, "int64")
    shift = np.uint32(32 - TERMS.bit_length() + 1)
    words, same, last = 0, 0, b""
    tail = b""
    for at in range(0, len(data), PIECE):
        b = np.frombuffer(data, "uint8", min(PIECE + 2, len(data) - at), at).astype("uint32")
        if len(b) > 2:
            codes = (b[:-2] << np.uint32(16)) + (b[1:-1] << np.uint32(8)) + b[2:]
            counts += np.bincount((codes * np.uint32(2654435761)) >> shift, minlength=TERMS)
        # A word that the piece cuts is carried into the next one.
        piece = tail + data[at : at + PIECE].translate(_TO_BLANK)
        found = piece.split(b" ")
        tail = found.pop() if at + PIECE < len(data) else b""
        found = [last, *filter(None, found)]
        same += sum(map(eq, found, found[1:]))
        words += len(found) - 1
        last = found[-1]
    buckets = np.flatnonzero(counts)
    return buckets, counts[buckets], same / max(1, words - 1)


@dataclass
class Voters:
    """Latent vectors of labelled documents, with what is needed to place others among them."""

    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @classmethod
    def fit(cls, idf: np.ndarray, found: list[tuple[np.ndarray, np.ndarray, float]], labels: np.ndarray) -> Voters:
        rows = np.zeros((len(found), TERMS + 2), "float32")
        for row, (buckets, counts, repeats) in zip(rows, found, strict=True):
            row[:] = weighted(idf, buckets, counts, repeats)
        k = min(LATENT, *rows.shape) if len(found) else 0
        directions = np.zeros((TERMS + 2, 0), "float32")
        if k:  # subspace iteration from a fixed start
            q = np.random.default_rng(7).standard_normal((rows.shape[1], min(k + 16, *rows.shape))).astype("float32")
            for _ in range(8):
                q, _ = np.linalg.qr(rows.T @ (rows @ q))
            _, _, v = np.linalg.svd(rows @ q, full_matrices=False)
            directions = (q @ v.T[:, :k]).astype("float32")
        return cls(idf, directions, _unit(rows @ directions), np.asarray(labels, "float64"))

    def scores(self, found: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
        """The share of label 1 among the votes of all labelled documents, for each of a block of documents."""
        if not len(self.labels):
            return np.full(len(found), 0.5)
        rows = np.stack([weighted(self.idf, *f) for f in found])
        cosines = np.maximum(_unit(rows @ self.directions) @ self.vectors.T, 0.0).astype("float64")
        top = cosines.max(1, keepdims=True)
        votes = np.where(top > 0, cosines / np.where(top > 0, top, 1.0), 1.0)
        for _ in range(POWER.bit_length() - 1):
            votes *= votes
        return np.clip(votes @ self.labels / votes.sum(1), 0.0, 1.0)


def weighted(idf: np.ndarray, buckets: np.ndarray, counts: np.ndarray, repeats: float) -> np.ndarray:
    """A document's weights: trigrams of length 1, then repetition of length REPEATS; no terms, no weights."""
    out = np.zeros(TERMS + 2, "float32")
    if len(buckets):
        w = np.log1p(counts) * idf[buckets]
        out[buckets] = w / max(np.linalg.norm(w), 1e-9)
        out[TERMS:] = REPEATS * np.array([repeats, 1 - repeats]) / np.hypot(repeats, 1 - repeats)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents, and in how many of them each bucket occurs. A task sends one row of TERMS counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, np.zeros(TERMS, "int64")
        for batch in batches:
            for text in batch.column(0):
                n += 1
                seen[terms(text.as_py())[0]] += 1
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([seen.tolist()])], ["n", "seen"])

    rows = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(work, "n long, seen array<long>")
    sums = rows.select("n", F.posexplode("seen").alias("bucket", "docs")).groupBy("bucket").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    found = sums.orderBy("bucket").collect()  # TERMS rows
    return (found[0]["n"] if found else 0), np.array([r["docs"] for r in found] or [0] * TERMS, "int64")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", limit: int = LABELLED) -> Voters:
    """Voters from at most `limit` labelled documents outside the held-out fifth."""
    n, seen = frequencies(docs, text_col)
    idf = np.log((1 + n) / (1 + seen)).astype("float32")
    ident = F.col(f"`{id_col}`")
    known = labels.where(ident.isNotNull() & ~held_out(f"`{id_col}`") & F.col(f"`{label}`").isNotNull()).groupBy(ident.alias("id")).agg(F.max(f"`{label}`").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(limit)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(t.as_py()) for t in batch.column(2)]
            arrays = [batch.column(0), batch.column(1), pa.array([b.astype("<i4").tobytes() for b, _, _ in found], pa.binary()), pa.array([c.astype("<i8").tobytes() for _, c, _ in found], pa.binary()), pa.array([r for _, _, r in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "y", "buckets", "counts", "repeats"])

    kind, what = docs.schema[id_col].dataType.simpleString(), known.schema["y"].dataType.simpleString()
    texts = docs.select(ident.alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "id").select("id", "y", "text")
    each = texts.mapInArrow(work, f"id {kind}, y {what}, buckets binary, counts binary, repeats double")
    rows = each.groupBy("id", "y").agg(F.min(F.struct("buckets", "counts", "repeats")).alias("t")).orderBy("id").collect()  # `limit` rows
    found = [(np.frombuffer(r["t"]["buckets"], "<i4"), np.frombuffer(r["t"]["counts"], "<i8"), r["t"]["repeats"]) for r in rows]
    return Voters.fit(idf, found, np.array([float(r["y"] > 0) for r in rows]))


def score(docs: DataFrame, voters: Voters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(voters)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                got = sent.value.scores([terms(t.as_py()) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.float64())], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(work, f"`{id_col}` {kind}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score of 0.3 or more) of every document."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
