"""Toxicity of whole texts: a bidirectional GRU with attention pooling, trained in numpy.

A word enters as its own embedding (if the training sample had it) beside the mean of its character trigrams'
embeddings, so unknown spellings still carry evidence. Windows of WINDOW words, STRIDE apart, cover the whole text
(runs without white space enter as overlapping pieces of LONG characters); each is read in both directions, its states are pooled by attention, and a document's score is the calibrated
logit of its worst window.

Only documents are labelled, so training is by witnesses: each toxic document gives the window that looks worst so
far (first by word log-odds, then by the network), clean documents give random windows and their worst one.

Labels come from a bounded sample: at most MAX_LABELLED labelled rows of at most MAX_CHARS characters, in the order of
a hash of doc_id, without the held-out fifth. Scoring reads every whole text; texts pass through in slices of
bounded size, and only the weights (under 2 MB) are broadcast. Null and empty texts score the sample's toxic share.
Rows are independent; repeated rows get equal scores, a null doc_id passes through, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

MAX_LABELLED, MAX_CHARS = 4000, 20_000
WINDOW, STRIDE = 32, 16
LONG, PACE = 64, 32
#: Sizes: word and trigram tables, their dimensions, hidden units of one direction, attention units.
WORDS, GRAMS, DW, DC, H, A = 8192, 4096, 10, 10, 12, 10
ROUNDS, EPOCHS, BATCH, RATE, SEED = 4, 4, 64, 0.006, 7
#: In training, the share of words whose own embedding is hidden (their letters stay), and the decay of weights.
HIDDEN_WORDS, DECAY = 0.5, 2e-3
#: Clean windows for each toxic one: the worst ones, and random ones.
HARD, RANDOM = 2, 3
#: One training document in so many only sets the calibration.
APART = 5
#: Words that are scored together, and windows that are read together.
SLICE_CHARS, READ = 4_000_000, 4096

Params = dict[str, np.ndarray]
_runs = re.compile(WORD).findall


def _words(text: str) -> list[str]:
    """Runs between white space; longer ones than LONG as pieces of LONG characters, PACE apart, so that windows cover them."""
    runs = _runs(text)
    if max(map(len, runs), default=0) <= LONG:
        return runs
    return [r[i : i + LONG] for r in runs for i in range(0, max(len(r) - LONG, 0) + PACE, PACE)]


def _stem(word: str) -> str:
    return word.lower().strip(".,;:!?\"'()[]{}")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers of all words in a row, and where each word's begin. A word has as many as it has letters."""
    framed = ["\x02" + w + "\x03" if w else "\x02 \x03" for w in words]
    size = np.fromiter(map(len, framed), "int64", len(framed))
    code = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64")
    mixed = (code[:-2] * np.uint64(0x9E3779B1) + code[1:-1] * np.uint64(0x85EBCA77) + code[2:] * np.uint64(0xC2B2AE3D)) >> np.uint64(7)
    starts = np.cumsum(size) - size
    inside = np.ones(len(code), bool)
    inside[starts + size - 1] = inside[starts + size - 2] = False
    return (mixed % np.uint64(GRAMS)).astype("int64")[inside[:-2]], starts - 2 * np.arange(len(words))


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of these sizes: each window's first word (in the joined texts), its length, and its text's number."""
    count = np.where(sizes > WINDOW, -(-(sizes - WINDOW) // STRIDE) + 1, (sizes > 0).astype("int64"))
    text = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = nth * STRIDE
    return first + (np.cumsum(sizes) - sizes)[text], np.minimum(WINDOW, sizes[text] - first), text


class Network:
    """Weights and the vocabulary. Arrays are (batch, time, units)."""

    def __init__(self, vocabulary: dict[str, int], params: Params | None = None):
        self.vocabulary = vocabulary
        rng = np.random.default_rng(SEED)
        n = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype("float32")
        self.p: Params = params or {
            "word": (rng.standard_normal((WORDS, DW)) * 0.3).astype("float32"), "gram": (rng.standard_normal((GRAMS, DC)) * 0.5).astype("float32"),
            "wx": n(DW + DC, 6 * H), "b": np.zeros(6 * H, "float32"), "uf": n(H, 2 * H), "vf": n(H, H), "ub": n(H, 2 * H), "vb": n(H, H),
            "wa": n(2 * H, A), "ba": np.zeros(A, "float32"), "va": n(A), "wo": n(2 * H), "bo": np.zeros(1, "float32"),
        }
        self.p["word"][0] = 0
        self.calibration, self.prior = np.array([1.0, 0.0, 0.0]), 0.5

    def inputs(self, words: list[str], hidden: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of distinct words: their rows, trigrams and projections for both directions."""
        stems = [_stem(w) for w in words]
        ids = np.fromiter((self.vocabulary.get(s, 0) for s in stems), "int64", len(stems))
        if hidden is not None:
            ids[hidden] = 0
        g, at = grams(stems)
        count = np.diff(np.append(at, len(g)))[:, None].astype("float32")
        x = np.concatenate([self.p["word"][ids], np.add.reduceat(self.p["gram"][g], at) / count], 1)
        return {"ids": ids, "g": g, "at": at, "count": count, "x": x, "proj": (x @ self.p["wx"] + self.p["b"]).astype(self.p["wx"].dtype)}

    def _run(self, proj: np.ndarray, mask: np.ndarray, u: np.ndarray, v: np.ndarray, back: bool, tape: list | None) -> np.ndarray:
        n, steps = mask.shape
        h = np.zeros((n, H), proj.dtype)
        out = np.empty((n, steps, H), proj.dtype)
        for t in reversed(range(steps)) if back else range(steps):
            x, m = proj[:, t], mask[:, t : t + 1]
            gate = 0.5 * np.tanh(0.5 * (x[:, : 2 * H] + h @ u)) + 0.5
            z, r = gate[:, :H], gate[:, H:]
            c = np.tanh(x[:, 2 * H :] + (r * h) @ v)
            if tape is not None:
                tape.append((t, z, r, c, h))
            h = h + z * m * (c - h)
            out[:, t] = h
        return out

    def forward(self, proj: np.ndarray, mask: np.ndarray, keep: bool = False):
        p = self.p
        tf, tb = ([], []) if keep else (None, None)
        s = np.concatenate([self._run(proj[..., : 3 * H], mask, p["uf"], p["vf"], False, tf), self._run(proj[..., 3 * H :], mask, p["ub"], p["vb"], True, tb)], 2)
        k = np.tanh(s @ p["wa"] + p["ba"])
        e = k @ p["va"] + (mask - 1) * 30
        a = np.exp(e - e.max(1, keepdims=True)) * mask
        a /= a.sum(1, keepdims=True)
        pooled = (s * a[..., None]).sum(1)
        logit = pooled @ p["wo"] + p["bo"]
        return (logit, (tf, tb, s, k, a, pooled)) if keep else logit

    def _back(self, tape: list, ds: np.ndarray, mask: np.ndarray, u: np.ndarray, v: np.ndarray, dproj: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        du, dv = np.zeros_like(u), np.zeros_like(v)
        dh = np.zeros_like(tape[0][4])
        for t, z, r, c, hp in reversed(tape):
            dh = dh + ds[:, t]
            zm = z * mask[:, t : t + 1]
            dz = dh * (c - hp) * mask[:, t : t + 1] * z * (1 - z)
            dc = dh * zm * (1 - c * c)
            drh = dc @ v.T
            dr = drh * hp * r * (1 - r)
            gates = np.concatenate([dz, dr], 1)
            du += hp.T @ gates
            dv += (r * hp).T @ dc
            dproj[:, t] = np.concatenate([gates, dc], 1)
            dh = dh * (1 - zm) + drh * r + gates @ u.T
        return du, dv

    def gradients(self, inputs: dict[str, np.ndarray], at: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
        """Mean logistic loss over windows and its gradients. at: each position's row of inputs."""
        p = self.p
        logit, (tf, tb, s, k, a, pooled) = self.forward(inputs["proj"][at], mask, True)
        prob = 0.5 * np.tanh(0.5 * logit) + 0.5
        loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
        d = ((prob - y) / len(y)).astype(s.dtype)
        g: Params = {"wo": pooled.T @ d, "bo": np.array([d.sum()], s.dtype)}
        dpooled = d[:, None] * p["wo"]
        da = (s * dpooled[:, None]).sum(2)
        de = a * (da - (a * da).sum(1, keepdims=True))
        dk = de[..., None] * p["va"] * (1 - k * k)
        g["va"] = (k * de[..., None]).sum((0, 1))
        g["wa"], g["ba"] = np.einsum("bti,btj->ij", s, dk), dk.sum((0, 1))
        ds = a[..., None] * dpooled[:, None] + dk @ p["wa"].T
        dproj = np.zeros((*mask.shape, 6 * H), s.dtype)
        g["uf"], g["vf"] = self._back(tf, ds[..., :H], mask, p["uf"], p["vf"], dproj[..., : 3 * H])
        g["ub"], g["vb"] = self._back(tb, ds[..., H:], mask, p["ub"], p["vb"], dproj[..., 3 * H :])
        n = len(inputs["x"])
        flat, order = dproj.reshape(-1, 6 * H), at.ravel().argsort(kind="stable")
        seen, first = np.unique(at.ravel()[order], return_index=True)
        dp = np.zeros((n, 6 * H), s.dtype)
        dp[seen] = np.add.reduceat(flat[order], first)
        g["wx"], g["b"] = inputs["x"].T @ dp, dp.sum(0)
        dx = dp @ p["wx"].T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], inputs["ids"], dx[:, :DW])
        g["word"][0] = 0
        np.add.at(g["gram"], inputs["g"], np.repeat(dx[:, DW:] / inputs["count"], inputs["count"][:, 0].astype(int), 0))
        return loss, g

    def read(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The logit of each window of all texts, and each window's text."""
        sizes = np.fromiter(map(len, texts), "int64", len(texts))
        first, length, text = windows(sizes)
        out = np.empty(len(first), "float32")
        if not len(first):
            return out, text
        number = {w: i for i, w in enumerate(set().union(*texts))}
        rows = np.fromiter((number[w] for t in texts for w in t), "int64", int(sizes.sum()))
        proj = self.inputs(list(number))["proj"]
        steps = np.arange(WINDOW)
        order = np.argsort(length, kind="stable")  # short windows together, so that few steps are read in vain
        for i in range(0, len(order), READ):
            some = order[i : i + READ]
            t = steps[: int(length[some].max())]
            mask = (t < length[some][:, None]).astype("float32")
            out[some] = self.forward(proj[rows[np.minimum(first[some][:, None] + t, len(rows) - 1)]], mask)
        return out, text

    def scores(self, texts: list[str | None]) -> np.ndarray:
        words = [_words(t) if t else [] for t in texts]
        logit, text = self.read(words)
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, text, logit.astype("float64"))
        some = np.isfinite(worst)
        f = np.stack([worst[some], np.log(np.bincount(text, minlength=len(texts))[some]), np.ones(some.sum())], 1)
        worst[some] = 1 / (1 + np.exp(-np.clip(f @ self.calibration, -30, 30)))
        return np.where(some, worst, self.prior)


def _adam(p: Params, g: Params, state: dict, step: int) -> None:
    for k, d in g.items():
        m, v = state.setdefault(k, [np.zeros_like(d), np.zeros_like(d)])
        m += 0.1 * (d - m)
        v += 0.001 * (d * d - v)
        p[k] -= (RATE * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7) + DECAY * p[k])).astype(p[k].dtype)


def _calibrated(x: np.ndarray, windows_read: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of (worst logit, log of the number of windows, 1): a logistic fit by Newton's method with some ridge."""
    f = np.stack([x, np.log(windows_read), np.ones_like(x)], 1)
    mid, wide = f.mean(0), f.std(0) + 1e-6
    mid[2], wide[2] = 0.0, 1.0
    g, w = (f - mid) / wide, np.zeros(3)

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, g @ w).sum() - y @ (g @ w) + 0.05 * w @ w)

    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(g @ w, -30, 30)))
        step = np.linalg.solve((g * (q * (1 - q))[:, None]).T @ g + 0.1 * np.eye(3), g.T @ (q - y) + 0.1 * w)
        while loss(w - step) > loss(w) and abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
    w = w / wide
    return w - np.array([0.0, 0.0, w @ mid])


def train(texts: list[str], y: np.ndarray) -> Network:
    """A network for these texts; y is 1 for toxic. With one class only, every score is that class's share."""
    words = [_words(t or "") for t in texts]
    stems = [[_stem(w) for w in t] for t in words]
    seen = Counter(s for t in stems for s in set(t))
    known = sorted((s for s, n in seen.items() if n >= 2 and s), key=lambda s: (-seen[s], s))[: WORDS - 1]
    net = Network({s: i + 1 for i, s in enumerate(known)})
    y = np.asarray(y, "float32")
    net.prior = float(y.mean()) if len(y) else 0.0
    bad = int(y.sum())
    if not bad or bad == len(y):
        net.calibration = np.array([0.0, 0.0, 30.0 if bad else -30.0])
        return net
    toxic = Counter(s for t, label in zip(stems, y, strict=True) if label for s in set(t))
    odds = {s: np.log((toxic[s] + 0.5) / (bad + 1)) - np.log((n - toxic[s] + 0.5) / (len(y) - bad + 1)) for s, n in seen.items() if n >= 3}
    flat_odds = np.array([max(odds.get(s, 0.0), 0.0) for t in stems for s in t], "float32")
    total = np.concatenate([[0.0], np.cumsum(flat_odds, dtype="float64")])
    sizes = np.fromiter(map(len, words), "int64", len(words))
    first, length, text = windows(sizes)
    logit = (total[first + length] - total[first]).astype("float32")
    number = {w: i for i, w in enumerate(dict.fromkeys(w for t in words for w in t))}
    rows = np.fromiter((number[w] for t in words for w in t), "int64", int(sizes.sum()))
    every, steps, rng, state, step = list(number), np.arange(WINDOW), np.random.default_rng(SEED), {}, 0
    begin = np.searchsorted(text, np.arange(len(y)))
    end = np.searchsorted(text, np.arange(len(y)), "right")
    full = np.flatnonzero((end > begin) & (np.arange(len(y)) % APART > 0))
    apart = np.flatnonzero((end > begin) & (np.arange(len(y)) % APART == 0))
    if not 0 < y[full].sum() < len(full):
        full = np.flatnonzero(end > begin)
    if not 0 < y[full].sum() < len(full):
        return net
    for _ in range(ROUNDS):
        worst = np.array([begin[i] + int(logit[begin[i] : end[i]].argmax()) for i in full])
        seen_bad, seen_clean = worst[y[full] == 1], worst[y[full] == 0]
        hard = seen_clean[np.argsort(-logit[seen_clean], kind="stable")[: HARD * len(seen_bad)]]
        clean = full[y[full] == 0]
        chance = np.array([rng.integers(begin[i], end[i]) for i in rng.choice(clean, RANDOM * len(seen_bad))], "int64")
        chosen = np.concatenate([seen_bad, hard, chance])
        target = np.concatenate([np.ones(len(seen_bad), "float32"), np.zeros(len(hard) + len(chance), "float32")])
        for _ in range(EPOCHS):
            order = rng.permutation(len(chosen))
            for i in range(0, len(order), BATCH):
                some = chosen[order[i : i + BATCH]]
                mask = (steps < length[some][:, None]).astype("float32")
                at = rows[np.minimum(first[some][:, None] + steps, len(rows) - 1)]
                used, local = np.unique(at, return_inverse=True)
                inputs = net.inputs([every[k] for k in used], rng.random(len(used)) < HIDDEN_WORDS)
                _, g = net.gradients(inputs, local.reshape(at.shape), mask, target[order[i : i + BATCH]])
                step += 1
                _adam(net.p, g, state, step)
        logit, _ = net.read(words)
    if not 0 < y[apart].sum() < len(apart):
        apart = full
    top = np.array([logit[begin[i] : end[i]].max() for i in apart], "float64")
    net.calibration = _calibrated(top, (end - begin)[apart].astype("float64"), y[apart].astype("float64"))
    return net


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = MAX_LABELLED) -> tuple[list[str], np.ndarray]:
    """At most `limit` labelled texts, none of the held-out fifth; of an id's several texts the least."""
    short = docs.where(F.length("text") <= MAX_CHARS).select("doc_id", "text")
    chosen = labels.where(~held_out() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    each = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = sorted((r["doc_id"], r["text"], r["y"]) for r in each.collect())
    return [t for _, t, _ in rows], np.array([float(v > 0) for _, _, v in rows])


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = sent.value
        for whole in batches:
            size = whole[text_col].str.len().fillna(0).to_numpy().cumsum()
            at = 0
            while at < len(whole):
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_CHARS, "right")))
                part = whole.iloc[at:end]
                yield pd.DataFrame({id_col: part[id_col], "score": net.scores(part[text_col].tolist())})
                at = end

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInPandas(work, f"`{id_col}` {kind}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    network = train(*training_sample(docs, labels))
    return score(docs, network).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
