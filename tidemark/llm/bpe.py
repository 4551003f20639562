"""Byte-pair encoding and decoding of whole texts by a streaming transducer with bounded lookahead.

A merge at a boundary can only be undone by the text to its right through a chain of merges of ever higher
priority. :func:`sufficient_lookahead` walks these chains once over the merge list and gives the number of
symbols after which a token can't change any more. :class:`Transducer` holds no more symbols than that (plus a
constant), emits each token as soon as it is stable, and so encodes a piece of any length in constant memory.
:class:`Utf8Machine` turns bytes back to text and keeps at most three bytes between calls.

A piece that ends within the lookahead has no stable token before its end; such pieces are finished many at a time.
A long text is read part by part (:meth:`Codec.stream`): beside the row's own text, ids and decoded text, only a part and
the normal form of one unbroken run are held. A row's columns are whole values, so that much is not constant.

Null texts count as empty and have no tokens. Every row yields one row, repeated rows and rows without an id too; other
columns pass unchanged, whatever their names. Texts are read whole. Merges of equal rank go from left to right. An empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import itertools
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, give_back, small_batches

#: White space as Unicode defines it; no piece crosses it.
CHUNK = re.compile("[^\x09-\x0d\x20\x85\xa0  -     　]+")
#: Entries of a worker's memos; they go at the end of each task.
MEMO = 50_000
#: Pieces of up to so many bytes are merged in batches.
SHORT = 32
#: Rows and characters that are encoded together.
ROWS_OUT, CHARS_OUT = 2048, 500_000
#: A text of more characters is encoded in parts of so many chunks; a chunk of more characters is never held in pieces.
LONG_TEXT, PART, LONG_CHUNK = 500_000, 20_000, 4096
#: Marks that often end a word.
MARKS = (".", ",", "!", "?", ";", ":")
#: The rank of a pair that never merges.
NONE = 1 << 40


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(shifted)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], length: dict[str, int]) -> int:
    """Symbols to the right of a boundary that can decide whether a merge crosses it.

    Rule r = (x, y) needs y whole. Only a rule of higher priority whose left part is y or lies on y's right edge
    can take that edge away, and it needs its own right part whole in turn. Priorities rise strictly along such
    a chain, so one pass in order of priority finds the longest reach."""
    edge = {s: (s,) for s in length}
    reach: dict[str, int] = {}
    most = 1
    for x, y in merges:
        r = length[y] + max((reach.get(s, 0) for s in edge[y]), default=0)
        most = max(most, r)
        reach[x] = max(reach.get(x, 0), r)
        edge[x + y] = tuple(dict.fromkeys((x + y, *edge[y], *edge.get(x + y, ()))))  # several rules may make one token
    return most


class Vocabulary:
    """A tokenizer file's merge list, ids and splitting rules. The driver reads the file and sends what comes out: reading it
    takes more memory than keeping it, in each of a machine's workers."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are read")
        self.ids: dict[str, int] = dict(model["vocab"])
        self.end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        one = {t: t for t in self.ids}  # a text that stands in many rules is held once
        self.rank = {(one.get(x, x), one.get(y, y)): i for i, (x, y) in enumerate(merges)}
        self.length = {t: len(t.removesuffix(self.end)) if self.end else len(t) for t in self.ids}
        self.longest = max(self.length.values())
        self.lookahead = sufficient_lookahead(merges, self.length)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        self.text = {i: t for t, i in self.ids.items()} | {i: t for t, i in special.items()}
        self.control = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split, self.lower, self.nfc = self._rules(spec)
        self.decoder = (spec.get("decoder") or {}).get("type")
        self.symbol = byte_symbols()
        self.byte = {s: bytes([b]) for b, s in enumerate(self.symbol)}

    @staticmethod
    def _rules(spec: dict) -> tuple[regex.Pattern, bool, bool]:
        norm = spec.get("normalizer") or {}
        kinds = [n["type"] for n in norm.get("normalizers", [norm] if norm else [])]
        pre = spec.get("pre_tokenizer") or {}
        parts = pre.get("pretokenizers", [pre])
        pattern = next((p["pattern"]["Regex"] for p in parts if p.get("type") == "Split"), None)
        if pattern is None or not set(kinds) <= {"NFC", "Replace", "Lowercase"}:
            raise ValueError("this file splits or normalises in a way that is not read")
        return regex.compile(pattern), "Lowercase" in kinds, "NFC" in kinds

    def bytes_of(self, i: int) -> bytes:
        token = self.text[i]
        if token in self.special:
            return token.encode()
        bare = token.removesuffix(self.end) if self.end else token
        return b"".join(map(self.byte.__getitem__, bare)) + b" " * (bare != token)

    def merged(self, symbols: list[str]) -> list[str]:
        """The merge list applied to these symbols: lowest rank first, then leftmost."""
        n = len(symbols)
        rank = self.rank
        if n < 24:
            parts = symbols[:]
            while len(parts) > 1:
                best, at = min((rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best == 1 << 60:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return parts
        parts, right, left = symbols[:], [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if parts[i] == a else -1
            if j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
                if (r := rank.get((parts[i], parts[right[j]]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[right[j]]))
            if left[i] >= 0 and (r := rank.get((parts[left[i]], parts[i]))) is not None:
                heapq.heappush(heap, (r, left[i], parts[left[i]], parts[i]))
        return [p for p in parts if p]


class Transducer:
    """Encodes one piece, pushed in parts of any size."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.held: list[str] = []
        self.room = 2 * (vocabulary.lookahead + vocabulary.longest) + 2

    def push(self, symbols: list[str]) -> Iterator[int]:
        for i in range(0, len(symbols), self.room):
            self.held += symbols[i : i + self.room]
            if len(self.held) > self.room:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        safe, done = len(self.held) - self.v.lookahead - 1, 0
        for token in self.v.merged(self.held):
            if done + self.v.length[token] > safe:
                break
            done += self.v.length[token]
            yield self.v.ids[token]
        del self.held[:done]

    def finish(self) -> Iterator[int]:
        if self.held:
            self.held[-1] += self.v.end
            yield from (self.v.ids[t] for t in self.v.merged(self.held))
            self.held = []


class Utf8Machine:
    """Bytes to text in parts; an unfinished character waits, a wrong byte gives U+FFFD."""

    def __init__(self):
        self.wait = b""

    def push(self, data: bytes) -> str:
        data = self.wait + data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):  # a character that began in the last three bytes may be unfinished
            b = data[-back]
            if b >= 0xC0:
                if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4):
                    cut -= back
                break
            if b < 0x80:
                break
        self.wait = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.wait = self.wait.decode("utf-8", "replace"), b""
        return out


class Codec:
    """Encodes and decodes whole texts; holds bounded memos of chunks and pieces.

    Pieces that fit the transducer's window are merged together, one numpy step for each merge of all of them;
    longer ones go through :class:`Transducer`."""

    def __init__(self, source: bytes | Vocabulary):
        self.v = v = Vocabulary(source) if isinstance(source, bytes) else source
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.start_id = np.array([v.ids[s] for s in v.symbol], "int64")
        self.last_id = np.array([v.ids[s + v.end] for s in v.symbol], "int64")
        self.plain_words = all(v.split.findall(t) == w for t, w in (("ab", ["ab"]), ("ab" + MARKS[0], ["ab", MARKS[0]])))
        n = len(v.rank)
        keys, ranks, made = (np.fromiter(c, "int64", n) for c in ((v.ids[x] << 20 | v.ids[y] for x, y in v.rank), v.rank.values(), (v.ids[x + y] for x, y in v.rank)))
        order = keys.argsort()
        self.keys, self.ranks = keys[order], ranks[order]
        self.made = np.empty(n, "int64")
        self.made[ranks] = made

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def _merge_all(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of many short pieces."""
        n = len(pieces)
        size = np.fromiter(map(len, pieces), "int64", n)
        width = int(size.max())
        flat = np.frombuffer(b"".join(pieces), "uint8")
        row, ends = np.repeat(np.arange(n), size), np.cumsum(size)
        ids = np.full((n, width + 1), -1, "int64")
        ids[row, np.arange(len(flat)) - np.repeat(ends - size, size)] = self.start_id[flat]
        ids[np.arange(n), size - 1] = self.last_id[flat[ends - 1]]
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        live, columns = np.arange(n), np.arange(width)
        work_i, work_r = ids, rank
        while len(live) and width > 1:
            at = work_r.argmin(1)
            every = np.arange(len(live))
            best = work_r[every, at]
            go = best < NONE
            if not go.all():
                ids[live[~go], :] = work_i[~go]
                live, work_i, work_r, at, best = live[go], work_i[go], work_r[go], at[go], best[go]
                every = every[: len(live)]
                if not len(live):
                    break
            late = columns >= at[:, None] + 1
            moved = np.full_like(work_i, -1)
            moved[:, :-1] = np.where(late, work_i[:, 1:], work_i[:, :-1])
            moved[every, at] = self.made[best]
            shifted = np.full_like(work_r, NONE)
            shifted[:, :-1] = np.where(late[:, :-1], work_r[:, 1:], work_r[:, :-1])
            shifted[every, at] = self._rank(moved[every, at], moved[every, at + 1])
            before = at > 0
            shifted[every[before], at[before] - 1] = self._rank(moved[every[before], at[before] - 1], moved[every[before], at[before]])
            work_i, work_r = moved, shifted
        filled = ids >= 0
        out, stop = ids[filled].tolist(), np.cumsum(filled.sum(1)).tolist()
        return [tuple(out[i:j]) for i, j in zip([0, *stop], stop, strict=False)]

    def _long(self, piece: str) -> Iterator[int]:
        t, sym = Transducer(self.v), self.v.symbol
        for i in range(0, len(piece), 4096):
            yield from t.push([sym[b] for b in piece[i : i + 4096].encode("utf-8", "replace")])
        yield from t.finish()

    def _parts(self, chunk: str) -> Iterator[str | int]:
        """What lies between control strings, and the ids of these."""
        at = 0
        if self.v.control is not None and "<|" in chunk:
            for m in self.v.control.finditer(chunk):
                yield chunk[at : m.start()]
                yield self.v.special[m[0]]
                at = m.end()
        yield chunk[at:] if at else chunk

    def _normal(self, text: str) -> str:
        if not text.isascii():
            if self.v.nfc:
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ") if self.v.lower else text  # one letter at a time: no final sigma
        return text.lower() if self.v.lower else text

    def _split(self, text: str) -> list[str]:
        text = self._normal(text)
        if self.plain_words:  # what the pattern gives for letters only, and for letters with one mark behind
            if text.isalpha():
                return [text]
            if text[-1:] in MARKS and text[:-1].isalpha():
                return [text[:-1], text[-1]]
        return self.v.split.findall(text)

    def learn(self, chunks: set[str]) -> None:
        """Puts these chunks into the memo."""
        older, memo = self.older, self.memo
        parts: dict[str, list[str | int]] = {}
        for chunk in chunks:
            got = older.get(chunk)
            if got is not None:
                memo[chunk] = got
            else:
                parts[chunk] = [x for p in self._parts(chunk) for x in (self._split(p) if p.__class__ is str else (p,))]
        pieces = self.pieces
        new = {x for own in parts.values() for x in own if x.__class__ is str and x not in pieces}
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for x in new:
            b = x.encode("utf-8", "replace")
            if len(b) <= SHORT:
                groups.setdefault((len(b) + 3) // 4, []).append((x, b))
            else:
                pieces[x] = tuple(self._long(x))
        for g in groups.values():
            for i in range(0, len(g), 20_000):
                some = g[i : i + 20_000]
                pieces.update(zip((x for x, _ in some), self._merge_all([b for _, b in some]), strict=True))
        for chunk, own in parts.items():
            memo[chunk] = pieces[own[0]] if len(own) == 1 and own[0].__class__ is str else tuple(i for x in own for i in (pieces[x] if x.__class__ is str else (x,)))

    def rest(self) -> None:
        """Bounds the memos: the newer half stays at hand."""
        if len(self.memo) > MEMO:
            self.older, self.memo = self.memo, {}
        if len(self.pieces) > MEMO:
            self.pieces = {}
        if sum(map(len, (long := [c for c in self.memo if len(c) > 4 * SHORT]))) > MEMO:
            for c in long:
                del self.memo[c]

    def forget(self) -> None:
        """Empties the memos: a worker that goes on to other stages keeps the vocabulary only."""
        self.memo, self.older, self.pieces = {}, {}, {}

    def stream(self, text: str) -> Iterator[int]:
        """Ids of a text of any length; holds PART chunks, or the normal form of one long chunk, and the memos."""
        found = CHUNK.finditer(text)
        while some := [*itertools.islice(found, PART)]:
            self.learn({m[0] for m in some if m.end() - m.start() <= LONG_CHUNK}.difference(self.memo))
            for m in some:
                if m.end() - m.start() <= LONG_CHUNK:
                    yield from self.memo[m[0]]
                    continue
                for part in self._parts(m[0]):
                    if part.__class__ is str:
                        for piece in self.v.split.finditer(self._normal(part)):
                            yield from self._long(piece[0])
                    else:
                        yield part
            self.rest()

    def encode_all(self, texts: list[str | None]) -> Iterator[Sequence[int]]:
        cut = [CHUNK.findall(t) if t and len(t) <= LONG_TEXT else () for t in texts]
        self.learn(set().union(*cut).difference(self.memo))
        get = self.memo.__getitem__
        done = [array("i", itertools.chain.from_iterable(map(get, chunks))) for chunks in cut]
        self.rest()
        for text, ids in zip(texts, done, strict=True):
            yield array("i", self.stream(text)) if text and len(text) > LONG_TEXT else ids

    def encode(self, text: str | None) -> list[int]:
        return next(iter([*self.encode_all([text])])).tolist()

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids. Without a decoder in the file, tokens are joined by a space, as its library does."""
        m, out, v = Utf8Machine(), [], self.v
        for k in range(0, len(ids), 4096):
            some = ids[k : k + 4096]
            if v.decoder is None:
                out.append(m.push(((" " if k else "") + " ".join(map(v.text.__getitem__, some))).encode()))
            else:
                out.append(m.push(b"".join(map(v.bytes_of, some))))
        return "".join([*out, m.finish()])


@functools.lru_cache(2)
def _codec(digest: str, sent) -> Codec:
    return Codec(sent())


class _Shipped:
    """A broadcast of the vocabulary that stays out of the cache key."""

    def __init__(self, sent):
        self.sent = sent

    def __call__(self) -> Vocabulary:
        return self.sent.value

    def __hash__(self):
        return 0

    def __eq__(self, other):
        return isinstance(other, _Shipped)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of ROWS_OUT rows and about CHARS_OUT bytes of text at most."""
    size = np.cumsum(np.array(pc.binary_length(batch.column(column)).fill_null(0), "int64")) if batch.num_rows else []
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        n = max(1, min(ROWS_OUT, int(np.searchsorted(size, before + CHARS_OUT, "right")) - at))
        yield batch.slice(at, n)
        at += n


def round_trip(docs: DataFrame, tokenizer: str, text_col: str = "text", ids_as: str = "token_ids", text_as: str = "decoded_text") -> DataFrame:
    """All columns of docs, the ids of each whole text, and the text that these ids decode to.

    tokenizer is the path of a tokenizer file that the driver reads; its rules go to the workers by
    broadcast (a vocabulary, so of fixed size). Where docs has a column of a new name, that name gets an underscore."""
    small_batches(docs.sparkSession)
    with open(tokenizer, "rb") as f:
        raw = f.read()
    digest, shipped = hashlib.sha256(raw).hexdigest(), _Shipped(docs.sparkSession.sparkContext.broadcast(Vocabulary(raw)))
    kept = docs.columns
    ids_as, text_as = free_name(ids_as, kept), free_name(text_as, kept)
    at = kept.index(text_col)
    out_schema = T.StructType([*docs.schema.fields, T.StructField(ids_as, T.ArrayType(T.IntegerType(), False)), T.StructField(text_as, T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(digest, shipped)
        gc.disable()  # the memos hold no cycles, and walking them at each collection costs more than the work
        try:
            for whole in batches:
                for batch in slices(whole, at):
                    flat, ends, texts = [], [0], []
                    for ids in codec.encode_all(batch.column(at).to_pylist()):
                        flat.append(np.array(ids, "int32"))
                        ends.append(ends[-1] + len(ids))
                        texts.append(codec.decode(ids))
                    tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.array([], "int32")))
                    yield pa.RecordBatch.from_arrays([*batch.columns, tokens, pa.array(texts, pa.string())], names=[*kept, ids_as, text_as])
        finally:
            codec.forget()
            gc.enable()  # the worker goes on to other stages
            give_back()

    return docs.mapInArrow(work, out_schema)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, one row for each document."""
    done = round_trip(docs.select("doc_id", "text"), tokenizer)
    return done.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded_text", 256).alias("decoded_sha256"),
    )
