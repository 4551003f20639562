"""Small fixtures for each operator: brute force, round trips, and odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, common, exact_dedup, jaccard, language, licenses, line_dedup, mixing, quality, queries, toxicity
from tidemark.llm.components import components

TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, id long, kept string, __x string"
WORDS = re.compile(common.WORD)


def documents(spark, texts, sources=None, ids=None):
    """Documents with extra columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", s, len(t or ""), "d", -1, "k", "x") for i, t, s in zip(ids, texts, sources or itertools.repeat("s"), strict=False)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \t\n", "a", "a", "word " * 3000, "x" * 20000, "<|im_end|>", "İΣ\x00 é"]


def babble(n, seed, words=12):
    rng = random.Random(seed)
    vocabulary = [a + b for a in "bdfgklm" for b in "aeiou"]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, words))) for _ in range(n)]


# op1
def test_gradients():
    net = toxicity.Network({"bad": 1, "the": 2})
    net.p = {k: v.astype("float64") for k, v in net.p.items()}
    words, rng = ["bad", "the", "foo", "bar"], np.random.default_rng(0)
    at, y = rng.integers(0, 4, (3, 5)), np.array([1.0, 0, 1])
    mask = (np.arange(5) < np.array([5, 4, 2])[:, None]).astype("float64")
    _, g = net.gradients(net.inputs(words), at, mask, y)
    for k, p in net.p.items():
        i = int(abs(g[k].ravel()).argmax())
        was, out = p.reshape(-1)[i], []
        for step in (1e-5, -1e-5):
            p.reshape(-1)[i] = was + step
            out.append(net.gradients(net.inputs(words), at, mask, y)[0])
        p.reshape(-1)[i] = was
        assert abs((out[0] - out[1]) / 2e-5 - g[k].ravel()[i]) < 1e-6, k


def test_windows_cover_every_word():
    sizes = np.array([0, 1, 32, 33, 100])
    first, length, text = toxicity.windows(sizes)
    for k, n in enumerate(sizes):
        begin = sizes[:k].sum()
        seen = {w for f, m, t in zip(first, length, text, strict=True) if t == k for w in range(f - begin, f - begin + m)}
        assert seen == set(range(n))


def test_pieces_cover_long_words():
    for n in (1, 63, 64, 65, 96, 97, 128, 129, 1000):
        word = "".join(chr(0x4E00 + i) for i in range(n))
        pieces = toxicity._words("a " + word + " b")[1:-1]
        assert "".join(sorted(set("".join(pieces)))) == word and all(p in word and len(p) <= toxicity.LONG for p in pieces)
        assert len(pieces) == 1 or all(any(word[i : i + 32] in p for p in pieces) for i in range(n - 31))


def test_toxicity_reads_long_words_to_the_end():
    clean = babble(160, 1, 60)
    net = toxicity.train([t + (" vile scum vile" if i % 4 == 0 else "") for i, t in enumerate(clean)], np.arange(160) % 4 == 0)
    start = "_".join(babble(6, 3, 12)).replace(" ", "_")
    one, two = net.scores([start + "_" + "_".join(["bade"] * 90), start + "_" + "_".join(["vile"] * 90)])
    assert len(start.split(" ")[0]) > 64 and abs(one - two) > 1e-3


def test_toxicity(spark):
    clean = babble(160, 1, 60)
    texts = [t + (" vile scum vile" if i % 4 == 0 else "") for i, t in enumerate(clean)] + ODD
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.report(docs, labels).collect()}
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    held = [i for i in range(160) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in rows)
    assert np.mean([rows[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.9
    assert toxicity.report(docs.limit(0), labels.limit(0)).count() == 0


# op2
def brute_components(texts, ids, size, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORDS.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    at = {i: i for i in ids}

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for (i, a), (j, b) in itertools.combinations(zip(ids, sets, strict=True), 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b) and find(i) != find(j):
            at[max(find(i), find(j))] = min(find(i), find(j))
    return {(i, len(s), find(i)) for i, s in zip(ids, sets, strict=True)}


def near_copies(n, seed):
    rng, base = random.Random(seed), babble(6, seed, 90)
    out = []
    for _ in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "new"
        out.append(" ".join(words))
    return out


def test_jaccard(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG", 3)
    monkeypatch.setattr(jaccard, "CHUNK_SHINGLES", 400)
    texts = near_copies(70, 3) + ODD + babble(10, 4, 5)
    ids = list(range(len(texts)))
    rows = jaccard.report(documents(spark, texts), jaccard.Likeness(4, 85)).collect()
    assert {tuple(r) for r in rows} == brute_components(texts, ids, 4, 85) and len(rows) == len(texts)


def set_pairs(sizes, percent, seed):
    """Pairs of sets that are linked as narrowly as their sizes allow."""
    rng = np.random.default_rng(seed)
    for n in sizes:
        for m in {n, n + 1, 100 * n // percent}:
            if 100 * n >= percent * m:
                common = -(-percent * (n + m) // (100 + percent))
                u = rng.integers(0, 1 << 63, n + m - common, "uint64")
                yield np.sort(u[:n]), np.sort(np.concatenate([u[:common], u[n:]]))


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (3, 50)])
def test_linked_pairs_share_segments(size, percent):
    like = jaccard.Likeness(size, percent)
    first, _, room, spare = jaccard.schemes(like)
    for a, b in set_pairs([*range(1, 60), 99, 250, 1000], percent, size):
        if jaccard._common(a, b) == len(a) == len(b):
            continue
        key, doc, _, scheme = jaccard.segments(np.array([0, 1]), [a, b], like)
        k = int(np.searchsorted(first, max(len(a), len(b)), "right")) - 1
        met = set(key[(doc == 0) & (scheme == k)]) & set(key[(doc == 1) & (scheme == k)])
        assert len(met) >= spare[k], (len(a), len(b))
        assert max(np.bincount(scheme[doc == 0])) <= room.max()


def test_search_connects_what_brute_force_connects():
    like, rng = jaccard.Likeness(4, 85), np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (3, 80), "uint64")
    sets = []
    for _ in range(90):
        s = base[rng.integers(3)].copy()
        s[rng.integers(0, 80, rng.integers(0, 12))] = rng.integers(0, 1 << 63, 1, "uint64")
        sets.append(np.unique(s[: rng.integers(70, 81)]))
    sides = rng.integers(0, 2, len(sets)).tolist()
    for some in (None, sides):
        def joined_by(links, at):
            for i, j in links:
                old, new = at[i], at[j]
                at = [new if x == old else x for x in at]
            return [at.index(x) for x in at]

        parts = [i // 2 for i in range(len(sets))]
        every = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if (some is None or some[i] != some[j]) and like.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]
        found = jaccard.searched(sets, parts, some, like)
        assert set(map(tuple, map(sorted, found))) <= set(every) and len(found) < len(sets) <= len(every)
        assert joined_by(found, parts) == joined_by(every, parts)


def test_jaccard_leaves_only_its_results(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    out, _ = jaccard.joined_documents(documents(spark, near_copies(20, 7)), jaccard.Likeness())
    assert out.count() == 20 and len([*tmp_path.glob("jaccard-*/*")]) == 2


def test_jaccard_odd_tables(spark):
    like = jaccard.Likeness()
    assert jaccard.report(documents(spark, []), like).count() == 0
    same = documents(spark, ["a b c d e f", "a b c d e f", "x y z u v w", "x y z u v w"], ids=[5, 7, 7, None])
    got = sorted(((r[0] is None, r[0] or 0, r[2]) for r in jaccard.report(same, like).collect()), key=str)
    assert got == sorted([(False, 5, 5), (False, 7, 5), (False, 7, 5), (True, 0, None)], key=str)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {tuple(r) for r in components(links, common.Scratch(spark, "test")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


# op3
@pytest.mark.parametrize("least", [1, 16])
def test_exact(spark, monkeypatch, least):
    monkeypatch.setattr(exact_dedup, "LEAST", least)
    texts = ODD + ["a"] * 40 + babble(30, 5, 2)
    rows = exact_dedup.digests(documents(spark, texts)).collect()
    last, count = {}, {}
    for i, t in enumerate(texts):
        last[t or ""], count[t or ""] = i, count.get(t or "", 0) + 1
    want = {(i, last[t or ""], count[t or ""], last[t or ""] == i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in enumerate(texts)}
    assert {tuple(r) for r in rows} == want and len(rows) == len(texts)


def test_exact_repeated_ids(spark):
    rows = exact_dedup.digests(documents(spark, ["t", "t", "t"], ids=[4, 4, None])).collect()
    assert sorted(r["kept"] for r in rows) == [False, False, True] and {r["keep_id"] for r in rows} == {4}
    assert exact_dedup.digests(documents(spark, [])).count() == 0


# op4
def test_licenses(spark):
    plain = babble(30, 6, 200)
    texts = [p + " Released under the MIT License. " + p if i % 3 == 0 else p for i, p in enumerate(plain)] + ODD
    texts.append("Permission is hereby granted, free of charge, " + licenses.TEMPLATES["mit-permission"].split(", ", 2)[2])
    rows = {(r["doc_id"], r["template_id"]) for r in licenses.scan(documents(spark, texts)).collect()}
    assert rows == {(i, "mit-short") for i in range(0, 30, 3)} | {(len(texts) - 1, "mit-permission")}
    templates = {k: np.unique(licenses.shingles(licenses.words(t))) for k, t in licenses.TEMPLATES.items()}
    for i, text in enumerate(texts):  # exact containment over the whole text can only be larger than in a window
        have = licenses.shingles(licenses.words(text))
        assert {k for k, s in templates.items() if np.isin(s, have).mean() == 1.0} <= {k for j, k in rows if j == i}
    assert licenses.scan(documents(spark, [])).count() == 0 and licenses.scan(documents(spark, texts), {}).count() == 0
    assert 1 - (1 - 0.2) ** licenses.bands_for(0.2) >= licenses.CATCH


# op5
def test_language(spark):
    de, en = "der die das und nicht ist mit ", "the and that with this from is "
    docs = spark.createDataFrame([(i, (de if i % 2 else en) * 5, "de" if i % 2 else "en") for i in range(10)], "doc_id long, text string, lang string")
    page = lambda text, lang="": f'<html lang="{lang}"><body><p>{text}</p></body></html>'
    rows = [(1, "http://a.example.com/x", page(de * 3)), (2, "http://a.example.com/y", page(en * 3)), (3, "http://b.example.de/", ""), (4, None, None), (5, "http://c.example.com/", page("", "de"))]
    rows += [(10 + i, "http://h.example.org/", page(de * 2)) for i in range(20)] + [(40, "http://h.example.org/", None), (41, "http://h.example.org/", None)]
    got = {r["page_id"]: r["lang"] for r in language.report(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert len(got) == len(rows) and (got[1], got[2], got[3], got[5], got[40]) == ("de", "en", "de", "de", "de")
    none = language.report(spark.createDataFrame(rows[:2], "page_id long, url string, html string"), docs.limit(0))
    assert {r["lang"] for r in none.collect()} == {None}


def brute_language(model, rows):
    """Posteriors in plain Python: the fusion of module language, one page and language at a time."""
    langs, out, own = model.langs, [], []
    for _, url, html in rows:
        host = m[1].lower() if (m := re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)", url or "")) else ""
        said = m[1].lower() if (m := re.search(r"""(?i)<html[^>]*?\slang\s*=\s*["']?([a-z]+)""", html or "")) else ""
        text = re.sub(r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "\n", html or "")
        text = "\n".join(x for x in (y.strip(" \t\n\x0b\x0c\r") for y in re.split(r"(?s)<[^>]*>|\n", text)) if x)
        logs = model.likelihoods(text)
        for named, sure in ((said, language.DECLARED), (language.SUFFIXES.get(host.rsplit(".", 1)[-1]), language.SUFFIX)):
            if named in langs:
                logs = [x + np.log(sure if lang == named else (1 - sure) / max(1, len(langs) - 1)) for x, lang in zip(logs, langs, strict=True)]
        p = np.exp(np.array(logs) - max(logs))
        own.append((host, p / p.sum(), np.array(logs)))
    domain = lambda h: ".".join(h.split(".")[-(3 if re.search(rf"(^|\.)({'|'.join(language.HOLDERS)})\.[a-z]{{2}}$", h) else 2) :])
    for (i, _, _), (host, p, logs) in zip(rows, own, strict=True):
        prior = np.full(len(langs), 1 / len(langs))
        for near in (lambda h: True, lambda h, host=host: domain(h) == domain(host), lambda h, host=host: h == host):
            counts = np.maximum(sum(q for h, q, _ in own if near(h)) - p, 0)
            prior = (counts + language.STRENGTH * prior) / (counts.sum() + language.STRENGTH)
        post = np.exp(logs + np.log(prior) - max(logs + np.log(prior)))
        out.append((i, host, post / post.sum()))
    return out


@pytest.mark.parametrize("most", [10**6, 0])
def test_language_by_hand(spark, monkeypatch, most):
    monkeypatch.setattr(language, "BROADCAST_ROWS", most)
    model = language.TextModel(["der die das und nicht", "the and that with this", "les des une dans pour"], ["de", "en", "fr"])
    hosts = ["a.co.uk", "b.co.uk", "x.a.de", "y.a.de", "n.org", "m.fr", "q"]
    texts = ["der und die nicht", "the and this", "les dans une", "", "zzz", "the der les", "und " * 9000]
    rng = random.Random(3)
    rows = [(k, f"https://{rng.choice(hosts)}/p", f'<html lang="{rng.choice(["de", "xx", "fr", ""])}"><p>{rng.choice(texts)}</p>') for k in range(60)]
    rows += [(60, None, None), (61, "", ""), (5, "https://q/p", "<p>the and</p>"), (5, "https://q/p", "<p>the and</p>")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, lang string, posterior string")
    got = sorted(((r["page_id"], r["host"], r["posterior"], r["lang"]) for r in language.identify(pages, model).collect()), key=lambda r: (r[0], r[2]))
    want = sorted(((i, h, p.tolist()) for i, h, p in brute_language(model, rows)), key=lambda r: (r[0], r[2]))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for (_, _, p, lang), (_, _, q) in zip(got, want, strict=True):
        assert np.allclose(p, q, atol=1e-6) and lang == model.langs[int(np.argmax(p))]
    assert language.identify(pages.limit(0), model).count() == 0


# op6
@pytest.mark.parametrize("most", [10**6, 0])
def test_line_dedup(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", most)
    texts = [f"Menu\nown {i}\n\nown {i}" for i in range(12)] + [None, "", "Menu\nMenu"]
    hosts = ["a"] * 12 + [None, "b", "b"]
    got = {r["doc_id"]: r for r in line_dedup.clean_documents(documents(spark, texts, hosts), least=2).collect()}
    assert [got[i]["text"] for i in range(15)] == [f"own {i}\n\nown {i}" for i in range(12)] + [None, "", "Menu\nMenu"]
    assert all(r["n_chars"] == len(r["text"] or "") for r in got.values())
    assert line_dedup.clean_documents(documents(spark, [])).count() == 0


def test_line_dedup_on_small_hosts(spark):
    texts = ["Menu\na", "Menu\nb", "only\nhere", "x\ny"]
    docs = documents(spark, texts, ["two", "two", "one", None])
    assert {r["doc_id"]: r["text"] for r in line_dedup.clean_documents(docs, least=2).collect()} == {0: "a", 1: "b", 2: "only\nhere", 3: "x\ny"}
    assert {r["text"] for r in line_dedup.clean_documents(docs).collect()} == {""}  # the ratio alone: each line is on half a host's pages or more


def brute_pages(rows):
    def lines(html):
        text = re.sub(r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "\n", html or "")
        return [x for x in (y.strip(" \t\n\x0b\x0c\r") for y in re.split(r"(?s)<[^>]*>|\n", text)) if x]

    hosts = [(m[1].lower() if (m := re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)", u or "")) else "") for _, u, _ in rows]
    on = {}
    for h, (_, _, html) in zip(hosts, rows, strict=True):
        for x in set(lines(html)):
            on[h, x] = on.get((h, x), 0) + 1
    out = []
    for h, (i, _, html) in zip(hosts, rows, strict=True):
        kept = [x for x in lines(html) if on[h, x] <= 0.1 * hosts.count(h)]
        out.append((i, h, len(lines(html)), len(lines(html)) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_pages_report(spark):
    rows = [(i, f"HTTP://A.com:80/{i}", f"<p>Menu</p><script>no</script><p>own {i}</p><!-- x --><b>{'often' if i % 9 == 0 else 'text'}</b>") for i in range(30)]
    rows += [(90, None, None), (90, None, None), (91, "", "<p></p>"), (None, "http://b.org", "line " * 20000)]
    pages = spark.createDataFrame([(*r, "h", "l") for r in rows], "page_id long, url string, html string, host string, lines string")
    assert sorted((tuple(r) for r in line_dedup.pages_report(pages).collect()), key=str) == brute_pages(rows)
    assert line_dedup.pages_report(pages.limit(0)).count() == 0


def test_op6_keeps_lines_of_one_page(spark, tmp_path):
    """On hosts of fewer than ten pages too, and its SQL does."""
    texts = {1: ("a.com", ["Menu", "own 1"]), 2: ("a.com", ["Menu", "own 2"]), 3: ("a.com", ["Menu", "own 1"]), 4: ("b.org", ["alone", "here"])}
    rows = [(i, f"http://{host}/{i}", "<br>".join(lines)) for i, (host, lines) in texts.items()]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    want = [(1, "a.com", 2, 2, ""), (2, "a.com", 2, 1, "own 2"), (3, "a.com", 2, 2, ""), (4, "b.org", 2, 0, "alone\nhere")]
    assert sorted(map(tuple, queries.op6_line_dedup(spark, str(tmp_path)).collect())) == want
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        assert sorted(con.sql(queries.ORACLES["op6_line_dedup"]).fetchall()) == want


CLASHING = ["epochs", "n_blocks", "last_block", "last_doc", "row", "host", "lines", "kept", "here", "gone", "line", "at", "__source", "__tokens", "__key", "__copies", "__m_w", "__m_text", "__m_kept", "tokens", "mix_epoch", "epoch", "order", "token_ids", "size"]


def test_columns_of_any_name_pass(spark, tmp_path):
    docs = documents(spark, [f"Menu\nsome text of document {i} that is a little longer than ten words" for i in range(12)])
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    docs = docs.drop("kept").withColumn("kept", F.lit("own kept"))
    done = [line_dedup.clean_documents(docs), quality.kept_documents(docs, []), mixing.mixed_documents(docs, 2.0), mixing.mixed(docs, repeats=2.0), bpe.round_trip(docs, TOKENIZER), jaccard.one_of_each_group(docs, jaccard.Likeness())]
    for d in done:
        rows = d.collect()
        assert len(rows) == 12 and d.columns[: len(docs.columns)] == docs.columns
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHING)
    assert {"mix_epoch_", "token_ids_"} <= {c for d in done for c in d.columns}


# op7
def test_bpe_matches_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    known = tokenizers.Tokenizer.from_file(TOKENIZER)
    rng = random.Random(2)
    letters = "abcdefghinorstuthehe'.,!?0123éüñßΣςİ𝔘你🙂́\x1c\x85\xa0 \n<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 8, 40, 300]))) for _ in range(300)]
    texts += [t + "<|endoftext|>" + t for t in texts[:20]] + ODD + ["th" * 4000, "a" * 5000]
    rows = {r["doc_id"]: r for r in bpe.digests(documents(spark, texts), TOKENIZER).collect()}
    for i, t in enumerate(texts):
        ids = known.encode(t or "", add_special_tokens=False).ids
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(known.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(documents(spark, []), TOKENIZER).count() == 0


def test_bpe_streams_long_texts(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    known = tokenizers.Tokenizer.from_file(TOKENIZER)
    with open(TOKENIZER, "rb") as f:
        codec = bpe.Codec(f.read())
    unbroken = "the.quick-brown\u00a0fox" * 2000 + "e\u0301" * 3000 + "<|endoftext|>" + "th" * 4000 + "<|" + "\u4f60\u597d" * 3000
    texts = [unbroken, " ".join([*babble(3000, 5), unbroken, "tail"]), unbroken + "\n" + unbroken.upper()]
    whole = [codec.encode(t) for t in texts]
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    monkeypatch.setattr(bpe, "PART", 50)
    monkeypatch.setattr(bpe, "LONG_CHUNK", 64)
    for t, ids in zip(texts, whole, strict=True):
        got = codec.encode(t)
        assert got == ids == known.encode(t, add_special_tokens=False).ids
        assert codec.decode(got) == known.decode(got, skip_special_tokens=False)


def test_transducer_parts_and_utf8():
    with open(TOKENIZER, "rb") as f:
        v = bpe.Vocabulary(f.read())
    text, rng = "thethanreinering" * 300, random.Random(1)
    want = [v.ids[t] for t in v.merged([*text[:-1], text[-1] + v.end])]
    t, got, at, most = bpe.Transducer(v), [], 0, 0
    while at < len(text):
        n = rng.randint(1, 400)
        got += t.push(list(text[at : at + n]))
        at, most = at + n, max(most, len(t.held))
    assert got + [*t.finish()] == want and most <= 2 * t.room
    data = "aé你🙂".encode() + b"\xff" + "z".encode()
    m = bpe.Utf8Machine()
    assert "".join([*(m.push(bytes([b])) for b in data), m.finish()]) == data.decode("utf-8", "replace")


# op8
def test_chat(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 2, "assistant", r"c<|im_sep|>\<\|x"), (2, None, None, "t"), (2, 5, "a\nb%0A", "<|im_end|>\n"), (None, 1, "user", "u"), (None, 1, "user", "u")]
    done = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in done.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_texts(F.col("formatted"), chat.loss_spans(F.col("loss_mask"))).alias("loss")).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", ""), ("assistant", "b"), ("assistant", r"c<|im_sep|>\<\|x")] and got[1]["loss"] == ["b", r"c<|im_sep|>\<\|x"]
    assert got[1]["formatted"].count("<|im_start|>") == 2 and sum(m["chars"] for m in got[1]["loss_mask"]) == len(got[1]["formatted"])
    assert [tuple(t) for t in got[2]["turns"]] == [("", "t"), ("a\nb%0A", "<|im_end|>\n")] and len(got[None]["turns"]) == 2
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r["n_turns"] for r in chat.digests(empty).collect()] == [2]


# op9
def test_mixing(spark):
    texts = babble(400, 8, 30) + ["", None]
    sources = ["big"] * 300 + ["mid"] * 80 + ["small"] * 20 + ["none", None]
    rows = mixing.report(documents(spark, texts, sources), 3.0).collect()
    tokens = {s: sum(len(WORDS.findall(t or "")) for t, x in zip(texts, sources, strict=True) if x == s) for s in set(sources)}
    low, high = 0.0, 1.0
    for _ in range(80):  # the least exponent with (largest / smallest) ** (1 - exponent) <= 3
        mid = (low + high) / 2
        low, high = (low, mid) if (tokens["big"] / tokens["small"]) ** (1 - mid) <= 3 else (mid, high)
    used = {s: sum(r["n_tokens"] for r in rows if r["source"] == s) for s in tokens}
    for s in ("big", "mid", "small"):
        want = tokens[s] ** high * tokens["big"] ** (1 - high)
        assert want - 1e-6 <= used[s] <= want + 31, s
    assert {r["doc_id"] for r in rows} == set(range(402)) and max(r["epoch"] for r in rows) <= 3
    assert len({(r["doc_id"], r["epoch"]) for r in rows}) == len(rows)
    assert mixing.report(documents(spark, []), 2.0).count() == 0
    totals = spark.createDataFrame([(900,), (100,)], "tokens long")
    a = mixing.exponent(totals, entropy=0.5)
    p = np.array([0.9, 0.1]) ** a
    assert abs(-(p / p.sum() * np.log(p / p.sum())).sum() - 0.5) < 1e-6


# op10
def brute_measures(text):
    text = text or ""
    words, lines, seen, dup = WORDS.findall(text), text.split("\n"), set(), 0
    for line in lines:
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(words) - 4):
        where.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality(spark):
    good, bad = babble(120, 9, 80), [t.replace(" ", "## ") for t in babble(60, 10, 80)]
    texts = good + bad + ODD + ["a b c d e f a b c d e f\nx\nx\n\n\n", "one two three four five six " * 4]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(180)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in quality.report(docs, labels).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_measures(t), t
        assert not (r["base_failed"] and r["kept"])
    assert all(rows[i]["kept"] for i in range(120) if not rows[i]["base_failed"])
    assert not any(rows[i]["kept"] for i in range(120, 180) if rows[i]["n_words"] > 12)
    assert quality.report(docs.limit(0), labels).count() == 0 and quality.learn([]) == []
    kept = quality.kept_documents(docs, [])
    assert kept.columns == docs.columns and kept.count() == sum(not brute_measures(t)[5] for t in texts)
