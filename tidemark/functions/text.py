"""Normalisers and cleaners: Column in, Column out. Everything but NFKC, NFKD and mojibake repair is a built-in expression."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed


def _sub(c: Column, pattern: str, by: str = "", flags: str = "iuU") -> Column:
    return F.regexp_replace(c, f"(?{flags}){pattern}", by)


def _full(c: Column, pattern: str, flags: str = "iuU") -> Column:
    return c.rlike(rf"(?{flags})^(?:{pattern})\z")


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once: written out, nested cleaners would double their input at each step."""
    return F.get(F.transform(F.array(c), f), 0)


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores behind it until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def where_signs(c: Column, sign: str, f: Callable[[Column], Column]) -> Column:
    """f(c) where the sign is in c, else c: most texts have nothing to clean, and one search tells that for many patterns."""
    return let(c, lambda x: F.when(x.rlike(f"(?iuU){sign}"), f(x)).otherwise(x))


def blank_to_null(c: Column) -> Column:
    return let(c, lambda x: F.when(x != "", x))


def clean_text(c: Column) -> Column:
    """Null becomes empty, white space single."""
    return F.trim(_sub(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " ", "U"))


def folded_case(c: Column) -> Column:
    """Lower case, with the one common letter where case folding differs from it."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def without_accents(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, case folded."""
    return s.map(lambda x: "" if x is None else "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)).casefold())


@F.pandas_udf(T.StringType())
def repair_mojibake(s: pd.Series) -> pd.Series:
    """Cyrillic that was read as Latin-1: read again if most letters are accented and most would be Cyrillic."""

    def mostly(text: str, low: str, high: str) -> bool:
        letters = [ch for ch in text if ch.isalpha() and (ch.isascii() or low <= ch <= high)]
        odd = sum(not ch.isascii() for ch in letters)
        return odd >= 5 and 2 * odd >= len(letters)

    def repaired(text: str | None) -> str | None:
        if text is None or text.isascii() or not mostly(text, "À", "ÿ"):
            return text
        try:
            again = text.encode("latin-1").decode("cp1251")
        except UnicodeError:
            return text
        return again if mostly(again, "Ѐ", "ӿ") else text

    return s.map(repaired)


def clean_optional(c: Column, unicode_forms: bool = True) -> Column:
    """Clean text or null; words that mean nothing are null. unicode_forms=False leaves out the Python step."""
    c = repair_mojibake(nfkc(c.cast("string"))) if unicode_forms else c.cast("string")
    c = F.trim(_sub(_sub(c, r"[\x00-\x08\x0b-\x1f]", "", "U"), r"\s+", " ", "U"))
    return let(c, lambda x: F.when((x != "") & ~folded_case(x).isin(fixed.NULL_WORDS), x))


def strip_marks(c: Column) -> Column:
    return F.btrim(c, F.lit(fixed.EDGE_MARKS))


def _noise_pass(c: Column) -> Column:
    c = _sub(_sub(c, fixed.BRACKETED_NOISE, " "), fixed.TRAILING_NOISE)
    c = _sub(_sub(c, fixed.KEY_SUFFIX), fixed.MASTER_SUFFIX, "", "U")
    c = _sub(_sub(c, fixed.TECHNICAL_SUFFIX), fixed.EMPTY_BRACKETS, " ")
    return _sub(_sub(c, r"([\[(])\s+", "$1"), r"\s+([\])])", "$1")


def _noise_passes(c: Column) -> Column:
    """Passes until one changes nothing. Each that changes a text shortens it, so its length bounds their number."""
    def step(acc: Column, _: Column) -> Column:
        # Bytes are known without reading a text: comparing texts in every step that is left would make the whole quadratic.
        settled_now = F.octet_length(acc["text"]) == F.octet_length(acc["before"])
        return F.when(settled_now, acc).otherwise(F.struct(_noise_pass(acc["text"]).alias("text"), acc["text"].alias("before")))

    def settled(x: Column) -> Column:
        first = F.struct(x.alias("text"), F.lit(None).cast("string").alias("before"))
        return F.aggregate(F.sequence(F.lit(0), F.length(x)), first, step, lambda acc: acc["text"])

    return where_signs(c, fixed.NOISE_SIGN, lambda x: let(_sub(_sub(_sub(x, fixed.DOMAIN, " "), fixed.BPM, " "), fixed.EMPTY_BRACKETS, " "), settled))


def remove_noise(c: Column) -> Column:
    return strip_marks(_sub(_noise_passes(c), r"\s+", " ", "U"))


def noise_settled(c: Column) -> Column:
    """Whether another pass would change nothing."""
    return let(_noise_passes(c), lambda x: x == _noise_pass(x))


def clean_artist(c: Column, unicode_forms: bool = True) -> Column:
    c = clean_optional(c, unicode_forms)
    c = _sub(_sub(c, fixed.PRICE_PREFIX), fixed.CODE_PREFIX)
    guests = lambda x: _sub(_sub(_sub(x, fixed.PRODUCER, " "), fixed.FEATURE, " feat. "), fixed.DASHED_FEATURE, " feat. $1")
    return blank_to_null(clean_text(where_signs(remove_noise(_sub(c, fixed.AUDIO_SUFFIX)), fixed.GUEST_SIGN, guests)))


def clean_album(c: Column, unicode_forms: bool = True) -> Column:

    def named(done: Column) -> Column:
        key = folded_case(F.btrim(done, F.lit("<>[]{}() ")))
        return F.when(~(key.isin(fixed.GENERIC_ALBUMS) | key.startswith("atualizando -")) & (done != ""), done)

    def shared(c: Column) -> Column:
        return F.when(~c.rlike(f"(?iuU){fixed.VIA}"), let(remove_noise(_sub(_sub(c, fixed.AUDIO_SUFFIX), fixed.HANDLE, " ")), named))

    return let(clean_optional(c, unicode_forms), shared)


def clean_title(c: Column, artist: Column, unicode_forms: bool = True) -> Column:
    c = remove_noise(_sub(clean_optional(c, unicode_forms), fixed.AUDIO_SUFFIX))

    def spaced(x: Column) -> Column:
        single = _sub(_sub(x, r"_+(?=[\s(\[\-–—|])", " "), r"(?<=[\s)\]\-–—|])_+", " ")
        return F.when(F.length(x) - F.length(F.replace(x, F.lit("_"), F.lit(""))) >= 2, F.translate(x, "_", " ")).otherwise(single)

    def credits(x: Column) -> Column:
        return let(_sub(_sub(_sub(_sub(x, fixed.PRODUCER, " "), fixed.BARE_PRODUCER), fixed.LEET_YEAR, " ", "U"), fixed.DRM), spaced)

    c = remove_noise(where_signs(c, fixed.CREDIT_SIGN, credits))
    c = where_signs(c, fixed.VERSION_SIGN, lambda x: _sub(_sub(_sub(x, fixed.TRACK_PREFIX), fixed.DASHED_VERSION, " $1"), fixed.QUOTED_TITLE, "$1"))

    def without_artist(s: Column) -> Column:
        """Patterns made of the artist: only for rows where the artist occurs, as each value compiles anew."""
        title, name = s["title"], s["artist"]
        quoted = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
        tail = F.concat(F.lit(r"(?iuU)\s*[\[(]\s*"), quoted, F.lit(rf"\s*[-–—|]\s*{fixed.KEY}(?:\s*-\s*\d+){{0,3}}\s*[\])]\s*$"))
        head = F.concat(F.lit("(?iuU)^"), quoted, F.lit(r"\s*[-–—]\s*"))
        own = F.regexp_replace(F.regexp_replace(title, tail, F.lit("")), head, F.lit(""))
        return F.struct(F.when(name.isNotNull() & F.contains(F.lower(title), F.lower(name)), own).otherwise(title).alias("title"), name.alias("artist"))

    def split_off(s: Column) -> Column:
        left, right = F.regexp_extract(s["title"], r"(?s)^(.+?)\s*[-–—]\s*(.+)\z", 1), F.regexp_extract(s["title"], r"(?s)^(.+?)\s*[-–—]\s*(.+)\z", 2)
        return F.when(s["title"].rlike("[-–—]") & (right != "") & (folded_case(clean_artist(left, False)) == folded_case(s["artist"])), right).otherwise(s["title"])

    both = F.struct(c.alias("title"), artist.alias("artist"))
    return blank_to_null(F.btrim(clean_text(let(let(both, without_artist), split_off)), F.lit(" -–—|_")))


def clean_genre(c: Column, names: list[str] | None = None, unicode_forms: bool = True) -> Column:
    """Genre name; numeric codes are looked up in `names`, and are unknown beyond it."""
    table = F.array(*[F.lit(n) for n in names or ["Unknown"]])

    def named(x: Column) -> Column:
        code = F.regexp_extract(x, r"^\(?([0-9]{1,3})\)?\z", 1)
        return F.when(code != "", F.coalesce(F.get(table, code.try_cast("int")), F.lit("Unknown"))).otherwise(x)

    def useful(x: Column) -> Column:
        halves = F.split(x, " ")
        doubled = (F.size(halves) == 2) & (folded_case(F.get(halves, 0)) == folded_case(F.get(halves, 1)))
        useless = folded_case(x).isin(fixed.GENERIC_GENRES) | x.rlike("^[@#]") | x.rlike(f"(?iuU){fixed.DOMAIN}") | _full(x, "[A-Za-z0-9_.-]+official")
        return F.when(~useless, F.when(doubled, F.get(halves, 0)).otherwise(x))

    return let(let(clean_optional(c, unicode_forms), named), useful)


def positive_integer(c: Column) -> Column:
    return let(c.try_cast("int"), lambda n: F.when(n > 0, n))


def clean_date(c: Column, unicode_forms: bool = False) -> Column:
    return let(clean_optional(c, unicode_forms), lambda x: F.when(x.rlike(r"^\d{4}(?:-\d{2}(?:-\d{2})?)?\z"), x))


def clean_reason(c: Column, unicode_forms: bool = False) -> Column:
    return F.rtrim(F.left(clean_optional(c, unicode_forms), F.lit(300)))


OUTPUT_FIELDS = ["title", "artist", "album_artist", "album", "date", "track_number", "disc_number", "genre", "compilation", "needs_review", "review_reason", "excluded", "exclusion_reason"]


def cleaned(rows: DataFrame, unicode_forms: bool = True, genre_names: list[str] | None = None) -> DataFrame:
    """rows with all OUTPUT_FIELDS cleaned together: a record without album has no album fields, an excluded one no review."""
    col = F.col
    one = {f: clean_artist(col(f), unicode_forms) for f in ("artist", "album_artist")} | {"album": clean_album(col("album"), unicode_forms), "date": clean_date(col("date")), "genre": clean_genre(col("genre"), genre_names, unicode_forms)}
    one |= {f: positive_integer(col(f)) for f in ("track_number", "disc_number")} | {f: clean_reason(col(f)) for f in ("review_reason", "exclusion_reason")}
    one |= {f: F.coalesce(col(f), F.lit(False)) for f in ("compilation", "needs_review", "excluded")}
    rows = rows.withColumns(one)
    rows = rows.withColumn("title", clean_title(col("title"), col("artist"), unicode_forms))
    has, poor = col("album").isNotNull(), col("title").isNull() | col("artist").isNull()
    why = F.when(poor, F.coalesce(F.when(col("needs_review"), col("review_reason")), F.lit("Insufficient reliable evidence for both a clean title and artist.")))
    why = why.when(col("needs_review"), F.coalesce(col("review_reason"), F.lit("Material metadata ambiguity requires human review.")))
    two = {f: F.when(has, col(f)) for f in ("album_artist", "track_number", "disc_number")} | {"compilation": col("compilation") & has}
    two |= {"needs_review": ~col("excluded") & (col("needs_review") | poor), "review_reason": F.when(~col("excluded"), why)}
    two["exclusion_reason"] = F.when(col("excluded"), F.coalesce(col("exclusion_reason"), F.lit("Intentionally excluded by user.")))
    return rows.withColumns(two)


def normalize_identity(c: Column) -> Column:
    return F.trim(F.regexp_replace(folded_case(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def link_key(c: Column, ascii_only: bool = False) -> Column:
    """Letters and digits only, accents removed."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))) if ascii_only else without_accents(c), "[^a-z0-9]", "")


def folded(c: Column, ascii_only: bool = False) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))) if ascii_only else without_accents(c), "[^a-z0-9]+", " "))


def words(c: Column) -> Column:
    """Distinct words of a folded text without noise words."""
    return F.array_except(F.filter(F.split(c, " "), lambda w: w != ""), F.array(*[F.lit(w) for w in fixed.NOISE_WORDS]))


def core_title(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, " "), lambda w: (w != "") & ~w.isin(fixed.VERSION_WORDS)), " ")


def version_words(c: Column) -> Column:
    return F.array_intersect(words(c), F.array(*[F.lit(w) for w in fixed.VERSION_WORDS]))


def canonical_release(artist: Column, title: Column) -> tuple[Column, Column]:
    main = F.get(F.split(F.coalesce(artist, F.lit("")), r"(?i)\s+(?:feat(?:uring)?|ft)\.?\s+", 2), 0)
    bare = F.regexp_replace(F.coalesce(title, F.lit("")), r"(?i)\s*[\[(](?:feat(?:uring)?|ft)\.?\s+[^\])]*[\])]", "")
    return normalize_identity(main), normalize_identity(bare)


def _word_key(c: Column) -> Column:
    """Words of any script, case folded, one space apart."""
    return F.trim(folded_case(_sub(c, r"[^\w]+", " ", "U")))


def title_without_context(c: Column) -> Column:
    return _word_key(_sub(c, fixed.TITLE_CONTEXT, " "))


def title_context(c: Column) -> Column:
    """The bracketed version and feature groups of a title as words, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"(?iuU)({fixed.TITLE_CONTEXT})"), F.lit(1)), _word_key)


def context_key(c: Column, unicode_forms: bool = False) -> Column:
    c = _sub(remove_noise(clean_optional(c, unicode_forms)), fixed.CONTEXT_VERSION, " ")
    c = _sub(c, r"\b(?:original|radio|extended)\s+(?:mix|edit|version)\b", " ")
    return let(normalize_identity(c), lambda key: F.when((F.length(key) >= 5) & ~_full(key, fixed.PLACEHOLDER), key))


def sanitize_component(c: Column, fallback: Column, longest: int = 120) -> Column:
    """A text that can stand as a file or folder name."""
    text = F.coalesce(blank_to_null(clean_text(c)), fallback)
    text = F.regexp_replace(F.regexp_replace(text, r"(?<=\S)[:/\\|](?=\S)", "-"), r"\s*[:/\\|]\s*", " - ")
    text = F.translate(text, '"<>?*', "'()？＊")
    text = F.btrim(_sub(F.regexp_replace(text, r"[\x00-\x1f]", ""), r"\s+", " ", "U"), F.lit(" ."))
    text = F.coalesce(blank_to_null(F.regexp_replace(text, r"(?:\s+-\s+){2,}", " - ")), fallback)
    text = let(text, lambda x: F.when(F.upper(x).isin(fixed.RESERVED_NAMES), F.concat(F.lit("_"), x)).otherwise(x))
    return F.coalesce(blank_to_null(F.rtrim(F.left(text, F.lit(longest)), F.lit(" ."))), fallback)


def path_key(c: Column) -> Column:
    return folded_case(F.replace(c, F.lit("\\"), F.lit("/")))


def file_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^\\/]*)$", 1)


def suffix(c: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(c), r"(?<=.)(\.[^.]*)$", 1))


def stem(c: Column) -> Column:
    return F.regexp_extract(file_name(c), r"^(.+?)(?:\.[^.]*)?$", 1)


def parent(c: Column) -> Column:
    return F.regexp_extract(c, r"^(.*)[\\/][^\\/]*$", 1)


def destination_identity(c: Column) -> Column:
    """Folder and stem, whatever the format."""
    return F.concat(path_key(parent(c)), F.lit("/"), folded_case(stem(c)))


def is_within(c: Column, root: Column) -> Column:
    return (path_key(c) == path_key(root)) | path_key(c).startswith(F.concat(F.rtrim(path_key(root), F.lit("/")), F.lit("/")))


def concise_source(c: Column) -> Column:
    parts = F.split(c, r"[\\/]")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3), "\\")


def copy_suffix_depth(c: Column) -> Column:
    """How many copy marks, like (1) or - 2, end a stem."""
    run = F.regexp_extract(F.rtrim(c), rf"((?:{fixed.COPY_SUFFIXES}\s*)*)$", 1)
    return F.regexp_count(run, F.lit(fixed.COPY_SUFFIXES))


def output_extension(c: Column, fallback: Column) -> Column:
    """A supported extension with its dot, else null."""
    e = F.coalesce(blank_to_null(F.lower(clean_text(c))), F.lower(fallback))
    e = let(e, lambda x: F.when((x != "") & ~x.startswith("."), F.concat(F.lit("."), x)).otherwise(x))
    return let(e, lambda x: F.when(x.isin(fixed.OUTPUT_EXTENSIONS), x))


def truncated(c: Column, most: int) -> Column:
    """The first `most` characters, and how many more there were."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(most)), F.lit("...[truncated "), (F.length(c) - most).cast("string"), F.lit(" chars]")))


def safe_key(c: Column, most: int = 200, digest: int = 12) -> Column:
    """A key on one line; an overlong one ends with the start of its digest."""
    c = F.trim(F.regexp_replace(c, r"[\x00-\x1f\x7f]+", " "))
    return let(c, lambda k: F.when(F.length(k) <= most, k).otherwise(F.concat(F.left(k, F.lit(most - digest - 3)), F.lit("...#"), F.left(F.sha2(k, 256), F.lit(digest)))))


def image_mime(raw: Column) -> Column:
    """Image type by the first bytes."""
    h = F.hex(F.substring(raw, 1, 12))
    kinds = {"FFD8FF": "image/jpeg", "89504E470D0A1A0A": "image/png", "474946383761": "image/gif", "474946383961": "image/gif", "424D": "image/bmp", "49492A00": "image/tiff", "4D4D002A": "image/tiff"}
    out = F.when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp")
    return reduce(lambda c, kv: c.when(h.startswith(kv[0]), kv[1]), kinds.items(), out)


def proposed_title(feedback: Column) -> Column:
    double = F.regexp_extract(feedback, r'(?i)should be\s+"([^"]+)"', 1)
    single = F.regexp_extract(feedback, r"(?i)should be\s+'([^']+)'", 1)
    return F.trim(F.coalesce(blank_to_null(double), blank_to_null(single)))


def metric_text(c: Column, decimals: int = 1) -> Column:
    return F.coalesce(F.format_number(c, decimals), F.lit("n/a"))


def duration_text(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    h, m, s = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, s)).when(m > 0, F.format_string("%dm %02ds", m, s)).otherwise(F.format_string("%ds", s))


def parse_assignment(c: Column) -> Column:
    """`a=b` to (left, right); null unless both sides have text."""
    cut = F.split(c, "=", 2)
    left, right = F.trim(F.get(cut, 0)), F.trim(F.get(cut, 1))
    return F.when((left != "") & (right != ""), F.struct(left.alias("left"), right.alias("right")))


def needs_capital(c: Column) -> Column:
    """A word of two letters or more that begins small though it is not a minor word."""
    found = F.regexp_extract_all(c, F.lit(rf"(?<![A-Za-z'’$@#])({fixed.CASED_WORD})"), F.lit(1))
    return F.exists(found, lambda w: (F.length(w) > 1) & F.left(w, F.lit(1)).rlike("[a-z]") & ~F.lower(w).isin(fixed.MINOR_WORDS))


def all_small(c: Column) -> Column:
    """Two words or more and no capital."""
    return (F.size(F.regexp_extract_all(c, F.lit(f"({fixed.CASED_WORD})"), F.lit(1))) >= 2) & (c == F.lower(c))
