"""Review findings as data, feedback filters, field repairs and bounded revisions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from . import manifest, plan
from .folds import first_of_each
from .link import ratio

TEXT_FIELDS = ["title", "artist", "album_artist", "album", "genre"]
NAMES_ALL = {"album_artist": "albumArtist", "track_number": "trackNumber", "disc_number": "discNumber", "needs_review": "needsReview", "review_reason": "reviewReason"}
NAMES = {"title": "title", "artist": "artist", "album_artist": "albumArtist", "album": "album", "genre": "genre"}


def own_columns(repair: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A repair's working columns begin with two underscores: a caller's columns that do so are set aside meanwhile."""

    @wraps(repair)
    def run(rows: DataFrame, *args: object, **named: object) -> DataFrame:
        aside = {c: X.free_name(f"aside_{i}", rows.columns) for i, c in enumerate(rows.columns) if c.startswith("__")}
        done = repair(rows.withColumnsRenamed(aside), *args, **named)
        return done.withColumnsRenamed({new: old for old, new in aside.items()})

    return run



def _unbalanced(c: Column) -> Column:
    pairs = [("(", ")"), ("[", "]"), ("{", "}")]
    count = lambda ch: F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
    return reduce(lambda a, b: a | b, [count(a) != count(b) for a, b in pairs])


def findings() -> Column:
    """array<struct<reason, rank>>: one entry a reason with its highest rank, in the order of the rules."""
    clean = {f: X.clean_text(F.col(f)) for f in TEXT_FIELDS}

    def finding(when: Column, reason: str, priority: str) -> Column:
        return F.when(when, F.struct(F.lit(reason).alias("reason"), F.lit(fixed.PRIORITIES[priority]).alias("rank")))

    found = [
        finding(F.coalesce(F.col("needs_review"), F.lit(False)), "needs review", "High"),
        finding((clean["title"] == "") | (clean["artist"] == ""), "missing title or artist", "High"),
        finding(clean["title"].rlike(rf"(?iuU)^(?:{fixed.KEY})\z"), "title is a standalone DJ key", "High"),
    ]
    for f in TEXT_FIELDS:
        c, name = clean[f], NAMES[f]
        found += [
            finding(c.rlike(f"(?iuU){fixed.REVIEW_DOMAIN}"), f"{name} contains a URL or domain", "High"),
            finding(c.rlike(fixed.MOJIBAKE), f"{name} contains corrupt encoding", "High"),
            finding(_unbalanced(c), f"{name} has unbalanced brackets", "High"),
            finding(F.contains(c, F.lit("_")), f"{name} contains underscore", "Medium"),
            finding(c.rlike(f"(?iuU){fixed.PROMOTIONAL}") | c.rlike(f"(?iuU){fixed.REVIEW_MASTER}"), f"{name} contains workflow or promo text", "Medium"),
        ]
        if f in ("artist", "album_artist"):
            found.append(finding(F.length(c) > 100, f"{name} is unusually long", "Medium"))
    found += [finding(X.all_small(clean[f]), f"{NAMES[f]} casing", "Medium") for f in ("artist", "album_artist")]
    found += [finding((F.size(F.regexp_extract_all(clean[f], F.lit(f"({fixed.CASED_WORD})"), F.lit(1))) >= 2) & X.needs_capital(clean[f]), f"{NAMES[f]} casing", "Low") for f in ("title", "album")]
    return F.array_compact(F.array(*found))


#: Writes rows that a plan uses several times.
Cut = Callable[[DataFrame], DataFrame]


def review_rows(rows: DataFrame, cut: Cut = lambda df: df) -> DataFrame:
    """Rows with findings: reasons joined in the order of the rules, and the highest priority. `cut` writes the findings, which
    the filter and the columns would look for once each."""
    names = F.create_map(*[F.lit(x) for k, v in fixed.PRIORITIES.items() for x in (v, k)])
    found = cut(rows.withColumn("findings", findings())).where(F.size("findings") > 0)
    found = found.withColumn("rank", F.array_max(F.transform("findings", lambda x: x["rank"])))
    return found.withColumns({"reasons": F.array_join(F.transform("findings", lambda x: x["reason"]), "; "), "priority": names[F.col("rank")]}).drop("findings")


def review_order() -> list[Column]:
    return [F.col("rank").desc(), *[X.folded_case(F.coalesce(F.col(c), F.lit(""))).asc() for c in ("artist", "album", "title", "source_path")], F.col("row_id").asc()]


def priority_counts(reviewed: DataFrame) -> DataFrame:
    return reviewed.groupBy("priority").agg(F.count("*").alias("n"))


def review_items(planned: DataFrame, cut: Cut = lambda df: df) -> DataFrame:
    """planned rows that a person looks at, with reasons, priority, rank, planned_path and status `review`; ready rows that
    lost to another copy come out with status `duplicate`, so that one pass gives the table and its counts.

    planned(the output fields, new_path, is_winner). Excluded rows and rows without findings are left out. `cut`
    writes the findings: the filter, the columns and a sort, which reads its input twice, would look for them once each."""
    lost = plan.is_ready() & ~F.coalesce(F.col("is_winner"), F.lit(False))
    rows = cut(planned.where(~F.coalesce(F.col("excluded"), F.lit(False))).withColumn("findings", findings())).withColumn("status", F.when(lost, "duplicate").when(F.size("findings") > 0, "review")).where("status is not null")
    rank = F.array_max(F.transform("findings", lambda x: x["rank"]))
    names = F.create_map(*[F.lit(x) for name, k in fixed.PRIORITIES.items() for x in (k, name)])
    shown = F.when(F.col("is_winner"), F.coalesce("new_path", F.lit(""))).otherwise("")
    return rows.withColumns({"rank": rank, "reasons": F.array_join(F.transform("findings", lambda x: x["reason"]), "; "), "planned_path": shown}).withColumn("priority", names[F.col("rank")]).drop("findings")


def review_table(items: DataFrame, originals: dict[str, Column] | None = None) -> DataFrame:
    """The table that is handed to a reviewer, in its order: decision and notes are open, texts are clean. originals adds
    columns such as those of :func:`evidence.original_texts`."""
    flag = lambda f: F.coalesce(F.col(f), F.lit(False)).cast("string")
    columns = {"priority": F.col("priority"), "reasons": F.col("reasons"), "review_decision": F.lit("Pending"), "review_notes": F.lit(""), "source_path": F.coalesce("source_path", F.lit("")), "planned_path": F.col("planned_path")}
    columns |= {f: X.clean_text(F.col(f)) for f in ("title", "artist", "album_artist", "album", "date")}
    columns |= {f: F.coalesce(F.col(f).cast("string"), F.lit("")) for f in ("track_number", "disc_number")}
    columns |= {"genre": X.clean_text(F.col("genre")), "compilation": flag("compilation"), "needs_review": flag("needs_review"), "review_reason": X.clean_text(F.col("review_reason"))}
    shown = items.where("status = 'review'").orderBy(*review_order())
    return shown.select(*[c.alias(n) for n, c in (columns | (originals or {})).items()])


def review_totals(items: DataFrame) -> DataFrame:
    """(name, n): review rows of each priority, and how many duplicates were left out."""
    name = F.when(F.col("status") == "duplicate", "excluded duplicate").otherwise(F.col("priority"))
    return items.groupBy(name.alias("name")).agg(F.count("*").alias("n"))


def retained(reviews: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, key, feedback, rule) of the flagged reviews(id, needs_revision, feedback): the source that a flag authorises a
    change of, or the rule that it breaks. A track id must be one of rows(row_id, source_path), named once, with a source and
    feedback; flags on other ids say nothing."""
    flagged = reviews.where(F.coalesce("needs_revision", F.lit(False))).groupBy("id").agg(F.count("*").alias("k"), F.min("feedback").alias("feedback"))
    known = rows.select(F.col("row_id").alias("id"), "source_path").withColumn("there", F.lit(True))
    found = flagged.join(known, "id", "left")
    rules = F.when(F.col("id").isNull() | F.col("there").isNull(), "track id out of range").when(F.col("k") > 1, "track id repeated").when(~plan.has_text(F.col("source_path")), "no source path").when(~plan.has_text(F.col("feedback")), "no feedback")
    return found.select("id", F.when(rules.isNull(), X.path_key(F.col("source_path"))).alias("key"), "feedback", rules.alias("rule"))


def changed_fields(rows: DataFrame, before: dict[str, Column], after: dict[str, Column], key: str = "row_id") -> DataFrame:
    """(key, field, before, after), one row for each field that a cleaner changed."""
    entries = [F.when(~before[f].eqNullSafe(after[f]), F.struct(F.lit(f).alias("field"), before[f].cast("string").alias("before"), after[f].cast("string").alias("after"))) for f in after]
    return rows.select(key, F.explode(F.array_compact(F.array(*entries))).alias("c")).select(key, "c.field", "c.before", "c.after")


def change_counts(changes: DataFrame, samples: int = 20) -> DataFrame:
    """Changed rows of each field, and its first few keys: no more than these leave a task."""
    few = first_of_each(changes.select("field", "row_id").where("row_id is not null").dropDuplicates(["field", "row_id"]), ["field"], [F.col("row_id")], samples)
    first = few.groupBy("field").agg(F.array_sort(F.collect_list("row_id")).alias("sample"))
    counts = changes.groupBy("field").agg(F.count("*").alias("n"))
    return counts.join(first, "field", "left").select("field", "n", F.coalesce("sample", F.array().cast(first.schema["sample"].dataType)).alias("sample"))


def _same(a: Column, b: Column) -> Column:
    return X.folded_case(a) == X.folded_case(b)


@own_columns
def split_misplaced(rows: DataFrame, artist_tag: str, title_tag: str, key_tag: str) -> DataFrame:
    """rows with title, artist and review state repaired where the tags name both; title_tag falls back on the file name.

    1. The title is a DJ key that ends the title tag or equals the key tag: artist and title come from their tags.
    2. The artist tag reads `Artist - Title`, the title tag is a bracketed version and the artist agrees: both are joined."""
    rows = rows.withColumns({"__a": X.clean_optional(F.col(artist_tag)), "__t": F.coalesce(X.clean_optional(F.col(title_tag)), X.stem(F.col("source_path"))), "__k": X.clean_optional(F.col(key_tag)), "__title": X.clean_optional(F.col("title"))})
    rows = rows.withColumn("__ca", X.clean_artist(F.col("__a")))
    rows = rows.withColumn("__ct", X.clean_title(F.col("__t"), F.col("__ca")))
    title, tag = F.col("__title"), F.col("__t")
    suffix = F.regexp_like(tag, F.concat(F.lit(r"(?iuU)\s[-–—|]\s*\Q"), title, F.lit(r"\E\s*\z")))
    is_key = title.rlike(rf"(?iuU)^(?:{fixed.KEY})\z") & (F.coalesce(suffix, F.lit(False)) | F.coalesce(_same(title, F.col("__k")), F.lit(False)))
    one = is_key & F.col("__ca").isNotNull() & ~_same(F.col("__ct"), title) & ~F.col("__ct").rlike(f"(?iuU){fixed.PLACEHOLDER}")
    two_parts = r"(?s)^(.+?)\s+[-–—]\s+(.+)\z"
    rows = rows.withColumns({"__left": X.clean_optional(F.regexp_extract("__a", two_parts, 1)), "__right": X.clean_optional(F.regexp_extract("__a", two_parts, 2))})
    own = X.clean_optional(F.col("artist"))
    two = F.col("__left").isNotNull() & F.col("__right").isNotNull() & tag.rlike(rf"(?iuUs)^(?:{fixed.VERSION_ONLY})\z") & (own.isNull() | _same(own, F.col("__left")))
    rows = rows.withColumns({"__one": F.coalesce(one, F.lit(False)), "__two": F.coalesce(two, F.lit(False)), "__joined": X.clean_title(F.concat_ws(" ", "__right", "__t"), F.col("__left"))})
    rows = rows.withColumns({
        "title": F.when(F.col("__one"), F.col("__ct")).when(F.col("__two"), F.col("__joined")).otherwise(F.col("title")),
        "artist": F.when(F.col("__one"), F.col("__ca")).when(F.col("__two"), F.col("__left")).otherwise(F.col("artist")),
        "needs_review": F.when(F.col("__one"), False).otherwise(F.col("needs_review")),
        "review_reason": F.when(F.col("__one"), F.lit(None)).otherwise(F.col("review_reason")),
    })
    return rows.drop("__a", "__t", "__k", "__title", "__ca", "__ct", "__left", "__right", "__one", "__two", "__joined")


@own_columns
def keep_context(rows: DataFrame, tags: list[str]) -> DataFrame:
    """rows whose title takes the first evidence (tags, folder, file name) that has the same words without its version
    groups, and all of the title's groups and more. Titles of nothing but groups stay."""
    artist = X.clean_artist(F.col("artist"))
    names = [*[F.col(t) for t in tags], X.file_name(X.parent(F.col("source_path"))), X.stem(F.col("source_path"))]
    rows = rows.withColumn("__artist", artist).withColumns({f"__e{i}": X.clean_title(c, F.col("__artist")) for i, c in enumerate(names)} | {"__now": X.clean_title(F.col("title"), F.col("__artist"))})
    rows = rows.withColumns({"__base": X.title_without_context(F.col("__now")), "__groups": X.title_context(F.col("__now"))})

    def fits(c: Column) -> Column:
        more = X.title_context(c)
        return (F.col("__base") != "") & (X.title_without_context(c) == F.col("__base")) & (F.size(F.array_except("__groups", more)) == 0) & (F.size(F.array_except(more, F.col("__groups"))) > 0)

    found = [F.when(fits(F.col(f"__e{i}")), F.col(f"__e{i}")) for i in range(len(names))]
    return rows.withColumn("title", F.coalesce(*found, F.col("title"))).drop("__artist", "__now", "__base", "__groups", *[f"__e{i}" for i in range(len(names))])


@own_columns
def keep_numeric_artist(rows: DataFrame, artist_tag: str) -> DataFrame:
    """rows whose artist is the tag's, if that begins with a digit, names the folder above the file's and stands before the
    dash of an `Artist - Title` file name."""
    rows = rows.withColumn("__a", X.clean_artist(F.col(artist_tag)))
    tag, stem = F.col("__a"), F.trim(X.stem(F.col("source_path")))
    folder = F.trim(X.file_name(X.parent(X.parent(F.col("source_path")))))
    named = F.regexp_like(stem, F.concat(F.lit(r"(?iuU)^\Q"), tag, F.lit(r"\E\s+[-–—]\s+\S")))
    agrees = tag.rlike(r"(?U)^\d") & _same(folder, tag) & named & ~X.clean_artist(F.col("artist")).eqNullSafe(tag)
    return rows.withColumn("artist", F.when(F.coalesce(agrees, F.lit(False)), tag).otherwise(F.col("artist"))).drop("__a")


@own_columns
def ground(rows: DataFrame, genre_names: list[str] | None = None) -> DataFrame:
    """rows with the catalogue facts that their tags support.

    Tags are columns s_album, s_album_artist, s_genre (texts), s_track, s_disc, s_date and s_compilation (first values).
    An album may differ from its tag's spelling; without an album there are no album facts. A fact that a row held for
    review leaves open stays open."""
    held = F.coalesce(F.col("needs_review"), F.lit(False))
    rows = rows.withColumns({"__tag": X.clean_album(F.col("s_album")), "__own": X.clean_album(F.col("album"))})
    plain = lambda c: F.trim(F.regexp_replace(X.folded_case(c), "[^a-z0-9]+", " "))
    near = (plain(F.col("__tag")) == plain(F.col("__own"))) | (ratio(plain(F.col("__tag")), plain(F.col("__own"))) >= 0.65)
    album = F.when(held & F.col("__own").isNull(), F.lit(None).cast("string")).when(F.col("__tag").isNotNull() & F.col("__own").isNotNull() & near, F.col("__own")).otherwise(F.col("__tag"))
    rows = rows.withColumn("__album", album)
    has = F.col("__album").isNotNull()
    shared = has & (F.coalesce(manifest.first_boolean(F.col("s_compilation")), F.lit(False)) | F.col("__album").rlike(f"(?iuU){fixed.COMPILATION_ALBUM}") | F.coalesce(F.col("compilation"), F.lit(False)))
    open_ = lambda f: held & F.col(f).isNull()
    number = lambda f, tag: F.when(has & ~open_(f), X.positive_integer(manifest.first_integer(F.col(tag))))
    rows = rows.withColumn("__shared", shared)
    return rows.withColumns({
        "album_artist": F.when(F.col("__shared"), "Various Artists").when(has, X.clean_artist(F.col("s_album_artist"))),
        "track_number": number("track_number", "s_track"), "disc_number": number("disc_number", "s_disc"),
        "date": F.when(~open_("date"), manifest.first_date(F.col("s_date"))),
        "genre": F.when(~open_("genre"), X.clean_genre(F.col("s_genre"), genre_names)),
        "album": F.col("__album"), "compilation": F.col("__shared"),
    }).drop("__tag", "__own", "__album", "__shared")


@own_columns
def cover_performer(rows: DataFrame) -> DataFrame:
    """rows whose file name, `Performer - Title`, says karaoke or originally performed by: both come from it, and the row is
    held for review, unless they agree already."""
    rows = rows.withColumn("__stem", F.trim(X.stem(F.col("source_path"))))
    parts = F.split("__stem", r"(?U)\s+[-–—]\s+", 2)
    rows = rows.withColumns({"__a": X.clean_artist(F.get(parts, 0)), "__t": F.get(parts, 1)})
    rows = rows.withColumns({"__t": X.clean_title(F.col("__t"), F.coalesce("__a", F.lit(""))), "__now": X.clean_title(F.col("title"), F.col("__a"))})
    agrees = X.clean_artist(F.col("artist")).eqNullSafe(F.col("__a")) & F.col("__now").eqNullSafe(F.col("__t"))
    rows = rows.withColumn("__use", F.col("__stem").rlike(f"(?iuU){fixed.COVER_CONTEXT}") & F.col("__a").isNotNull() & F.col("__t").isNotNull() & ~agrees)
    new = {"title": F.col("__t"), "artist": F.col("__a"), "needs_review": F.lit(True), "review_reason": F.lit(fixed.COVER_REASON)}
    return rows.withColumns({c: F.when(F.col("__use"), v).otherwise(F.col(c)) for c, v in new.items()}).drop("__stem", "__a", "__t", "__now", "__use")


#: The fields that are held against their canonical values, in the order of their reasons.
CANONICAL = ["title", "artist", "album_artist", "album", "date", "track_number", "disc_number", "genre", "compilation", "needs_review", "review_reason"]


def canonical_output(rows: DataFrame, genre_names: list[str] | None = None, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """rows cleaned, repaired by their tags and grounded in them. Tags are columns s_title, s_artist, s_key and those of
    :func:`ground`. `cut` writes the rows between repairs: in one plan, each repair's expressions stand inside the next one's."""
    done = cut(X.cleaned(rows, genre_names=genre_names))
    done = cut(split_misplaced(done, "s_artist", "s_title", "s_key"))
    done = cut(keep_context(done, ["s_title", "s_album"]))
    return ground(cut(keep_numeric_artist(done, "s_artist")), genre_names)


def suspicious(rows: DataFrame, key: str = "row_id", genre_names: list[str] | None = None, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(key, reasons) of rows whose output is not canonical, or whose casing looks wrong."""
    was = rows.select("*", *[F.col(c).alias(f"__w_{c}") for c in CANONICAL])
    done = cut(canonical_output(was, genre_names, cut))
    differs = [F.when(~F.col(f"__w_{c}").eqNullSafe(F.col(c)), F.lit(NAMES_ALL.get(c, c))) for c in CANONICAL]
    text = {f: X.clean_optional(F.col(f"__w_{f}")) for f in ("artist", "album_artist", "title", "album")}
    casing = [F.when(X.all_small(text[f]), F.lit(f"{NAMES[f]} casing")) for f in ("artist", "album_artist")]
    casing += [F.when((F.size(F.regexp_extract_all(text[f], F.lit(f"({fixed.CASED_WORD})"), F.lit(1))) >= 2) & X.needs_capital(text[f]), F.lit(f"{NAMES[f]} casing")) for f in ("title", "album")]
    return done.select(key, F.array_compact(F.array(*differs, *casing)).alias("reasons")).where(F.size("reasons") > 0)


def _key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"(?U)[^\w]+", "")


def _inside(whole: Column) -> Callable[[Column], Column]:
    return lambda q: (F.length(_key(q)) >= 4) & F.contains(whole, _key(q))


def actionable(feedback: Column) -> Column:
    """Whether a verifier's feedback may act: rejections first, then what it must name.

    Uses the columns title, artist, album_artist, needs_review and evidence (source path and tags as one text)."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(feedback, F.lit(""))), r"(?U)\s+", " "))
    title, artist, album_artist = (F.coalesce(F.col(c), F.lit("")) for c in ("title", "artist", "album_artist"))
    has = lambda *terms: reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in terms])
    removes, replaces = t.startswith("remove unsupported albumartist"), t.startswith("replace albumartist")
    optional = removes | replaces
    quoted = F.regexp_extract_all(feedback, F.lit(r"""['"]([^'"]+)['"]"""), F.lit(1))
    value = lambda p: F.regexp_extract(feedback, f"(?i){p}", 1)
    reject = [
        optional & F.col("album_artist").isNull(),
        replaces & (value(r"""source-tag value\s+['"]([^'"]+)['"]""") != "") & (_key(value(r"""source-tag value\s+['"]([^'"]+)['"]""")) == _key(album_artist)),
        F.coalesce(F.col("needs_review"), F.lit(False)) & ~optional,
        has(*fixed.FILE_TERMS),
        has(*fixed.CASING_TERMS),
        has(*fixed.SOUND_TERMS),
        t.startswith("keep "),
        (F.size(quoted) >= 2) & (F.trim(F.lower(F.element_at(quoted, -1))) == F.trim(F.lower(F.get(quoted, F.size(quoted) - 2)))),
    ]
    for name, current in (("title", title), ("artist", artist)):
        for p in (rf"""{name}(?: field)?\s+should be(?: changed to)?\s+['"]([^'"]+)['"]""", rf"""change (?:the )?{name}(?: field)?\s+to\s+['"]([^'"]+)['"]"""):
            reject.append((current != "") & (value(p) != "") & (_key(value(p)) == _key(current)))
        same = F.array_contains(F.transform(quoted, _key), _key(current))
        here = F.transform(quoted, _inside(_key(current)))
        part = F.exists(here, lambda x: x)
        reject.append((current != "") & same & has(*fixed.PRESERVE_TERMS))
        reject.append((current != "") & part & has(*fixed.INCLUDE_TERMS))
    low = F.lower(title)
    reject.append((has("remix information is lost") & F.contains(low, F.lit("remix"))) | (has("bootleg information is missing") & F.contains(low, F.lit("bootleg"))))
    reject.append((artist != "") & feedback.rlike(r"""(?i)(?:change|set) (?:the )?artist(?: field)? to\s+['"]?(unknown|null|unknown artist)['"]?"""))
    versions = F.filter(quoted, lambda q: q.rlike("(?i)remix|mix|edit|vip|bootleg"))
    reject.append(has("original metadata") & has(*fixed.FEEDBACK_VERSIONS) & (F.size(versions) > 0) & ~F.exists(versions, lambda q: F.contains(_key(F.coalesce(F.col("evidence"), F.lit(""))), _key(q))))
    missing = value(r"""(?:include|missing) (?:the )?(?:featured )?artist\s+['"]([^'"]+)['"]""")
    reject.append((missing != "") & F.contains(F.lower(artist), F.lower(missing)))
    out = F.when(F.coalesce(reduce(lambda a, b: a | b, reject), F.lit(False)), False)
    out = out.when(has(*fixed.OPTIONAL_TERMS), optional)
    return out.otherwise(has(*fixed.SOURCE_TERMS))


def conservative(feedback: Column) -> Column:
    """Actionable, and neither removes a version word that the title has nor moves the artist into the title."""
    t, title = F.lower(feedback), F.lower(F.coalesce(F.col("title"), F.lit("")))
    takes = reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in fixed.REMOVAL_TERMS])
    loses = reduce(lambda a, b: a | b, [F.contains(title, F.lit(w)) & F.contains(t, F.lit(w)) for w in fixed.LOST_VERSIONS])
    lead = F.concat(X.normalize_identity(F.col("artist")), F.lit(" "))
    absorbs = (F.trim(lead) != "") & X.normalize_identity(X.proposed_title(feedback)).startswith(lead) & ~X.normalize_identity(F.col("title")).startswith(lead)
    return actionable(feedback) & ~(takes & loses) & ~F.coalesce(absorbs, F.lit(False))


def optional_feedback(source_album_artist: Column) -> Column:
    """What the tags alone say about an album artist; compilations are exempt."""
    have = F.col("album_artist").isNotNull() & ~F.coalesce(F.col("compilation"), F.lit(False))
    no = F.concat(F.lit("Remove unsupported albumArtist '"), F.col("album_artist"), F.lit("'; no source tag supports it."))
    other = F.concat(F.lit("Replace albumArtist '"), F.col("album_artist"), F.lit("' with source-tag value '"), source_album_artist, F.lit("'."))
    return F.when(have & source_album_artist.isNull(), no).when(have & (X.normalize_identity(source_album_artist) != X.normalize_identity(F.col("album_artist"))), other)


def constrained(fields: list[str], feedback: Column) -> dict[str, Column]:
    """Of original o_* and candidate c_* columns: each field is revised only where the feedback names it."""
    t = F.lower(feedback)
    only = t.startswith("remove unsupported albumartist") | t.startswith("replace albumartist")
    names_aa = t.rlike("album[ -]?artist")
    rest = F.regexp_replace(t, "album[ -]?artist", "")
    terms = {"title": ["title"], "artist": ["artist"], "album": ["album"], "date": ["date", "year"], "genre": ["genre"], "track_number": ["tracknumber", "track number"], "disc_number": ["discnumber", "disc number"], "compilation": ["compilation"]}
    named = {f: ~only & reduce(lambda a, b: a | b, [F.contains(rest, F.lit(x)) for x in terms[f]]) for f in terms} | {"album_artist": names_aa}
    core = named["title"] | named["artist"]
    named |= {"needs_review": core, "review_reason": core}
    out = {f: F.when(named.get(f, F.lit(False)), F.col(f"c_{f}")).otherwise(F.col(f"o_{f}")) for f in fields}
    if "album_artist" in out:
        out["album_artist"] = F.when(~t.startswith("remove unsupported albumartist"), out["album_artist"])
    return out


def deterministic_revision(feedback: Column, source_album_artist: Column) -> tuple[Column, Column]:
    """(album_artist, handled): revisions that need no model."""
    t = F.lower(feedback)
    removes, replaces = t.startswith("remove unsupported albumartist"), t.startswith("replace albumartist") & source_album_artist.isNotNull()
    return F.when(removes, F.lit(None)).when(replaces, source_album_artist).otherwise(F.col("album_artist")), removes | replaces


def sanitised(reviews: DataFrame, keeps: Column) -> DataFrame:
    """reviews(row_id, needs_revision, feedback) whose flagged rows that do not keep their flag lose it and their feedback.

    rejected says which did. keeps may use any column; flags without a verdict go as well."""
    flagged = F.coalesce(F.col("needs_revision"), F.lit(False))
    rejected = flagged & ~F.coalesce(keeps, F.lit(False))
    marked = reviews.withColumn("rejected", rejected)
    return marked.withColumns({"needs_revision": F.when(F.col("rejected"), False).otherwise(F.col("needs_revision")), "feedback": F.when(~F.col("rejected"), F.col("feedback"))})


def sanitisation_summary(cleaned: DataFrame) -> DataFrame:
    """One row: flagged reviews before, flagged ones that stay, rejected ones. The rejected rows are cleaned.where(rejected)."""
    stays = F.coalesce(F.col("needs_revision"), F.lit(False))
    return cleaned.agg(F.count_if(stays | F.col("rejected")).alias("input_flagged"), F.count_if(stays).alias("retained_flagged"), F.count_if("rejected").alias("rejected_count"))


def resolved(rows: DataFrame, resolutions: DataFrame, audited: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with resolutions applied and cleaned, violations (key, rule)); rows that break a rule stay as they are.

    resolutions(source_path, evidence, any of the output fields, and optionally changed: array<string>, the fields that a
    row sets, null values included; without it, those that are not null). A target must be known, unique, named once and
    under review, on the audited list (source_path) or put under review; evidence and changes must be there. A row put
    under review needs a reason; any other resolution clears the review and leaves a title and an artist."""
    allowed = [f for f in X.OUTPUT_FIELDS if f not in ("excluded", "exclusion_reason")]
    given = [f for f in allowed if f in resolutions.columns]
    key = X.path_key(F.coalesce(F.col("source_path"), F.lit("")))
    filled = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in given])) if given else F.array().cast("array<string>")
    changed = F.col("changed") if "changed" in resolutions.columns else filled
    said = F.struct(F.coalesce(changed, F.array().cast("array<string>")).alias("changed"), F.trim(F.coalesce("evidence", F.lit(""))).alias("evidence"), *[F.col(f) for f in given])
    per = resolutions.select(key.alias("key"), said.alias("r")).groupBy("key").agg(F.count("*").alias("k"), F.min("r").alias("r"))
    keyed = rows.withColumn("key", key)
    per = per.join(keyed.join(per.select("key"), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n")), "key", "left")
    if audited is None:
        per = per.withColumn("listed", F.lit(False))
    else:
        per = per.join(audited.select(key.alias("key")).distinct().withColumn("listed", F.lit(True)), "key", "left")
    sets = lambda f: F.array_contains(F.col("r.changed"), F.lit(f))
    after = {f: F.when(sets(f), F.col(f"r.{f}").cast(rows.schema[f].dataType)).otherwise(F.col(f)) for f in given if f in rows.columns}
    holds = F.coalesce(sets("needs_review") & F.col("r.needs_review"), F.lit(False)) if "needs_review" in given else F.lit(False)
    joined = keyed.join(per, "key", "left").withColumn("holds", holds)
    held = F.coalesce(F.col("needs_review"), F.lit(False)) | F.coalesce("listed", F.lit(False)) | F.col("holds")
    value = lambda f: after.get(f, F.col(f))
    reason = X.clean_reason(value("review_reason")) if "review_reason" in rows.columns else F.lit(None).cast("string")
    known = F.array(*[F.lit(f) for f in given])
    rules = [
        (F.col("k") > 1, "target repeated"),
        (F.col("n") > 1, "manifest source repeated"),
        (F.size("r.changed") == 0, "no changes"),
        (F.size(F.array_except("r.changed", known)) > 0, "field not allowed"),
        (F.col("r.evidence") == "", "no evidence"),
        (~held, "target not held"),
        (F.col("holds") & (F.coalesce(reason, F.lit("")) == ""), "hold without a reason"),
        (~F.col("holds") & F.coalesce(value("needs_review"), F.lit(False)), "review not cleared"),
        (~F.col("holds") & ~(plan.has_text(value("title")) & plan.has_text(value("artist"))), "no title or artist"),
    ]
    rule = F.coalesce(*[F.when(F.coalesce(when, F.lit(False)), F.lit(name)) for when, name in rules])
    joined = joined.withColumn("rule", F.when(F.col("k").isNotNull(), rule)).withColumn("good", F.col("k").isNotNull() & F.col("rule").isNull())
    done = joined.select(*[F.when(F.col("good"), after[c]).otherwise(F.col(c)).alias(c) if c in after else F.col(c) for c in rows.columns], "good")
    if set(X.OUTPUT_FIELDS) <= set(rows.columns):  # a merged record is cleaned as a whole
        fresh = X.cleaned(done.where("good"))
        fields = [F.col(c).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]
        done = done.where("not good").select(*rows.columns).unionByName(fresh.select(*fields))
    unknown = per.where("n is null").select("key", F.when(F.col("key") == "", "source blank").otherwise("unknown target").alias("rule"))
    return done.select(*rows.columns), unknown.unionByName(joined.where("rule is not null").select("key", "rule")).distinct()
