"""Evidence from nested tags: bounded copies of JSON values, and the few facts of them that a request or a review needs.

Values are VARIANT columns of JSON. Bounded copies apart, nested values are followed by expressions, level by level to a depth,
so a row is rewritten where it lies: no rows are made of its parts, and nothing is shuffled. Keys of an object come out in
their own order, by name. Nulls and values that are no JSON give null; empty objects and lists stay.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import copies, fixed
from ..functions import text as X

#: Levels of a value that are followed before it counts as too deep.
DEPTH = 12
#: Levels that the meaning of a tag is looked for in.
MEANING = 12


def parsed(text: Column) -> Column:
    """JSON text as VARIANT; null if it is none."""
    return F.try_parse_json(text)


def quoted(c: Column) -> Column:
    """A text as JSON."""
    return X.let(F.to_json(F.array(c)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def _level(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), as a text that is empty for null: the plan then need not look into a level for the next one's type."""
    return X.let(value, lambda x: F.concat_ws("", of(x)))


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _read(value: Column, of: Callable[[Column, Column, Column], Column]) -> Column:
    """of(value, its object, its list), each read once: every mention of an object would unpack all that is in it anew."""
    return _level(F.struct(value.alias("x"), _object(value).alias("obj"), _list(value).alias("arr")), lambda s: of(s["x"], s["obj"], s["arr"]))


def _is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def _bounded(x: Column, most: int) -> Column:
    """A value that is no object or list as JSON text, a long text cut. The schema is asked only of texts that may be long: it
    costs more than the value."""
    return X.let(F.to_json(x), lambda j: F.when((F.length(j) <= most + 2) | ~j.startswith('"'), j).otherwise(quoted(X.truncated(_text(x), most))))


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _kind(v: Column) -> Column:
    """The name of a value's type."""
    s = F.schema_of_variant(v)
    return F.when(s == "STRING", "str").when(s == "BOOLEAN", "bool").when(s == "VOID", "NoneType").when(s == "BIGINT", "int").when(s.startswith("OBJECT"), "dict").when(s.startswith("ARRAY"), "list").otherwise("float")


def _entries(obj: Column, arr: Column, most_keys: int | None, most_items: int) -> Column:
    """(k, v) of an object's or a list's values; k is null in a list."""
    entry = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    named = F.map_entries(obj) if most_keys is None else F.slice(F.map_entries(obj), 1, most_keys)
    return F.coalesce(F.transform(named, lambda e: entry(e["key"], e["value"])), F.transform(F.slice(arr, 1, most_items), lambda x: entry(F.lit(None).cast("string"), x)))


def _written(obj: Column, parts: Column) -> Column:
    return F.concat(F.when(obj.isNotNull(), "{").otherwise("["), F.array_join(parts, ","), F.when(obj.isNotNull(), "}").otherwise("]"))


def _image_key(key: Column) -> Column:
    """Whether a tag of this name holds pictures."""
    name = F.trim(F.regexp_replace(F.lower(key), r"[\s_]+", " "))
    return F.coalesce(F.exists(F.array(*[F.lit(x) for x in fixed.IMAGE_KEYS]), lambda m: F.contains(name, m)), F.lit(False))


def _omitted(arr: Column, most: int) -> Column:
    """What stands for the items of a list beyond the first."""
    return F.when(F.size(arr) > most, F.array(F.concat(F.lit('"['), (F.size(arr) - most).cast("string"), F.lit(' additional values omitted]"')))).otherwise(F.array().cast("array<string>"))


def safe_json(v: Column, text: int = 500, items: int = 50, depth: int = DEPTH) -> Column:
    """A bounded copy of a value as JSON text: long texts are cut, lists end after `items`, pictures (by the name of their tag)
    become their number, and what lies deeper than `depth` its type and text. Python walks each value once, over the JSON text
    that Spark writes of it (:mod:`copies`): in expressions, each level would be unpacked again for those inside it."""

    @F.pandas_udf("string")
    def copied(texts: pd.Series, values: pd.Series) -> pd.Series:
        sys.setrecursionlimit(10_000)  # values may be a thousand levels deep
        return pd.Series([None if t is None else copies.bounded(t, x, text, items, depth) for t, x in zip(texts, values, strict=True)], dtype=object)

    return copied(F.to_json(v), v)


def artwork_count(v: Column) -> Column:
    """How many pictures a tag object holds, by the names of its tags: a list's items, else one."""
    named = F.filter(F.map_entries(_object(v)), lambda e: _image_key(e["key"]) & (_object(e["value"]).isNotNull() | _list(e["value"]).isNotNull()))
    return F.coalesce(F.aggregate(named, F.lit(0), lambda n, e: n + F.greatest(F.lit(1), F.coalesce(F.size(_list(e["value"])), F.lit(1)))), F.lit(0))


def _binary(obj: Column) -> Column:
    """Whether an object stands for bytes."""
    exists = X.let(F.element_at(obj, "exists"), lambda x: (F.schema_of_variant(x) == "BOOLEAN") & F.try_variant_get(x, "$", "boolean"))
    return F.coalesce((F.map_contains_key(obj, "byteLength") & F.coalesce(exists, F.lit(False))) | F.map_contains_key(obj, "binaryBase64"), F.lit(False))


def contains_binary(v: Column, depth: int = DEPTH) -> Column:
    """Whether an object that stands for bytes is in the value, to a depth and in the first hundred items of a list."""
    opened = lambda x: F.struct(_object(x).alias("obj"), _list(x).alias("arr"))
    children = lambda s: F.transform(F.coalesce(F.map_values(s["obj"]), F.slice(s["arr"], 1, 100), F.array().cast("array<variant>")), opened)
    start = F.struct(F.array(opened(v)).alias("at"), F.lit(False).alias("found"))

    def step(s: Column, _: Column) -> Column:
        # The levels that are left cost nothing once the answer is known or nothing is left to open.
        more = F.struct(F.flatten(F.transform(s["at"], children)).alias("at"), F.exists(s["at"], lambda x: _binary(x["obj"])).alias("found"))
        return F.when(s["found"] | (F.size(s["at"]) == 0), s).otherwise(more)

    return F.coalesce(F.aggregate(F.sequence(F.lit(0), F.lit(depth)), start, step)["found"], F.lit(False))


def compact_json(v: Column, text: int, depth: int = DEPTH) -> Column:
    """A copy as JSON text without bytes: a hundred keys, fifty items, cut texts."""

    def copy(value: Column, level: int) -> Column:
        if level > depth:
            return F.lit('"[nested value omitted]"')

        def of(x: Column, obj: Column, arr: Column) -> Column:
            inner = F.transform(_entries(obj, arr, 100, 50), lambda e: F.concat(F.when(e["k"].isNull(), "").otherwise(F.concat(quoted(_prompt_key(e["k"])), F.lit(":"))), copy(e["v"], level + 1)))
            more = F.when(F.size(obj) > 100, F.array(F.concat(F.lit('"omittedFields":'), (F.size(obj) - 100).cast("string")))).otherwise(F.coalesce(_omitted(arr, 50), F.array().cast("array<string>")))
            size = F.coalesce(_text(F.element_at(obj, "byteLength")), F.lit("unknown"))
            bytes_ = F.concat(F.lit('"[binary metadata omitted: '), size, F.lit(' bytes]"'))
            return F.when(_binary(obj), bytes_).when(obj.isNotNull() | arr.isNotNull(), _written(obj, F.concat(inner, more))).otherwise(_bounded(x, text))

        return _read(value, of)

    return F.when(v.isNotNull(), copy(v, 0))


def _prompt_key(key: Column) -> Column:
    one_line = F.trim(F.regexp_replace(key, r"[\x00-\x20\x7f]+", " "))
    return X.let(one_line, lambda k: F.when(k == "", "unnamed").otherwise(X.safe_key(k, 160, 10)))


def concise_value(v: Column, text: int = 500, depth: int = MEANING) -> Column:
    """What a tag says, as JSON text, or null: the value inside its wrappers, a date from its parts, the values of a list of up
    to twenty (one alone stands for itself), a text on one line. Objects with bytes say nothing."""

    def meaning(value: Column, level: int) -> Column:
        def of(x: Column, obj: Column, arr: Column) -> Column:
            plain = X.let(F.trim(F.regexp_replace(_text(x), r"[\x00-\x20\x7f]+", " ")), lambda t: F.when(t != "", quoted(F.left(t, F.lit(text)))))
            scalar = F.when(_is_text(x), plain).when(~F.is_variant_null(x), F.to_json(x))
            if level > depth:
                return F.when(obj.isNull() & arr.isNull(), scalar)
            key = F.coalesce(*[F.when(F.map_contains_key(obj, k), k) for k in fixed.VALUE_WRAPPERS])
            part = lambda name: X.let(F.element_at(obj, name), lambda p: F.when(F.schema_of_variant(p) == "BIGINT", F.try_variant_get(p, "$", "bigint")))
            two = lambda n: F.lpad(n.cast("string"), 2, "0")
            year, month, day = part("year"), part("month"), part("day")
            date = F.when(year.isNotNull(), F.concat(F.lit('"'), F.lpad(year.cast("string"), 4, "0"), F.coalesce(F.concat(F.lit("-"), two(month), F.coalesce(F.concat(F.lit("-"), two(day)), F.lit(""))), F.lit("")), F.lit('"')))
            inside = F.when(key.isNotNull(), F.array(F.element_at(obj, key))).otherwise(F.slice(arr, 1, 20))
            said = F.filter(F.transform(inside, lambda e: meaning(e, level + 1)), lambda s: s != "")
            several = X.let(said, lambda s: F.when(F.size(s) == 1, F.get(s, 0)).when(F.size(s) > 1, F.concat(F.lit("["), F.array_join(s, ", "), F.lit("]"))))
            return F.when(obj.isNotNull() & key.isNull(), date).when(obj.isNotNull() | arr.isNotNull(), several).otherwise(scalar)

        return _read(value, of)

    # Only an object is searched for bytes; a value that was made by an expression is made once.
    said = lambda x: F.when(x.isNotNull() & ~F.coalesce(F.when(_object(x).isNotNull(), contains_binary(x)), F.lit(False)), meaning(x, 0))
    return X.blank_to_null(_level(v, said))


def metadata_evidence(v: Column, text: int = 500, most: int = 2400) -> Column:
    """The evidence of a row's original metadata, as JSON text: nine fields by lists of tag names, the distinct values of each.
    The last fields are dropped until the text has at most `most` characters. Metadata that is no object is copied compactly."""
    known = F.array(*[F.lit(a) for names in fixed.EVIDENCE_ALIASES.values() for a in names])

    def said(tags: Column) -> Column:
        """(k, v) of the known tags, the last ones first, so that the first of a name is the one that counts."""
        keyed = F.transform(F.map_entries(tags), lambda e: F.struct(X.folded_case(_prompt_key(e["key"])).alias("k"), e["value"].alias("v")))
        return F.reverse(F.transform(F.filter(keyed, lambda e: F.array_contains(known, e["k"])), lambda e: F.struct(e["k"].alias("k"), concise_value(e["v"], text).alias("v"))))

    def fields(found: Column) -> Column:
        parts = []
        for field, names in fixed.EVIDENCE_ALIASES.items():
            values = [F.get(found["v"], (F.array_position(found["k"], a) - 1).cast("int")) for a in names]
            value = X.let(F.array_distinct(F.array_compact(F.array(*values))), lambda d: F.when(F.size(d) == 1, F.get(d, 0)).when(F.size(d) > 1, F.concat(F.lit("["), F.array_join(d, ", "), F.lit("]"))))
            parts.append(F.concat(F.lit(f'"{field}": '), value))
        return F.array_compact(F.array(*parts))

    def kept(parts: Column) -> Column:
        # Lengths grow, so the prefixes that fit are the first ones.
        size = lambda n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda s, p: s + F.length(p)) + 2 * n
        fit = F.size(F.filter(F.transform(parts, lambda _, i: i + 1), lambda n: size(n) <= most))
        return F.concat(F.lit("{"), F.array_join(F.slice(parts, F.lit(1), fit), ", "), F.lit("}"))

    def of(x: Column) -> Column:
        evidence = X.let(X.let(said(F.try_variant_get(x, "$.tags", "map<string,variant>")), fields), kept)
        return F.when(_object(x).isNotNull(), F.coalesce(evidence, F.lit("{}"))).when(x.isNotNull(), compact_json(x, text))

    return X.let(v, of)


def _first_inside(v: Column, own: Callable[[Column], Column], keys: list[str], depth: int = MEANING) -> Column:
    """The first own(x) of a value, or of what lies in its list, or under the keys of its object; null if there is none."""

    def first(value: Column, level: int) -> Column:
        def of(x: Column, obj: Column, arr: Column) -> Column:
            named = F.filter(F.array(*[F.element_at(obj, k) for k in keys]), lambda e: e.isNotNull())
            inside = F.coalesce(F.when(obj.isNotNull(), named), arr)
            return F.coalesce(own(x), F.get(F.filter(F.transform(inside, lambda e: first(e, level + 1)), lambda s: s != ""), 0))

        return _level(value, own) if level > depth else _read(value, of)

    return X.blank_to_null(first(v, 0))


def nested_text(v: Column) -> Column:
    """The first text inside a text, a list or an object with text; null words and blanks are none."""
    return _first_inside(v, lambda x: F.when(_is_text(x), X.clean_optional(_text(x), False)), ["text"])


def _whole(x: Column) -> Column:
    """A whole number, not a flag."""
    return F.when(F.schema_of_variant(x) == "BIGINT", F.try_variant_get(x, "$", "bigint"))


def nested_integer(v: Column) -> Column:
    """The first positive number inside a number, a text with digits, a list, or an object with text, value or number."""

    def own(x: Column) -> Column:
        number = F.when(_kind(x) == "float", F.try_variant_get(x, "$", "double"))
        digits = F.when(_is_text(x), F.regexp_extract(_text(x), "([0-9]+)", 1)).try_cast("int")
        found = F.coalesce(_whole(x), F.when(number == F.floor(number), number).try_cast("bigint"), digits.cast("bigint"))
        return F.when(found > 0, found.cast("string"))

    return _first_inside(v, own, ["text", "value", "number"]).try_cast("int")


def nested_boolean(v: Column) -> Column:
    """The first flag inside true or false, 0 or 1, a word for them, a list, or an object with text or value."""

    def own(x: Column) -> Column:
        said = F.lower(F.trim(F.when(_is_text(x) | (F.schema_of_variant(x) == "BOOLEAN"), _text(x)).otherwise(_whole(x).cast("string"))))
        return F.when(said.isin("1", "true", "yes"), "true").when(said.isin("0", "false", "no"), "false")

    return _first_inside(v, own, ["text", "value"]) == "true"


def nested_date(v: Column) -> Column:
    """The first date of 19xx or 20xx inside a text, a list, an object of year, month and day, or one with text, at the precision
    it has; a first of January is a year only."""

    def own(x: Column) -> Column:
        text = F.when(_is_text(x), F.regexp_extract(_text(x), r"\b((?:19|20)[0-9]{2}(?:-[0-9]{2}(?:-[0-9]{2})?)?)\b", 1))
        part = lambda name, low, high: X.let(_whole(F.element_at(_object(x), name)), lambda n: F.when(n.between(low, high), F.lpad(n.cast("string"), 2, "0") if high < 100 else n.cast("string")))
        year, month, day = part("year", 1900, 2099), part("month", 1, 12), part("day", 1, 31)
        date = F.concat(year, F.coalesce(F.concat(F.lit("-"), month, F.coalesce(F.concat(F.lit("-"), day), F.lit(""))), F.lit("")))
        return X.let(F.coalesce(X.blank_to_null(text), date), lambda d: F.when(d.endswith("-01-01"), F.left(d, F.lit(4))).otherwise(d))

    return _first_inside(v, own, ["text"])


def original_record(v: Column) -> Column:
    """The original title, artist, album artist, album and key of a row's metadata, as one struct: the first tag with text, by
    lists of names; empty if there is none. Tags are opened once for all fields: write it to a column and take fields of that."""
    wanted = F.array(*[F.lit(n) for names in fixed.REVIEW_ALIASES.values() for n in dict.fromkeys(a.casefold() for a in names)])
    tags = F.transform(F.map_entries(F.try_variant_get(v, "$.tags", "map<string,variant>")), lambda e: F.struct(X.folded_case(e["key"]).alias("k"), e["value"].alias("v")))
    texts = F.transform(F.filter(tags, lambda e: F.array_contains(wanted, e["k"])), lambda e: F.struct(e["k"].alias("k"), nested_text(e["v"]).alias("t")))

    def record(found: Column) -> Column:
        of = lambda name: F.get(found["t"], (F.array_position(found["k"], name.casefold()) - 1).cast("int"))
        return F.struct(*[F.coalesce(*[of(a) for a in names], F.lit("")).alias(field) for field, names in fixed.REVIEW_ALIASES.items()])

    none = F.array().cast("array<struct<k:string,t:string>>")
    return X.let(F.coalesce(F.filter(texts, lambda e: e["t"].isNotNull()), none), record)


def original_texts(v: Column) -> dict[str, Column]:
    """The fields of :func:`original_record` by name. Each mention makes the whole record anew: a table of all fields is cheaper
    from a column of records."""
    return {field: original_record(v)[field] for field in fixed.REVIEW_ALIASES}


def request_items(rows: DataFrame, metadata: str = "metadata", context: str | None = None, feedback: str | None = None, text: int = 500, most: int = 2400) -> DataFrame:
    """(row_id, item): the compact JSON that stands for a row in a request: its source's last names, its evidence, and, where a
    row has them, library context (JSON text) and the reviewer's concern."""
    parts = [F.concat(F.lit('{"id":'), F.col("row_id").cast("string")), F.concat(F.lit('"source":'), quoted(X.concise_source(F.col("source_path")))), F.concat(F.lit('"originalMetadata":'), F.coalesce(metadata_evidence(F.col(metadata), text, most), F.lit("{}")))]
    if context:
        parts.append(F.when(F.col(context) != "", F.concat(F.lit('"libraryContext":'), F.col(context))))
    if feedback:
        parts.append(F.when(F.col(feedback) != "", F.concat(F.lit('"auditFeedback":'), quoted(F.col(feedback)))))
    return rows.select("row_id", F.concat(F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), ","), F.lit("}")).alias("item"))
