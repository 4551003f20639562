"""Bounded copies of JSON values, one at a time: what expressions would unpack again at each level and mention."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql.types import VariantVal

from . import fixed


class Number(str):
    """A number as it is written."""


class Unsure(Exception):
    """The text does not tell a value's type."""


#: No types were given.
NONE = object()
ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def quoted(text: str) -> str:
    """A text as Spark writes it in JSON."""
    return '"' + re.sub(r'["\\\x00-\x1f]', lambda m: ESCAPES.get(m[0]) or f"\\u{ord(m[0]):04X}", text) + '"'


def truncated(text: str, most: int) -> str:
    return text if len(text) <= most else f"{text[:most]}...[truncated {len(text) - most} chars]"


def written(x: Any) -> str:
    if isinstance(x, dict):
        return "{" + ",".join([f"{quoted(k)}:{written(v)}" for k, v in x.items()]) + "}"
    if isinstance(x, list):
        return "[" + ",".join([written(v) for v in x]) + "]"
    return x if isinstance(x, Number) else quoted(x) if isinstance(x, str) else json.dumps(x)


def image_key(key: str) -> bool:
    name = re.sub(r"[ \t\n\x0b\f\r_]+", " ", key.lower()).strip(" ")
    return any(m in name for m in fixed.IMAGE_KEYS)


def typed_text(x: Any, typed: Any, most: int) -> str:
    """The type and text of a value. 2.00 is written as 2, and infinity as a text: only the types tell them apart."""
    if isinstance(x, (bool, dict, list)) or x is None:
        kind, bare = type(x).__name__, str(x) if x is None or isinstance(x, bool) else written(x)
    elif typed is NONE and (x.lstrip("-").isdigit() if isinstance(x, Number) else x in ("Infinity", "-Infinity", "NaN")):
        raise Unsure
    elif isinstance(x, Number):
        whole = isinstance(typed, int) and -(1 << 63) <= typed < 1 << 63
        kind, bare = "int" if whole else "float", x
    else:
        kind, bare = ("str", x) if typed is NONE or isinstance(typed, str) else ("float", quoted(x))
    return f'{{"type":"{kind}","value":{quoted(truncated(bare, most))}}}'


def bounded(text: str, value: VariantVal, most: int, items: int, depth: int) -> str:
    """The copy of the value that text is the JSON of."""

    def copy(x: Any, typed: Any, image: bool, level: int) -> str:
        if level > depth:
            return typed_text(x, typed, most)
        of = lambda k: NONE if typed is NONE else typed[k]
        if image and isinstance(x, (dict, list)):
            return f'{{"exists":true,"count":{max(1, len(x)) if isinstance(x, list) else 1}}}'
        if isinstance(x, dict):
            return "{" + ",".join([f"{quoted(k)}:{copy(v, of(k), image_key(k), level + 1)}" for k, v in x.items()]) + "}"
        if isinstance(x, list):
            parts = [copy(v, of(i), image, level + 1) for i, v in enumerate(x[:items])]
            return "[" + ",".join(parts + [f'"[{len(x) - items} additional values omitted]"'] * (len(x) > items)) + "]"
        return quoted(truncated(x, most)) if isinstance(x, str) and not isinstance(x, Number) else written(x)

    read = json.loads(text, parse_int=Number, parse_float=Number, parse_constant=Number)
    try:
        return copy(read, NONE, False, 0)
    except Unsure:
        return copy(read, value.toPython(), False, 0)
