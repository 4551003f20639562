"""License notices in whole texts: MinHash bands over overlapping windows find templates, exact containment decides.

Words are lower-cased and stripped of marks; shingles are SHINGLE words. Templates are dealt to size classes; a class's
windows are twice its longest template and move by half their length, so every notice lies whole in some window. The
least Jaccard similarity of such a window with a template that it holds to CONTAINMENT follows from the sizes, and from
it the number of one-row bands for which a collision has probability CATCH or more (:func:`bands_for`). Each candidate
is then verified exactly: the share of the template's shingles that lie in the window.

The templates are a short list of fixed size, so they go to every task; documents are never shuffled. Texts pass in
slices of bounded size. Null and empty texts match nothing; repeated rows match alike; a null doc_id passes through;
an empty table or an empty list of templates gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from .common import WORD
from .hashing import joined, mixed

SHINGLE, CONTAINMENT, CATCH, SEED = 3, 0.8, 0.999, 11
#: Words of a block; windows are whole blocks.
UNIT = 8
SLICE_CHARS = 4_000_000
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)

# Public license notices.
TEMPLATES: dict[str, str] = {
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-short": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

_words = re.compile(WORD).findall


def words(text: str | None) -> list[str]:
    return [s for w in _words(text or "") if (s := w.lower().strip(".,;:!?\"'()[]{}<>*#/-"))]


def shingles(ws: list[str]) -> np.ndarray:
    return joined(np.array([xxhash.xxh3_64_intdigest(w) for w in ws], "uint64"), SHINGLE)


def bands_for(similarity: float, catch: float = CATCH) -> int:
    """Bands of one row for which sets this similar collide with probability `catch` or more."""
    return math.ceil(math.log(1 - catch) / math.log(1 - similarity))


def _min_ahead(values: np.ndarray, text: np.ndarray, blocks: int) -> np.ndarray:
    """The least of each block and the blocks - 1 next ones of its text; blocks is a power of two."""
    have = 1
    while have < blocks:
        if len(values) > have:
            ahead = values.copy()
            same = text[have:] == text[:-have]
            ahead[:-have][same] = np.minimum(values[:-have][same], values[have:][same])
            values = ahead
        have *= 2
    return values


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.classes: dict[int, list[tuple[str, np.ndarray]]] = {}
        least = 1.0
        for name, text in sorted(templates.items()):
            ws = words(text)
            s = np.unique(shingles(ws))
            if not len(s):
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            blocks = 2
            while blocks * UNIT // 2 < len(ws):
                blocks *= 2
            self.classes.setdefault(blocks, []).append((name, s))
            need = math.ceil(CONTAINMENT * len(s))
            least = min(least, need / (blocks * UNIT + len(s) - need))
        rng = np.random.default_rng(SEED)
        n = bands_for(least) if templates else 0
        self.keys = rng.integers(1, 1 << 63, n, "uint64") * np.uint64(2) + np.uint64(1)
        self.wanted = {b: [{} for _ in range(n)] for b in self.classes}
        for b, group in self.classes.items():
            for i, key in enumerate(self.keys):
                for at, (_, s) in enumerate(group):
                    self.wanted[b][i].setdefault(int(mixed(s * key).min()), []).append(at)

    def scan(self, texts: list[str | None]) -> list[tuple[int, str, float, int, int]]:
        """(text's number, template, best containment, first word of its window, matching windows)."""
        ws = [words(t) for t in texts]
        sizes = np.fromiter(map(len, ws), "int64", len(ws))
        room = -(-sizes // UNIT) * UNIT
        total = int(room.sum())
        if not total or not self.classes:
            return []
        code = {w: i for i, w in enumerate(set().union(*ws))}
        hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in code), "uint64", len(code))
        start = np.cumsum(room) - room
        at = np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        flat = np.zeros(total + SHINGLE - 1, "uint64")
        flat[at] = hashed[np.fromiter((code[w] for t in ws for w in t), "int64", int(sizes.sum()))]
        left = np.zeros(total, "int64")
        left[at] = np.repeat(np.cumsum(sizes), sizes) - np.arange(int(sizes.sum()))
        real = left >= SHINGLE
        grams = joined(flat, SHINGLE)
        text = np.repeat(np.arange(len(ws)), room // UNIT)
        nth = np.arange(len(text)) - start[text] // UNIT
        found: set[tuple[int, int, int]] = set()
        for i, key in enumerate(self.keys):
            values = np.where(real, mixed(grams * key), ONES).reshape(-1, UNIT).min(1)
            for blocks in self.classes:
                wanted = self.wanted[blocks][i]
                least = _min_ahead(values, text, blocks)
                hits = np.flatnonzero(np.isin(least, np.array(list(wanted), "uint64")) & (nth % (blocks // 2) == 0))
                found.update((int(h), blocks, t) for h in hits for t in wanted[int(least[h])])
        matches: dict[tuple[int, str], tuple[float, int, int]] = {}
        for h, blocks, t in sorted(found):
            name, s = self.classes[blocks][t]
            which = int(text[h])
            end = min(h + blocks, (int(start[which]) + int(room[which])) // UNIT) * UNIT
            here = grams[h * UNIT : end][real[h * UNIT : end]]
            share = float(np.isin(s, here).mean())
            if share >= CONTAINMENT:
                best, first, n = matches.get((which, name), (0.0, 0, 0))
                matches[which, name] = (share, int(nth[h]) * UNIT, n + 1) if share > best else (best, first, n + 1)
        return [(k, name, *m) for (k, name), m in sorted(matches.items())]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, template_id, containment, first_word, n_windows), one row for each document and template that match."""
    scanner = Scanner(TEMPLATES if templates is None else templates)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            size = whole[text_col].str.len().fillna(0).to_numpy().cumsum()
            at = 0
            while at < len(whole):
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_CHARS, "right")))
                part = whole.iloc[at:end]
                rows = scanner.scan(part[text_col].tolist())
                ids = part[id_col].iloc[[r[0] for r in rows]].reset_index(drop=True)
                yield pd.DataFrame({id_col: ids, "template_id": pd.Series([r[1] for r in rows], dtype=object), "containment": [r[2] for r in rows], "first_word": [r[3] for r in rows], "n_windows": [r[4] for r in rows]})
                at = end

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInPandas(work, f"`{id_col}` {kind}, template_id string, containment double, first_word long, n_windows long")
