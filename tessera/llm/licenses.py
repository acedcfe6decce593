"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Templates and texts are read as lower-cased words and shingles of five words (a shorter template is one
shingle). Templates fall into size classes, the powers of two. A text is read in windows of 1.5 class sizes that
start every half class size, so any stretch as long as a template of the class lies whole in some window.

A window has BANDS MinHash values, each a band of one row. A window that holds a share c of a template's
shingles has a Jaccard similarity of at least c / (1 + 3 - c) even for the smallest template of its class (a
template is over half of its class size, a window 1.5 class sizes and one shingle more at the class of one), so
at the least accepted share of 0.8 the chance to meet in some band is at least 1 - (1 - 0.25)**64, over
0.99999998. Retrieved pairs are then verified on the words themselves.

The bands of all templates are one index, value to templates, and every window looks its values up there. A
window can only share a band's value with a template if it holds the shingle that gives the template this value;
signatures are therefore worked out for windows around such shingles alone, which loses nothing. The work on a
text follows its windows and the templates that they retrieve, not the number of templates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import text_chunks
from ._words import WordCache, cache_for, mix

SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 64
_WORD = re.compile(r"\w+")

# The public notices' own wording.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def words_of(text: str) -> list[str]:
    """Lower-cased words, as many as the text has (lower-casing first could split one)."""
    found = _WORD.findall(text)
    return "\n".join(found).lower().split("\n") if found else []


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x100000001B3) + hashes[k : k + n])
    return out


_BAND_KEYS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _signature(shingles: np.ndarray) -> np.ndarray:
    return mix(shingles[:, None] ^ _BAND_KEYS).min(axis=0)


@dataclass
class _Template:
    name: str
    shingles: set[tuple[str, ...]]
    size: int  # words of a shingle: SHINGLE, or all words of a shorter template
    span: int  # size class in shingles


class Scanner:
    def __init__(self, templates: Mapping[str, str]):
        self.templates: list[_Template] = []
        #: (words of a shingle, size class) -> band and value -> templates: the band index
        self.index: dict[tuple[int, int], dict[tuple[int, int], list[_Template]]] = {}
        triggers: dict[tuple[int, int], list[np.ndarray]] = {}  # the shingles behind the bands' values
        for name, text in sorted(templates.items()):
            words = words_of(text)
            if not words:
                raise ValueError(f"template {name} has no word")
            size = min(SHINGLE, len(words))
            hashes = _shingle_hashes(_word_hashes(words), size)
            span = 1 << (len(hashes) - 1).bit_length()
            template = _Template(name, {tuple(words[i : i + size]) for i in range(len(hashes))}, size, span)
            self.templates.append(template)
            bands = self.index.setdefault((size, span), {})
            for band, value in enumerate(_signature(hashes).tolist()):
                bands.setdefault((band, value), []).append(template)
            triggers.setdefault((size, span), []).append(hashes[mix(hashes[:, None] ^ _BAND_KEYS).argmin(axis=0)])
        self.triggers = {kind: np.unique(np.concatenate(found)) for kind, found in triggers.items()}
        self.by_size = {s: np.unique(np.concatenate([t for (size, _), t in self.triggers.items() if size == s])) for s in {size for size, _ in self.triggers}}

    def _scan_text(self, text: str, hashes: np.ndarray) -> list[tuple[str, float, int, int]]:
        words = words_of(text)
        shingles = {s: _shingle_hashes(hashes, s) for s in self.by_size}
        found: dict[str, set[tuple[float, int, int]]] = {}
        for (size, span), bands in self.index.items():
            own = shingles[size]
            hits = np.flatnonzero(np.isin(own, self.triggers[size, span]))
            if not len(hits):
                continue
            step, width = max(1, span // 2), span + max(1, span // 2)
            first, last = np.maximum(0, (hits - width) // step + 1), hits // step
            starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(first.tolist(), last.tolist(), strict=True)])) * step
            for start in starts.tolist():
                values = enumerate(_signature(own[start : start + width]).tolist())
                retrieved = {t.name: t for value in values if value in bands for t in bands[value]}
                if not retrieved:
                    continue
                here: dict[tuple[str, ...], list[int]] = {}
                for i in range(start, min(start + width, len(own))):
                    here.setdefault(tuple(words[i : i + size]), []).append(i)
                for t in retrieved.values():
                    shared = [here[s] for s in t.shingles if s in here]
                    if (share := len(shared) / len(t.shingles)) >= CONTAINMENT:
                        found.setdefault(t.name, set()).add((share, min(p[0] for p in shared), max(p[0] for p in shared) + size))
                        if any(len(p) > 1 for p in shared):  # more than one occurrence: the last one of each shingle too
                            found[t.name].add((share, min(p[-1] for p in shared), max(p[-1] for p in shared) + size))
        if not found:
            return []
        spans, out = [m.span() for m in _WORD.finditer(text)], []
        for name in sorted(found):
            told: list[tuple[int, int]] = []
            for share, a, b in sorted(found[name], key=lambda f: (-f[0], f[2] - f[1], f[1])):
                if all(b <= c or a >= d for c, d in told):
                    told.append((a, b))
                    out.append((name, share, spans[a][0], spans[b - 1][1]))
        return sorted(out, key=lambda f: (f[0], f[2]))

    def scan(self, texts: list[str], cache: WordCache) -> list[list[tuple[str, float, int, int]]]:
        """For each whole text (template, containment, first and after-last character) of its stretches."""
        words, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = words_of(text)
            counts[i] = len(own)
            words += own
        out: list[list] = [[] for _ in texts]
        if not words:
            return out
        rows, table = cache.lookup(words)
        hashes = table[rows]
        ends = np.cumsum(counts)
        some = set()
        for size, triggers in self.by_size.items():
            at = np.flatnonzero(np.isin(_shingle_hashes(hashes, size), triggers))
            some |= set(np.searchsorted(ends, at, side="right").tolist())
        for i in sorted(some):
            out[i] = self._scan_text(texts[i], hashes[ends[i] - counts[i] : ends[i]])
        return out


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` and stretch that matches a template: id, license, containment, start, end.

    start and end are character positions in the text. Stretches of one template do not overlap: of those that do,
    the one with the largest containment is told, then the shorter, then the first. Texts of any length are read
    whole; null, empty and wordless texts match nothing; repeated rows are reported each; an empty table gives no
    rows; other columns are ignored.
    """
    known = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known)
        cache = cache_for(("license_words", 1), lambda: WordCache(_word_hashes))
        for part, texts in text_chunks(batches, "_text"):
            rows = [(i, *hit) for i, hits in enumerate(scanner.scan(texts, cache)) for hit in hits]
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            columns = [pa.array([r[k + 1] for r in rows], kind) for k, kind in enumerate(kinds)]
            ids = part.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["_id", "license", "containment", "start", "end"])

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, license string, containment double, start long, end long").withColumnRenamed("_id", id_col)
