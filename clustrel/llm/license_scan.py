"""License scans: fingerprints of templates in an inverted index, then banded alignment.

Texts and templates become words (letters and digits of any script, ASCII letters in lower case). Every
GRAM words in a row are hashed, and of each WINDOW such hashes in a row, in texts and templates alike, the least is a fingerprint, so that any
GRAM + WINDOW - 1 words in common share one. The templates' fingerprints are an inverted index from hash to
template and position: its size is that of the templates, a fixed list, so it goes to every task. Templates of
fewer than SHORT words are met wherever as many of their words as the coverage asks for stand within twice
their length, so that no edit hides them; long ones need a fingerprint in common. Hits whose diagonals (position
in the text less that in the template) lie within half a template of each other are one band; its text is
aligned to the template within the band (matches 1, others -1), and what an alignment leaves is aligned again. What is reported is the share of
the template's words that match, and the span of the text, in code points, end exclusive.

Edge cases: a null or empty text has no hits; texts are read whole; several notices in one text are reported
each; of spans that overlap the one with more matched words stays (ties: by name); repeated rows are scanned
each for itself; an empty table gives no rows; columns other than id and text aren't read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrel.llm import hashing
from clustrel.llm.common import documents

GRAM, WINDOW, BAND = 3, 2, 8
#: Templates of fewer words are found by their words, not by fingerprints.
SHORT = 24
COVERAGE = 0.7

# Notices of common licenses and beginnings of their texts, not whole texts.
TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}

_MEMBER = np.zeros(256, bool)
_MEMBER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(text: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The text's bytes in lower case, and starts, ends and hashes of its words in them."""
    low = text.encode("utf-8", "surrogatepass").lower()
    data = np.frombuffer(low, np.uint8)
    starts, ends = hashing.runs(_MEMBER[data])
    return low, starts, ends, hashing.hashes(data, starts, ends)


def fingerprints(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the winnowed grams of a sequence of words."""
    g = hashing.grams(h, GRAM)
    if not len(g):
        return g, np.zeros(0, np.int64)
    if len(g) < WINDOW:
        at = np.array([int(g.argmin())])
    else:
        views = np.lib.stride_tricks.sliding_window_view(g, WINDOW)
        at = np.unique(np.arange(len(views)) + WINDOW - 1 - views[:, ::-1].argmin(axis=1))  # of equals the last
    return g[at], at


def needed(template: list[int], coverage: float) -> int:
    """The least number of matches that reach the coverage."""
    return max(1, next(m for m in range(int(coverage * len(template)), len(template) + 2) if m >= coverage * len(template)))


class Index:
    """The templates' words, the inverted index of the long ones' fingerprints, and that of the short ones' words."""

    def __init__(self, templates: Mapping[str, str]) -> None:
        self.names = sorted(templates)
        self.words: list[list[int]] = []
        posts = []
        for k, name in enumerate(self.names):
            h = tokens(templates[name])[3]
            self.words.append(h.tolist())
            if len(h) < SHORT:
                continue
            posts += [(int(x), k, int(i)) for x, i in zip(*fingerprints(h), strict=True)]
        posts.sort()
        self.keys, self.first = np.unique(np.array([p[0] for p in posts], np.uint64), return_index=True)
        self.first = np.append(self.first, len(posts))
        self.posts = [(k, i) for _, k, i in posts]
        self.short = [(k, np.unique(np.array(w, np.uint64))) for k, w in enumerate(self.words) if 0 < len(w) < SHORT]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w for _, w in self.short)]))
        self.member = [(k, np.isin(self.vocabulary, w)) for k, w in self.short]

    def near(self, h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """By short template, the positions of a text's words that it has."""
        if not len(h) or not len(self.vocabulary):
            return
        slot = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        at = np.flatnonzero(self.vocabulary[slot] == h)
        slot = slot[at]
        for k, member in self.member:
            yield k, at[member[slot]]

    def hits(self, h: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By template, the pairs of positions in text and template that share a fingerprint."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        g, at = fingerprints(h)
        if len(g) and len(self.keys):
            slot = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
            for s, p in zip(*(x[self.keys[slot] == g].tolist() for x in (slot, at)), strict=True):
                for k, i in self.posts[self.first[s] : self.first[s + 1]]:
                    found[k].append((p, i))
        return found


#: Of a cell of an alignment, in one number: what a score of one, and a match, are worth; the first word's place is the rest.
_POINT, _MATCHED = 1 << 46, 1 << 31


def align(text: list[int], template: list[int], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """The best local alignment with text position minus template position within a band of diagonal: matches, first and end of the text's words.

    Rows of the band are arrays. Of equal scores the one with more matches counts, then the one that begins later.
    """
    words, n = np.array(template), len(template)
    ramp = np.arange(n, dtype=np.int64) * _POINT
    row = np.zeros(n + 1, np.int64)  # by template position + 1; 0 where no alignment ends
    best, end = 0, 0
    for i, w in enumerate(text):
        lo, hi = max(0, i - diagonal - band), min(n, i - diagonal + band + 1)
        if lo >= hi:
            continue
        before = row[lo:hi]
        cell = np.where(before > 0, before, i) + np.where(words[lo:hi] == w, _POINT + _MATCHED, -_POINT)
        np.maximum(cell, row[lo + 1 : hi + 1] - _POINT, out=cell)
        cell = np.maximum.accumulate(cell + ramp[lo:hi]) - ramp[lo:hi]  # words of the template left out
        cell[cell < _POINT] = 0
        row[lo + 1 : hi + 1] = cell
        row[lo] = 0
        top = int(cell.max())
        if top // _MATCHED > best // _MATCHED:
            best, end = top, i + 1
            if top // _POINT == n:  # the whole template as it is: nothing that follows is better
                break
    return best % _POINT // _MATCHED, best % _MATCHED, end


def places(template: list[int]) -> dict[int, int]:
    """Of each word of a template, its positions as bits."""
    out: dict[int, int] = defaultdict(int)
    for j, w in enumerate(template):
        out[w] |= 1 << j
    return out


def in_order(words: list[int], bits: dict[int, int], n: int) -> int:
    """The most words that any alignment could match: the longest common subsequence with the template of n words, a row of it in the bits of a number."""
    full = row = (1 << n) - 1
    for w in words:
        if w in bits:
            both = row & bits[w]
            row = (row + both | row - both) & full
    return n - row.bit_count()


def every(h: list[int], template: list[int], need: int, diagonal: int, band: int) -> Iterator[tuple[int, int, int]]:
    """matches, first and end of the template's alignments of at least so many matches within the band, apart from each other.

    An alignment has fewer errors than matches, so it is shorter than two templates; a window of four holds
    all that start in its first half. After the best of a window what lies before it is searched, then what follows.
    """
    n, have = len(template), places(template)
    todo = [(0, len(h))]
    while todo:
        s, hi = todo.pop()
        if hi - s < need:
            continue
        window = h[s : min(hi, s + 4 * n)]
        if in_order(window, have, n) < need:
            if s + 4 * n < hi:
                todo.append((s + 2 * n + 1, hi))
            continue
        matched, first, end = align(window, template, diagonal - s, band)
        first, end = s + first, s + end
        if first >= s + 2 * n:  # it may go on beyond the window
            todo += [(first, hi), (s, first)]
        elif matched >= need:
            yield matched, first, end
            todo += [(end, hi), (s, first)]
        else:
            todo += [(first + 1, hi), (s, first)]


def scan(text: str | None, index: Index, coverage: float = COVERAGE) -> list[tuple[str, float, int, int, int, int]]:
    """template, coverage, matched words, template's words, start and end of each notice in a text."""
    if not text:
        return []
    low, starts, ends, h = tokens(text)
    ranges: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # first and end in the text, and the band
    for k, pairs in index.hits(h).items():
        n = len(index.words[k])
        diagonals = np.unique(np.array([p - i for p, i in pairs]))
        cuts = np.flatnonzero(np.diff(diagonals) > n // 2 + BAND) + 1  # an alignment leaves out fewer words than either side of them matches
        for part in np.split(diagonals, cuts):
            lo, hi = int(part[0]), int(part[-1])
            ranges[k].append((lo - BAND, hi + n + BAND, (lo + hi) // 2, (hi - lo) // 2 + 1 + BAND))
    for k, at in index.near(h):
        n, need = len(index.words[k]), needed(index.words[k], coverage)
        if len(at) >= need:
            close = at[np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] < 2 * n)]
            for part in np.split(close, np.flatnonzero(np.diff(close) > 4 * n) + 1) if len(close) else ():
                lo, hi = int(part[0]) - 2 * n, int(part[-1]) + 2 * n
                ranges[k].append((lo, hi, (lo + hi) // 2, hi - lo + n))
    found = []
    for k, spans in ranges.items():
        template = index.words[k]
        for lo, hi, diagonal, band in spans:
            lo = max(0, lo)
            for matched, first, end in every(h[lo:hi].tolist(), template, needed(template, coverage), diagonal - lo, band):
                found.append((index.names[k], matched / len(template), matched, len(template), lo + first, lo + end))
    kept: list[tuple] = []
    for f in sorted(set(found), key=lambda f: (-f[2], -f[1], f[0], f[4])):
        if all(f[5] <= o[4] or o[5] <= f[4] for o in kept):
            kept.append(f)
    chars = lambda at: len(low[:at].decode("utf-8", "surrogatepass"))
    return [(*f[:4], chars(starts[f[4]]), chars(ends[f[5] - 1])) for f in sorted(kept, key=lambda f: f[4])]


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, template, coverage, n_matched, n_template, start, end: a row per notice of docs(doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(Index(templates))
    types = [pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 4]
    names = ["doc_id", "template", "coverage", "n_matched", "n_template", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for b in batches:
            rows = [(d, *f) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for f in scan(t.as_py(), index, coverage)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, template string, coverage double, n_matched long, n_template long, start long, end long")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    """The license notices of all documents."""
    return scan_licenses(documents(spark, sf_dir))


__all__ = ["COVERAGE", "TEMPLATES", "Index", "align", "fingerprints", "op9_license_scan", "scan", "scan_licenses", "tokens"]
