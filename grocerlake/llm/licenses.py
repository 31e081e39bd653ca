"""License scans: known notices found in texts, with matched coverage and spans.

Templates and texts are cut into word 3-grams, whose hashes are winnowed; an
inverted index of the templates' fingerprints picks candidate templates and diagonals,
and a banded alignment of the words at a diagonal decides.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import LOWER, chunks, mix, runs, span_hashes
from .common import table

#: Words of a gram and grams of a winnowing window: every shared run of
#: GRAM + WINDOW - 1 words has a fingerprint in common.
GRAM, WINDOW = 3, 2
#: Words by which an alignment may leave its diagonal; for short templates a quarter of theirs,
#: lest it reach the next occurrence.
BAND = 12
MIN_COVERAGE = 0.8

# The wording of public license texts and notices.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "mit-line-licensed": "Licensed under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."
    ),
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
}

RESULT = "template string, matched_words int, template_words int, coverage double, span_start int, span_end int"

_WORD = np.zeros(256, bool)
_WORD[[b for b in range(256) if b >= 128 or chr(b).isalnum()]] = True


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and text number of each word; bytes are counted over the joined texts."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts, ends = runs(_WORD[data])
    owner = np.searchsorted(begins, starts, "right") - 1
    return span_hashes(LOWER[data], starts, ends) if len(starts) else np.zeros(0, np.uint64), starts, ends, owner


def fingerprints(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places of their grams): the least hash of each window of grams of one text."""
    if len(words) < GRAM:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(words) - GRAM + 1
    gram = mix(words[:n] + mix(words[1 : n + 1] + mix(words[2 : n + 2])))
    inside = owner[:n] == owner[GRAM - 1 :]
    gram[~inside] = np.uint64(2**64 - 1)
    keep = inside.copy()
    # a gram stays unless it is the larger one in each window that it shares
    if n > 1:
        left = np.concatenate(([False], gram[:-1] < gram[1:])) & np.concatenate(([False], inside[:-1]))
        right = np.concatenate((gram[1:] < gram[:-1], [False])) & np.concatenate((inside[1:], [False]))
        has_left = np.concatenate(([False], inside[:-1])) & inside
        has_right = np.concatenate((inside[1:], [False])) & inside
        lone = ~has_left & ~has_right
        keep = inside & (lone | (has_left & ~left) | (has_right & ~right))
    at = np.flatnonzero(keep)
    return gram[at], at


class Index:
    """Templates' words and the inverted index of their fingerprints."""

    def __init__(self, templates: Mapping[str, str]):
        self.names, self.words = list(templates), []
        hashes, template, place = [], [], []
        for k, name in enumerate(self.names):
            w, _, _, owner = _words([templates[name].encode()])
            if len(w) < GRAM + WINDOW - 1:
                raise ValueError(f"template {name} is shorter than {GRAM + WINDOW - 1} words")
            h, at = fingerprints(w, owner)
            self.words.append(w.tolist())
            hashes.append(h)
            template.append(np.full(len(h), k))
            place.append(at)
        hashes, template, place = map(np.concatenate, (hashes, template, place))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.template, self.place = hashes[order], template[order], place[order]
        # a small table tells most hashes apart from the index without a search
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the hash, number of the index entry) of all equal pairs."""
        maybe = np.flatnonzero(self.bits[(hashes >> np.uint64(48)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hashes, hashes[maybe]), np.searchsorted(self.hashes, hashes[maybe], "right")
        n = hi - lo
        return np.repeat(maybe, n), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def align(template: list[int], words: list[int], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, past the last matched word) of the best alignment in the band.

    Word i of the template may match word i + diagonal + d, |d| <= band.  A match
    counts 2, a word left out on either side costs 1; the best local score wins.
    """
    width, best = 2 * band + 1, (0, 0, 0, 0)
    none = (0, 0, -1, -1)  # score, matches, first, past last
    above = [none] * (width + 1)
    for i, w in enumerate(template):
        row, left = [none] * (width + 1), none
        base = i + diagonal - band
        for d in range(width):
            j = base + d
            cell = none
            up = above[d + 1]
            if up[0] > 1:
                cell = (up[0] - 1, *up[1:])
            if left[0] - 1 > cell[0]:
                cell = (left[0] - 1, *left[1:])
            if 0 <= j < len(words) and words[j] == w:
                p = above[d]
                score = p[0] + 2
                if score >= cell[0]:
                    cell = (score, p[1] + 1, p[2] if p[1] else j, j + 1)
                    best = max(best, (cell[0], cell[1], -cell[2], cell[3]))
            elif above[d][0] - 1 > cell[0]:
                p = above[d]
                cell = (p[0] - 1, *p[1:])
            row[d] = left = cell
        above = row
    return best[1], -best[2], best[3]


@lru_cache(maxsize=2)
def _index(templates: tuple[tuple[str, str], ...]) -> Index:
    return Index(dict(templates))


def scan(texts: list[bytes], index: Index, min_coverage: float = MIN_COVERAGE) -> Iterator[list[tuple]]:
    """For each text its matches: (template, matched, words, coverage, start, end).

    Start and end are counted in code points.  Matches never overlap: of
    two that do, the one with more matched words counts.
    """
    for _, group in chunks(texts):
        words, starts, ends, owner = _words(group)
        h, at = fingerprints(words, owner)
        which, entry = index.hits(h)
        found: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        first_word = np.searchsorted(owner, np.arange(len(group) + 1))
        for a, e in zip(at[which].tolist(), entry.tolist()):
            doc = int(owner[a])
            found[doc, int(index.template[e])][a - int(first_word[doc]) - int(index.place[e])].append(a - int(first_word[doc]))
        matches: list[list[tuple]] = [[] for _ in group]
        begins = np.cumsum([0, *(len(t) + 1 for t in group)])
        for (doc, k), diagonals in sorted(found.items()):
            lo, hi = first_word[doc], first_word[doc + 1]
            template = index.words[k]
            kinds, most = np.unique(np.array(template, words.dtype), return_counts=True)
            kind = np.minimum(np.searchsorted(kinds, words[lo:hi]), len(kinds) - 1)
            kind[kinds[kind] != words[lo:hi]] = len(kinds)
            band, upto = min(BAND, max(1, len(template) // 4)), -1
            for diagonal, places in sorted(diagonals.items()):
                if max(places) < upto:
                    continue  # within the match before
                # only the words that the band can reach
                base = max(0, diagonal - band)
                end = min(hi, lo + max(0, diagonal) + len(template) + band)
                # no alignment matches a word more often than both have it
                common = np.minimum(np.bincount(kind[base : end - lo], minlength=len(kinds) + 1)[:-1], most).sum()
                if common < min_coverage * len(template):
                    continue
                near = words[lo + base : end].tolist()
                matched, a, b = align(template, near, diagonal - base, band)
                coverage = matched / len(template)
                if coverage >= min_coverage:
                    upto = base + b
                    start, end = int(starts[lo + base + a] - begins[doc]), int(ends[lo + base + b - 1] - begins[doc])
                    matches[doc].append((-matched, -coverage, index.names[k], len(template), start, end))
        yield from (_apart(found, text) for found, text in zip(matches, group))


def _apart(found: list[tuple], text: bytes) -> list[tuple]:
    """The longest matches, then the best covered; what overlaps one of them is left out."""
    taken: list[tuple[int, int]] = []
    out = []
    for matched, coverage, name, words, start, end in sorted(set(found)):
        k = bisect_left(taken, (start, end))
        if (k and taken[k - 1][1] > start) or (k < len(taken) and taken[k][0] < end):
            continue
        taken.insert(k, (start, end))
        begin = len(text[:start].decode())
        out.append((name, -matched, words, -coverage, begin, begin + len(text[start:end].decode())))
    return sorted(out, key=lambda m: m[4])


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, text: str = "text", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """A row for each match of a template in a document: doc_id, template, matched and
    template words, coverage, span in code points.

    Null, empty and unmatched texts have no row; repeated rows are scanned apart; a
    text with the notice twice has two rows.  Other columns are ignored.
    """
    fixed = tuple(templates.items())

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(fixed)
        types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
        names = ["doc_id", "template", "matched_words", "template_words", "coverage", "span_start", "span_end"]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[i], *m) for i, found in enumerate(scan([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()], index, min_coverage)) for m in found]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(matches, f"doc_id long, {RESULT}")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
