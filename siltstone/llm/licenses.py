"""Licence scan: winnowed template fingerprints in an inverted index, then banded alignment.

Templates are hashed in runs of ``GRAM`` words (lower case, punctuation aside); of every ``WINDOW`` consecutive
hashes the least is a fingerprint, so a text that shares ``GRAM + WINDOW - 1`` words with a template shares a
fingerprint. The index maps fingerprints to (template, position). It is fixed by the template list, not by the data,
and travels with the task. A document's own fingerprints point to templates and diagonals; each such candidate is
aligned in a band around its diagonal. One map over the input, whole texts, no shuffle.

Coverage alone can't tell licences apart whose notices differ in one word, so a template may have *telling phrases*:
runs of words of which one must stand, word by word, in the aligned stretch (the name and the version). Templates of
fewer than ``SHORT_WORDS`` words must be covered to ``SHORT_COVERAGE``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import words as W
from siltstone.llm.alignment import banded, plain_words
from siltstone.llm.common import bounded_batches, lean

GRAM, WINDOW, BAND = 3, 2, 24
MIN_COVERAGE = 0.6
SHORT_WORDS, SHORT_COVERAGE = 20, 0.75

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the
Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the
hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU {name} for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by
any means."""

# Licence id and a text that states it; public licence headers and the usual one-line notices.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + _BSD3),
    ("Apache-2.0", _APACHE),
    ("GPL-2.0", _GNU.format(name="General Public License", version="2")),
    ("GPL-3.0", _GNU.format(name="General Public License", version="3")),
    ("LGPL-3.0", _GNU.format(name="Lesser General Public License", version="3")),
    ("AGPL-3.0", _GNU.format(name="Affero General Public License", version="3")),
    ("MPL-2.0", _MPL),
    ("Unlicense", _UNLICENSE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
]


# The phrases that tell a licence from its neighbours, as plain words; licences without any need none.
TELLING: dict[str, list[str]] = {
    "MIT": ["mit license", "mit licence", "permission is hereby granted free of charge"],
    "BSD-3-Clause": ["neither the name of", "bsd 3 clause"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache licence version 2 0"],
    "GPL-2.0": ["gnu general public license version 2", "version 2 of the license"],
    "GPL-3.0": ["gnu general public license version 3", "version 3 of the license"],
    "LGPL-3.0": ["gnu lesser general public license"],
    "AGPL-3.0": ["gnu affero general public license"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0"],
    "CC-BY-4.0": ["cc by 4 0", "attribution 4 0"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "attribution sharealike 4 0"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "attribution noncommercial 4 0"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "attribution noncommercial sharealike 4 0"],
    "CC0-1.0": ["cc0 1 0"],
}
# Phrases of which one must be there as well, where the version stands apart from the name.
VERSIONS: dict[str, list[str]] = {
    "GPL-2.0": ["gnu general public license"],
    "GPL-3.0": ["gnu general public license"],
    "LGPL-3.0": ["version 3"],
    "AGPL-3.0": ["version 3"],
}


def winnow(hashes: np.ndarray, word_off: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (hash, word index) of each text: the least run hash of each window, the rightmost of equals.

    A text with fewer runs than a window gives its least one, one with fewer words than a run none.
    """
    index, counts = W.valid_windows(word_off, gram)
    if not len(index):
        return np.zeros(0, dtype=np.uint64), index
    runs = W.window_hashes(hashes, gram)[index]
    ends = np.repeat(np.cumsum(counts), counts)
    at = np.arange(len(runs))
    best = at.copy()
    for k in range(1, window):
        other = np.minimum(at + k, ends - 1)
        best = np.where(runs[other] <= runs[best], other, best)
    starts = ends - np.repeat(counts, counts)
    chosen = np.unique(best[(at + window <= ends) | (at == starts)])
    return runs[chosen], index[chosen]


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: list[tuple[str, str]], telling: dict[str, list[str]], versions: dict[str, list[str]]):
        self.names = [name for name, _ in templates]
        hashes, word_off = _plain([text for _, text in templates])
        self.words = [hashes[a:b] for a, b in zip(word_off[:-1], word_off[1:], strict=True)]
        self.phrases = [[_phrases(table[n]) for table in (telling, versions) if n in table] for n in self.names]
        prints, index = winnow(hashes, word_off)
        template = np.searchsorted(word_off, index, side="right") - 1
        order = np.argsort(prints, kind="stable")
        self.prints, self.template, self.place = prints[order], template[order], (index - word_off[template])[order]

    def candidates(self, prints: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, word index, diagonal) of each match of a document fingerprint."""
        lo, hi = np.searchsorted(self.prints, prints, "left"), np.searchsorted(self.prints, prints, "right")
        reps = hi - lo
        which = np.repeat(lo, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        where = np.repeat(index, reps)
        return self.template[which], where, where - self.place[which]


def _plain(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [text.encode() for text in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    hashes, _, _, word_off = plain_words(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    return hashes, word_off


def _phrases(texts: list[str]) -> list[np.ndarray]:
    hashes, word_off = _plain(texts)
    return [hashes[a:b] for a, b in zip(word_off[:-1], word_off[1:], strict=True)]


def _holds(words: np.ndarray, phrase: np.ndarray) -> bool:
    """Whether a run of words stands in others word by word."""
    if len(words) < len(phrase):
        return False
    runs = np.lib.stride_tricks.sliding_window_view(words, len(phrase))
    return bool((runs == phrase).all(axis=1).any())


def _aligned(index: Index, words: np.ndarray, hits: list[tuple[int, int, int]], band: int, least: float) -> list[tuple[float, int, int, int, int]]:
    """(coverage, matched, start, end, template) of the candidates (template, word, diagonal) of one document.

    The candidates of a template are taken in text order. What lies before the end of an accepted stretch is not
    aligned again, so a notice that is repeated soon after itself is found each time; a candidate before a stretch that
    its alignment preferred gets the words up to there.
    """
    found: list[tuple[float, int, int, int, int]] = []
    at, floor, tried = None, 0, (0, 0)
    for template, where, diagonal in sorted(set(hits)):
        if template != at:
            at, floor, tried = template, 0, (-(1 << 60), 0)
        if where < floor or (where < tried[1] and abs(diagonal - tried[0]) <= band // 2):
            continue
        query, stop = index.words[template], len(words)
        need = max(least, SHORT_COVERAGE) if len(query) < SHORT_WORDS else least
        while True:
            matched, start, end, _ = banded(query, words[floor:stop], diagonal - floor, band)
            start, end = start + floor, end + floor
            fits = matched >= need * len(query) and all(any(_holds(words[start:end], p) for p in group) for group in index.phrases[template])
            if fits:
                found.append((matched / len(query), matched, start, end, template))
            if not fits or start <= where or stop == start:
                break
            stop = start
        tried = (diagonal, end)
        floor = max([floor, *(f[3] for f in found if f[4] == template)])
    return found


def _best(found: list[tuple[float, int, int, int, int]]) -> list[tuple[float, int, int, int, int]]:
    """Matches that don't overlap a better one (more matched words, then coverage)."""
    chosen: list[tuple[float, int, int, int, int]] = []
    for x in sorted(found, key=lambda f: (-f[1] * f[0], -f[0], f[2], f[4])):
        if all(x[3] <= y[2] or x[2] >= y[3] for y in chosen):
            chosen.append(x)
    return sorted(chosen, key=lambda f: f[2])


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str]] | None = None,
    min_coverage: float = MIN_COVERAGE,
    band: int = BAND,
    telling: dict[str, list[str]] | None = None,
    versions: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Licence statements in documents, in text order.

    One row for each: ``id_col``, ``license``, ``template`` (its number in the list), ``coverage`` (matched share of
    the template's words), ``matched_words``, ``start_word``, ``end_word`` (words by letters and digits) and
    ``start_byte``, ``end_byte`` in the UTF-8 text. Overlapping candidates leave the best; a notice that a text repeats
    is a row each time. With own ``templates`` the telling phrases are those given, or none.

    Edge cases: null, empty and wordless texts have no rows; templates of fewer than ``GRAM`` words can't match. A very
    long text is read whole, a very common notice costs one alignment each time it stands there. Repeated rows each
    give their own result; null ids are reported as null. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    own = templates is None
    lookup = Index(TEMPLATES if own else templates, (TELLING if own else {}) if telling is None else telling, (VERSIONS if own else {}) if versions is None else versions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = W.text_bytes(batch.column(1))
            rows: list[tuple] = []
            for a, b in W.pieces(offsets):
                base = offsets[a : b + 1] - offsets[a]
                hashes, starts, ends, word_off = plain_words(data[offsets[a] : offsets[b]], base)
                template, where, diagonal = lookup.candidates(*winnow(hashes, word_off))
                row = np.searchsorted(word_off, where, side="right") - 1
                for i in np.unique(row).tolist():
                    own, first = row == i, int(word_off[i])
                    words = hashes[first : word_off[i + 1]]
                    hits = list(zip(template[own].tolist(), (where[own] - first).tolist(), (diagonal[own] - first).tolist(), strict=True))
                    for coverage, matched, start, end, t in _best(_aligned(lookup, words, hits, band, min_coverage)):
                        rows.append((ids[a + i], lookup.names[t], t, coverage, matched, start, end, int(starts[first + start] - base[i]), int(ends[first + end - 1] - base[i])))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    names = ["id", "license", "template", "coverage", "matched_words", "start_word", "end_word", "start_byte", "end_byte"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.float64(), *[pa.int64()] * 5]
    schema = "id long, license string, template int, coverage double, matched_words long, start_word long, end_word long, start_byte long, end_byte long"
    plain = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)
