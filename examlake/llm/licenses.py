"""Licences: normalised text against licence texts, headers and notices by the Dice coefficient over word bigrams.

Words are runs of letters and digits, lower-cased; a unit is the set of its neighbouring word pairs. Units are the lines of
a text, the whole text where it has more than one line, and all runs of words within it, over line ends too, so a licence
is found wherever it stands. A Dice coefficient of t needs t / (2 - t) of the template's pairs in the text, so a text that
holds fewer of them is never compared with that template; no unit that could match is left out by this.

Lines and whole texts that match are always reported. Of the runs of words, the best one from each first word counts; they
are taken best first (of equal scores the shorter, then the earlier), without those of whose words more than half lie
in better units; those inside a line or whole text reported for the same licence are not told again.

The templates are broadcast; each has at most ``LARGEST`` word pairs, a larger one is an error.

Defined results: a null or empty text, and a unit of one word, has no pairs and matches nothing; of equal scores
the first licence by name counts; repeated rows give repeated rows; a column named licenses is replaced,
other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.shared import fresh, slices, text_of, with_results
from examlake.llm.words import NON_SPACE, mixed, words

# Notices and headers as their licences ask for them.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "MIT": ["Released under the MIT License."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
}
_GNU = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."
for _name, *_of in (("GPL-2.0", "program", "General Public License", "2"), ("GPL-3.0", "program", "General Public License", "3"), ("LGPL-2.1", "library", "Lesser General Public License", "2.1"), ("LGPL-3.0", "library", "Lesser General Public License", "3")):
    NOTICES.setdefault(_name, []).append(_GNU.format(*_of))
#: The licences' own texts, a file each.
TEXTS = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted((resources.files(__package__) / "license_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}
TEMPLATES = {name: NOTICES.get(name, []) + [TEXTS[name] for _ in range(name in TEXTS)] for name in sorted({*NOTICES, *TEXTS})}
#: A Dice coefficient of at least this reports a licence; in hundredths, so that comparisons are of integers.
DICE_PERCENT = 80
#: Word pairs of the largest template allowed.
LARGEST = 8192
FOUND = "array<struct<line:int,last:int,license:string,dice:double>>"
_BITS = 20


def _words_of(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _pairs_of(text: str) -> list[str]:
    w = _words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def _hashes(h: np.ndarray) -> np.ndarray:
    """Of all neighbouring pairs of word hashes."""
    return mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ mixed(h[1:]))


class _Forms:
    """Pairs of all templates, and the numbers of word pairs that a match needs (``least``) and may have (``most``)."""

    def __init__(self, templates: dict[str, list[str]], percent: int):
        forms = [(name, np.unique(_hashes(words(pa.array([" ".join(_words_of(t))])).hash))) for name, texts in sorted(templates.items()) for t in texts]
        forms = [(name, pairs) for name, pairs in forms if len(pairs)]
        self.percent, self.names, self.of = percent, [name for name, _ in forms], [pairs for _, pairs in forms]
        self.size = np.array([len(p) for p in self.of], np.int64)
        if self.size.max(initial=0) > LARGEST:
            raise ValueError(f"a template of {self.size.max()} word pairs; {LARGEST} at most")
        self.least, self.most = -(-self.size * percent // (200 - percent)), self.size * (200 - percent) // percent
        self.pairs, at = np.unique(np.concatenate([*self.of, np.zeros(0, np.uint64)]), return_inverse=True)
        order = np.argsort(at, kind="stable")
        self.owner = np.repeat(np.arange(len(forms)), self.size)[order]
        self.first = np.searchsorted(at[order], np.arange(len(self.pairs) + 1))
        self.known = np.zeros(1 << _BITS, bool)
        self.known[(self.pairs & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def near(self, h: np.ndarray, text: np.ndarray) -> dict[int, list[int]]:
        """By text, the templates of which it holds enough pairs; ``h`` and ``text`` are those of its pairs."""
        at = np.flatnonzero(self.known[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        place = np.searchsorted(self.pairs, h[at])
        ok = self.pairs[np.minimum(place, len(self.pairs) - 1)] == h[at]
        cell = np.unique(text[at[ok]] * len(self.pairs) + place[ok])
        t, p = cell // len(self.pairs), cell % len(self.pairs)
        n = self.first[p + 1] - self.first[p]
        flat = np.repeat(self.first[p] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        key, count = np.unique(np.repeat(t, n) * len(self.names) + self.owner[flat], return_counts=True)
        out: dict[int, list[int]] = {}
        for k in key[count >= self.least[key % len(self.names)]].tolist():
            out.setdefault(k // len(self.names), []).append(k % len(self.names))
        return out


def _runs(inside: np.ndarray, before: np.ndarray, size: int, most: int, percent: int) -> Iterator[tuple[float, int, int]]:
    """(score, first pair, last pair) of the best run from each pair of a template; ``before`` is where each pair stood last."""
    total = int(np.count_nonzero(inside & (before < 0)))
    for s in np.flatnonzero(inside).tolist():
        width = 2 * most
        while True:
            new = before[s : s + width] < s
            n, hit = np.cumsum(new), np.cumsum(new & inside[s : s + width])
            if n[-1] > most or hit[-1] == total or s + width >= len(inside):
                break
            width *= 2  # repeated words
        score = np.where(n <= most, 200.0 * hit / (n + size), 0.0)
        e = int(np.argmax(score))
        if score[e] >= percent:
            yield float(score[e]), s, s + e


def _of_text(h: np.ndarray, line: np.ndarray, lines: int, near: list[int], forms: _Forms) -> list[dict]:
    """Matches of one text: hashes of its word pairs, and the line of each word."""
    _, same = np.unique(h, return_inverse=True)
    order = np.argsort(same, kind="stable")
    before = np.full(len(h), -1)
    again = np.flatnonzero(np.diff(same[order]) == 0)
    before[order[again + 1]] = order[again]
    distinct = before < 0
    own = np.flatnonzero(line[:-1] == line[1:])
    own = own[np.unique(line[own] * len(h) + same[own], return_index=True)[1]]  # each pair once a line
    n_line = np.bincount(line[own], minlength=lines)
    units: dict[int, tuple[float, str]] = {}
    runs = []
    for k in near:
        name, size = forms.names[k], int(forms.size[k])
        place = np.searchsorted(forms.of[k], h)
        inside = forms.of[k][np.minimum(place, size - 1)] == h
        score = 200.0 * np.bincount(line[own[inside[own]]], minlength=lines) / (n_line + size)
        found = [(int(i), float(score[i])) for i in np.flatnonzero(score >= forms.percent)]
        if lines > 1:
            found.append((-1, 200.0 * int(np.count_nonzero(inside & distinct)) / (int(np.count_nonzero(distinct)) + size)))
        for i, x in found:
            if x >= forms.percent and (i not in units or x > units[i][0]):
                units[i] = x, name
        runs += [(-x, 1, e + 2 - s, s, name) for x, s, e in _runs(inside, before, size, int(forms.most[k]), forms.percent)]
    places = {i: (0, len(line)) if i < 0 else tuple(np.searchsorted(line, (i, i + 1)).tolist()) for i in units}
    runs += [(-x, 0, places[i][1] - places[i][0], places[i][0], name) for i, (x, name) in units.items()]
    covered = np.zeros(len(line), bool)
    out = [{"line": i, "last": i, "license": name, "dice": x / 100} for i, (x, name) in units.items()]
    for x, is_run, n, s, name in sorted(runs):
        if is_run:
            if 2 * int(np.count_nonzero(covered[s : s + n])) > n:
                continue
            if not any(units[i][1] == name and a <= s and s + n <= b for i, (a, b) in places.items() if i < 0 or i == line[s]):
                out.append({"line": int(line[s]), "last": int(line[s + n - 1]), "license": name, "dice": -x / 100})
        covered[s : s + n] = True
    return sorted(out, key=lambda m: (m["line"], m["last"]))


def find_licenses(docs: DataFrame, text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, percent: int = DICE_PERCENT) -> DataFrame:
    """``docs`` with licenses: an array, ordered by line (the whole text as line -1), of line, last line, license and dice."""
    forms = _Forms(templates, percent)
    docs, schema = with_results(docs, f"licenses {FOUND}")
    if not forms.names:
        return docs.withColumn("licenses", F.expr(f"cast(array() as {FOUND})"))
    sent = docs.sparkSession.sparkContext.broadcast(forms)
    names, column = schema.names, fresh(docs, "plain")
    kind = pa.list_(pa.struct([("line", pa.int32()), ("last", pa.int32()), ("license", pa.string()), ("dice", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms: _Forms = sent.value
        for batch in slices(batches, column):
            plain = text_of(batch, column)
            w = words(plain, NON_SPACE)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            if len(w.hash) > 1:
                h, text = _hashes(w.hash), w.text()
                inner = np.flatnonzero(text[:-1] == text[1:])
                near = forms.near(h[inner], text[inner])
                ends = np.flatnonzero(w.data == 10) if near else None
                for i, which in near.items():
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    of = plain[i].as_py()
                    line = np.searchsorted(ends, w.start[a:b])
                    line += of.count("\n", 0, len(of) - len(of.lstrip(" \n"))) - line[0]
                    found[i] = _of_text(h[a : b - 1], line, of.count("\n") + 1, which, forms)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names)

    plain = F.regexp_replace(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    # the last column, under a name that no column of the input has
    return docs.withColumn(column, plain).mapInArrow(scan, schema)
