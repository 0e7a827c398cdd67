"""License scans by patience alignment against license templates.

A text is read as words of ASCII letters and digits, lower-cased. Runs of it that share three-word shingles with a
template are aligned with that template: the words that occur once in the run and once in the template anchor the
alignment, as the longest increasing subsequence of their positions; the gaps between anchors are aligned in the same way
with words that are unique inside the gap; equal words at a gap's ends are taken first. Coverage is the share of the
template's words that align; from ``LEAST`` on the license counts as found.

A run is a stretch of hits without a gap wider than the template. A step back in the template may start another copy or
come from a stray phrase: pieces between such steps are aligned first; what is in no found copy is joined again from the
smallest steps to the largest, aligned as one, and a copy found is taken out, until nothing reaches ``LEAST``. A run
whose words can't cover ``LEAST`` of the template, in whatever order, isn't aligned.

Only texts with shingles of a template are aligned, and only around these, so a pass costs one hash per word. Templates
are a parameter of fixed size, and no document is shuffled. Where one run fits several templates, those that only cover a
part of another one's words there give way.

Defined results: null, empty and wordless texts have no license. A license that comes twice in a text is found twice.
Ties go to the larger coverage, then the longer template, then its name. Repeated rows are scanned each.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, chunks, window_hashes, word_hashes

LEAST, SHINGLE = 0.75, 3
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))

# The wording of public licenses, as their authors publish it; short notices and full or opening texts.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by patience sorting."""
    tops, at, before = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b), in order, of equal words."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if cb[w] == 1}
        once = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if ca[w] == 1 and w in where]
        anchors = [once[k] for k in longest_increasing([j for _, j in once])]
        if not anchors:
            continue
        out += anchors
        pa_, pb = a0, b0
        for i, j in [*anchors, (a1, b1)]:
            todo.append((pa_, i, pb, j))
            pa_, pb = i + 1, j + 1
    return sorted(out)


class Library:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [word_hashes([templates[n].encode().translate(_WORDS)])[0] for n in self.names]
        self.lists = [w.tolist() for w in self.words]
        self.bags = [Counter(x) for x in self.lists]
        held = [window_hashes(w, SHINGLE) for w in self.words]
        self.keys = np.unique(np.concatenate([*held, np.empty(0, U)]))
        self.of = [set(h.tolist()) for h in held]
        #: Place in the template of the shingles that come once in it.
        self.place = [{x: i for i, x in enumerate(h.tolist()) if c[x] == 1} for h in held for c in [Counter(h.tolist())]]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> U(44)).astype(np.int64)] = True

    def known(self, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.maybe[(h >> U(44)).astype(np.int64)])
        if not len(self.keys) or not len(at):
            return at[:0]
        spot = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        return at[self.keys[spot] == h[at]]

    def align(self, k: int, words: np.ndarray, hits: list[int], lo: int = 0, hi: int | None = None) -> tuple | None:
        """The copy of template ``k`` around ``hits``, within words lo to hi; None below LEAST."""
        size = len(self.lists[k])
        # a few words on both sides may align that are in no common shingle
        lo, hi = max(lo, hits[0] - size // 8 - 1), min(len(words) if hi is None else hi, hits[-1] + SHINGLE + size // 8 + 1)
        own = words[lo:hi].tolist()
        have = Counter(own)
        if sum(min(n, have[w]) for w, n in self.bags[k].items()) < LEAST * size:
            return None
        pairs = [(i + lo, j) for i, j in patience(own, self.lists[k])]
        if len(pairs) < LEAST * size:
            return None
        return k, len(pairs) / size, pairs[0][0], pairs[-1][0] + 1, len(pairs)

    def copies(self, k: int, words: np.ndarray, pieces: list[tuple[int, list[int]]]) -> list[tuple]:
        """Copies of template ``k`` in one run: those of single pieces, then of what is left between them, joined."""
        size, hits = len(self.lists[k]), [p for _, own in pieces for p in own]
        have = Counter(words[max(0, hits[0] - size // 8 - 1) : hits[-1] + SHINGLE + size // 8 + 1].tolist())
        if sum(min(n, have[w]) for w, n in self.bags[k].items()) < LEAST * size:
            return []
        found = [x for _, own in pieces if (x := self.align(k, words, own))]
        # pieces outside the copies found, in stretches between these; each stretch is joined over its least steps first
        todo, at = [], 0
        for x in [*found, None]:
            lo, hi = (found[at - 1][3] if at else 0), (x[2] if x else len(words))
            todo.append((lo, hi, [(step, own) for step, all_ in pieces if (own := [p for p in all_ if lo <= p and p + SHINGLE <= hi])]))
            at += 1
        for lo, hi, left in todo:
            if len(left) > 1:
                found += self.joined(k, words, left, lo, hi)
        return found

    def joined(self, k: int, words: np.ndarray, left: list[tuple[int, list[int]]], lo: int, hi: int) -> list[tuple]:
        """Copies of several pieces each: both sides of the largest step back first, then what is left, as one."""
        if len(left) < 2:
            return []
        size, hits = len(self.lists[k]), [p for _, own in left for p in own]
        have = Counter(words[max(lo, hits[0] - size // 8 - 1) : min(hi, hits[-1] + SHINGLE + size // 8 + 1)].tolist())
        if sum(min(n, have[w]) for w, n in self.bags[k].items()) < LEAST * size:
            return []
        cut = max(range(1, len(left)), key=lambda i: (left[i][0], -abs(2 * i - len(left))))
        found = sorted(self.joined(k, words, left[:cut], lo, hi) + self.joined(k, words, left[cut:], lo, hi), key=lambda x: x[2])
        edges = [lo, *(e for x in found for e in (x[2], x[3])), hi]
        todo = list(zip(edges[::2], edges[1::2], strict=True))
        while todo:
            a, b = todo.pop()
            own = [p for p in hits if a <= p and p + SHINGLE <= b]
            if len(own) > 1 and (x := self.align(k, words, own, a, b)):
                found.append(x)
                todo += [(a, x[2]), (x[3], b)]
        return found

    def scan(self, words: np.ndarray, h: np.ndarray) -> list[tuple[int, float, int, int, int]]:
        """(template, coverage, first word, end word, aligned words) of one text's licenses."""
        at = self.known(h)
        found = []
        for k, own in enumerate(self.of):
            hits = [p for p in at.tolist() if int(h[p]) in own]
            size = len(self.lists[k])
            #: Pieces of the runs, each with the step back in the template before it.
            runs: list[list[tuple[int, list[int]]]] = []
            last, before = -1, None
            for p in hits:
                spot = self.place[k].get(int(h[p]), last + 1)
                if before is None or p - before > size:
                    runs.append([(0, [p])])
                elif spot > last:
                    runs[-1][-1][1].append(p)
                else:
                    runs[-1].append((last - spot, [p]))
                last, before = self.place[k].get(int(h[p]), last), p
                if runs[-1][-1][1] == [p] and int(h[p]) not in self.place[k]:
                    last = -1
            for run in runs:
                found += self.copies(k, words, run)
        found.sort(key=lambda x: (-x[4], -x[1], self.names[x[0]]))
        kept: list = []
        for x in found:
            if not any(x[2] < y[3] and y[2] < x[3] for y in kept):
                kept.append(x)
        return sorted(kept, key=lambda x: x[2])


RESULT = "doc_id long, license_id string, coverage double, first_word long, end_word long, aligned_words long"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license_id, coverage, first_word, end_word, aligned_words): one row per license found in a text."""
    held = docs.sparkSession.sparkContext.broadcast(dict(templates or TEMPLATES))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = Library(held.value)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for start, part in chunks(batch.column(1).to_pylist()):
                words, doc, _, _ = word_hashes([t.translate(_WORDS) for t in part])
                h = window_hashes(words, SHINGLE)
                hit = np.unique(doc[lib.known(h)])
                lo, hi = np.searchsorted(doc, hit), np.searchsorted(doc, hit, side="right")
                for i, a, b in zip(hit.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    for k, cover, first, end, n in lib.scan(words[a:b], h[a : max(a, b - SHINGLE + 1)]):
                        out.append((ids[start + i], lib.names[k], cover, first, end, n))
            if out:
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(scan, RESULT)
