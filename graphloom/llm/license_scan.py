"""License scans by patience alignment of texts with license templates.

Words that occur once in both text and template are anchors; the longest increasing run of them is kept, and the gaps
between are aligned in the same way. The coverage is the share of the template's words that the alignment finds.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.llm._arrow import text_slices

#: Short notices and file headers by name; fixed values. Whole license texts stand in the folder ``licenses``.
NOTICES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "All-rights-reserved": "All rights reserved.",
}


def _whole_texts() -> dict[str, str]:
    folder = resources.files("graphloom.llm") / "licenses"
    return {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


TEMPLATES = NOTICES | _whole_texts()
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: Least coverage of a hit, and the share of the template's distinct words that it must have. A hit spans at most STRETCH
#: template lengths of the text; short notices, of less than NOTICE_WORDS, are hits only whole and without gaps.
COVERAGE, DISTINCT, STRETCH, NOTICE_WORDS = 0.8, 0.7, 1.5, 16


def template_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing in both lists.

    Common ends are matched first, then anchors: words that are unique on both sides, of which the longest increasing run
    is kept. The gaps are aligned likewise; a gap without anchors gets a longest common subsequence.
    """
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: k for k, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a.get(w) == 1}
        anchors = _increasing([(k, at[w]) for k, w in enumerate(a[a0:a1], a0) if w in at])
        if anchors:
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            out += anchors
            work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:], strict=True)]
        else:
            out += _common(a, b, a0, a1, b0, b1)
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given in the order of the first member, that increases in the second."""
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(ends, j)
        before.append(last[p - 1] if p else -1)
        ends[p : p + 1], last[p : p + 1] = [j], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _common(a: list, b: list, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """A longest common subsequence. Of each place of ``a`` on, a row of bits is held: 0 where one more word of ``b`` at
    the front makes the subsequence longer; the last word of ``b`` is the lowest bit."""
    n, m = a1 - a0, b1 - b0
    places: dict = {}
    for j in range(m):
        places[b[b0 + j]] = places.get(b[b0 + j], 0) | 1 << (m - 1 - j)
    full = (1 << m) - 1
    rows = [full] * (n + 1)
    for i in range(n - 1, -1, -1):
        row = rows[i + 1]
        same = row & places.get(a[a0 + i], 0)
        rows[i] = ((row + same) | (row - same)) & full
    best = lambda i, j: m - j - (rows[i] & ((1 << (m - j)) - 1)).bit_count()
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[a0 + i] == b[b0 + j]:
            out.append((a0 + i, b0 + j))
            i, j = i + 1, j + 1
        elif best(i + 1, j) >= best(i, j + 1):
            i += 1
        else:
            j += 1
    return out


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float, stretch: float = STRETCH) -> None:
        words = {name: w for name, t in sorted(templates.items()) if (w := template_words(t))}
        self.number = {w: k for k, w in enumerate(sorted({w for ws in words.values() for w in ws}))}
        self.templates = []
        for name, ws in words.items():
            whole = len(ws) < NOTICE_WORDS
            least, width = (len(ws), len(ws)) if whole else (-(-int(round(coverage * len(ws) * 1000)) // 1000), int(stretch * len(ws)))
            self.templates.append((name, [self.number[w] for w in ws], least, width))
        #: How often each template has each word; the last word stands for all that none has.
        self.counts = np.zeros((len(self.templates), len(self.number) + 1), dtype=np.int64)
        for k, (_, template, _, _) in enumerate(self.templates):
            self.counts[k] = np.bincount(template, minlength=len(self.number) + 1)
        self.least = np.array([least for _, _, least, _ in self.templates], dtype=np.int64)

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first character, end) of the hits, by place; of overlapping hits the one with the most words stays."""
        number, none = self.number, len(self.number)
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer: characters must keep their places
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        ids = np.array([number.get(w, none) for w in _WORD.findall(low)], dtype=np.int64)
        seen, often = np.unique(ids, return_counts=True)
        # What the whole text shares with a template bounds every alignment.
        held = np.minimum(self.counts[:, seen], often).sum(axis=1)
        found = []
        for k in np.flatnonzero(held >= self.least).tolist():
            name, template, least, width = self.templates[k]
            starts, at = self._starts(ids, self.counts[k], least, width), 0
            while at < len(starts):
                start = int(starts[at])
                hit = self._first(ids, start, template, least, width)
                if hit:
                    n, a, skip = hit
                    found.append((n, name, round(n / len(template), 6), a, skip))
                else:  # each window holds what begins within a sixteenth of a template, so the next may begin there
                    skip = start + max(1, len(template) // 16)
                at = int(np.searchsorted(starts, skip))
        out: list[tuple[str, float, int, int]] = []
        firsts: list[int] = []
        ends: list[int] = []
        spans = [m.span() for m in _WORD.finditer(low)] if found else []
        for _, name, share, a, b in sorted(found, key=lambda x: (-x[0], x[3], x[1])):
            k = bisect_left(firsts, b)  # the hits taken don't overlap, so only the last that begins before the end can reach in
            if k == 0 or ends[k - 1] <= a:
                firsts.insert(k, a)
                ends.insert(k, b)
                out.append((name, share, spans[a][0], spans[b - 1][1]))
        return sorted(out, key=lambda x: x[2:])

    @staticmethod
    def _starts(ids: np.ndarray, counts: np.ndarray, least: int, width: int) -> np.ndarray:
        """The template's words in the text from which on a window shares as many words, and as many distinct ones, as a hit has.

        A word counts in all windows that begin after the occurrence of it that is as many before as the template has of it.
        """
        at = np.flatnonzero(counts[ids])
        order = np.argsort(ids[at], kind="stable")
        place, word = at[order], ids[at][order]

        def in_window(copies: np.ndarray | int) -> np.ndarray:
            before = np.arange(len(place)) - copies
            earlier = np.where((before >= 0) & (word[np.maximum(before, 0)] == word), place[np.maximum(before, 0)], -1)
            first = np.maximum(np.maximum(earlier, place - width) + 1, 0)
            change = np.bincount(first, minlength=len(ids) + 1) - np.bincount(place + 1, minlength=len(ids) + 1)
            return np.cumsum(change)[at]

        enough = (in_window(counts[word]) >= least) & (in_window(1) >= DISTINCT * np.count_nonzero(counts))
        return at[enough]

    def _first(self, ids: np.ndarray, start: int, template: list[int], least: int, width: int) -> tuple[int, int, int] | None:
        """(number of pairs, first word, end) of the first hit from a place on, if there is one.

        Where copies follow closely, a wide window may mix them or show a later one. Narrower windows hold fewer; a hit that
        leaves room for one before it, or takes words of the next so that one is lost, gives way to the one in front.
        """
        in_window = lambda a, b: self._aligned(ids, a, b, template, least, width)
        hit = next(filter(None, (in_window(start, start + size) for size in (2 * width, width, len(template) + len(template) // 8, len(template)))), None)
        while hit and hit[1] - start >= least and (earlier := in_window(start, hit[1])):
            hit = earlier
        n = len(template)
        for at, size in ((start, n), (start, n + n // 8), (hit[1], n), (hit[1], n + n // 8)) if hit else ():
            near = in_window(at, at + size)
            if near and near[2] < hit[2] and (after := in_window(near[2], near[2] + width) or in_window(near[2], near[2] + n + n // 8) or in_window(near[2], near[2] + n)) and after[1] < hit[2] and not in_window(hit[2], after[2]):
                return near
        return hit

    def _aligned(self, ids: np.ndarray, start: int, end: int, template: list[int], least: int, width: int) -> tuple[int, int, int] | None:
        """(number of pairs, first word, end) of the hit in a window, if it has one."""
        counts = np.bincount(template, minlength=len(self.number) + 1)
        common = np.minimum(np.bincount(ids[start:end], minlength=len(counts)), counts)
        distinct = DISTINCT * np.count_nonzero(counts)
        if common.sum() < least or np.count_nonzero(common) < distinct:
            return None
        window = ids[start:end].tolist()
        pairs = self._densest(patience(window, template), width)
        if len(pairs) < least or len({window[i] for i, _ in pairs}) < distinct:
            return None
        return len(pairs), start + pairs[0][0], start + pairs[-1][0] + 1

    @staticmethod
    def _densest(pairs: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
        """The most pairs within one width of the text."""
        best, first = (0, 0), 0
        for k, (i, _) in enumerate(pairs):
            while i - pairs[first][0] >= width:
                first += 1
            best = max(best, (k + 1 - first, -first))
        return pairs[-best[1] : -best[1] + best[0]]


def license_scan(df: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, stretch: float = STRETCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_hits, licenses, best_license, best_coverage, start_char, end_char) for every row.

    A hit is a span of at most ``stretch`` template lengths whose alignment holds ``coverage`` of the template's words and
    0.7 of its distinct ones; a license with longer insertions is a hit only at a greater ``stretch``. Gaps are aligned
    exactly at any size. ``licenses`` joins the names of all hits, sorted, once each; the best hit has the greatest coverage,
    then the longest span, then the first place. Null and empty texts, and those without hits, have 0 hits and nulls. Each
    row gives a row, also a repeated one or one without id; an empty table gives none.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage, stretch)
        for ids, texts in text_slices(batches):
            rows = []
            for i, text in zip(ids, texts, strict=True):
                hits = scanner.scan(text)
                best = min(hits, key=lambda x: (-x[1], x[2] - x[3], x[2]), default=(None, None, None, None))
                rows.append((i, len(hits), "|".join(sorted({h[0] for h in hits})) or None, *best))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "n_hits", "licenses", "best_license", "best_coverage", "start_char", "end_char"])

    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_hits long, licenses string, best_license string, best_coverage double, start_char long, end_char long")
    return out.withColumnRenamed("id", id_col)
