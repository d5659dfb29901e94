"""License scans (op5) by patience alignment.

A text and a template are word sequences. Words that occur once in both are the
anchors; the longest increasing subsequence of their places fixes the alignment,
equal neighbours extend it, and every gap between is aligned in the same way.
Gaps without an anchor are closed by a longest common subsequence (they are short:
a region of a text is a few template lengths at most). Coverage is the share of
the template's words that are aligned.

A document is looked at closely only where a template may reach its least
coverage: coverage cannot exceed the share of the template's words (with
multiplicity) that the document has. That bound is computed for all documents and
templates at once from distinct words; regions come from runs of template words.
No shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LUT_ALNUM, slices, split_words, table

#: License notices as they are published.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "All-rights-reserved": "All rights reserved.",
}
COVERAGE = 0.85
#: Words between two words of a template that may lie outside it, at most, within one region.
GAP = 12
_MATCHES = "array<struct<license:string,coverage:double,matched:long,first:long,last:long>>"
_word = re.compile("[0-9a-z\u0080-\U0010ffff]+").findall


def template_words(text: str) -> list[str]:
    return _word(text.lower() if text.isascii() else re.sub("[A-Z]", lambda m: m.group().lower(), text))


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by the first number) that increases in the second, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []  # the pair on top of each pile
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        p = bisect_left(tops, b)
        back.append(piles[p - 1] if p else -1)
        tops[p : p + 1] = [b]
        piles[p : p + 1] = [k]
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence."""
    n = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            n[i, j] = n[i + 1, j + 1] + 1 if a[i] == b[j] else max(n[i + 1, j], n[i, j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif n[i + 1, j] >= n[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def patience(a: list, b: list, inside: bool = False) -> list[tuple[int, int]]:
    """Aligned places of two sequences, increasing in both: anchors, their extensions, and the gaps in the same way.

    inside: b is to be found somewhere inside a, so that the ends of a are no
    ends of the alignment; before the first and after the last anchor no more
    of a is looked at than twice the rest of b and GAP.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b), inside, inside)]
    while todo:
        a0, a1, b0, b1, left, right = todo.pop()
        if left != right:
            near = 2 * (b1 - b0) + GAP
            a0, a1 = (max(a0, a1 - near), a1) if left else (a0, min(a1, a0 + near))
        while not left and a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while not right and a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: j for j, w in enumerate(b[b0:b1], b0) if nb[w] == 1}
        anchors = _increasing([(i, at[w]) for i, w in enumerate(a[a0:a1], a0) if na[w] == 1 and w in at])
        if not anchors:
            out += [(a0 + i, b0 + j) for i, j in _common(a[a0:a1], b[b0:b1])]
            continue
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        for k, ((i, j), (x, y)) in enumerate(zip(ends, ends[1:])):
            todo.append((i + 1, x, j + 1, y, left and k == 0, right and k == len(anchors)))
    return sorted(out)


def _regions(hits: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Word ranges that may hold a template: runs of its words, cut where more than GAP others intervene; long runs in overlapping stretches of three template lengths."""
    cuts = np.flatnonzero(np.diff(hits) > GAP + 1)
    for a, b in zip(np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(hits) - 1]))):
        lo, hi = int(hits[a]), int(hits[b]) + 1
        span = 3 * length + GAP
        while hi - lo > span:
            yield lo, lo + span
            lo += span - length - GAP
        yield lo, hi


def scan(words: list[str], template: list[str], least: float = COVERAGE) -> list[tuple[float, int, int, int]]:
    """(coverage, matched words, first word, last word + 1) of each place of a text that has the template; of overlapping places the best, the first of equals."""
    kinds = set(template)
    hits = np.array([k for k, w in enumerate(words) if w in kinds], np.int64)
    found = []
    todo = list(_regions(hits, len(template)))[::-1] if len(hits) else []
    while todo:
        lo, hi = todo.pop()
        have = Counter(words[lo:hi])
        if sum(min(n, have[w]) for w, n in Counter(template).items()) < least * len(template):
            continue
        pairs = patience(words[lo:hi], template, inside=True)
        if len(pairs) < least * len(template):
            continue
        first, last = lo + pairs[0][0], lo + pairs[-1][0] + 1
        if last - first <= 2 * len(template) + GAP:
            found.append((len(pairs) / len(template), len(pairs), first, last))
        # the same template may stand on either side
        todo += [x for x in ((last, hi), (lo, first)) if x[1] - x[0] >= least * len(template)]
    out: list[tuple[float, int, int, int]] = []
    for f in sorted(set(found), key=lambda f: (-f[0], f[2])):
        if all(f[3] <= o[2] or f[2] >= o[3] for o in out):
            out.append(f)
    return sorted(out, key=lambda f: f[2])


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, matches (license, coverage, matched, first, last: word numbers), by place and then name.

    Words are runs of ASCII letters (lower-cased), digits and other characters
    beyond ASCII. Null and empty texts match nothing; a template without words
    never does; repeated rows are judged each on its own; an empty table gives
    no rows. Texts are read whole.
    """
    known = {k: w for k, t in sorted((templates or TEMPLATES).items()) if (w := template_words(t))}
    vocabulary = sorted({x for w in known.values() for x in w})
    place = {w: k for k, w in enumerate(vocabulary)}
    weight = np.zeros((len(vocabulary), len(known)))
    for t, w in enumerate(known.values()):
        for x, n in Counter(w).items():
            weight[place[x], t] = n / len(w)
    wanted = pa.array(vocabulary, pa.large_string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            starts, ids, words = split_words(batch.column(1), LUT_ALNUM)
            term = pc.fill_null(pc.index_in(words, value_set=wanted), -1).to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, np.int64)
            held = np.flatnonzero(term[ids] >= 0) if len(ids) else np.zeros(0, np.int64)
            doc = np.searchsorted(starts, held, side="right") - 1
            there = np.zeros((len(starts) - 1, len(vocabulary)), bool)
            there[doc, term[ids[held]]] = True
            bound = there @ weight  # coverage is at most this
            matches: list[list[dict]] = [[] for _ in range(len(starts) - 1)]
            names = list(known)
            for d in np.flatnonzero((bound >= least - 1e-9).any(1)).tolist():
                own = words.take(pa.array(ids[starts[d] : starts[d + 1]])).to_pylist()
                for t in np.flatnonzero(bound[d] >= least - 1e-9).tolist():
                    matches[d] += [{"license": names[t], "coverage": c, "matched": m, "first": a, "last": b} for c, m, a, b in scan(own, known[names[t]], least)]
                matches[d].sort(key=lambda m: (m["first"], m["license"]))
            kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(starts)), pa.array(matches, kind)], ["doc_id", "n_words", "matches"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, f"doc_id long, n_words long, matches {_MATCHES}")


def op5_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents"))
    best = F.array_max(F.transform("matches", lambda m: F.round(m["coverage"], 6)))
    return found.select(
        "doc_id", "n_words", F.size("matches").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        F.coalesce(best, F.lit(0.0)).alias("coverage"), F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["first"].cast("string"), m["last"].cast("string"))), ",").alias("places"),
    )
