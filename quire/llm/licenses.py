"""License scans: patience alignment of texts with license templates."""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashCache, gram_hashes, released, small_batches

#: Notices and texts of public licenses, as their owners publish them. Of the longest licenses the parts
#: that stand at their start.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "
        '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
    ],
    "Apache-2.0-header": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and "
        "distribute verbatim copies of this license document, but changing it is not allowed.",
    ],
    "GPL-2.0": [
        "Licensed under the GNU General Public License v2.0.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and "
        "distribute verbatim copies of this license document, but changing it is not allowed.",
    ],
    "GPL-header": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "LGPL-header": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ],
    "LGPL-3.0": [
        "Licensed under the GNU Lesser General Public License v3.0.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and "
        "distribute verbatim copies of this license document, but changing it is not allowed.",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License v3.0.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and "
        "distribute verbatim copies of this license document, but changing it is not allowed.",
    ],
    "MIT": ["Released under the MIT License.", "This project is licensed under the MIT License."],
    "MIT-text": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ],
    "MIT-warranty": [
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-warranty": [
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
        "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "All-rights-reserved": ["Copyright. All rights reserved."],
}
#: Identifiers of the SPDX list that tags name.
SPDX = (
    "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only "
    "GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib"
).split()
TEMPLATES |= {name: [*TEMPLATES.get(name, ()), f"SPDX-License-Identifier: {name}"] for name in SPDX}
COVERAGE = 0.8
#: Templates of fewer words must align whole: one word decides there which license it is.
SHORT = 10
#: Claims that grant nothing: they are notices, no licenses.
CLAIMS = frozenset({"All-rights-reserved"})
#: Notices with a holder's name and years between their first word and the rest, and the most words of these.
HOLDERS = frozenset({"All-rights-reserved"})
HOLDER_WORDS = 25
_WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs, sorted by their first place, whose second places increase (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect.bisect_left(tops, b)
        tops[k : k + 1] = [b]
        at[k : k + 1] = [i]
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Places (in text, in template) of equal words, both increasing.

    Equal ends are matched first. Words that are unique in both are the anchors; the longest increasing run of them
    stays, and the gaps between are aligned in the same way. A gap without an anchor matches nothing.
    """
    out: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once = {w for w, n in Counter(template[c:d]).items() if n == 1}
        seen: dict[int, int] = {}
        twice = set()
        for i in range(a, b):
            w = text[i]
            if w in once:
                if w in seen:
                    twice.add(w)
                seen[w] = i
        places = {template[j]: j for j in range(c, d)}
        run = _increasing(sorted((i, places[w]) for w, i in seen.items() if w not in twice))
        if not run:
            continue
        edges = [(a - 1, c - 1), *run, (b, d)]
        out += run
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if k > i + 1 and m > j + 1]
    return sorted(out)


_SIEVE = (1 << 20) - 1


def _scanner(templates: list[tuple[str, str]], coverage: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()

        def words(text: str) -> np.ndarray:
            return cache.of([w.lower().encode() for w in _WORD.findall(text)])

        made, seeds = [], {}
        for name, text in templates:
            w = words(text)
            for j, gram in enumerate(gram_hashes(w, 3).tolist()):
                seeds.setdefault(gram, []).append((len(made), j))
            made.append((name, w.tolist(), len(w) if len(w) < SHORT else coverage * len(w)))
        sieve = np.zeros(_SIEVE + 1, bool)
        sieve[[g & _SIEVE for g in seeds]] = True

        def scan(text: str) -> list[dict]:
            own = words(text)
            grams = gram_hashes(own, 3)
            maybe = np.nonzero(sieve[(grams & np.uint64(_SIEVE)).astype(np.int64)])[0]
            hits = [(at, k, j) for at in maybe.tolist() for k, j in seeds.get(int(grams[at]), ())]
            if not hits:
                return []
            spots, ends, found = [m.span() for m in _WORD.finditer(text)], {}, []
            for at, k, j in hits:
                name, template, least = made[k]
                if at < ends.get(k, 0):
                    continue
                slack = max(3, len(template) // 4)
                lo, hi = max(0, ends.get(k, 0), at - j - slack), at - j + len(template) + slack
                pairs = align(own[lo:hi].tolist(), template)
                if name in HOLDERS and j and len(pairs) < least:
                    # the nearest first word before the seed, then the words of the seed alone
                    far = max(ends.get(k, 0), at - j - HOLDER_WORDS)
                    if len(near := far + np.nonzero(own[far:at] == np.uint64(template[0]))[0]):
                        lo = int(near[-1])
                        pairs = align(own[lo : at - j + len(template)].tolist(), template)
                if len(pairs) >= least:
                    ends[k] = lo + pairs[-1][0] + 1
                    found.append((lo + pairs[0][0], ends[k], len(pairs), name, len(pairs) / len(template)))
            out = []
            for a, b, n, name, share in sorted(found, key=lambda x: (-x[2], -x[4], x[0], x[3])):
                if all(b <= x["a"] or a >= x["b"] for x in out):
                    out.append({"a": a, "b": b, "license": name, "start": spots[a][0], "end": spots[b - 1][1], "coverage": share})
            return sorted(({k: v for k, v in x.items() if k not in "ab"} for x in out), key=lambda x: x["start"])

        for batch in batches:
            out = [scan(text) if text else [] for text in batch.column(1).to_pylist()]
            span = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, span)], ["doc_id", "spans"])

    return run


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """License notices in every whole text: ``doc_id, spans`` with ``license, start, end`` (code points of the
    text, end exclusive) and ``coverage``, the share of the template's words that align.

    Runs of three template words seed a window as long as the template and a quarter more on either side; the window
    and the template are aligned by words that are unique in both, recursively. A span counts from ``coverage`` on, so
    other words, line breaks and punctuation inside a notice don't hide it; a template of fewer than ten words must align
    whole. Of notices that overlap the one with the most aligned words stays. Notices in ``HOLDERS`` may have up to 25 words of names and years after their first.

    Null and empty texts have no span. Null ids and repeated rows are rows of their own. An empty table gives no
    rows. Other columns are not read. One pass, no shuffle; the templates travel with the tasks (some 15 KB).
    """
    small_batches(docs.sparkSession)
    made = [(name, text) for name, texts in (TEMPLATES if templates is None else templates).items() for text in texts]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(_scanner(made, coverage)), "doc_id long, spans array<struct<license:string,start:long,end:long,coverage:double>>")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    claim = lambda x: x["license"].isin(*CLAIMS)
    names = F.array_join(F.array_sort(F.array_distinct(F.filter("spans", lambda x: ~claim(x))["license"])), ",")
    best = F.coalesce(F.array_max("spans.coverage"), F.lit(0.0))
    return out.select(
        "doc_id", F.size("spans").cast("long").alias("n_spans"), names.alias("licenses"), F.size(F.filter("spans", claim)).cast("long").alias("n_claims"), best.alias("best_coverage"), "spans"
    )
