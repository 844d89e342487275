"""License scan: MinHash bands over overlapping word windows retrieve templates, exact containment decides.

Templates and texts are words in lower case without punctuation at their ends, cut into shingles of
SHINGLE words. Every window of a text as long as a template gets HASHES MinHash values over its
shingles; a window that agrees with the template in all hashes of one of BANDS bands is a candidate,
and it is a match if it holds at least CONTAINMENT of the template's distinct shingles.

Band settings. A window of the template's length that holds a share c of its shingles has a Jaccard
similarity of at least c / (2 - c): 0.667 for 0.8. With 24 bands of 2 hashes such a window is
retrieved with probability 1 - (1 - 0.667^2)^24 > 0.9999992, and its neighbours give it more chances;
an exact copy is always retrieved. Only windows with a shingle of a template can agree in a hash, so
the sliding minima are computed for the stretches around such shingles only; elsewhere no band can
collide, and skipping it changes no result.

Templates go with the tasks; their total size is checked against TEMPLATE_BYTES, and larger sets
are scanned in blocks of that size.

Defined results: null and empty texts match nothing; templates of fewer than SHINGLE words are not
looked for; of overlapping matches of one template the best, then the first, is reported; a match is
left out where one of another license holds more of its own template and covers half of the match or
more (of templates in one block); repeated rows are scanned alike.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ByteHash, CodePoints, Words, disjoint, grams, mixed, slices, sliding_min, utf8

SHINGLE = 5
CONTAINMENT = 0.8
BANDS, ROWS = 24, 2
HASHES = BANDS * ROWS
TEMPLATE_BYTES = 1 << 20
MATCH_TYPE = "doc_id long, license string, start int, end int, containment double"

_SALTS = np.random.default_rng(7).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

# Notices by which published texts name their license, and whole texts of short licenses.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
                "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
                   "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
            "Software is furnished to do so, subject to the following conditions:"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met:"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    # Short notices in their usual wordings.
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Distributed under the terms of the MIT license."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("Apache-2.0", "Licensed under the Apache License 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Released under the GNU General Public License v2."),
    ("GPL-3.0", "Released under the GNU General Public License v3."),
    ("LGPL-3.0", "Released under the GNU Lesser General Public License v3."),
    ("AGPL-3.0", "Released under the GNU Affero General Public License v3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "Released under the Mozilla Public License 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
                "available at https://www.eclipse.org/legal/epl-2.0/"),
    # Notices of file heads.
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                 "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                 "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
                 "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    # Whole texts.
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
            "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
            "shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY "
            "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
            "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
            "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
            "THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
                     "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
                     "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
                     "distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                     "derived from this software without specific prior written permission."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
            "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
            "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
            "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
            "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
            "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND "
            "THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
            "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
            "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT "
            "OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
             "any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
             "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as "
                  "a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize "
                  "copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
                  "public domain."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
                "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the "
                "Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to "
                "do so, all subject to the following:"),
)

_EDGES = b"\"'()[]{}<>.,;:!?*#$%&|`_-"


class Folded(Words):
    """Words in lower case without punctuation at their ends; `from_`, `to`: their bytes in the joined texts."""

    def __init__(self, texts: list[bytes]):
        super().__init__([t.lower() for t in texts])
        edge = np.zeros(256, bool)
        edge[list(_EDGES)] = True
        inner = ~edge[self.codes]
        places = np.flatnonzero(inner)
        low = np.searchsorted(places, self.start)
        high = np.searchsorted(places, self.end)
        some = high > low  # a word of nothing but punctuation stays as it is
        self.low, self.high = self.start.copy(), self.end.copy()
        self.low[some] = places[low[some]]
        self.high[some] = places[high[some] - 1] + 1

    def hashes(self) -> np.ndarray:
        return ByteHash(self.codes).of(self.low, self.high)

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the shingle that begins at each word, and whether one does."""
        out = np.zeros(len(self.place), np.uint64)
        gram = grams(self.hashes(), SHINGLE)
        out[: len(gram)] = gram
        return out, self.has_window(SHINGLE)


class Templates:
    def __init__(self, templates: list[tuple[str, bytes]]):
        self.name: list[str] = []
        self.shingles: list[np.ndarray] = []
        self.length: list[int] = []
        for name, text in templates:
            gram, has = Folded([text]).shingles()
            if has.any():
                self.name.append(name)
                self.shingles.append(np.unique(gram[has]))
                self.length.append(int(has.sum()))
        self.all = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.shingles]))
        self.least = [np.array([mixed(s * salt).min() for salt in _SALTS]) for s in self.shingles]


def _stretches(marks: np.ndarray, before: int, n: int) -> Iterator[tuple[int, int]]:
    """Ranges of window begins that reach a marked place at most `before` later, joined where they touch."""
    if not len(marks):
        return
    low, high = np.maximum(0, marks - before), np.minimum(n, marks + 1)
    cut = np.flatnonzero(low[1:] > high[:-1])
    for a, b in zip(np.append(0, cut + 1).tolist(), np.append(cut, len(marks) - 1).tolist(), strict=True):
        yield int(low[a]), int(high[b])


def find(templates: Templates, texts: list[bytes]) -> list[tuple[int, str, int, int, float]]:
    """(text, license, first word, last word + 1, containment) of one slice of texts."""
    words = Folded(texts)
    gram, has = words.shingles()
    at = np.minimum(np.searchsorted(templates.all, gram), max(0, len(templates.all) - 1))
    shared = np.flatnonzero(has & (templates.all[at] == gram)) if len(templates.all) else np.zeros(0, np.int64)
    out = []
    for text in np.unique(words.text[shared]).tolist():
        first, count = int(words.first[text]), int(words.count[text])
        n = count - SHINGLE + 1
        own = gram[first : first + n]
        marks = shared[(shared >= first) & (shared < first + n)] - first
        for name, shingles, length, least in zip(templates.name, templates.shingles, templates.length, templates.least, strict=True):
            mine = marks[np.isin(own[marks], shingles)]
            hits = []
            for low, high in _stretches(mine, length - 1, n):
                hits += _windows(own, low, high, length, shingles, least)
            hits.sort(key=lambda h: (-h[0], h[1]))
            out += [(text, name, a, b + SHINGLE - 1, share) for share, a, b in disjoint(hits)]
    return out


def _windows(own: np.ndarray, low: int, high: int, length: int, shingles: np.ndarray, least: np.ndarray) -> list[tuple[float, int, int]]:
    """Verified windows of `length` shingles that begin in low..high-1; a shorter rest of the text is one window."""
    stretch = own[low : high + length - 1]
    width = min(length, len(stretch))
    agree = np.stack([sliding_min(mixed(stretch * salt), width) == value for salt, value in zip(_SALTS, least, strict=True)])
    candidate = np.flatnonzero(agree.reshape(BANDS, ROWS, -1).all(1).any(0))
    out = []
    for k in candidate.tolist():
        window = stretch[k : k + width]
        inside = np.flatnonzero(np.isin(window, shingles))
        share = len(np.unique(window[inside])) / len(shingles)
        if share >= CONTAINMENT:
            # The span reported is that of the shared shingles.
            out.append((share, low + k + int(inside[0]), low + k + int(inside[-1]) + 1))
    return out


def _clearest(hits: list[tuple]) -> list[tuple]:
    """Without the matches that a better one of another license covers by half or more: licenses that differ in a number."""
    hits = sorted(hits, key=lambda h: (h[2], h[3], h[1]))
    starts = [h[2] for h in hits]
    longest = max(h[3] - h[2] for h in hits)
    out = []
    for hit in hits:
        _, name, a, b, share = hit
        near = hits[bisect_left(starts, a - longest) : bisect_left(starts, b)]
        if not any(n != name and s > share and 2 * (min(b, d) - max(a, c)) >= b - a for _, n, c, d, s in near):
            out.append(hit)
    return out


def _scan_with(templates: Templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = utf8(part.column("text"))
            ids = part.column("doc_id").to_pylist()
            rows = []
            for k, hits in groupby(find(templates, texts), key=lambda h: h[0]):
                points = CodePoints(texts[k])
                begin, end = points.words()
                rows += [(ids[k], name, points.before(int(begin[a])), points.before(int(end[b - 1])), share) for _, name, a, b, share in _clearest(list(hits))]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64())
            columns = zip(*rows, strict=True) if rows else ([] for _ in kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             ["doc_id", "license", "start", "end", "containment"])

    return run


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, text) -> (doc_id, license, start, end, containment): every license notice, in code points."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks: list[list[tuple[str, bytes]]] = [[]]
    size = 0
    for name, text in templates:
        raw = text.encode()
        if blocks[-1] and size + len(raw) > TEMPLATE_BYTES:
            blocks.append([])
            size = 0
        blocks[-1].append((name, raw))
        size += len(raw)
    out = None
    for block in blocks:
        found = texts.mapInArrow(_scan_with(Templates(block)), MATCH_TYPE)
        out = found if out is None else out.unionByName(found)
    return out
