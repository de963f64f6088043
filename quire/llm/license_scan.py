"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Templates are sorted into classes by size: class S holds those of more than S/2 and at most S shingles.  For each class a
text is covered by windows of 3S/2 shingles at a stride of S/2, so any run of S shingles lies whole in one window.  A window
that holds ``CONTAINMENT`` of a template then has a similarity of at least J with it, and with bands of one minhash, as many
as make ``(1 - J) ** bands`` at most ``MISS``, it retrieves the template.  What is retrieved is verified on the shingles of the
window and of half a class on either side.  A band can only agree through a shingle of the template itself, so texts without
any template shingle need no minhashes: leaving them out changes nothing.

Defined results
  * null and empty texts match nothing; texts are read whole; words are runs of letters, digits and non-ASCII bytes, lower case;
  * the templates' whole text is configuration and goes to every task; templates of fewer than five words are one shingle;
  * rows with null or repeated ``doc_id`` are scanned row by row; an empty table gives an empty result;
  * overlapping matches of one licence are one span; of overlapping licences the one that more shingles speak for is
    returned, of equals the one that is held better, else all, in order of name;
  * further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import hold, read, slices, small_batches, text_or_empty
from quire.llm.near_dedup import mix, shingle_sequence

WORDS = 5
CONTAINMENT = 0.75
MISS = 1e-6
LEAST_CLASS = 4

# Sentences that licences share, and notices and whole short licences as widely published.
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
TEMPLATES = {
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", _GNU.format("Affero General Public License", 3)],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-2-Clause": [_BSD + _AS_IS],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS,
    ],
    "BSL-1.0": [
        'Distributed under the Boost Software License, Version 1.0.',
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so',
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal public domain dedication."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _GNU.format("General Public License", 3)],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", _GNU.format("Lesser General Public License", 3)],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
}

#: ASCII letters in lower case, digits and bytes of other characters stay; all else separates words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def sequence(text: str) -> np.ndarray:
    return shingle_sequence(text, WORDS, _WORDS)


class Scanner:
    """The templates' shingles and bands by class."""

    def __init__(self, templates: dict[str, list[str]], containment: float = CONTAINMENT, miss: float = MISS):
        self.containment = containment
        self.sets = [(name, np.unique(s)) for name, texts in sorted(templates.items()) for t in texts if len(s := sequence(t))]
        self.classes: dict[int, list[int]] = {}
        least = 1.0
        for i, (_, s) in enumerate(self.sets):
            size = max(LEAST_CLASS, 1 << (len(s) - 1).bit_length())
            self.classes.setdefault(size, []).append(i)
            held = math.ceil(containment * len(s))
            least = min(least, held / (size + size // 2 + len(s) - held))
        self.bands = math.ceil(math.log(miss) / math.log(1 - least)) if least < 1 else 1
        rng = np.random.default_rng(77)
        self.xor = rng.integers(0, 2**64, self.bands, dtype=np.uint64)
        self.mul = rng.integers(0, 2**64, self.bands, dtype=np.uint64) | np.uint64(1)
        self.every = np.unique(np.concatenate([s for _, s in self.sets])) if self.sets else np.zeros(0, np.uint64)
        self.keys = {size: np.array([[((self.sets[i][1] ^ x) * m).min() for i in members] for x, m in zip(self.xor, self.mul)]) for size, members in self.classes.items()}

    def retrieved(self, h: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
        """(window's first shingle, template) of every window and template that agree in a band."""
        step = size // 2
        starts = np.arange(0, len(h), step)
        agree = np.zeros((len(starts), len(self.classes[size])), bool)
        for x, m, keys in zip(self.xor, self.mul, self.keys[size]):
            low = np.minimum.reduceat((h ^ x) * m, starts)
            padded = np.concatenate([low, np.full(2, 2**64 - 1, np.uint64)])
            window = np.minimum(np.minimum(low, padded[1:-1]), padded[2:])
            agree |= window[:, None] == keys[None, :]
        for w, j in zip(*np.nonzero(agree)):
            yield int(starts[w]), self.classes[size][j]

    def verified(self, h: np.ndarray, start: int, size: int, template: int) -> tuple[float, int, int] | None:
        """(containment, first, last shingle) if the window's neighbourhood holds enough of the template."""
        a, b = max(0, start - size // 2), min(len(h), start + 2 * size)
        inside = np.flatnonzero(np.isin(h[a:b], self.sets[template][1]))
        share = len(np.unique(h[a:b][inside])) / len(self.sets[template][1])
        return (share, a + int(inside[0]), a + int(inside[-1])) if share >= self.containment else None

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """The matches without those that a better one of another licence overlaps: licences that differ in a word or a number,
        or hold one another, would else be found together.  The better one holds more shingles, or else a larger share."""
        found = self._merged(text)
        return [x[:4] for x in found if not any(y[0] != x[0] and (y[4], y[1]) > (x[4], x[1]) and y[2] < x[3] and x[2] < y[3] for y in found)]

    def matches(self, text: str) -> list[tuple[str, float, int, int]]:
        """(licence, containment, first word, word after the last) by licence and place."""
        return [x[:4] for x in self._merged(text)]

    def _merged(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """The matches, each with the shingles that its best one holds; overlapping ones of a licence are one."""
        h = sequence(text)
        if not len(h) or not np.isin(h, self.every).any():
            return []
        found: dict[str, list[tuple[int, int, int, float]]] = {}
        for size in self.classes:
            for start, template in sorted(set(self.retrieved(h, size))):
                if hit := self.verified(h, start, size, template):
                    name, own = self.sets[template]
                    found.setdefault(name, []).append((hit[1], hit[2], round(hit[0] * len(own)), hit[0]))
        out = []
        for name, hits in sorted(found.items()):
            merged: list[tuple[int, int, int, float]] = []
            for a, b, held, share in sorted(hits):
                if merged and a <= merged[-1][1]:
                    first, last, *best = merged.pop()
                    merged.append((first, max(b, last), *max(tuple(best), (held, share))))
                else:
                    merged.append((a, b, held, share))
            out += [(name, share, a, b + WORDS, held) for a, b, held, share in merged]
        return out


_SCANNERS: dict[str, Scanner] = {}


def find(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, matches (license, containment, start_word, end_word): a row for each row of ``docs``."""
    small_batches(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("license_scan", _SCANNERS.clear)
        key = repr(sorted(templates.items()))
        if key not in _SCANNERS:
            _SCANNERS[key] = Scanner(templates)
        scanner = _SCANNERS[key]
        kind = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("start_word", pa.int32()), ("end_word", pa.int32())]))
        for batch in slices(batches):
            rows = [[dict(zip(("license", "containment", "start_word", "end_word"), x)) for x in scanner.scan(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "matches"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, matches array<struct<license:string,containment:double,start_word:int,end_word:int>>")


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start_word"].cast("string"), m["end_word"].cast("string")))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"), F.array_join(spans, ",").alias("spans"), F.round(F.coalesce(F.array_min(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)), 6).alias("least_containment"))
