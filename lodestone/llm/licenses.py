"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Templates are grouped by length. A group of templates of up to C shingles is sought in windows of W >= C shingles whose
starts are far enough apart to save work and close enough that any run of C shingles lies whole in one window. A window
that holds the required share of a template has at least a known resemblance J with it, so the number of bands follows
from the collision probability that is asked for: 1 - (1 - J^rows)^bands.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .words import Words, chunks, lowered, mixed

SHINGLE = 5
#: A window matches a template if it contains this share of the template's shingles.
CONTAINMENT = 0.8
#: Hashes a band, and the probability that a matching window and its template meet in a band.
ROWS, COLLISION = 2, 0.999

#: Notices of public licenses, as their publishers word them.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit-line": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        'portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED '
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
        "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:"
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0"
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
        "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "bsd-3-clause-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "isc-disclaimer": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative '
        "works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
    ),
    "lgpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}

RESULT = "doc_id long, license string, containment double, start_word long, end_word long, n_places int"


_MOST = np.uint64(2**64 - 1)


class _Group:
    """Templates of one shingle size and of up to ``most`` shingles, and their bands."""

    def __init__(self, shingle: int, most: int, members: list[tuple[str, np.ndarray]], containment: float):
        self.shingle = shingle
        self.stride = max(1, most // 4)
        self.width = most + (self.stride if self.stride > 1 else 0)
        self.names = [name for name, _ in members]
        self.shingles = [np.unique(s) for _, s in members]
        held = [(ceil(containment * len(s) - 1e-9), len(s)) for s in self.shingles]
        likeness = min(n / (self.width + m - n) for n, m in held)
        self.bands = 1 if likeness >= 1 else ceil(log(1 - COLLISION) / log(1 - likeness**ROWS))
        self.factors = _factors(self.bands)
        keys = np.array([[self._key([(s * f).min(keepdims=True) for f in band])[0] for band in self.factors] for s in self.shingles], np.uint64)
        self.keys = [np.sort(keys[:, b]) for b in range(self.bands)]
        self.owner = [np.argsort(keys[:, b], kind="stable") for b in range(self.bands)]
        self.bits = np.zeros((self.bands, 1 << 16), bool)
        for b in range(self.bands):
            self.bits[b, (self.keys[b] >> np.uint64(48)).astype(np.int64)] = True

    @staticmethod
    def _key(minima: list) -> np.ndarray:
        key = np.asarray(minima[0], np.uint64)
        for m in minima[1:]:
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.asarray(m, np.uint64))
        return mixed(key)

    def _windows(self, blocks: np.ndarray) -> np.ndarray:
        """The least value in every window, from the least ones of its blocks of one stride."""
        length, done = self.width // self.stride, 1
        while done < length:
            step = min(done, length - done)
            blocks = np.minimum(blocks, np.concatenate([blocks[step:], np.full(min(step, len(blocks)), _MOST)]))
            done += step
        return blocks

    def met(self, band: int, minima: list[_Blocks]) -> np.ndarray:
        """(window, template) that meet in a band. minima: of each of the band's hashes."""
        keys = self._key([self._windows(m.of(self.stride)) for m in minima])
        at = np.flatnonzero(self.bits[band][(keys >> np.uint64(48)).astype(np.int64)])
        low, high = (np.searchsorted(self.keys[band], keys[at], side=s) for s in ("left", "right"))
        found = [np.empty((0, 2), np.int64)]
        for shift in range(int((high - low).max()) if len(at) else 0):
            some = low + shift < high
            found.append(np.stack([at[some], self.owner[band][(low + shift)[some]]], axis=1))
        return np.concatenate(found)


class _Blocks:
    """Least values of blocks of a stride, each stride from the largest one that divides it."""

    def __init__(self, values: np.ndarray):
        self.known = {1: values}

    def of(self, stride: int) -> np.ndarray:
        if stride not in self.known:
            base = max(s for s in self.known if stride % s == 0)
            values, step = self.known[base], stride // base
            values = np.concatenate([values, np.full(-len(values) % step, _MOST)])
            out = values[::step]
            for i in range(1, step):
                out = np.minimum(out, values[i::step])
            self.known[stride] = out
        return self.known[stride]


def _factors(bands: int) -> np.ndarray:
    """The multipliers of the bands' hashes; all groups share them, so a hash of the text serves every group."""
    return np.random.default_rng(7).integers(1, 1 << 63, (bands, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _candidates(groups: list[_Group], hashes: np.ndarray) -> dict[_Group, np.ndarray]:
    """Distinct (window, template) of groups of one shingle size."""
    found: dict[_Group, list[np.ndarray]] = {g: [] for g in groups}
    for band, factors in enumerate(_factors(max(g.bands for g in groups))):
        minima = [_Blocks(hashes * f) for f in factors]
        for group in sorted((g for g in groups if band < g.bands), key=lambda g: g.stride):
            found[group].append(group.met(band, minima))
    return {g: np.unique(np.concatenate(x), axis=0) for g, x in found.items()}


def _groups(templates: dict[str, str], containment: float) -> list[_Group]:
    sizes = [1, 2, 3, 4]
    while sizes[-1] < 1 << 20:
        sizes += [sizes[-1] // 2 * 3, sizes[-1] * 2]
    dealt: dict[tuple[int, int], list] = {}
    for name, text in templates.items():
        words = Words([lowered(text)])
        size = min(SHINGLE, len(words.hash))
        if size:
            shingles = np.unique(words.shingles(size)[0])
            dealt.setdefault((size, next(s for s in sizes if s >= len(shingles))), []).append((name, shingles))
    return [_Group(size, most, members, containment) for (size, most), members in sorted(dealt.items())]


def _scan(groups: list[_Group], ids: list, texts: list[bytes], containment: float) -> Iterator[tuple]:
    words = Words(texts)
    best: dict[tuple[int, str], list] = {}
    hashed = {size: words.shingles(size) for size in {g.shingle for g in groups}}
    met = [x for size, (hashes, _) in hashed.items() if len(hashes) for x in _candidates([g for g in groups if g.shingle == size], hashes).items()]
    for group, pairs in met:
        hashes, whole = hashed[group.shingle]
        for window, template in pairs.tolist():
            start = window * group.stride
            inside = np.arange(start, min(start + group.width, len(hashes)))
            inside = inside[whole[inside]]
            hit = inside[np.isin(hashes[inside], group.shingles[template])]
            docs = words.doc[hit]
            for doc in np.unique(docs).tolist():  # a window may reach over the end of a text
                own = hit[docs == doc]
                share = len(np.unique(hashes[own])) / len(group.shingles[template])
                if share >= containment:
                    base, key = words.first_word[doc], (doc, group.names[template])
                    place = (share, int(own[0] - base), int(own[-1] - base) + group.shingle)
                    best.setdefault(key, []).append(place)
    for (doc, name), places in best.items():
        share, start, end = max(places, key=lambda p: (p[0], -p[1], -p[2]))
        yield ids[doc], name, share, start, end, _apart(places)


def _apart(places: list[tuple]) -> int:
    """How many of the places do not overlap one before."""
    n, reach = 0, -1
    for _, start, end in sorted(places, key=lambda p: p[1]):
        if start >= reach:
            n, reach = n + 1, end
    return n


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """License notices in whole texts.

    Returns doc_id, license, containment, start_word, end_word (words as runs of letters and digits), n_places, a row
    per row and license found: the fullest place. Templates of fewer than five words are sought as one shingle of all
    their words; templates without words are ignored. Licenses whose notices differ in a few words, such as a version, may all
    reach the containment at one place: the greatest containment is the one that stands there. Null and empty texts match nothing; repeated rows give a row each;
    texts of any length are scanned whole; an empty table gives an empty result and other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_groups(templates, containment))  # as large as the templates given

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in chunks(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1))):
                rows = list(_scan(shared.value, ids, texts, containment))
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "license", "containment", "start_word", "end_word", "n_places"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, RESULT)
