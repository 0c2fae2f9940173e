"""License scans: winnowed fingerprints, then banded alignment.

Templates are winnowed into an inverted index of fingerprints.  A document is
winnowed alike, and its fingerprints pick candidates: a template and a
diagonal.  Each
candidate region is aligned with the template within a band around that
diagonal, which gives the matched share of the template and the span in the
text.  Any passage of K + WINDOW - 1 equal tokens is sure to be found.  A
template of up to SHORT tokens can be covered enough without one; its
candidates are all stretches of text with enough of its tokens.

Documents are scanned on their own, whole, in Arrow batches; only the
templates' index, which doesn't grow with the data, goes to the workers.

Defined cases: a null or empty text has no match; each occurrence is a row,
also of several templates at one place when each is covered enough; repeated
rows are scanned each; an empty table gives no rows; further columns are not
read.  A batch is cut at about 1 MB of text, so a longer text comes alone.  A
repetitive text costs one alignment for each of its candidate diagonals, of
the template's length times the band's width.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship, slices
from .textops import arrow_buffers, run_hashes, window_hashes

K = 4
WINDOW = 4
BAND = 6
#: Tokens of a template up to which candidates are found by counting.
SHORT = 16
#: Share of a template's tokens that a reported match covers at least.
LEAST = 0.7

# Wordings of public licenses and license notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details. You should have received a copy of the GNU General Public License along with this program. If not, see "
        "https://www.gnu.org/licenses/."
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details. You should have received a copy of the GNU General Public License along with this program; if not, write to "
        "the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public "
        "License for more details."
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public "
        "License for more details."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
        "this software to the public domain worldwide. This software is distributed without any warranty."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "
        "\"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF "
        "THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY "
        "THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would "
        "be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, "
        "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
        "Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire "
        "statement, including the above license grant, this restriction and the following disclaimer, must be included in all "
        "copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or "
        "derivative works are solely in the form of machine-executable object code generated by a source language processor."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors "
        "of this software dedicate any and all copyright interest in the software to the public domain."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}

_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (bytes) of each token, each text's first token, and text offsets."""
    buffer, offsets = arrow_buffers(column)
    data = _FOLD[buffer[int(offsets[0]) : int(offsets[-1])]]
    offsets = offsets - offsets[0]
    n = len(data)
    padded = np.zeros(n + 1, bool)
    padded[:n] = _TOKEN[data]
    begins = padded[:n].copy()
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    if n:
        begins[1:] &= ~padded[: n - 1] | cut[1:n]
    start = np.flatnonzero(begins)
    stops = np.flatnonzero(~padded | cut)
    end = stops[np.searchsorted(stops, start, side="right")] if len(start) else start
    return run_hashes(data, start, end), start, end, np.searchsorted(start, offsets), offsets


def winnow(values: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest value of each ``window`` neighbours of one text, the rightmost of equals.

    A text with fewer values than a window keeps its smallest.
    """
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    best = np.arange(n)
    for j in range(1, window):
        other = np.minimum(np.arange(n) + j, n - 1)
        same = doc[other] == doc
        best = np.where(same & (values[other] <= values[best]), other, best)
    # A window that would run over the end of its text is none, unless the text has no whole one.
    last = np.minimum(np.arange(n) + window - 1, n - 1)
    whole = (doc[last] == doc) & (np.arange(n) + window - 1 < n)
    first = np.ones(n, bool)
    first[1:] = doc[1:] != doc[:-1]
    return np.unique(best[whole | first])


@dataclass
class TemplateIndex:
    """Inverted index: sorted fingerprints with their template and position."""

    names: list[str]
    token_hashes: list[np.ndarray]
    fingerprints: np.ndarray
    template: np.ndarray
    position: np.ndarray

    @classmethod
    def build(cls, templates: dict[str, str]) -> TemplateIndex:
        names = list(templates)
        hashed, _, _, first, _ = tokens(pa.array(list(templates.values()), pa.string()))
        values, doc = window_hashes(hashed, first, K)
        start = np.searchsorted(doc, np.arange(len(names)))
        kept = winnow(values, doc, WINDOW)
        order = kept[np.argsort(values[kept], kind="stable")]
        each = [hashed[first[i] : first[i + 1]] for i in range(len(names))]
        return cls(names, each, values[order], doc[order], order - start[doc[order]])


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Banded alignment of a template with a text: (matched tokens, first, last matched text token).

    ``shift`` is where the template's first token is expected in the text;
    cells stay within ``band`` of that diagonal.  A match scores 2, a gap or a
    mismatch -1; the template may lose its ends.  -1, -1 without a match.
    """
    width = 2 * band + 1
    best = (0, 0, -1, -1)
    # A cell: (score, matched, first, last).
    row = [(0, 0, -1, -1)] * width
    for i, wanted in enumerate(template.tolist()):
        new = []
        for c in range(width):
            j = shift + i + c - band
            if not 0 <= j < len(text):
                new.append((0, 0, -1, -1))
                continue
            diagonal = row[c]
            if int(text[j]) == wanted:
                score, matched, first, _ = diagonal
                cell = (score + 2, matched + 1, first if matched else j, j)
            else:
                cell = (diagonal[0] - 1, *diagonal[1:])
            if c + 1 < width and row[c + 1][0] - 1 > cell[0]:
                cell = (row[c + 1][0] - 1, *row[c + 1][1:])
            if c and new[c - 1][0] - 1 > cell[0]:
                cell = (new[c - 1][0] - 1, *new[c - 1][1:])
            if cell[0] <= 0:
                cell = (0, 0, -1, -1)
            new.append(cell)
            if cell[0] > best[0]:
                best = cell
        row = new
    return best[1], best[2], best[3]


def counted(hashed: np.ndarray, first: np.ndarray, template: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """(text, place, shift) of a template's tokens in stretches with enough of them for a match."""
    hits = np.flatnonzero(np.isin(hashed, template))
    if not len(hits):
        return []
    doc = np.searchsorted(first, hits, side="right") - 1
    # A match within the band is no longer than the template and the band's width.
    stop = np.searchsorted(hits, np.minimum(hits + len(template) + 2 * BAND, first[doc + 1]))
    begin, covered = np.arange(len(hits)), np.zeros(len(hits), np.int64)
    for token, times in zip(*np.unique(template, return_counts=True), strict=True):
        before = np.concatenate([[0], np.cumsum(hashed[hits] == token)])
        covered += np.minimum(before[stop] - before[begin], times)
    enough = np.flatnonzero(covered >= least * len(template))
    change = np.zeros(len(hits) + 1, np.int64)
    np.add.at(change, begin[enough], 1)
    np.add.at(change, stop[enough], -1)
    out = []
    for i in np.flatnonzero(np.cumsum(change[:-1]) > 0).tolist():
        place = int(hits[i] - first[doc[i]])
        out += [(int(doc[i]), place, place - int(x)) for x in np.flatnonzero(template == hashed[hits[i]])]
    return out


def scan(column: pa.Array, index: TemplateIndex, least: float) -> list[tuple[int, str, int, int, float, int, int]]:
    """Matches in a batch: (row, template, matched, tokens, coverage, start, end), characters."""
    hashed, start, end, first, offsets = tokens(column)
    values, doc = window_hashes(hashed, first, K)
    at = np.searchsorted(doc, np.arange(len(column)))
    kept = winnow(values, doc, WINDOW)
    low = np.searchsorted(index.fingerprints, values[kept])
    low[low == len(index.fingerprints)] = 0
    hit = np.flatnonzero(index.fingerprints[low] == values[kept])
    # Of a text and a template: where a hit stands in the text and the template's shift.
    regions: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
    for p, x in zip(kept[hit].tolist(), low[hit].tolist(), strict=True):
        d = int(doc[p])
        while x < len(index.fingerprints) and index.fingerprints[x] == values[p]:
            place = p - int(at[d])
            regions[d, int(index.template[x])].add((place, place - int(index.position[x])))
            x += 1
    for t, template in enumerate(index.token_hashes):
        if len(template) <= SHORT:
            for d, place, shift in counted(hashed, first, template, least):
                regions[d, t].add((place, shift))
    out = []
    for (d, t), hits in sorted(regions.items()):
        text, template = hashed[first[d] : first[d + 1]], index.token_hashes[t]
        raw = None
        last, tried = -1, set()
        for place, shift in sorted(hits):
            if place <= last or shift in tried:
                continue  # within what is taken already, or in vain
            tried.add(shift)
            found, high = [], len(text)
            # The best match may leave room for another one before it.
            while high > last + 1:
                matched, a, b = align(template, text[last + 1 : high], shift - last - 1, BAND)
                if not matched or matched < least * len(template):
                    break
                found.append((matched, a + last + 1, b + last + 1))
                high = a + last + 1
            for matched, a, b in reversed(found):
                raw = (column[d].as_py() or "").encode() if raw is None else raw
                low_, high_ = int(start[first[d] + a] - offsets[d]), int(end[first[d] + b] - offsets[d])
                span = len(raw[:low_].decode()), len(raw[:high_].decode())
                out.append((d, index.names[t], matched, len(template), matched / len(template), *span))
            if found:
                last, tried = found[0][2], set()
    return out


def license_matches(
    docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, license, matched, tokens, coverage, start, end) of each match, spans in characters."""
    ship(docs.sparkSession)
    index = TemplateIndex.build(templates or TEMPLATES)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "license", "matched", "tokens", "coverage", "start", "end"]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
        for batch in slices(batches, "text"):
            ids = batch.column(0).to_pylist()
            rows = [(ids[d], *rest) for d, *rest in scan(batch.column(1), index, least)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return narrow.mapInArrow(find, "doc_id long, license string, matched int, tokens int, coverage double, start long, end long")
