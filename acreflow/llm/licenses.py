"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Each template's word triples are winnowed: of every few in a row the one of
least hash is kept (of a shorter template all are), with its place, in an inverted index.  The triples of all
texts are looked up in it; hits of one template on diagonals no more than a
band from the first of them make one candidate place, where the template is aligned with the text's words by
Smith-Waterman inside a band around the diagonal.  A candidate is reported if
enough of the template's words are matched; of reports that overlap, the one
with most matched words stays.  The index is bounded by the templates.

Defined results: a null or empty text has no matches; of overlapping reports
with equally many matched words the template that comes first stays, then the
first in the text; texts of any length are scanned whole, in time that grows
with their length and hits; every row gives a row, repeated rows and null ids
too; offsets count code points; an empty table gives an empty table; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import buffers, pieces, shingles, spans, word_hashes

K, WINDOW, LEAST = 3, 4, 0.6  # words hashed together; hashes of which one is kept; share of words that must match

#: Notices and texts of well-known licenses.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit-line": "Released under the MIT License.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}

#: Only ASCII letters and digits and all bytes over 127 are parts of words.
_APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _words(data: np.ndarray, at: np.ndarray):
    first, last, row = spans(data, at, _APART)
    return word_hashes(data, first, last), first, last, row


def _triples(hashes: np.ndarray) -> np.ndarray:
    return shingles(hashes, np.zeros(len(hashes), np.int64), K)[0]


def build_index(templates: dict[str, str]) -> dict:
    """Names, word hashes, and fingerprints by hash with template and place."""
    words, found = [], []
    for t, text in enumerate(templates.values()):
        data = np.frombuffer(text.encode(), np.uint8)
        hashes = _words(data, np.array([0, len(data)]))[0]
        words.append(hashes)
        prints = _triples(hashes)
        windows = max(1, len(prints) - WINDOW + 1)
        # of equal hashes the last one, as winnowing has it; a template without a whole window keeps all
        kept = range(len(prints)) if len(prints) < WINDOW else {i + len(w) - 1 - int(np.argmin(w[::-1])) for i in range(windows) for w in [prints[i : i + WINDOW]]}
        found += [(prints[i], t, i) for i in sorted(kept)]
    found.sort(key=lambda x: int(x[0]))
    hashes, template, place = zip(*found, strict=True)
    return {"names": list(templates), "words": words, "hash": np.array(hashes, np.uint64), "template": np.array(template), "place": np.array(place)}


def align(t: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """Matched words and the first and last text word of the best local alignment of ``t`` in a band around text = t + diagonal."""
    m, width = len(t), 2 * band + 1
    k = np.arange(width)
    score = np.zeros((m + 1, width), np.int32)
    for i in range(1, m + 1):
        j = i - 1 + diagonal - band + k
        inside = (j >= 0) & (j < len(text))
        same = inside & (text[np.clip(j, 0, len(text) - 1)] == t[i - 1])
        step = score[i - 1] + np.where(same, 2, -1)
        skip = np.r_[score[i - 1, 1:] - 1, -1]
        best = np.where(inside, np.maximum(np.maximum(step, skip), 0), 0)
        score[i] = np.maximum(np.maximum.accumulate(best + k) - k, 0)
    i, k = (int(x) for x in np.unravel_index(int(score.argmax()), score.shape))
    matched, last = 0, i - 1 + diagonal - band + k
    first = last
    while i > 0 and score[i, k] > 0:
        j = i - 1 + diagonal - band + k
        same = 0 <= j < len(text) and text[j] == t[i - 1]
        if score[i, k] == score[i - 1, k] + (2 if same else -1):
            matched += same
            first = j if same else first
            i -= 1
        elif k + 1 < width and score[i, k] == score[i - 1, k + 1] - 1:
            i, k = i - 1, k + 1
        else:
            k -= 1
        if k < 0:
            break
    return matched, first, last


def _matches(index: dict, hashes: np.ndarray, row: np.ndarray, least: float):
    """row, template, coverage, first and last word of the reports of a piece."""
    out: dict[int, list] = {}
    n = len(hashes)
    if n < K:
        return out
    heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    ends = dict(zip(row[heads].tolist(), np.r_[heads[1:], n].tolist(), strict=True))
    begins = dict(zip(row[heads].tolist(), heads.tolist(), strict=True))
    inside = np.flatnonzero(row[: n - K + 1] == row[K - 1 :])
    prints = _triples(hashes)[inside]
    lo, hi = np.searchsorted(index["hash"], prints, "left"), np.searchsorted(index["hash"], prints, "right")
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return out
    many = (hi - lo)[hit]
    entry = np.repeat(lo[hit] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
    place = np.repeat(inside[hit], many)
    template = index["template"][entry]
    diagonal = place - index["place"][entry]
    size = np.array([len(w) for w in index["words"]])
    band = np.maximum(2, size // 8)
    order = np.lexsort((place, diagonal, template, row[place]))
    place, template, diagonal = place[order], template[order], diagonal[order]
    r = row[place]
    new = np.r_[True, (r[1:] != r[:-1]) | (template[1:] != template[:-1]) | (np.diff(diagonal) > band[template[1:]])]
    starts = np.flatnonzero(new)
    todo = list(zip(starts.tolist(), [*starts[1:].tolist(), len(r)], strict=True))[::-1]
    while todo:
        i, end = todo.pop()
        t, who = int(template[i]), int(r[i])
        # a chain of hits may be longer than the band: what is too far from its first one is a candidate of its own
        if (rest := i + int(np.searchsorted(diagonal[i:end], diagonal[i] + band[t], "right"))) < end:
            todo.append((rest, end))
        a = max(begins[who], int(diagonal[i]) - int(band[t]))
        b = min(ends[who], int(diagonal[i]) + int(size[t]) + 2 * int(band[t]) + 1)
        matched, first, last = align(index["words"][t], hashes[a:b], int(diagonal[i]) - a, 2 * int(band[t]))
        if matched >= least * size[t]:
            out.setdefault(who, []).append((-matched, t, matched / float(size[t]), a + first, a + last))
    for who, found in out.items():
        kept: list = []  # in text order, none over another
        for x in sorted(found):
            at = bisect_left(kept, x[3], key=lambda y: y[0])
            if (at == len(kept) or kept[at][0] > x[4]) and (not at or kept[at - 1][3] < x[3]):
                kept.insert(at, (x[3], x[1], x[2], x[4]))
        out[who] = kept
    return out


def scan_batches(templates: dict[str, str], least: float):
    """mapInArrow: id, text -> id, licenses, coverages, starts, ends"""
    index = build_index(templates)

    def run(batches):
        for batch in batches:
            data, at = buffers(batch.column(1))
            for i, j in pieces(at):
                part, off = data[at[i] : at[j]], at[i : j + 1] - at[i]
                hashes, first, last, row = _words(part, off)
                rows = _matches(index, hashes, row, least)
                lists: list[list] = [[] for _ in range(j - i)]
                for who, found in rows.items():
                    text = part[off[who] : off[who + 1]]
                    count = np.r_[0, np.cumsum((text & 0xC0) != 0x80)]
                    lists[who] = [(index["names"][t], c, int(count[first[a] - off[who]]), int(count[last[b] - off[who]])) for a, t, c, b in found]
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
                columns = [pa.array([[x[c] for x in row] for row in lists], pa.list_(kind)) for c, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=["doc_id", "licenses", "coverages", "starts", "ends"])

    return run


def license_matches(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, licenses, coverages, starts, ends (arrays, in text order) of each row."""
    plain = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(scan_batches(templates, least), f"doc_id {kind}, licenses array<string>, coverages array<double>, starts array<long>, ends array<long>")


def license_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_matches, best, coverage, spans of each row."""
    found = license_matches(docs).withColumn("all", F.arrays_zip("licenses", "coverages", "starts", "ends"))
    top = F.array_max(F.transform("all", lambda x: F.struct(x["coverages"].alias("c"), x["licenses"].alias("l"))))
    joined = F.array_join(F.transform("all", lambda x: F.concat_ws(":", x["licenses"], x["starts"], x["ends"])), ",")
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_matches"), top["l"].alias("best"), top["c"].alias("coverage"), joined.alias("spans"))
