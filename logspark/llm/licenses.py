"""License scan by patience alignment.

Words that occur once in a passage and once in a template are anchors; the longest increasing run of anchors is kept and
the gaps between them are aligned the same way; a gap without an anchor takes its longest common subsequence, which is the
longest increasing run of all places of equal words. Coverage is the share of the template's words that are aligned.

Only passages that can reach the coverage are aligned: windows of three times the template's length, half a length apart,
that hold enough words of the template; so a notice spread over up to two and a half lengths lies whole in one. Where words
that begin the template come again in a window, its parts between them are aligned as well, so notices in a row are told apart.
A passage that does not hold the whole template is aligned once more within a length of its own on both sides, so that what is
found does not depend on where windows begin.

Edge cases: null and empty texts hold no notice; very long texts are scanned whole, in the task that reads them; repeated rows
and rows without an id are reported each; a template without words is refused; equal coverage goes to the first passage; an
empty table gives no rows; of the input only id and text are read.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, map_batches, words

COVERAGE = 0.8

#: Public license notices and texts to look for.
DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
BSD_ENDORSEMENT = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: "
)
MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES "
    "WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
    "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
    "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
    "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
    "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
    "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
    "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
    "software. 3. This notice may not be removed or altered from any source distribution."
)
APACHE_NOTICE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a "
    "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
    "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
    "the specific language governing permissions and limitations under the License."
)
GPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
    "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will "
    "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General "
    "Public License for more details. You should have received a copy of the GNU General Public License along with this program."
)
TEMPLATES = {
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "mit-grant": MIT_GRANT,
    "mit-text": MIT_GRANT + MIT_NOTICE + DISCLAIMER,
    "apache-2.0-notice": APACHE_NOTICE,
    "gpl-3.0-notice": GPL_NOTICE,
    "bsd-conditions": BSD_CONDITIONS,
    "bsd-2-clause-text": BSD_CONDITIONS + BSD_DISCLAIMER,
    "bsd-3-clause-text": BSD_CONDITIONS + BSD_ENDORSEMENT + BSD_DISCLAIMER,
    "isc-text": ISC,
    "zlib-text": ZLIB,
}


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect.bisect_left(tops, v)
        back.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common(template: list[str], text: list[str], a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
    """A longest common subsequence of template[a:b] and text[c:d]: of each word's places in the text the last come first, so
    an increasing run takes one of them at most."""
    places: dict[str, list[int]] = {}
    for y in range(d - 1, c - 1, -1):
        places.setdefault(text[y], []).append(y)
    pairs = [(x, y) for x in range(a, b) for y in places.get(template[x], ())]
    return [pairs[i] for i in increasing([y for _, y in pairs])]


def align(template: list[str], text: list[str]) -> list[tuple[int, int]]:
    """Aligned (template place, text place) pairs, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(template), 0, len(text))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and template[a] == text[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and template[b - 1] == text[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        ours, theirs = Counter(template[a:b]), Counter(text[c:d])
        where = {w: k for k, w in enumerate(text[c:d], c) if theirs[w] == 1}
        anchors = [(k, where[w]) for k, w in enumerate(template[a:b], a) if ours[w] == 1 and w in where]
        if not anchors:
            out += common(template, text, a, b, c, d)
            continue
        chain = [anchors[i] for i in increasing([y for _, y in anchors])]
        out += chain
        for (p, q), (r, s) in zip([(a - 1, c - 1), *chain], [*chain, (b, d)], strict=True):
            todo.append((p + 1, r, q + 1, s))
    return sorted(out)


def openings(template: list[str], coverage: float) -> dict[str, int]:
    """Words that a passage that covers the template must hold one of near its beginning, and their places: those that the
    template has once, or all where it has none such."""
    upto = int((1 - coverage) * len(template) + 1e-9) + 1
    once = Counter(template)
    return {w: k for k, w in enumerate(template[:upto]) if once[w] == 1} or {w: template.index(w) for w in template[:upto]}


def pieces(text: list[str], begins: dict[str, int], need: float, n: int) -> set[tuple[int, int]]:
    """Parts of a window in which opening words come again: from one's beginning to the beginnings of later ones, and to the end."""
    at = [(k, begins[w]) for k, w in enumerate(text) if w in begins]
    if len({p for _, p in at}) == len(at):
        return set()
    starts = sorted({max(0, k - p) for k, p in at})
    out = set()
    for s in starts:
        ends = [e for e in starts if s + need <= e <= s + 5 * n // 2]
        out |= {(s, e) for e in (*ends[: 2 * len(begins) + 2], len(text))}
    return out


def passages(text: list[str], held: np.ndarray, template: list[str], coverage: float) -> list[tuple[float, int, int]]:
    """(coverage, first word, word after the last) of passages that cover the template, best first, without overlaps.

    held: for each word whether the template has it.
    """
    n, need = len(template), coverage * len(template)
    counts, begins = Counter(template), openings(template, coverage)
    sums = np.concatenate([[0], np.cumsum(held)])
    starts = np.arange(0, max(1, len(text)), max(1, n // 2))
    likely = starts[sums[np.minimum(starts + 3 * n, len(text))] - sums[starts] >= need]
    done: set[tuple[int, int]] = set()
    found: dict[tuple[int, int], int] = {}
    for at in likely.tolist():
        window = text[at : at + 3 * n]
        for s, e in {(0, len(window))} | pieces(window, begins, need, n):
            if (at + s, at + e) in done or sums[at + e] - sums[at + s] < need:
                continue
            done.add((at + s, at + e))
            part = window[s:e]
            if (Counter(part) & counts).total() >= need and len(pairs := align(template, part)) >= need:
                place, score = (at + s + pairs[0][1], at + s + pairs[-1][1] + 1), len(pairs)
                while score < n:
                    # What lies beyond the window may hold more of the template.
                    first = max(0, place[0] - n)
                    pairs = align(template, text[first : place[1] + n])
                    if len(pairs) <= score:
                        break
                    place, score = (first + pairs[0][1], first + pairs[-1][1] + 1), len(pairs)
                found[place] = max(found.get(place, 0), score)
    spans = sorted(found)

    def holds_two(first: int, end: int) -> bool:
        """Whether two passages lie in this one without overlap: it is aligned with some words of each."""
        inner = [x for x in spans[bisect.bisect_left(spans, (first,)) : bisect.bisect_left(spans, (end,))] if x[1] <= end and x != (first, end)]
        return bool(inner) and max(x[0] for x in inner) >= min(x[1] for x in inner)

    out: list[tuple[float, int, int]] = []
    taken: list[tuple[int, int]] = []
    for first, end in sorted((x for x in spans if not holds_two(*x)), key=lambda x: (-found[x], x[1] - x[0], x)):
        k = bisect.bisect_left(taken, (first, end))
        if (k == 0 or taken[k - 1][1] <= first) and (k == len(taken) or taken[k][0] >= end):
            taken.insert(k, (first, end))
            out.append((found[first, end] / n, first, end))
    return sorted(out, key=lambda f: (-f[0], f[1]))


def scan(
    docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """id_column, license, coverage, first_word, end_word (of the best passage), passages for each row and license found in it."""
    parsed = {name: words(t) for name, t in (templates or TEMPLATES).items()}
    if not all(parsed.values()) or len(parsed) > 64:
        raise ValueError("1 to 64 templates, each with words")
    has: dict[str, int] = {}
    for k, t in enumerate(parsed.values()):
        for w in t:
            has[w] = has.get(w, 0) | 1 << k
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = has.get
        for ids, texts in chunks(batches):
            rows = []
            for i, t in enumerate(texts):
                found = words(t)
                mask = np.fromiter((get(w, 0) for w in found), np.uint64, len(found))
                for k, (name, template) in enumerate(parsed.items()):
                    held = (mask >> np.uint64(k)) & np.uint64(1)
                    if held.sum() >= coverage * len(template) and (best := passages(found, held.astype(np.int64), template, coverage)):
                        rows.append((i, name, best[0][0], best[0][1], best[0][2], len(best)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.record_batch(
                [
                    ids.take(pa.array(list(cols[0]), pa.int64())),
                    *(pa.array(list(c), t) for c, t in zip(cols[1:], (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()), strict=True)),
                ],
                names=[id_column, "license", "coverage", "first_word", "end_word", "passages"],
            )

    return map_batches(
        docs.select(id_column, text_column), run, f"{id_column} {kind}, license string, coverage double, first_word int, end_word int, passages int",
    )
