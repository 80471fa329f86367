"""License scan by patience alignment of documents with license templates.

Template and text are words. Where enough words of a template stand close together, the
stretch is aligned with it: words that occur once in both are anchors, the longest
increasing subsequence of anchors is kept, and the gaps between them are aligned in the
same way; a gap without anchors falls back to the longest common subsequence, which is
small there. Coverage is the aligned share of the template; the aligned words must be as
large a share of their stretch of the document, and versions and variants must agree.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._text import ALNUM, LOWER, flat, slices, word_hashes, words

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu(name: str, version: str, what: str = "program") -> dict[str, str]:
    """The notice and the header of a GNU license."""
    kind = {"GPL": "GNU", "LGPL": "GNU Lesser", "AGPL": "GNU Affero"}[name]
    header = f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {kind} General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {kind} General Public License for more details."
    full = version if "." in version else f"{version}.0"
    return {f"{name}-{full}": f"This work is licensed under the {kind} General Public License, version {version}.", f"{name}-{full}-header": header[: header.index(" This ")], f"{name}-{full}-text": header}


def _cc(kind: str, spelled: str) -> dict[str, str]:
    """The short and the long notice of a Creative Commons license."""
    return {f"CC-{kind}-4.0": f"Licensed under CC {kind} 4.0.", f"CC-{kind}-4.0-text": f"This work is licensed under a Creative Commons {spelled} 4.0 International License."}


#: Public license notices, headers and whole short licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "Apache-2.0-text": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _BSD_THIRD + _BSD_END,
    **_cc("BY", "Attribution"),
    **_cc("BY-NC", "Attribution-NonCommercial"),
    **_cc("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    **_cc("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    **_cc("BY-ND", "Attribution-NoDerivatives"),
    **_cc("BY-SA", "Attribution-ShareAlike"),
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    **_gnu("AGPL", "3"),
    **_gnu("GPL", "2"),
    **_gnu("GPL", "3"),
    **_gnu("LGPL", "2.1", "library"),
    **_gnu("LGPL", "3"),
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-text": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
#: Words that tell licenses of one family apart.
MARKS = frozenset(b"lesser affero sa nd nc sharealike alike noderivatives noderivs derivatives noderivative noncommercial".split())
_NUMBER = regex.compile(rb"v?\d+")
_WORDS = regex.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text: str) -> list[bytes]:
    """Words of a text: letters and digits of ASCII, A-Z in lower case, and all that is not ASCII."""
    return _WORDS.findall(text.encode().translate(LOWER.tobytes()))


def common(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence, as pairs of places."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def longest_rise(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tops: list[int] = []
    last: list[int] = []
    before = [-1] * len(values)
    for k, v in enumerate(values):
        p = bisect_left(tops, v)
        before[k] = last[p - 1] if p else -1
        if p == len(tops):
            tops.append(v)
            last.append(k)
        else:
            tops[p], last[p] = v, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Patience alignment: pairs of places with equal words, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i == i2 or j == j2:
            continue
        ca, cb = Counter(a[i:i2]), Counter(b[j:j2])
        place = {w: k for k, w in enumerate(b[j:j2], j) if cb[w] == 1}
        both = [(k, place[w]) for k, w in enumerate(a[i:i2], i) if ca[w] == 1 and w in place]
        anchors = [both[k] for k in longest_rise([y for _, y in both])]
        if not anchors:
            out += [(i + x, j + y) for x, y in common(a[i:i2], b[j:j2])]
            continue
        out += anchors
        for (x, y), (x2, y2) in zip([(i - 1, j - 1), *anchors], [*anchors, (i2, j2)]):
            todo.append((x + 1, x2, y + 1, y2))
    return sorted(out)


class Templates:
    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        self.words = [split(texts[n]) for n in self.names]
        joined, off = flat(pa.array([b" ".join(w).decode() for w in self.words], pa.large_string()))
        starts, ends, first = words(joined, off, ALNUM)
        h = word_hashes(joined, starts, ends)
        self.hashes = [np.unique(h[first[k] : first[k + 1]]) for k in range(len(self.names))]
        self.all = np.unique(h)
        low = np.zeros(1 << 16, bool)
        low[(self.all & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.low = low


def stretches(places: np.ndarray, need: int, reach: int) -> list[tuple[int, int]]:
    """Maximal stretches [first, last] of places in which some `need` of them lie within `reach` words."""
    if len(places) < need:
        return []
    k = np.flatnonzero(places[need - 1 :] - places[: len(places) - need + 1] < reach)
    out: list[tuple[int, int]] = []
    for i in k.tolist():
        s, e = int(places[i]), int(places[i + need - 1])
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def marks(own: list[bytes], numbers: bool) -> set[int]:
    """Places of words that tell variants apart, and of version numbers where `numbers`."""
    return {i for i, w in enumerate(own) if w in MARKS or numbers and _NUMBER.fullmatch(w) or w == b"library" and own[i + 1 : i + 2] == [b"general"]}


def numbered(own: list[bytes]) -> bool:
    """Whether the template's numbers are versions, and not those of a list's items."""
    return any(_NUMBER.fullmatch(w) for w in own) and b"redistributions" not in own


def rich(w: list[bytes], own: list[bytes], need: int, most: int) -> list[int]:
    """Places from which `most` words hold `need` of the template's, each counted as often as the template has it."""
    have = Counter(own)
    held: Counter = Counter()
    out, both, j = [], 0, 0
    for i, first in enumerate(w):
        while j < min(i + most, len(w)):
            both += held[w[j]] < have[w[j]]
            held[w[j]] += 1
            j += 1
        if both >= need:
            out.append(i)
        held[first] -= 1
        both -= held[first] < have[first]
    return out


def aligned(own: list[bytes], w: list[bytes], need: int, least: float, goes_on) -> list[tuple[int, int]]:
    """`need` aligned pairs or more that are `least` of their stretch and agree in all marks; the longest start of w that has them."""
    numbers, tails = numbered(own), set(own[need - 1 :])
    own_marks, marked = marks(own, numbers), marks(w, numbers)
    for end in range(len(w), need - 1, -1):
        if w[end - 1] not in tails:
            continue
        pairs = align(own, w[:end])
        if len(pairs) < need:
            continue
        first, last = pairs[0][1], pairs[-1][1]
        if len(pairs) >= least * (last - first + 1) - 1e-9 and own_marks <= {i for i, _ in pairs} and {j for j in marked if first <= j <= last} <= {j for _, j in pairs} and not (numbers and goes_on(last)):
            return pairs
    return []


def matches(h: np.ndarray, spelled, templates: Templates, least: float, goes_on=lambda i: False) -> list[tuple[int, float, int, int, int]]:
    """(template, coverage, aligned words, first word, last word), the best of each template in one document.

    A match aligns `least` of the template's words, they are `least` of the words from the first to the
    last of them, and version numbers and words of MARKS agree there. It is at most 1 / `least` times as
    long as the template, begins with one of its first words and ends with one of its last, so that looking only at such places in
    stretches with as many template words close together loses nothing. goes_on(i): word i is a
    number that a point and another number follow.
    """
    near = np.flatnonzero(templates.low[(h & np.uint64(0xFFFF)).astype(np.int64)])
    near = near[np.isin(h[near], templates.all)]
    out = []
    for t, own in enumerate(templates.words):
        need, most = max(1, int(np.ceil(least * len(own) - 1e-9))), int(len(own) / least + 1e-9)
        if len(near) < need:
            continue
        best = None
        heads = set(own[: len(own) - need + 1])
        for s, e in stretches(near[np.isin(h[near], templates.hashes[t])], need, most):
            w = spelled(s, e + 1)
            for i in rich(w, own, need, most):
                if w[i] not in heads:
                    continue
                pairs = aligned(own, w[i : i + most], need, least, lambda j, at=s + i: goes_on(at + j))
                if pairs and (best is None or len(pairs) > best[2]):
                    best = (t, len(pairs) / len(own), len(pairs), s + i + pairs[0][1], s + i + pairs[-1][1])
                if best and best[2] == len(own):
                    break
            if best and best[2] == len(own):
                break
        if best:
            out.append(best)
    return out


def scan(docs: DataFrame, *, templates: dict[str, str] = TEMPLATES, least: float = 0.9, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a document: n_words, license, coverage, n_aligned, first_word, last_word, all_licenses.

    `license` is the template with the largest coverage, at least `least`; then with more aligned
    words, then the first by name. Null where no template is covered. Null and empty texts have no
    words and no license; repeated rows are scanned each; other columns are not read. Templates
    are a parameter of fixed size and travel with the task.
    """
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    made = docs.sparkSession.sparkContext.broadcast(Templates(templates))

    def run(batches):
        ts = made.value
        for b in slices(batches, "text"):
            buf, off = flat(b.column("text"))
            buf = LOWER[buf]
            starts, ends, first = words(buf, off, ALNUM)
            h = word_hashes(buf, starts, ends)
            raw = buf.tobytes()
            known = np.flatnonzero(ts.low[(h & np.uint64(0xFFFF)).astype(np.int64)])
            known = known[np.isin(h[known], ts.all)]
            has = np.diff(np.searchsorted(known, first))
            rows = []
            for d in range(b.num_rows):
                at, n = int(first[d]), int(first[d + 1] - first[d])
                spelled = lambda s, e, at=at: [raw[x:y] for x, y in zip(starts[at + s : at + e].tolist(), ends[at + s : at + e].tolist())]
                goes_on = lambda i, at=at, n=n: i + 1 < n and starts[at + i + 1] == ends[at + i] + 1 and raw[ends[at + i]] == 0x2E and raw[starts[at + i + 1] : ends[at + i + 1]].isdigit() and raw[starts[at + i] : ends[at + i]][-1:].isdigit()
                got = matches(h[at : at + n], spelled, ts, least, goes_on) if has[d] else []
                got.sort(key=lambda x: (-x[1], -x[2], ts.names[x[0]]))
                top = got[0] if got else None
                rows.append((n, ts.names[top[0]] if top else None, top[1] if top else 0.0, top[2] if top else 0, top[3] if top else None, top[4] if top else None, ",".join(sorted(ts.names[x[0]] for x in got))))
            types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], [*keep, "n_words", "license", "coverage", "n_aligned", "first_word", "last_word", "all_licenses"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{fields}, n_words bigint, license string, coverage double, n_aligned bigint, first_word bigint, last_word bigint, all_licenses string")
