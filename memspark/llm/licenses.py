"""License scan by patience alignment.

A text's words are aligned with a template's: words unique to both sides are anchors, the
longest increasing subsequence of their places is kept, and the gaps between anchors (and
before and after them) are aligned likewise; where a gap has no anchor, its equal head and
tail match. Coverage is the share of the template's words that are matched.

A passage is a place where telling words (template words that aren't common) stand no farther
apart than the template is long, so a long text is cut at wider gaps. Inside such a stretch a passage may start wherever one of the template's first telling words puts
its start. As those words may also recur inside a notice, each start is tried with every
near end, cut at a later start or uncut, and the best is kept; what no passage took is then
aligned uncut. So all passages are returned, however often the template occurs. A text is
only aligned with templates of which it holds enough distinct words to reach the least
coverage, a bound that loses nothing.

Coverage alone doesn't name a license: the few words that tell siblings apart (a version, `lesser`, `by-nd`, a third
clause) may be the missing ones. So each template has deciding words that must be matched, and deciding words of its siblings must
not stand unmatched in the passage; a passage that no template may name is left out.

 Each text is judged whole and by itself: nulls and empty
texts hold no license, repeated rows agree, ties go to the first template in the list, and
other columns are ignored. An empty table gives no rows; templates without words match
nothing, and without templates no text holds a license.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from memspark.llm.common import slices

LEAST_COVERAGE = 0.8
#: Notices as their licenses word them.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "MIT-notice": "Released under the MIT License",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-notice": "Released under the BSD License",
    "Apache-1.1-notice": "Licensed under the Apache License, Version 1.1",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.
You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA""",
    "LGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.
You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.
You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "all-rights-reserved": "All rights reserved",
}
#: Codes and versions of the Creative Commons licenses; their notices differ in nothing else.
CC_CODES, CC_VERSIONS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"), ("4.0", "3.0", "2.5", "2.0", "1.0")
TEMPLATES |= {f"CC-{code}-{version}-notice": f"Licensed under CC {code} {version}" for code in CC_CODES for version in CC_VERSIONS}
_LESSER = {"lesser", "library", "affero"}
#: Deciding words by template: those that must be matched, and those of its siblings that must not stand unmatched in the passage.
DECIDING: dict[str, tuple[set[str], set[str]]] = {
    "MIT": ({"sublicense", "merge"}, set()),
    "MIT-grant": ({"sublicense", "merge"}, set()),
    "MIT-notice": ({"mit"}, set()),
    "Apache-2.0": ({"apache", "2.0"}, {"1.0", "1.1"}),
    "Apache-2.0-notice": ({"apache", "2.0"}, {"1.0", "1.1"}),
    "Apache-1.1-notice": ({"apache", "1.1"}, {"1.0", "2.0"}),
    "GPL-3.0": ({"general", "public", "3"}, _LESSER | {"2"}),
    "GPL-3.0-notice": ({"general", "public", "3"}, _LESSER | {"2"}),
    "GPL-2.0": ({"general", "public", "2"}, _LESSER | {"3"}),
    "GPL-2.0-notice": ({"general", "public", "2"}, _LESSER | {"3"}),
    "LGPL-2.1": ({"lesser", "2.1"}, {"3"}),
    "LGPL-3.0": ({"lesser", "3"}, {"2.1"}),
    "AGPL-3.0": ({"affero", "3"}, set()),
    "BSD-2-Clause": ({"redistributions", "binary"}, {"endorse", "neither", "advertising", "acknowledgement", "acknowledgment"}),
    "BSD-3-Clause": ({"redistributions", "binary", "endorse", "neither"}, {"advertising", "acknowledgement", "acknowledgment"}),
    "BSD-notice": ({"bsd"}, {"2-clause", "3-clause", "4-clause"}),
    "ISC": ({"fee", "purpose"}, set()),
    "MPL-2.0": ({"mozilla", "2.0"}, {"1.0", "1.1"}),
    "EPL-2.0": ({"eclipse", "2.0"}, {"1.0"}),
    "Unlicense": ({"unencumbered"}, set()),
    "Zlib": ({"misrepresented", "altered"}, set()),
    "CC0-notice": ({"waived"}, set()),
    "all-rights-reserved": ({"all", "rights", "reserved"}, set()),
} | {f"CC-{code}-{version}-notice": ({"cc", code.lower(), version}, set()) for code in CC_CODES for version in CC_VERSIONS}
#: Telling words that may mark a passage's start, and the longest passage, in lengths of the template, that is tried past other starts.
STARTERS, REACH = 3, 8
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: Words that say little about where a notice stands.
_COMMON = frozenset("a above all and any are as at be by can for in is it may not of on or source terms that the this to under use was which with without you".split())


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (sorted by the first) whose second members increase: patience piles."""
    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(last[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            last.append(k)
        else:
            tops[pile], last[pile] = j, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of a and b by patience alignment, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        if i >= m or j >= n:
            continue
        ca, cb = Counter(a[i:m]), Counter(b[j:n])
        at = {w: x for x, w in enumerate(b[j:n], j) if cb[w] == 1}
        anchors = increasing([(x, at[w]) for x, w in enumerate(a[i:m], i) if ca[w] == 1 and w in at])
        if anchors:
            out += anchors
            for x, y in [*anchors, (m, n)]:
                todo.append((i, x, j, y))
                i, j = x + 1, y + 1
            continue
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            out.append((m - 1, n - 1))
            m, n = m - 1, n - 1
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, deciding: tuple[set[str], set[str]] = (set(), set())) -> None:
        self.name, self.words = name, words_of(text)
        self.required, self.barred = deciding
        self.counts = Counter(self.words)
        self.telling = frozenset(w for w in self.words if w not in _COMMON) or frozenset(self.words)
        #: The first STARTERS telling words and where each stands first.
        self.starters = {w: self.words.index(w) for w in [w for w in dict.fromkeys(self.words) if w in self.telling][:STARTERS]}

    def may_cover(self, words: list[str], least: float) -> bool:
        have = Counter(words)
        return sum(min(c, have[w]) for w, c in self.counts.items()) >= least * len(self.words)


def stretches(words: list[str], t: Template) -> Iterator[tuple[int, int]]:
    """Ranges of words that hold telling words close together."""
    spots = [i for i, w in enumerate(words) if w in t.telling]
    begin = 0
    for k in range(1, len(spots) + 1):
        if k == len(spots) or spots[k] - spots[k - 1] > len(t.words):
            before = spots[begin - 1] + 1 if begin else 0
            after = spots[k] if k < len(spots) else len(words)
            yield max(before, spots[begin] - len(t.words)), min(after, spots[k - 1] + len(t.words) + 1)
            begin = k


def follows(words: list[str], t: Template, least: float) -> float:
    """Coverage of the template by these words, 0 below the least."""
    cover = len(align(words, t.words)) / len(t.words) if t.may_cover(words, least) else 0.0
    return cover if cover >= least else 0.0


def best_range(words: list[str], t: Template, start: int, ends: list[int], least: float) -> tuple[str, float, int, int] | None:
    """The best covered alignment of a range from start to one of the ends (ascending); ties go to the nearest end.

    A farther end must not take words of the next notice: what follows is counted too.
    """
    best = None
    if not ends or not t.may_cover(words[start : ends[-1]], least):
        return None
    for end in ends:
        pairs = align(words[start:end], t.words)
        cover = len(pairs) / len(t.words)
        if cover >= least and (best is None or cover > best[1]):
            new = (t.name, cover, start + pairs[0][0], start + pairs[-1][0] + 1)
            stop = new[3] + len(t.words)
            if best is None or cover + follows(words[new[3] : stop], t, least) > best[1] + follows(words[best[3] : stop], t, least):
                best = new
        if cover == 1:
            break
    return best


def covered(words: list[str], t: Template, lo: int, hi: int, least: float) -> list[tuple[str, float, int, int]]:
    """All covered passages of one stretch, in order; they don't overlap."""
    short, far = least * len(t.words), REACH * len(t.words)
    starts = sorted({lo} | {max(lo, i - t.starters[words[i]]) for i in range(lo, hi) if words[i] in t.starters})
    out: list[tuple[str, float, int, int]] = []
    at = lo
    k = 0
    while at < hi:
        k = bisect_left(starts, at, k)
        a = bisect_left(starts, at + short, k)  # nearer ends leave too few words
        ends = starts[a : max(a + 1, bisect_left(starts, at + far, a))]
        ends = sorted({*ends, min(hi, at + far)} | (set() if ends else {hi}))
        found = best_range(words, t, at, ends, least)
        if found:
            out.append(found)
            at = found[3]
        else:
            n = bisect_left(starts, at + 1, k)
            at = starts[n] if n < len(starts) else hi
    gaps = list(zip([lo, *(f[3] for f in out)], [*(f[2] for f in out), hi], strict=True))
    while gaps:
        i, j = gaps.pop()
        found = best_range(words, t, i, [j], least) if j - i >= short else None
        if found:
            out.append(found)
            gaps += [(i, found[2]), (found[3], j)]
    return sorted(out, key=lambda f: f[2])


def find(text: str, templates: list[Template], least: float = LEAST_COVERAGE) -> list[tuple[str, float, int, int]]:
    """(template, coverage, first word, end word) of every passage that covers a template, by template and place."""
    words = words_of(text)
    have = set(words)
    out = []
    for t in templates:
        if not t.words or sum(c for w, c in t.counts.items() if w in have) < least * len(t.words):
            continue
        for lo, hi in stretches(words, t):
            out += covered(words, t, lo, hi, least)
    return out


def named(text: str, templates: list[Template], least: float = LEAST_COVERAGE) -> list[tuple[str, float, int, int, int, float]]:
    """The found passages that their template may name, each with its matched words and the share of words matched on both sides.

    All deciding words of the template must be matched, and no deciding word of a sibling may stand unmatched in the
    passage.
    """
    words, of = words_of(text), {t.name: t for t in templates}
    kept = []
    for name, cover, a, b in find(text, templates, least):
        t = of[name]
        pairs = align(words[a:b], t.words)
        matched = {i for i, _ in pairs}
        said = {t.words[j] for _, j in pairs}
        if t.required <= said and not any(words[i] in t.barred and i - a not in matched for i in range(a, b)):
            kept.append((name, cover, a, b, len(pairs), 2 * len(pairs) / (len(t.words) + b - a)))
    return kept


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE, deciding: dict[str, tuple[set[str], set[str]]] | None = None) -> DataFrame:
    """Per document: best license, its coverage and all named passages as name:first:end.

    The best one has most matched words, then the greatest share of words matched on both sides, then comes first in the
    list. `deciding` gives the required and barred words of templates; templates without an entry need none.
    """
    known = dict(TEMPLATES if templates is None else templates)
    decide = dict((DECIDING if templates is None else {}) if deciding is None else deciding)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Template(n, t, decide.get(n, (set(), set()))) for n, t in known.items()]
        for batch in slices(batches):
            name, cover, spans = [], [], []
            for text in batch.column(1).to_pylist():
                found = named(text or "", made, least)
                best = max(found, key=lambda f: f[4:], default=None)
                name.append(best[0] if best else None)
                cover.append(round(best[1], 6) if best else 0.0)
                spans.append(",".join(f"{n}:{a}:{b}" for n, _, a, b, _, _ in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.string()), pa.array(cover, pa.float64()), pa.array(spans, pa.string())], ["doc_id", "license", "coverage", "passages"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, coverage double, passages string")
