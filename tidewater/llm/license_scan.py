"""License scan: normalised text against licence templates by the Dice coefficient over word bigrams.

Segments of a document are its whole text, its paragraphs (split at blank lines), its lines, and of the runs of consecutive lines
those that match best: none that shares over half of the larger one's words with a match at least as good. A segment is lower-cased,
copyright lines are dropped where it has others, everything but letters and digits becomes a space, and the multiset of its
word bigrams is compared with that of each template: dice = 2 |both| / (|segment| + |template|). Two multisets of sizes m and n
can't exceed 2 min(m, n) / (m + n), so only templates whose size lies within [m t / (2 - t), m (2 - t) / t] are compared at threshold t.

Defined results, a row for each row of docs: doc_id, licenses (SPDX-like names found, sorted), license (that of the highest
coefficient; ties: the first template), dice (0 if none is found), segments (how many segments matched; the same words twice
count twice). Very long texts are read whole. Null or empty text: no licence. An empty table gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import small_batches, table
from tidewater.llm.license_texts import TEXTS

THRESHOLD = 0.8

#: Public licence notices and texts, by SPDX-like name.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License, see the LICENSE file for details."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor,
Boston, MA 02110-1301 USA."""),
    ("LGPL-3.0", """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have
received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>."""),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have
received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS
PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright
holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission. THIS SOFTWARE IS
PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR
BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of
our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights
to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to
<https://unlicense.org>"""),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    *TEXTS,
]

_COPYRIGHT = re.compile(r"^\W*(?:copyright\b|\(c\)\s|©).*$", re.IGNORECASE | re.MULTILINE)
_BREAK = re.compile(r"[\W_]+")


def words(segment: str) -> list[str]:
    """The normalised words of a segment."""
    bare = _COPYRIGHT.sub(" ", segment)
    return _BREAK.sub(" ", (bare if bare.strip() else segment).lower()).split()


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:])) if len(words) > 1 else Counter([tuple(words)] if words else [])


class Templates:
    """Templates by size, and the words that a match can't do without."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.threshold = threshold
        self.all = [(name, b, sum(b.values())) for name, text in templates for b in [bigrams(words(text))]]
        self.holders: dict[tuple, list[int]] = {}
        for i, (_, b, _) in enumerate(self.all):
            for pair in b:
                self.holders.setdefault(pair, []).append(i)
        self.words = frozenset(w for _, b, _ in self.all for pair in b for w in pair)

    def best(self, found: Counter, size: int) -> list[tuple[float, int]]:
        """(dice, template) of those at the threshold, the best first."""
        t, out = self.threshold, []
        for i, (_, b, n) in enumerate(self.all):
            if size * t <= n * (2 - t) and n * t <= size * (2 - t):
                dice = 2 * sum(min(k, b[x]) for x, k in found.items() if x in b) / (size + n)
                if dice >= t:
                    out.append((-dice, i))
        return [(-d, i) for d, i in sorted(out)]

    @property
    def sizes(self) -> tuple[float, float]:
        """Sizes that some template can match."""
        t = self.threshold
        return min(n for _, _, n in self.all) * t / (2 - t), max(n for _, _, n in self.all) * (2 - t) / t


def segments(text: str) -> list[str]:
    """Whole text, paragraphs and lines; each stretch of the text once."""
    paragraphs = re.split(r"\n\s*\n", text)
    out = [text]
    for p in paragraphs:
        lines = p.splitlines()
        if len(paragraphs) > 1:
            out.append(p)
        if len(lines) > 1:
            out += lines
    return out


def runs(text: str, templates: Templates) -> list[tuple[float, int, int, int]]:
    """(dice, start, end, template) of runs of two or more consecutive lines at the threshold, by word numbers.

    Of each template and first line, the best run; paragraphs are runs of lines. Copyright lines count as empty. A first or last line
    without a bigram of the template is left out: the run is better without it.
    """
    t, w, lines = templates.threshold, [], []
    for line in text.splitlines():
        own = _BREAK.sub(" ", _COPYRIGHT.sub(" ", line).lower()).split()
        if own:
            lines.append(len(w))
            w += own
    if len(lines) < 2:
        return []
    hits: dict[int, list[int]] = {}
    for p, pair in enumerate(zip(w, w[1:])):
        for i in templates.holders.get(pair, ()):
            hits.setdefault(i, []).append(p)
    ends, out = [*lines[1:], len(w)], []
    line_of = [k for k, (a, b) in enumerate(zip(lines, ends)) for _ in range(b - a)]
    for i, at in hits.items():
        _, b, n = templates.all[i]
        least, most = n * t / (2 - t), n * (2 - t) / t  # a match shares at least the least size
        if len(at) < least or sum(min(k, b[x]) for x, k in Counter((w[p], w[p + 1]) for p in at).items()) < least - 1e-9:
            continue
        for first in sorted({line_of[p] for p in at}):
            start, left, shared, best = lines[first], {}, 0, None
            begin = bisect_left(at, start)
            if bisect_left(at, start + most + 1) - begin < least - 1e-9:
                continue
            for k in range(begin, len(at)):
                p = at[k]
                last = line_of[p + 1]
                if p + 1 - start > most + 1:
                    break
                pair = (w[p], w[p + 1])
                room = left.get(pair, b[pair])
                left[pair] = room - 1
                shared += room > 0
                end = ends[last]
                if k + 1 < len(at) and at[k + 1] + 1 < end:
                    continue  # the line holds more of them
                size = end - start - 1
                if last > first and size <= most + 1e-9:
                    dice = 2 * shared / (size + n)
                    if dice >= t and (best is None or dice > best[0]):
                        best = (dice, start, end, i)
            if best:
                out.append(best)
    return out


def apart(found: list[tuple[float, int, int, int]], taken: list[tuple[float, int, int]]) -> list[tuple[float, int, int, int]]:
    """The best runs: none that shares over half of the larger one's words with a run, or a matching segment (dice, start, end), at least as good."""
    kept: list[tuple[float, int, int]] = []
    out = []
    for d, a, e, i in sorted(found, key=lambda r: (-r[0], r[2] - r[1], r[3], r[1])):
        if all(x < d or 2 * (min(e, f) - max(a, b)) <= max(e - a, f - b) for x, b, f in taken + kept):
            kept.append((d, a, e))
            out.append((d, a, e, i))
    return out


def spans(text: str) -> list[tuple[int, int]]:
    """Of each of segments(text) its first and last word's numbers among the words outside copyright lines."""
    paragraphs, at, out = re.split(r"\n\s*\n", text), 0, []
    for p in paragraphs:
        lines, first = [], at
        for line in p.splitlines():
            n = len(_BREAK.sub(" ", _COPYRIGHT.sub(" ", line)).split())
            lines.append((at, at + n))
            at += n
        if len(paragraphs) > 1:
            out.append((first, at))
        if len(lines) > 1:
            out += lines
    return [(0, at), *out]


def scanned(text: str | None, templates: Templates) -> tuple[list[str], str | None, float, int]:
    """(licenses, license, dice, segments) of one text."""
    found, least, most = [], *templates.sizes
    known, t = templates.words, templates.threshold
    whole = []
    for k, s in enumerate(segments(text) if text else []):
        w = words(s)
        size = max(1, len(w) - 1)
        # Every matching bigram needs two of the templates' words.
        if not w or not least <= size <= most or sum(x in known for x in w) < t / 2 * size:
            continue
        best = templates.best(bigrams(w), size)
        if best:
            found.append(best[0])
            whole.append((best[0][0], k))
    more = runs(text, templates) if text else []
    if more:
        at = spans(text) if whole else []
        found += [(d, i) for d, _, _, i in apart(more, [(d, *at[k]) for d, k in whole])]
    if not found:
        return [], None, 0.0, 0
    dice, first = min(((-d, i) for d, i in found))
    return sorted({templates.all[i][0] for _, i in found}), templates.all[first][0], -dice, len(found)


def licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Templates(templates, threshold)
        for f in frames:
            rows = [scanned(x, known) for x in f.text]
            yield pd.DataFrame({"doc_id": f.doc_id, "licenses": [r[0] for r in rows], "license": [r[1] for r in rows], "dice": [r[2] for r in rows], "segments": [r[3] for r in rows]})

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, licenses array<string>, license string, dice double, segments long")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "license", F.round("dice", 6).alias("dice"), "segments")
