"""License scans: normalised text compared to licence templates by Dice over word bigrams.

Text is normalised to lower-case words of letters, digits and non-ASCII bytes. Units
are compared whole: each line, each paragraph of several lines, each two to four
paragraphs that follow one another (licences have so many), and each text of several
paragraphs. A unit's bigrams (with marks for its begin and end, repeats
included) are compared to a template's by Dice, 2 common / (a + b). As the common
ones are at most the smaller count, a template of b bigrams can reach ``DICE`` only
for units of b DICE / (2 - DICE) to b (2 - DICE) / DICE bigrams: other templates are
not compared. A unit is compared at all only if enough of its bigrams are of any
template, which is found for a whole slice at once.

The templates are a parameter and small whatever the data; nothing is shuffled.

Nulls and edges: a null text and a text without words match nothing; ties between
templates go to the first by name; repeated rows and null ids are scanned alike;
``n_matches`` counts the units that match, so a licence may count by itself and in a run.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import wordkernel as wk

DICE = 0.8
#: Paragraphs of a run that is compared as one unit, short of a whole text; as many more as the longest template has.
RUN = 4

_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Short notices by which works name their licence, standard file headers, and whole licence texts.
TEMPLATES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-2-clause": "Released under the BSD 2-Clause License.",
    "bsd-3-clause": "Released under the BSD 3-Clause License.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-nd-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Released under the ISC License.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "apache-2.0-whole-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-2-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. " + _BSD_DISCLAIMER,
    "bsd-3-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_DISCLAIMER,
    "bsl-1.0-text": "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "cc0-1.0-long": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>.",
    "cc-by-sa-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EDGES = (np.uint64(0x5B5B5B5B), np.uint64(0x5D5D5D5D))


def _words(data: np.ndarray, bounds: np.ndarray) -> wk.Words:
    return wk.words(bounds, np.where(_IS_WORD[data], _LOWER[data], np.uint8(32)), 0, len(bounds) - 1)


def _bigrams(hashes: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bigram hashes of units that have words, begin and end included, and where each unit's start (a unit of n words has n + 1)."""
    begins = np.cumsum(counts + 1) - (counts + 1)
    out = np.empty(int((counts + 1).sum()), np.uint64)
    place = np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)
    before = np.empty(len(out), np.uint64)
    after = np.empty(len(out), np.uint64)
    after[place] = hashes
    before[place + 1] = hashes
    before[begins] = _EDGES[0]
    after[begins + counts] = _EDGES[1]
    out[:] = wk.mix(before * np.uint64(0x9E3779B97F4A7C15) + wk.mix(after))
    return out, begins


class Templates:
    def __init__(self, texts: dict[str, str], dice: float = DICE) -> None:
        self.dice, self.grams, self.run = dice, {}, longest_run(texts)
        for name in sorted(texts):
            data = np.frombuffer(texts[name].encode(), np.uint8)
            w = _words(data, np.array([0, len(data)]))
            if len(w.starts):
                self.grams[name] = Counter(_bigrams(wk.word_hashes(w), w.firsts, w.counts)[0].tolist())
        self.sizes = {name: sum(g.values()) for name, g in self.grams.items()}
        self.known = np.unique(np.array([x for g in self.grams.values() for x in g], np.uint64))

    def compared(self, size: np.ndarray | int) -> tuple[float, float]:
        """Sizes of templates that a unit of ``size`` bigrams can match."""
        return size * self.dice / (2 - self.dice), size * (2 - self.dice) / self.dice

    def match(self, grams: np.ndarray) -> tuple[str, float] | None:
        """The best template of a unit at ``dice`` or more."""
        own, best = Counter(grams.tolist()), None
        low, high = self.compared(len(grams))
        for name, size in self.sizes.items():
            if low <= size <= high:
                common = sum((own & self.grams[name]).values())
                score = 2 * common / (len(grams) + size)
                if score >= self.dice and (best is None or score > best[1]):
                    best = (name, score)
        return best

    def scan(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, str, float]]:
        """``(begin, end, name, score)`` of the units of the texts between ``bounds`` that match, each extent of words once."""
        w = _words(data, bounds)
        n = len(w.starts)
        if not n or not len(self.known):
            return []
        h = wk.word_hashes(w)
        # bigrams of the whole stream of words, and of each word with a begin or an end
        pair = lambda x, y: wk.mix(x * np.uint64(0x9E3779B97F4A7C15) + wk.mix(y))
        inside, begin, end = pair(h[:-1], h[1:]), pair(np.full(n, _EDGES[0]), h), pair(h, np.full(n, _EDGES[1]))
        so_far = np.concatenate([[0], np.cumsum(np.isin(inside, self.known))])
        begins, ends = np.isin(begin, self.known), np.isin(end, self.known)
        a, b = (np.searchsorted(w.starts, x) for x in _units(data, bounds, self.run))
        units = np.unique(np.stack([a, b], axis=1)[b > a], axis=0)
        a, b = units[:, 0], units[:, 1]
        hits, sizes = begins[a] + (so_far[b - 1] - so_far[a]) + ends[b - 1], b - a + 1
        least, most = min(self.sizes.values()), max(self.sizes.values())
        low, high = self.compared(sizes)
        # the common bigrams are at most the hits, and the template is at least the smallest that can match
        able = (low <= most) & (high >= least) & (2 * hits >= self.dice * (sizes + np.maximum(low, least)) - 1e-9)
        out = []
        for x, y in units[able].tolist():
            got = self.match(np.concatenate([begin[x : x + 1], inside[x : y - 1], end[y - 1 : y]]))
            if got:
                out.append((int(w.starts[x]), int(w.starts[y - 1]), *got))
        return out


def longest_run(templates: dict[str, str]) -> int:
    """Paragraphs of the longest run that can be one of the templates, ``RUN`` at least."""
    return max([RUN, *(len([p for p in re.split(r"\n[ \t\r\x0b\x0c]*\n", t) if p.strip()]) for t in templates.values())])


def _units(data: np.ndarray, bounds: np.ndarray, most: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of lines, of paragraphs, of runs of paragraphs, and of texts."""
    texts = np.unique(bounds)
    lines = np.unique(np.concatenate([texts, np.flatnonzero(data == 10) + 1]))
    filled = np.add.reduceat(_IS_WORD[data].astype(np.int64), lines[:-1]) > 0
    # a paragraph goes from a line with words after one without, or at a text's begin, to the next line without
    opens = np.isin(lines[:-1], texts[:-1]) | ~np.concatenate([[False], filled[:-1]])
    first = np.flatnonzero(filled & opens)
    last = np.searchsorted(np.flatnonzero(~filled), first)
    empty = np.concatenate([lines[:-1][~filled], [len(data)]])
    begins = lines[:-1][first]
    text = np.searchsorted(texts, begins, "right")
    ends = np.minimum(empty[last], texts[np.minimum(text, len(texts) - 1)])
    units = [(lines[:-1], lines[1:]), (begins, ends), (texts[:-1], texts[1:])]
    for run in range(2, most + 1):
        same = text[run - 1 :] == text[: max(len(text) - run + 1, 0)]
        units.append((begins[: len(same)][same], ends[run - 1 :][same]))
    return tuple(np.concatenate(x) for x in zip(*units))


_OUT = pa.schema([("doc_id", pa.int64()), ("licenses", pa.list_(pa.string())), ("n_matches", pa.int64()), ("best", pa.string()), ("best_dice", pa.float64())])


def _scans(templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = templates.value
        for batch in batches:
            offsets, data = wk.text_buffers(batch.column("text"))
            for a, b in wk.slices(offsets):
                base = int(offsets[a])
                part, bounds = data[base : int(offsets[b])], offsets[a : b + 1] - base
                found: list[dict] = [{} for _ in range(b - a)]
                for begin, _, name, score in t.scan(part, bounds) if len(part) else ():
                    doc = int(np.searchsorted(bounds, begin, "right")) - 1
                    n, best = found[doc].get(name, (0, 0.0))
                    found[doc][name] = (n + 1, max(best, score))
                best = [max(sorted(f), key=lambda x: f[x][1]) if f else None for f in found]
                yield pa.record_batch(
                    [batch.column("doc_id").slice(a, b - a), pa.array([sorted(f) for f in found], pa.list_(pa.string())), pa.array([sum(n for n, _ in f.values()) for f in found], pa.int64()), pa.array(best, pa.string()), pa.array([f[x][1] if x else 0.0 for f, x in zip(found, best)], pa.float64())],
                    schema=_OUT,
                )

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, dice: float = DICE) -> DataFrame:
    """``doc_id, licenses, n_matches, best, best_dice`` for every row of ``docs``."""
    known = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates, dice))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scans(known), "doc_id long, licenses array<string>, n_matches long, best string, best_dice double")


def brute_force(text: str | None, templates: dict[str, str], dice: float = DICE) -> set[str]:
    """Names of all templates that are the best of some unit, from the definition."""
    def grams(t: str) -> Counter:
        w = ["<", *(x.decode() for x in re.findall(rb"[0-9a-z\x80-\xff]+", t.translate({c: c + 32 for c in range(65, 91)}).encode())), ">"]
        return Counter(zip(w, w[1:])) if len(w) > 2 else Counter()

    lines = (text or "").split("\n")
    units, run = list(lines), []
    for line in [*lines, ""]:
        if grams(line):
            run.append(line)
        else:
            units.append("\n".join(run))
            run = []
    said = [u for u in units[len(lines) :] if grams(u)]
    for n in range(2, longest_run(templates) + 1):
        units += ["\n".join(said[k : k + n]) for k in range(len(said) - n + 1)]
    units.append(text or "")
    out = set()
    for own in filter(None, map(grams, units)):
        scored = [(2 * sum((own & g).values()) / (sum(own.values()) + sum(g.values())), name) for name, g in ((n, grams(t)) for n, t in sorted(templates.items())) if g]
        top = max(scored, key=lambda x: x[0], default=(0, ""))
        if top[0] >= dice:
            out.add(top[1])
    return out
