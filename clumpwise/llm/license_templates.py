"""License scans by template-markup matching.

A template is a license's mandatory wording with marked regions: ``[[...]]``
may be left out, ``{name:a-b}`` stands for a to b words of any kind. It is compiled
into a token automaton whose states are sets of places; matching starts where
the template's first words occur and ends at the first accepting place, so a
text is accepted only if all mandatory wording follows exactly.

Texts are cut into words and hashed many documents at a time; the automata run
only from places where a template's opening words stand, found by their window
hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clumpwise.llm.textops import ALNUM, map_arrow, text_slices, window_hashes, word_hashes, word_spans

#: Phrases (as consecutive words) and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Opening words by which a template is found; these must be plain, which is checked.
OPENING = 3

# Public license wordings that several licenses share.
_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal {how} the Software without restriction, including without limitation the
    rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
    persons to whom the Software is furnished to do so"""
_NOTICE = """, subject to the following conditions: The above copyright notice and this permission notice
    [[(including the next paragraph)]] shall be included in all copies or substantial portions of the Software."""
_AS_IS = """ THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
    WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {holder:2-12} BE
    LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
    OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS {how} THE SOFTWARE"""
_DISCLAIMS = """ THE SOFTWARE IS PROVIDED "AS IS" AND {holder:1-12} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
    ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {holder:1-12} BE LIABLE FOR ANY SPECIAL, DIRECT,
    INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
    OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"""
_TWO_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: [[1]] Redistributions of source code must retain the above copyright notice, this list of
    conditions and the following disclaimer. [[2]] Redistributions in binary form must reproduce the above copyright notice,
    this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
    distribution."""
_THIRD_CLAUSE = """ [[3]] Neither the name of {holder:1-16} nor the names of {its:1-2} contributors may be used to endorse or promote
    products derived from this software without specific prior written permission."""
_PROVIDED_BY = """ THIS SOFTWARE IS PROVIDED BY {holder:2-14} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
    TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
    {holder:2-14} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
    LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
    CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
    ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"""
_GNU = """is free software[[:]] you can redistribute it and/or modify it under the terms of the {name} as published by the
    Free Software Foundation[[; either]] version {version:1-2} [[of the License]] [[, or (at your option) any later version]].
    {program:1-6} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details"""


def _filled(text: str, **parts: str) -> str:
    for k, v in parts.items():
        text = text.replace("{" + k + "}", v)
    return text


# Public license wordings, whole; those of licenses that are too long to stand in a file are their notices.
TEMPLATES: dict[str, str] = {
    "mit-notice": "released under the mit license",
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "gpl-notice": "licensed under the gnu general public license",
    "cc-by-nc-notice": "licensed under cc by nc {version:1-2}",
    "mit": _filled(_GRANT + _NOTICE + _AS_IS, how="in"),
    "mit-0": _filled(_GRANT + _AS_IS, how="in"),
    "x11": _filled(_GRANT + _NOTICE + _AS_IS, how="in")
    + """. Except as contained in this notice, the name of {holder:1-16} shall not be used in advertising or otherwise to promote the
        sale, use or other dealings in this Software without prior written authorization from {holder:1-16}""",
    "ncsa": _filled(_GRANT, how="with")
    + """, subject to the following conditions: [[1]] Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimers. [[2]] Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimers in the documentation and/or other materials provided with the distribution.
        [[3]] Neither the names of {holder:1-20}, nor the names of its contributors may be used to endorse or promote products derived
        from this Software without specific prior written permission."""
    + _filled(_AS_IS, how="with"),
    "isc": """Permission to use, copy, modify, [[and/or]] [[and]] distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies."""
    + _DISCLAIMS,
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
    + _DISCLAIMS,
    "bsd-2-clause": _TWO_CLAUSES + _PROVIDED_BY,
    "bsd-3-clause": _TWO_CLAUSES + _THIRD_CLAUSE + _PROVIDED_BY,
    "bsd-4-clause": _TWO_CLAUSES
    + """ [[3]] All advertising materials mentioning features or use of this software must display the following acknowledgement: This
        product includes software developed by {holder:1-20}. [[4]]"""
    + _THIRD_CLAUSE.replace("[[3]]", "")
    + _PROVIDED_BY,
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at {address:1-12} Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
        License""",
    "gpl": _filled(_GNU, name="GNU General Public License"),
    "lgpl": _filled(_GNU, name="GNU Lesser General Public License"),
    "lgpl-2.0": _filled(_GNU, name="GNU Library General Public License"),
    "agpl": _filled(_GNU, name="GNU Affero General Public License"),
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at {address:1-12}""",
    "epl": """This program and the accompanying materials are made available under the terms of the Eclipse Public License {version:1-3}
        which [[accompanies this distribution, and]] is available at {address:1-12}""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this
        software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit
        of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
        relinquishment in perpetuity of all present and future rights to this software under copyright law."""
    + _filled(_AS_IS, how="in"),
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will {holder:1-12} be held liable
        for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
        including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: [[1]] The
        origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
        software in a product, an acknowledgment in the product documentation would be appreciated but is not required. [[2]] Altered
        source versions must be plainly marked as such, and must not be misrepresented as being the original software. [[3]] This notice
        may not be removed or altered from any source distribution""",
    "bsl-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
        and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
        furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the
        above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or
        in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
        machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
        ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE,
        TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES
        OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE""",
    "postgresql": """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and
        without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two
        paragraphs appear in all copies. IN NO EVENT SHALL {holder:2-16} BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, SPECIAL, INCIDENTAL,
        OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS DOCUMENTATION, EVEN IF
        {holder:2-16} HAS BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGE. {holder:2-16} SPECIFICALLY DISCLAIMS ANY WARRANTIES, INCLUDING,
        BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE. THE SOFTWARE PROVIDED HEREUNDER
        IS ON AN "AS IS" BASIS, AND {holder:2-16} HAS NO OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT, UPDATES, ENHANCEMENTS, OR
        MODIFICATIONS""",
    "cc0": """To the extent possible under law, {name:1-12} has waived all copyright and related or neighboring rights to {work:1-12}""",
    "cc-by": "This work is licensed under {a:0-1} Creative Commons Attribution [[NonCommercial]] [[ShareAlike]] [[NoDerivatives]] {version:1-2} [[International]] License",
}

_MARK = re.compile(r"\[\[(.*?)\]\]|\{\w+:(\d+)-(\d+)\}", re.DOTALL)


def _hashes(text: str) -> list[int]:
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, _ = word_spans(data, np.asarray([0, len(data)]), ALNUM)
    return [int(x) for x in word_hashes(data, start, end)]


class Automaton:
    """A compiled template: per place, words leading on, places reachable without a word, and any-word steps."""

    def __init__(self, markup: str) -> None:
        self.on: list[dict[int, int]] = [{}]
        self.free: list[set[int]] = [set()]
        self.any: list[int | None] = [None]
        self.mandatory = 0
        at = 0
        for m in _MARK.finditer(markup):
            self._words(markup[at : m.start()], True)
            if m[1] is not None:
                before = len(self.on) - 1
                self._words(m[1], False)
                self.free[before].add(len(self.on) - 1)
            else:
                least, most = int(m[2]), int(m[3])
                places = [len(self.on) - 1, *(self._place() for _ in range(most))]
                for a, b in zip(places, places[1:], strict=False):
                    self.any[a] = b
                for k in range(least, most):
                    self.free[places[k]].add(places[-1])
            at = m.end()
        self._words(markup[at:], True)
        self.end = len(self.on) - 1
        plain = _MARK.search(markup)
        self.opening = _hashes(markup[: plain.start()] if plain else markup)[:OPENING]
        if len(self.opening) < OPENING:
            raise ValueError(f"a template must begin with {OPENING} plain words")
        self.closed = [self._closure({k}) for k in range(len(self.on))]

    def _place(self) -> int:
        self.on.append({})
        self.free.append(set())
        self.any.append(None)
        return len(self.on) - 1

    def _words(self, text: str, mandatory: bool) -> None:
        for h in _hashes(text):
            last = len(self.on) - 1
            self.on[last][h] = self._place()
            self.mandatory += mandatory

    def _closure(self, places: set[int]) -> frozenset[int]:
        todo, seen = list(places), set(places)
        while todo:
            for k in self.free[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        return frozenset(seen)

    def accept(self, words: list[int]) -> tuple[int | None, float]:
        """(words taken by the shortest accepted prefix or None, share of places reached)."""
        now, best = self.closed[0], 0
        if self.end in now:
            return 0, 1.0
        for n, h in enumerate(words, 1):
            then: set[int] = set()
            for k in now:
                if (to := self.on[k].get(h)) is not None:
                    then |= self.closed[to]
                if (to := self.any[k]) is not None:
                    then |= self.closed[to]
            if not then:
                break
            now, best = then, max(best, *then)
            if self.end in now:
                return n, 1.0
        return None, best / self.end


@lru_cache(maxsize=4)
def compiled(templates: tuple[tuple[str, str], ...]) -> tuple[tuple[str, ...], tuple[Automaton, ...], np.ndarray]:
    """Names, automata and the rising window hashes of their openings."""
    names = tuple(n for n, _ in templates)
    automata = tuple(Automaton(m) for _, m in templates)
    opening = np.asarray([window_hashes(np.asarray(a.opening, np.uint64), np.asarray([0, OPENING]), OPENING)[0][0] for a in automata], np.uint64)
    return names, automata, opening


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, matches, score) of every row.

    Words are counted from 0. ``matches`` lists (label, start, end) of accepted
    templates; ``score`` is 1 with an accepted template, else the larger of 1/2 for a
    phrase and the share of a template that was followed. A null text is empty.
    Repeated rows stay; other columns are ignored.
    """
    chosen = tuple((TEMPLATES if templates is None else templates).items())
    spans = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, automata, opening = compiled(chosen)
        phrases = [(np.asarray(_hashes(p), np.uint64), label) for p, label in PHRASES]
        for batch in batches:
            for i, j, data, offs in text_slices(batch, "text"):
                start, end, first = word_spans(data, offs, ALNUM)
                h = word_hashes(data, start, end)
                doc = np.repeat(np.arange(j - i), np.diff(first))
                n_base = np.zeros(j - i, np.int64)
                low = np.full(j - i, np.iinfo(np.int64).max)
                high = np.full(j - i, -1)
                labels: list[list[str]] = [[] for _ in range(j - i)]
                for words, label in phrases:
                    at = np.flatnonzero(h[: len(h) - len(words) + 1] == words[0]) if len(h) >= len(words) else np.zeros(0, np.int64)
                    for k in range(1, len(words)):
                        at = at[h[at + k] == words[k]]
                    at = at[doc[at] == doc[at + len(words) - 1]]
                    place = at - first[doc[at]]
                    n_base += np.bincount(doc[at], minlength=j - i)
                    np.minimum.at(low, doc[at], place)
                    np.maximum.at(high, doc[at], place)
                    for d in np.unique(doc[at]):
                        labels[d].append(label)
                found: list[list[dict]] = [[] for _ in range(j - i)]
                score = np.where(n_base > 0, 0.5, 0.0)
                if len(h) >= OPENING:
                    w, _ = window_hashes(h, np.asarray([0, len(h)]), OPENING)
                    for name, automaton, key in zip(names, automata, opening, strict=True):
                        for at in np.flatnonzero((w == key) & (doc[: len(w)] == doc[OPENING - 1 :])):  # within one document
                            d = doc[at]
                            taken, share = automaton.accept(h[at : min(first[d + 1], at + 4 * len(automaton.on))].tolist())
                            score[d] = max(score[d], share)
                            if taken is not None:
                                found[d].append({"label": name, "start": int(at - first[d]), "end": int(at - first[d] + taken)})
                none = n_base == 0
                yield pa.record_batch(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(np.diff(first)),
                        pa.array(n_base),
                        pa.array(low, mask=none),
                        pa.array(high, mask=none),
                        pa.array([",".join(sorted(set(x))) for x in labels], pa.string()),
                        pa.array(found, spans),
                        pa.array(score),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "matches", "score"],
                )

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, matches array<struct<label:string,start:long,end:long>>, score double"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), scan, schema)
