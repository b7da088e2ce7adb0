"""License scans by template markup.

A template is a license's whole text, or the notice that stands for it, in which <<optional>>..<<end>> may be absent and
<<var max=n>> stands for up to n words of any kind. It compiles to an automaton over words: mandatory words in order, skips
over optional regions, counted loops for replaceable ones. A text has the license if some run of its words is accepted, so
all mandatory wording matches exactly (letter case, punctuation and line breaks aside): a text with a word of it changed, up
to the disclaimer's last, has not. Of runs of several templates that begin at one place, all count but those that a longer
run of the same family (cc-by in cc-by-nc) goes beyond.

Words are runs of characters other than ASCII ones that aren't digits or letters, in lower case (A-Z only). Beside the
templates, base phrases count wherever their words stand in a row.

Edge cases: null and empty texts have no words, no labels and score 0; very long texts are scanned whole, in time that
grows with the places where a template may begin; repeated rows are scanned one by one; an empty table gives an empty
result; further columns, whatever their names, are ignored. The score grows with the share of
a template's words, mandatory or not, that a run has; base phrases alone give 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, need

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

# Wording of public license texts and notices, whole, with markup for what may differ.
AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: <<optional>>1<<end>> Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. <<optional>>2<<end>> Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAMES = """<<optional>>3<<end>> Neither the name of <<var max=12>> nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission."""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT <<var max=6>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
        COPYRIGHT <<var max=6>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
        NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
        AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
        OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
GNU_NOTICE = """<<optional>>you can redistribute it and/or modify it<<end>> <<optional>>under the terms of the<<end>> GNU {name} General Public License
        <<optional>>as published by the Free Software Foundation<<end>> <<optional>>either<<end>> version {version}
        <<optional>>of the License<<end>> <<optional>>or (at your option) any later version<<end>>"""
CC_NOTICE = """licensed under <<optional>>a<<end>> <<optional>>the<<end>> <<optional>>Creative Commons<<end>> CC {kind} <<optional>>{version}<<end>>"""

TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice <<optional>>(including the next paragraph)<<end>> shall be included in all copies or substantial portions of the Software.
        """ + AS_IS + """ IN NO EVENT SHALL THE <<var max=6>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """Permission to use, copy, modify, and<<optional>>/or<<end>> distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
        "AS IS" AND <<var max=4>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
        AND FITNESS. IN NO EVENT SHALL <<var max=4>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
        ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause-text": BSD_CONDITIONS + " " + BSD_DISCLAIMER,
    "bsd-3-clause-text": BSD_CONDITIONS + " " + BSD_NAMES + " " + BSD_DISCLAIMER,
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the <<var max=4>> be held liable
        for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
        including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        <<optional>>1<<end>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
        If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        <<optional>>2<<end>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        <<optional>>3<<end>> This notice may not be removed or altered from any source distribution.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means. <<optional>>In jurisdictions that recognize copyright laws, the author or authors of this software
        dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public
        at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
        perpetuity of all present and future rights to this software under copyright law.<<end>>
        """ + AS_IS + """ IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
        TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 <<optional>>(the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at <<var max=8>> Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License.<<end>>""",
    "mit-notice": tuple(f"<<optional>>This <<var max=4>> is<<end>> {verb} under the <<optional>>terms of the<<end>> MIT License" for verb in ("Released", "Licensed", "Distributed", "Available")),
    "gpl-2.0-notice": GNU_NOTICE.format(name="", version="2"),
    "gpl-3.0-notice": GNU_NOTICE.format(name="", version="3"),
    "lgpl-2.1-notice": GNU_NOTICE.format(name="Lesser", version="2.1"),
    "lgpl-3.0-notice": GNU_NOTICE.format(name="Lesser", version="3"),
    "agpl-3.0-notice": GNU_NOTICE.format(name="Affero", version="3"),
    "mpl-2.0-notice": """subject to the terms of the Mozilla Public License<<optional>>,<<end>> <<optional>>v<<end>> <<optional>>version<<end>> 2.0
        <<optional>>If a copy of the MPL was not distributed with this file, You can obtain one at <<var max=6>><<end>>""",
    **{f"cc-{kind.lower().replace(' ', '-')}-notice": CC_NOTICE.format(kind=kind, version="4.0") for kind in ("BY", "BY SA", "BY NC", "BY ND", "BY NC SA", "BY NC ND")},
}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


@dataclass
class Automaton:
    """states: for each state a list of (word or None for any, next state); jumps: states that may be entered without a word."""

    label: str
    steps: list[list[tuple[str | None, int]]] = field(default_factory=list)
    jumps: list[list[int]] = field(default_factory=list)
    mandatory: tuple[str, ...] = ()
    size: int = 0  # words of the template, mandatory or not

    def state(self) -> int:
        self.steps.append([])
        self.jumps.append([])
        return len(self.steps) - 1

    def closed(self, states: set[int]) -> set[int]:
        todo, found = list(states), set(states)
        while todo:
            for s in self.jumps[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return found

    def accepts_at(self, text: list[str], start: int) -> int:
        """The end of the longest accepted run that begins at start, or -1."""
        final, states, end = len(self.steps) - 1, self.closed({0}), -1
        for i in range(start, len(text) + 1):
            if final in states:
                end = i
            if i == len(text) or not states:
                break
            w = text[i]
            states = self.closed({n for s in states for x, n in self.steps[s] if x == w or x is None})
        return end

    def starts(self) -> set[str]:
        """Words that an accepted run may begin with."""
        return {x for s in self.closed({0}) for x, _ in self.steps[s] if x is not None}


def compile_template(label: str, template: str) -> Automaton:
    a = Automaton(label)
    here = a.state()
    opened: list[int] = []
    mandatory: list[str] = []
    for part in re.split(r"(<<[^>]*>>)", template):
        if part == "<<optional>>":
            opened.append(here)
        elif part == "<<end>>":
            after = a.state()
            a.jumps[here].append(after)
            a.jumps[opened.pop()].append(after)
            here = after
        elif m := re.fullmatch(r"<<var max=(\d+)>>", part):
            ends = [here]
            for _ in range(int(m[1])):
                after = a.state()
                a.steps[here].append((None, after))
                here = after
                ends.append(here)
            after = a.state()
            for s in ends:
                a.jumps[s].append(after)
            here = after
        else:
            for w in words(part):
                after = a.state()
                a.steps[here].append((w, after))
                here = after
                a.size += 1
                if not opened:
                    mandatory.append(w)
    if opened or not mandatory:
        raise ValueError(f"{label}: an optional region isn't closed, or nothing is mandatory")
    after = a.state()
    a.jumps[here].append(after)
    a.mandatory = tuple(dict.fromkeys(mandatory))
    return a


class Scanner:
    def __init__(self, templates: dict[str, str | tuple[str, ...]] | None = None, base: dict[str, str] | None = None) -> None:
        self.automata = [compile_template(k, x) for k, v in (templates or TEMPLATES).items() for x in ((v,) if isinstance(v, str) else v)]
        self.starts: dict[str, list[Automaton]] = {}
        for a in self.automata:
            for w in a.starts():
                self.starts.setdefault(w, []).append(a)
        self.base = {label: tuple(words(phrase)) for label, phrase in (base or BASE).items()}
        self.triggers = [set(a.mandatory) for a in self.automata]

    def templates_in(self, text: list[str]) -> list[tuple[str, int, int, float]]:
        """(label, start, end, share of the template's words) of every accepted run that isn't inside an earlier one of its label."""
        there = set(text)
        left = {a.label for a, t in zip(self.automata, self.triggers) if t <= there}  # all mandatory words occur at all
        found: list[tuple[str, int, int, float]] = []
        if not left:
            return found
        done: dict[str, int] = {}
        for i, w in enumerate(text):
            for a in self.starts.get(w, ()):
                if a.label in left and i >= done.get(a.label, 0) and (end := a.accepts_at(text, i)) >= 0:
                    found.append((a.label, i, end, min(1.0, (end - i) / a.size)))
                    done[a.label] = end
        longest = {}
        for label, i, end, _ in found:
            family = (label.split("-")[0], i)
            longest[family] = max(longest.get(family, 0), end)
        return [x for x in found if x[2] == longest[x[0].split("-")[0], x[1]]]

    def base_in(self, text: list[str]) -> list[tuple[str, int]]:
        found = []
        for label, phrase in self.base.items():
            n, i = len(phrase), -1
            while True:
                try:
                    i = text.index(phrase[0], i + 1)
                except ValueError:
                    break
                if tuple(text[i : i + n]) == phrase:
                    found.append((label, i))
        return found


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, the base places (label, word) and the template matches (label, first_word, end_word)."""
    need(docs, "doc_id", "text")

    def make():
        scanner = Scanner(templates)

        def rows(doc_id, text) -> Iterator[tuple]:
            w = words(text)
            yield (doc_id, len(w), [{"label": a, "word": b} for a, b in scanner.base_in(w)], [{"label": a, "first_word": b, "end_word": c, "share": x} for a, b, c, x in scanner.templates_in(w)])

        return rows

    kind = dict(docs.dtypes)["doc_id"]
    return map_rows(docs.select("doc_id", F.col("text").cast("string")), make, f"doc_id {kind}, n_words bigint, base array<struct<label:string,word:bigint>>, matches array<struct<label:string,first_word:bigint,end_word:bigint,share:double>>")


def report(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """scan() by document: counts, labels, and the score: 0.5 and half the largest share of a template's words, 0.5 for base phrases alone, else 0."""
    found = scan(docs, templates)
    place = F.col("base.word")
    labels = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*c))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(place).alias("first_word"),
        F.array_max(place).alias("last_word"),
        labels(F.col("base.label")).alias("base_labels"),
        labels(F.col("base.label"), F.col("matches.label")).alias("labels"),
        F.when(F.size("matches") > 0, F.round(0.5 + F.array_max("matches.share") / 2, 6)).when(F.size("base") > 0, 0.5).otherwise(0.0).alias("score"),
    )
