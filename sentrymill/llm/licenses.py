"""License scans: phrases, and templates with optional and replaceable regions.

Template markup: ``<<beginOptional>> .. <<endOptional>>`` may be left out (and may be nested);
``<<var;name=n;words=1-3;match="[0-9]+">>`` stands for that many words (by default one), each of
which matches the pattern as a whole (by default any word). All other words are mandatory and
must stand there exactly. A template is compiled into a nondeterministic automaton over words,
which is made deterministic state by state as texts need it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import ALNUM_TABLE, filled, steps

# ---- fixed values: base phrases ----
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# ---- end of fixed values ----

# ---- fixed values: wording of common licenses and notices ----
_AS_IS = """
    this software is provided by the <<var;name=holders;words=1-12>> "as is" and any express or implied warranties,
    including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose
    are disclaimed. in no event shall the <<var;name=holders;words=1-12>> be liable for any direct, indirect, incidental,
    special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or
    services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability,
    whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the
    use of this software, even if advised of the possibility of such damage"""
_TWO_CLAUSES = """
    redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: <<beginOptional>>1.<<endOptional>> redistributions of source code must retain the above
    copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> redistributions
    in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
    the documentation and/or other materials provided with the distribution."""

LICENSES = {
    "mit-text": """
        permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "software"), to deal in the software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and
        to permit persons to whom the software is furnished to do so, subject to the following conditions: the above
        copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be
        included in all copies or substantial portions of the software. the software is provided "as is", without
        warranty of any kind, express or implied, including but not limited to the warranties of merchantability,
        fitness for a particular purpose and noninfringement. in no event shall the <<var;name=holders;words=1-12>> be liable
        for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from,
        out of or in connection with the software or the use or other dealings in the software""",
    "isc-text": """
        permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or
        without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies. the software is provided "as is" and <<var;name=author;words=1-8>> disclaims all warranties with regard to
        this software including all implied warranties of merchantability and fitness. in no event shall
        <<var;name=author;words=1-8>> be liable for any special, direct, indirect, or consequential damages or any damages
        whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other
        tortious action, arising out of or in connection with the use or performance of this software""",
    "bsd-2-clause-text": _TWO_CLAUSES + _AS_IS,
    "bsd-3-clause-text": _TWO_CLAUSES + """
        <<beginOptional>>3.<<endOptional>> neither the name of the <<var;name=organization;words=1-12>> nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior
        written permission.""" + _AS_IS,
    "apache-2.0-header": """
        licensed under the apache license, version 2.0 (the "license"); you may not use this file except in compliance
        with the license. you may obtain a copy of the license at <<var;name=scheme;match="https?">>://www.apache.org/licenses/license-2.0
        unless required by applicable law or agreed to in writing, software distributed under the license is distributed
        on an "as is" basis, without warranties or conditions of any kind, either express or implied. see the license
        for the specific language governing permissions and limitations under the license""",
    "gpl-header": """
        is free software: you can redistribute it and/or modify it under the
        terms of the gnu <<beginOptional>><<var;name=kind;match="lesser|affero|library">><<endOptional>> general public license as published
        by the free software foundation, either version <<var;name=version;words=1-2;match="[0-9]+">> of the
        license, or (at your option) any later version. <<var;name=program;words=1-6>> is distributed in the hope that it
        will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a
        particular purpose. see the gnu <<beginOptional>><<var;name=kind;match="lesser|affero|library">><<endOptional>> general public
        license for more details""",
    "mpl-2.0-header": """
        this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was
        not distributed with this file, you can obtain one at <<var;name=scheme;match="https?">>://mozilla.org/mpl/2.0""",
    "zlib-text": """
        this software is provided 'as-is', without any express or implied warranty. in no event will the authors be held
        liable for any damages arising from the use of this software. permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely,
        subject to the following restrictions: <<beginOptional>>1.<<endOptional>> the origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. if you use this software in a product,
        an acknowledgment in the product documentation would be appreciated but is not required.
        <<beginOptional>>2.<<endOptional>> altered source versions must be plainly marked as such, and must not be misrepresented
        as being the original software. <<beginOptional>>3.<<endOptional>> this notice may not be removed or altered from any source
        distribution""",
}
# ---- end of fixed values ----

TEMPLATES = {
    **LICENSES,
    "apache-2.0-notice": """
        <<beginOptional>>this <<var;name=what;match="work|file|software|program|project">> is<<endOptional>>
        licensed under the <<beginOptional>>terms of the<<endOptional>> Apache License
        <<beginOptional>>Version<<endOptional>> 2.0""",
    "bsd-conditions": """
        Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met""",
    "cc-by-nc-notice": """
        <<beginOptional>>this <<var;name=what;match="work|file|text|document">> is<<endOptional>>
        licensed under <<beginOptional>>the<<endOptional>> CC BY-NC
        <<var;name=version;words=1-2;match="[0-9]+">>""",
    "gpl-notice": """
        <<beginOptional>>this <<var;name=what;match="work|file|software|program|project">> is<<endOptional>>
        licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License
        <<beginOptional>>version <<var;name=version;words=1-2;match="[0-9]+">>
        <<beginOptional>>or later<<endOptional>><<endOptional>>""",
    "mit-notice": """
        <<var;name=how;match="released|licensed|distributed|available">> under the
        <<beginOptional>>terms of the<<endOptional>> MIT License""",
    "mit-permission": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this
        <<var;name=what;words=1-3>> <<beginOptional>>and associated documentation files<<endOptional>>
        <<beginOptional>>the <<var;name=term>><<endOptional>> to deal in the <<var;name=term>> without restriction""",
}


def words_of(text: bytes) -> list[bytes]:
    """Runs of 0-9, a-z and non-ASCII bytes, after lower-casing A-Z."""
    return text.translate(ALNUM_TABLE).split()


class Template:
    """The word automaton of one template."""

    _TAG = re.compile(r"<<(.*?)>>", re.S)

    def __init__(self, markup: str):
        self.free: list[list[int]] = [[]]  # moves that take no word
        self.moves: list[list[tuple]] = [[]]  # (word, next) and (test index, next)
        self.tests: list[re.Pattern] = []
        self.accept = self._parse(markup)
        self.vocabulary = {w for m in self.moves for w, _ in m if isinstance(w, bytes)}
        self.start = self._closed({0})
        self.known: dict[tuple, frozenset] = {}
        if self.accept in self.start:
            raise ValueError("the template has no mandatory word")

    def _state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def _take(self, at: int, what: bytes | int) -> int:
        to = self._state()
        self.moves[at].append((what, to))
        return to

    def _parse(self, markup: str) -> int:
        at, opened, anchors = 0, [], [b""]
        pieces = self._TAG.split(markup)
        for k, piece in enumerate(pieces):
            if k % 2 == 0:
                for word in words_of(piece.encode()):
                    at = self._take(at, word)
                    if not opened:
                        anchors.append(word)
            elif piece == "beginOptional":
                opened.append(at)
            elif piece == "endOptional":
                if not opened:
                    raise ValueError("endOptional without beginOptional")
                to = self._state()
                self.free[at].append(to)
                self.free[opened.pop()].append(to)
                at = to
            elif piece.startswith("var;"):
                options = dict(re.findall(r'(\w+)=("[^"]*"|[^;]*)', piece[4:]))
                low, _, high = options.get("words", "1").partition("-")
                self.tests.append(re.compile(options.get("match", '".*"').strip('"').encode(), re.S))
                skips = []
                for n in range(int(high or low)):
                    if n >= int(low):
                        skips.append(at)
                    at = self._take(at, len(self.tests) - 1)
                for s in skips:
                    self.free[s].append(at)
            else:
                raise ValueError(f"unknown markup <<{piece}>>")
        if opened:
            raise ValueError("beginOptional without endOptional")
        # a text without the longest mandatory word has no match
        self.anchor = max(anchors, key=len)
        return at

    def _closed(self, states: set[int]) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    def step(self, states: frozenset, word: bytes) -> frozenset:
        passes = tuple(t.fullmatch(word) is not None for t in self.tests)
        key = (states, word if word in self.vocabulary else None, passes)
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = self._closed({
                to for s in states for what, to in self.moves[s]
                if (passes[what] if isinstance(what, int) else what == word)})
        return found

    def accepts(self, text: str) -> bool:
        """Whether the template makes up the whole text."""
        states = self.start
        for word in words_of(text.encode()):
            states = self.step(states, word)
        return self.accept in states

    def longest(self, words: list[bytes], i: int) -> int:
        """Where the longest match that starts at word i ends; i where there is none."""
        states, end, n = self.start, i, len(words)
        k = i
        while states and k < n:
            states = self.step(states, words[k])
            k += 1
            if self.accept in states:
                end = k
        return end

    def spans(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Leftmost, longest matches that don't overlap."""
        out, i = [], 0
        while i < len(words):
            end = self.longest(words, i)
            if end > i:
                out.append((i, end))
            i = max(end, i + 1)
        return out


def phrase_places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Every word at which the phrase starts."""
    out, n, k = [], len(phrase), 0
    while True:
        try:
            k = words.index(phrase[0], k)
        except ValueError:
            return out
        if words[k:k + n] == phrase:
            out.append(k)
        k += 1


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,start:int,end:int>>"
)


def license_scan(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES,
    templates: dict[str, str] = TEMPLATES,
) -> DataFrame:
    """Phrases and template matches of every text; one row per row of ``docs``.

    ``n_base``, ``first_word`` and ``last_word``: all places of the phrases, and their smallest and
    largest start (null without any). ``spans``: words that templates match. ``score``: 1 with
    a template match, else 0.5 with a phrase, else 0. Null text counts as empty.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [(words_of(p.encode()), label) for p, label in phrases.items()]
        automata = {label: Template(markup) for label, markup in templates.items()}
        for batch in steps(batches, "text"):
            out = []
            for text in filled(batch.column("text")).cast(pa.large_binary()).to_pylist():
                body = text.translate(ALNUM_TABLE)
                words = body.split()
                places, base, spans = [], set(), []
                for phrase, label in wanted:
                    if phrase[-1] in body and (found := phrase_places(words, phrase)):
                        places += found
                        base.add(label)
                for label, automaton in automata.items():
                    if automaton.anchor in body:
                        spans += [(a, b, label) for a, b in automaton.spans(words)]
                labels = base | {label for _, _, label in spans}
                out.append({
                    "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None),
                    "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)),
                    "labels": ",".join(sorted(labels)), "score": 1.0 if spans else 0.5 if base else 0.0,
                    "spans": [{"label": x, "start": a, "end": b} for a, b, x in sorted(spans)],
                })
            found = pa.RecordBatch.from_pylist(out, schema=arrow)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found.columns], ["doc_id", *found.schema.names])

    arrow = pa.schema([
        *[(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")], ("base_labels", pa.string()),
        ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
    ])
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
