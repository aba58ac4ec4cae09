import itertools
import re

import pytest
from hypothesis import given, settings, strategies as st

from sentrymill.llm import licenses as li

DOCS = "doc_id long, text string, labels string, n_words int, spans string"


def language(markup, vocabulary):
    """All word sequences of a template, by expanding its regions; wildcards range over the vocabulary."""
    pieces = re.split(r"<<(.*?)>>", markup, flags=re.S)
    stack = [[()]]
    for k, p in enumerate(pieces):
        if k % 2 == 0:
            stack[-1] = [s + tuple(p.lower().split()) for s in stack[-1]]
        elif p == "beginOptional":
            stack.append([()])
        elif p == "endOptional":
            inner = stack.pop()
            stack[-1] = [s + t for s in stack[-1] for t in [(), *inner]]
        else:
            words = re.search(r"words=(\d+)(?:-(\d+))?", p)
            low, high = (int(words[1]), int(words[2] or words[1])) if words else (1, 1)
            match = re.search(r'match="([^"]*)"', p)
            fits = [w for w in vocabulary if not match or re.fullmatch(match[1], w)]
            stack[-1] = [s + t for s in stack[-1] for n in range(low, high + 1) for t in itertools.product(fits, repeat=n)]
    return set(stack[0])


MARKUPS = [
    "a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d",
    'x <<var;name=n;words=0-2;match="[0-9]+">> y <<beginOptional>>z<<endOptional>>',
    "<<beginOptional>>a<<endOptional>> <<var;name=v>> a <<var;words=2>>",
    "<<beginOptional>>a b<<endOptional>> <<beginOptional>>a<<endOptional>> b",
]


@pytest.mark.parametrize("markup", MARKUPS)
def test_automaton_accepts_exactly_the_language(markup):
    vocabulary = sorted(set(re.sub(r"<<.*?>>", " ", markup).split()) | {"7", "q"})
    want = language(markup, vocabulary)
    t = li.Template(markup)
    for n in range(6):
        for s in itertools.product(vocabulary, repeat=n):
            assert t.accepts(" ".join(s)) == (s in want), s


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(MARKUPS), st.lists(st.sampled_from("a b c d x y z 7 q".split()), max_size=14))
def test_spans_are_leftmost_longest(markup, words):
    want = language(markup, "a b c d x y z 7 q".split())
    out, i = [], 0
    while i < len(words):
        ends = [j for j in range(i + 1, len(words) + 1) if tuple(words[i:j]) in want]
        if ends:
            out.append((i, max(ends)))
        i = max([i + 1, *ends])
    assert li.Template(markup).spans([w.encode() for w in words]) == out


@pytest.mark.parametrize("bad", ["a <<endOptional>>", "<<beginOptional>> a", "a <<other>>", "<<beginOptional>>a<<endOptional>>", ""])
def test_bad_markup(bad):
    with pytest.raises(ValueError):
        li.Template(bad)


def test_edge_cases(spark):
    rows = [
        (1, None), (2, ""), (3, "The MIT license, the mit-LICENSE"), (4, "Released under the MIT License."),
        (5, "This work is licensed under the GNU General Public License, version 3."), (6, "Licensed under CC BY-NC 4.0."),
        (7, "x " * 40000 + "Licensed under the Apache License, Version 2.0."), (None, "licensed under the apache license version 3"),
        (8, "general public licenses"), (8, "general public licenses"), (9, "ünder MIT licensé mit license"),
        (10, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
        (11, "Permission is hereby granted, free of charge, to any person obtaining one copy of this software to deal in the Software without restriction"),
    ]
    docs = spark.createDataFrame([(*r, "l", 1, "s") for r in rows], DOCS)
    got = {r.doc_id: r for r in li.license_scan(docs).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].labels, got[1].score) == (0, 0, None, "", 0.0)
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].base_labels, got[3].score) == (2, 1, 4, "mit", 0.5)
    assert got[4].labels == "mit,mit-notice" and got[4].score == 1.0
    assert got[5].labels == "gpl,gpl-notice" and (got[5].spans[0].start, got[5].spans[0].end) == (0, 12)
    assert (got[6].base_labels, got[6].labels) == ("", "cc-by-nc-notice")
    assert got[7].labels == "apache,apache-2.0-notice" and got[7].first_word == 40003
    assert got[None].labels == "apache" and got[8].labels == "" and (got[9].n_base, got[9].first_word) == (1, 3)
    assert got[10].labels == "mit-permission" and got[11].labels == ""
    assert li.license_scan(docs.limit(0)).collect() == [] and li.license_scan(docs).count() == len(rows)


MIT = """The MIT License (MIT)\n\nCopyright (c) 2024 Some One\n
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:\n
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n"""
HEADER = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#     {scheme}://www.apache.org/licenses/LICENSE-2.0
# Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
# "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
# language governing permissions and limitations under the License."""


def example(markup, optional, word="holder"):
    """A text of a template: optional regions in or out, wildcards filled."""
    depth, out = 0, []
    for k, p in enumerate(re.split(r"<<(.*?)>>", markup, flags=re.S)):
        if k % 2 == 0:
            out += [p] if optional or not depth else []
        elif p.startswith("var;"):
            match = re.search(r'match="([^"]*)"', p)
            fill = word if not match else "3" if "0-9" in match[1] else match[1].split("|")[0].replace("?", "")
            out += [f" {fill} "] if optional or not depth else []
        else:
            depth += 1 if p == "beginOptional" else -1
    return "".join(out)


def found(text):
    return {label for label, markup in li.LICENSES.items() if li.Template(markup).spans(li.words_of(text.encode()))}


def test_whole_license_texts():
    assert found(MIT) == {"mit-text"}
    assert found(HEADER.format(scheme="http")) == found(HEADER.format(scheme="https")) == {"apache-2.0-header"}
    assert not found(MIT.replace("sublicense, ", "")) and not found(MIT.replace("ANY CLAIM", "A CLAIM"))
    assert not found(HEADER.format(scheme="ftp")) and not found(MIT[:600])


@pytest.mark.parametrize("label", li.LICENSES)
def test_each_license_is_told_from_the_others(label):
    for optional in (True, False):
        text = example(li.LICENSES[label], optional)
        assert found(f"Before it. {text} After it.") == {label}
        words = text.split()
        for k in range(0, len(words), 17):  # a changed mandatory word is no match
            if words[k].lower() not in ("holder", "1.", "2.", "3."):
                broken = " ".join([*words[:k], "otherwords", *words[k + 1:]])
                assert label not in found(broken) or re.search("holder|[0-9]", words[k] + words[max(0, k - 1)])


def test_pattern_of_the_sql_says_the_same():
    from sentrymill.llm.oracle import template_pattern

    texts = [MIT, MIT.replace("sublicense, ", ""), HEADER.format(scheme="https")]
    texts += [example(m, o) for m in li.LICENSES.values() for o in (True, False)]
    for text in texts:
        line = " " + " ".join(w.decode() for w in li.words_of(text.encode())) + " "
        assert {label for label, m in li.LICENSES.items() if re.search(" " + template_pattern(m), line)} == found(text)
