"""License scans: base places against plain loops, automata against regular expressions."""

import re

import pytest

from noticeworks.llm import licenses
from noticeworks.llm.queries import QUERIES

DIR = "/root/testdata/sf0.01"


def slow_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for i in range(len(words)) for p, label in licenses.PHRASES if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_op5_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op5_licenses"](spark, DIR).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == {d: slow_base(t) for d, t in docs.items()}
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert sum("cc-notice" in r.labels for r in got) == sum("Licensed under CC BY-NC" in t for t in docs.values()) > 2


@pytest.mark.parametrize("markup,pattern", [
    ("a [b] c", r"a (b )?c "), ("{a|b c} d", r"(a|b c) d "), ("a <1-3> b", r"a (\w+ ){1,3}b "), ("[a [b]] c d", r"(a (b )?)?c d "),
    ("a", r"a "), ("a {b|c [d]} <0-2>", r"a (b|c( d)?) (\w+ ){0,2}"), ("[x] {a|b}", r"(x )?(a|b) "),
])
def test_automata_accept_what_expressions_accept(markup, pattern):
    import random

    rng = random.Random(markup)
    automaton = licenses.compile_template("t", markup)
    openings = automaton.openings()
    for _ in range(400):
        words = rng.choices("abcdx", k=rng.randrange(1, 7))
        ends = [n for n in range(len(words) + 1) if n and re.fullmatch(pattern, " ".join(words[:n]) + " ")]
        assert automaton.longest([w.encode() for w in words], 0) == max(ends, default=0)
        if ends:
            first, second = words[0].encode(), words[1].encode() if len(words) > 1 else None
            assert (first, second) in openings or (first, None) in openings


def test_odd_texts(spark):
    docs = [
        (1, None), (2, ""), (3, "?!"), (4, "MIT\tLicense, mit license"), (5, "Released under the terms of the MIT License."), (5, "mit licenses"),
        (None, "Licensed under the Apache License, Version 2.0"), (7, "pad " * 100_000 + "GNU General Public License"), (8, "MIT"), (9, "Licensed under the"),
        (10, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."),
        (11, "This program is not free software: you can redistribute it"),
    ]
    rows = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, labels string, Score int")
    out = licenses.scan_licenses(rows)
    assert out.columns[:2] == ["doc_id", "text"] and len(out.columns) == 9
    got = {(r.doc_id, r.text[:5] if r.text else r.text): r for r in out.collect()}
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels) for k, r in got.items() if k[0] == 4] == [(2, 0, 2, "mit")]
    by_id = {k[0]: r for k, r in got.items() if k[0] not in (5,)}
    assert by_id[1].labels == by_id[2].labels == by_id[3].labels == by_id[8].labels == by_id[9].labels == by_id[11].labels == ""
    assert by_id[None].labels == "apache,apache-2.0-notice" and by_id[7].labels == "gpl" and by_id[7].last_word == 100_001
    assert by_id[10].labels == "gpl,gpl-header"
    assert got[(5, "Relea")].labels == "mit,mit-notice" and got[(5, "mit l")].labels == ""
    assert {r.label: r.n_docs for r in licenses.found_labels(out).collect()}["mit"] == 2
    assert licenses.scan_licenses(rows.limit(0)).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{extra}THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE {holder} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
{extra}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
NO_ENDORSEMENT = "3. Neither the name of the Example Project nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
ADVERTISING = "3. All advertising materials mentioning features or use of this software must display an acknowledgement.\n"


def test_whole_wordings_and_altered_ones(spark):
    mit = MIT.format(extra="", holder="AUTHORS OR COPYRIGHT HOLDERS")
    bsd2, bsd3 = BSD.format(extra=""), BSD.format(extra=NO_ENDORSEMENT)
    texts = {
        "mit": (mit, "mit-text"), "holder": (MIT.format(extra="", holder="X CONSORTIUM"), "mit-text"), "bsd2": (bsd2, "bsd-text"), "bsd3": (f"Some words. {bsd3}", "bsd-text"),
        "json": (MIT.format(extra="The Software shall be used for Good, not Evil.\n", holder="AUTHORS OR COPYRIGHT HOLDERS"), ""),
        "bsd4": (BSD.format(extra=ADVERTISING + NO_ENDORSEMENT.replace("3.", "4.")), ""), "no warranty": (mit.split("THE SOFTWARE IS PROVIDED")[0], ""),
        "altered": (mit.replace("sublicense, and/or sell", "and sublicense"), ""), "liable": (bsd2.replace("EVEN IF ADVISED", "UNLESS ADVISED"), ""),
    }
    rows = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id string, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(rows).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: want for k, (_, want) in texts.items()}
    assert all((score > 0.5) == bool(label) for label, score in got.values())
