"""License scans by matching template markup over words.

A template is words with regions: ``[...]`` may be left out, ``{a|b|c}`` stands for one of several wordings, ``<min-max>`` for so
many words of any kind. It is compiled into an automaton over words; a text is accepted where the mandatory words follow one another exactly.

Documents are read once, in chunks. Hashes of word pairs find where a template or a phrase may begin, so only these places are run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.llm import textbytes as tb

# Phrases and labels of the contract.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Wording of well-known license texts, whole, and of notices and file headers that name a license.
TEMPLATES = (
    ("mit-notice", "{released|licensed|distributed|available|provided} under [the terms of] [the] mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the <1-12> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc-text", "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <1-12> {disclaims|disclaim} all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <1-12> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("apache-2.0-notice", "{released|licensed|distributed|available} under [the terms of] the apache license [version {2 0|2}]"),
    ("apache-2.0-header", "you may not use this file except in compliance with the license you may obtain a copy of the license at [http www apache org licenses license 2 0] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl-notice", "{released|licensed|distributed} under [the terms of] the gnu [{lesser|library|affero}] general public license [version {1|2|2 1|3}] [or any later version]"),
    ("gpl-header", "this {program|library|file|software} is free software you can redistribute it and or modify it under the terms of the gnu [{lesser|library|affero}] general public license as published by the free software foundation either version <1-2> of the license or at your option any later version"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[3] neither the name of <1-12> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission] this software is provided by <1-16> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <1-16> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-notice", "{released|licensed|distributed|available} under [a] [the] {cc by|cc by sa|cc by nc|cc by nd|cc by nc sa|cc by nc nd|creative commons attribution} [{1 0|2 0|2 5|3 0|4 0}]"),
    ("unlicense-opening", "this is free and unencumbered software released into the public domain"),
)


@dataclass(frozen=True)
class Automaton:
    """States with word edges, free edges (any word), and empty edges; the last state accepts."""

    label: str
    words: tuple[dict[bytes, tuple[int, ...]], ...]
    free: tuple[tuple[int, ...], ...]
    empty: tuple[tuple[int, ...], ...]
    mandatory: int

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def longest(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted run of words from ``at``; ``at`` if none."""
        states, best, last = self.closure({0}), at, len(self.words) - 1
        for i in range(at, len(words)):
            states = self.closure({t for s in states for t in (*self.words[s].get(words[i], ()), *self.free[s])})
            if not states:
                break
            if last in states:
                best = i + 1
        return best

    def openings(self) -> set[tuple[bytes, bytes | None]]:
        """First two words of accepted runs; None where the second is free."""
        out = set()
        for s in self.closure({0}):
            for w, after in self.words[s].items():
                for t in self.closure(set(after)):
                    out |= {(w, v) for v in self.words[t]} | ({(w, None)} if self.free[t] or t == len(self.words) - 1 else set())
        return out


def compile_template(label: str, markup: str) -> Automaton:
    """Automaton of a template. It begins with a word or an optional or alternative region."""
    words: list[dict[bytes, set[int]]] = [{}]
    free: list[set[int]] = [set()]
    empty: list[set[int]] = [set()]
    tokens = re.findall(r"[][{}|]|<\d+-\d+>|[^][{}|<>\s]+", markup)
    mandatory = 0

    def state() -> int:
        words.append({})
        free.append(set())
        empty.append(set())
        return len(words) - 1

    def sequence(i: int, at: int, closing: str, depth: int) -> tuple[int, int]:
        """Compiles up to a closing token; returns its place and the last state."""
        nonlocal mandatory
        while i < len(tokens) and tokens[i] not in closing:
            token = tokens[i]
            if token == "[":
                i, end = sequence(i + 1, at, "]", depth + 1)
                after = state()
                empty[end].add(after)
                empty[at].add(after)
                at = after
            elif token == "{":
                after = state()
                while tokens[i] != "}":
                    branch = state()
                    empty[at].add(branch)
                    i, end = sequence(i + 1, branch, "|}", depth + 1)
                    empty[end].add(after)
                at = after
                mandatory += not depth
            elif token[0] == "<":
                least, most = map(int, token[1:-1].split("-"))
                after = state()
                for k in range(most):
                    if k >= least:
                        empty[at].add(after)
                    step = state()
                    free[at].add(step)
                    at = step
                empty[at].add(after)
                at = after
            else:
                step = state()
                words[at].setdefault(token.encode(), set()).add(step)
                at = step
                mandatory += not depth
            i += 1
        return i, at

    _, end = sequence(0, 0, "", 0)
    empty[end].add(state())
    return Automaton(label, tuple({w: tuple(t) for w, t in x.items()} for x in words), tuple(map(tuple, free)), tuple(map(tuple, empty)), mandatory)


@lru_cache(maxsize=4)
def _compiled(templates: tuple, phrases: tuple):
    automata = [compile_template(*t) for t in templates]
    opened: dict[bytes, dict[bytes | None, list[Automaton]]] = {}
    for a in automata:
        for first, second in a.openings():
            opened.setdefault(first, {}).setdefault(second, []).append(a)
    for p, label in phrases:
        opened.setdefault(p.split()[0].encode(), {})
    firsts = np.array(sorted(tb.word_hash(w) for w in opened), dtype=np.uint64)
    return opened, firsts, [(p.encode().split(), label) for p, label in phrases]


def _found(words: list[bytes], starts: list[int], opened: dict, phrases: list) -> tuple[list[tuple[int, int, str]], list[tuple[str, int]]]:
    """(first word, words, label) of the phrases; (label, mandatory words) of the templates."""
    places, accepted = [], []
    for at in starts:
        for p, label in phrases:
            if words[at : at + len(p)] == p:
                places.append((at, len(p), label))
        after = opened.get(words[at], {})
        second = words[at + 1] if at + 1 < len(words) else None
        for a in [*after.get(second, ()), *(after.get(None, ()) if second is not None else ())]:
            if a.longest(words, at) > at:
                accepted.append((a.label, a.mandatory))
    return places, accepted


def _scan(text_col: str, templates: tuple, phrases: tuple, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, firsts, base = _compiled(templates, phrases)
        for batch in batches:
            for a, b, data, starts in tb.chunks(batch.column(text_col)):
                words = tb.Words(data, starts)
                n = b - a
                out = {"n_words": words.counts.tolist(), "n_base": [0] * n, "first_word": [None] * n, "last_word": [None] * n, "base_labels": [""] * n, "labels": [""] * n, "score": [0.0] * n}
                may = np.flatnonzero(np.isin(words.hashes(), firsts))
                of = words.text_of(may)
                for t in np.unique(of).tolist():
                    lo, hi = int(words.bounds[t]), int(words.bounds[t + 1])
                    found = [words.data[s:e].tobytes() for s, e in zip(words.begin[lo:hi].tolist(), words.end[lo:hi].tolist(), strict=True)]
                    places, accepted = _found(found, (may[of == t] - lo).tolist(), opened, base)
                    labels = {x[2] for x in places}
                    out["base_labels"][t] = ",".join(sorted(labels))
                    out["labels"][t] = ",".join(sorted(labels | {x[0] for x in accepted}))
                    best = max([x[1] for x in places] + [x[1] for x in accepted], default=0)
                    out["score"][t] = best / (best + 4) if best else 0.0
                    if places:
                        out["n_base"][t], out["first_word"][t], out["last_word"][t] = len(places), min(places)[0], max(places)[0]
                part = batch.slice(a, n)
                kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
                yield pa.RecordBatch.from_arrays([pa.array(out[c], kinds.get(c, pa.int64())) if c in out else part.column(c) for c in names], names=names)

    return run


ADDED = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, *, text_col: str = "text", templates: tuple = TEMPLATES, phrases: tuple = PHRASES, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (without the text if not ``keep_text``) and n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is m / (m + 4) for the longest match of m mandatory words. Null and empty texts have no words, no labels ("") and score 0, with null
    first and last word. Texts of any length are read whole; repeated rows are judged alike; no rows give none. Columns of ``docs`` named like an added one are replaced.
    """
    added = [x.split()[0] for x in ADDED.split(", ")]
    rows = docs.drop(*[c for c in docs.columns if c.lower() in added and c != text_col])
    kept = [f for f in rows.schema.fields if keep_text or f.name != text_col]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), ADDED])
    return rows.mapInArrow(_scan(text_col, templates, phrases, [*(f.name for f in kept), *added]), schema)


def found_labels(scanned: DataFrame) -> DataFrame:
    """How many documents carry each label."""
    return scanned.filter("labels <> ''").select(F.explode(F.split("labels", ",")).alias("label")).groupBy("label").agg(F.count("*").alias("n_docs"))
