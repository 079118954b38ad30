"""License scans by template markup, compiled to token automata.

A template is words with two kinds of regions: `[[ ... ]]` may be left out, `{{name a-b}}` stands for
any a to b words, such as a holder's name. It compiles to a non-deterministic automaton over words
(case, punctuation and layout don't count). A text is accepted where the automaton reaches its end:
every mandatory word is there, in order, with nothing but the marked regions between; so a license
with a clause of its own is not that license, and gets the label of an opening at most. A template
must begin with a mandatory word. Its automaton runs only at places where all of its first words up to
the first marked region stand, in texts that hold each of its mandatory words, the rare ones too: both are
found for a whole batch at once.

Base phrases are plain runs of words, counted at every place.

score: 1 - 2 ** (-m / 2) for the m mandatory words of the longest phrase or template accepted, else 0.

Defined results: null and empty texts have no places. Rows are scanned one by one, so repeated rows
and ties don't matter. A very long text is scanned whole, at some 40 bytes of memory a byte. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textbytes import ALNUM, Batch, slices

#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_WARRANTY = "including but not limited to the [[ implied ]] warranties of merchantability [[ and ]] fitness for a particular purpose"
#: Fixed values: (label, template). Whole texts of short public licenses, the usual notices of long ones, and openings, which say no more than that a text begins like a license.
TEMPLATES = [
    ("agpl-3", "licensed under the gnu affero general public license [[ version ]] 3 [[ 0 ]]"),
    ("apache-2", "licensed under the apache license [[ version ]] 2 [[ 0 ]]"),
    ("apache-2", "you may obtain a copy of the license at [[ http ]] [[ https ]] [[ www ]] apache org licenses license 2 0"),
    ("bsd", "licensed under the [[ {{clauses 1-2}} clause ]] bsd license"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "[[ 1 ]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "[[ 2 ]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "[[ [[ 3 ]] neither the name of {{holder 1-12}} nor the names of {{its 1-3}} contributors may be used to endorse or promote products derived from this software without specific prior written permission ]] "
        f"this software is provided by {{{{holder 1-12}}}} as is and any express or implied warranties {_WARRANTY} are disclaimed in no event shall {{{{holder 1-12}}}} be liable for any direct indirect incidental special exemplary or consequential damages "
        "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
        "arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    ("bsd-opening", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under [[ a ]] [[ the ]] [[ creative commons ]] cc by nc [[ {{version 1-2}} ]]"),
    ("cc-by-sa", "licensed under [[ a ]] [[ the ]] [[ creative commons ]] cc by sa"),
    ("gpl-2", "licensed under the gnu general public license [[ version ]] 2 [[ 0 ]]"),
    ("gpl-3", "licensed under the gnu general public license [[ version ]] 3 [[ 0 ]]"),
    (
        "isc",
        "permission to use copy modify and [[ or ]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and {{holder 1-6}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{holder 1-6}} be liable for any special direct indirect or consequential damages "
        "or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    ("lgpl", "licensed under the gnu lesser general public license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this {{work 1-4}} and associated documentation files [[ the {{work 1-3}} ]] to deal in the {{work 1-3}} without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the {{work 1-3}} and to permit persons to whom the {{work 1-3}} is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice [[ including the next paragraph ]] shall be included in all copies or substantial portions of the {{work 1-3}} the {{work 1-3}} is provided as is without warranty of any kind express or implied "
        f"{_WARRANTY} and noninfringement in no event shall the {{{{holder 1-8}}}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the {{{{work 1-3}}}} or the use or other dealings in the {{{{work 1-3}}}}",
    ),
    ("mit-opening", "permission is hereby granted free of charge to any person obtaining a copy of this {{work 1-4}} and associated documentation files [[ the {{work 1-3}} ]] to deal in"),
    ("mpl-2", "subject to the terms of the mozilla public license [[ v ]] [[ version ]] 2 0"),
    ("spdx", "spdx license identifier {{id 1-3}}"),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means "
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors "
        "we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",
    ),
]


class Word(NamedTuple):
    text: str


class Gap(NamedTuple):
    least: int
    most: int


class Optional(NamedTuple):
    parts: list


def parse(template: str) -> list:
    """The template's parts; raises ValueError where its markup is wrong."""
    stack: list[list] = [[]]
    for token in re.findall(r"\[\[|\]\]|\{\{.*?\}\}|[^\s\[\]{}]+|\S", template):
        if token == "[[":
            stack.append([])
        elif token == "]]":
            if len(stack) == 1:
                raise ValueError("an optional region ends that has not begun")
            parts = stack.pop()
            stack[-1].append(Optional(parts))
        elif token.startswith("{{"):
            m = re.fullmatch(r"\{\{\s*\w+\s+(\d+)-(\d+)\s*\}\}", token)
            if not m or int(m[1]) > int(m[2]):
                raise ValueError(f"a replaceable region needs a name and least-most words: {token}")
            stack[-1].append(Gap(int(m[1]), int(m[2])))
        else:
            words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", token.lower())
            if not words:
                raise ValueError(f"not a word: {token}")
            stack[-1] += map(Word, words)
    if len(stack) > 1:
        raise ValueError("an optional region has no end")
    if not stack[0] or not isinstance(stack[0][0], Word):
        raise ValueError("a template must begin with a mandatory word")
    return stack[0]


class Automaton:
    """States 0 .. end; steps[s]: [(word or None for any, next state)]; skips[s]: states reached without a word."""

    def __init__(self, label: str, template: str):
        self.label, self.parts = label, parse(template)
        self.steps: list[list[tuple[str | None, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        self.end = self._build(self.parts, 0)
        self.mandatory = sum(isinstance(x, Word) for x in self.parts)
        self.required = {x.text for x in self.parts if isinstance(x, Word)}
        self.lead = [x.text for x in self.parts[: next((i for i, x in enumerate(self.parts) if not isinstance(x, Word)), len(self.parts))]]

    def _state(self) -> int:
        self.steps.append([])
        self.skips.append([])
        return len(self.steps) - 1

    def _build(self, parts: list, at: int) -> int:
        for part in parts:
            if isinstance(part, Word):
                to = self._state()
                self.steps[at].append((part.text, to))
                at = to
            elif isinstance(part, Optional):
                to = self._build(part.parts, at)
                self.skips[at].append(to)
                at = to
            else:
                chain = [at]
                for _ in range(part.most):
                    chain.append(self._state())
                    self.steps[chain[-2]].append((None, chain[-1]))
                for s in chain[part.least : -1]:
                    self.skips[s].append(chain[-1])
                at = chain[-1]
        return at

    def words(self) -> set[str]:
        return {w for s in self.steps for w, _ in s if w is not None}

    def closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accepts_from(self, words, at: int, stop: int) -> int | None:
        """Where the shortest accepted run of words from `at` ends, or None."""
        states = self.closed({0})
        while states:
            if self.end in states:
                return at
            if at == stop:
                return None
            word = words[at]
            states = self.closed({to for s in states for w, to in self.steps[s] if w is None or w == word})
            at += 1
        return None


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, base: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score; spans: (label, word from, to) of every template accepted."""
    base = BASE if base is None else base
    automata = [Automaton(*t) for t in (TEMPLATES if templates is None else templates)]
    phrases = [(k.split(), v) for k, v in base.items()]
    vocabulary = sorted({w for p, _ in phrases for w in p}.union(*[a.words() for a in automata]))
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def find(batches):
        own = Batch(pa.array(vocabulary, pa.string()), ALNUM, lower=True).hashes()
        order = np.argsort(own)
        codes = {w: i for i, w in enumerate(vocabulary)}
        for batch in batches:
            for a, z in slices(batch.column(1)):
                b = Batch(batch.column(1).slice(a, z - a), ALNUM, lower=True)
                h, n = b.hashes(), z - a
                at = np.searchsorted(own[order], h)
                at[at == len(own)] = 0
                code = np.where(own[order][at] == h, order[at], -1)
                places, base_of, labels_of, best, spans = [[] for _ in range(n)], [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n), [[] for _ in range(n)]
                for words, label in phrases:
                    found = np.flatnonzero(code == codes[words[0]])
                    for i, w in enumerate(words[1:], 1):
                        found = found[found + i < len(code)]
                        found = found[code[found + i] == codes[w]]
                    for p in found[b.doc[found] == b.doc[found + len(words) - 1]] if len(found) else []:
                        d = b.doc[p]
                        places[d].append(int(p - b.first[d]))
                        base_of[d].add(label)
                        best[d] = max(best[d], len(words))
                held = np.unique(b.doc[code >= 0] * len(codes) + code[code >= 0])
                held_doc, held_word = held // len(codes), held % len(codes)
                for automaton in automata:
                    need = np.zeros(len(codes), bool)
                    need[[codes[w] for w in automaton.required]] = True
                    whole = np.bincount(held_doc[need[held_word]], minlength=n) == need.sum()
                    found = np.flatnonzero(code == codes[automaton.lead[0]])
                    found = found[whole[b.doc[found]]]
                    for i, w in enumerate(automaton.lead[1:], 1):
                        found = found[found + i < len(code)]
                        found = found[code[found + i] == codes[w]]
                    for p in found:
                        d = b.doc[p]
                        stop = int(b.first[d + 1])
                        run = [vocabulary[c] if c >= 0 else "" for c in code[p : min(stop, p + len(automaton.steps))]]
                        end = automaton.accepts_from(run, 0, len(run))
                        if end is not None:
                            labels_of[d].add(automaton.label)
                            best[d] = max(best[d], automaton.mandatory)
                            spans[d].append({"label": automaton.label, "start": int(p - b.first[d]), "stop": int(p - b.first[d]) + end})
                columns = [
                    batch.column(0).slice(a, n), pa.array(b.counts, pa.int64()), pa.array([len(x) for x in places], pa.int64()),
                    pa.array([min(x, default=None) for x in places], pa.int64()), pa.array([max(x, default=None) for x in places], pa.int64()),
                    pa.array([",".join(sorted(x)) for x in base_of]), pa.array([",".join(sorted(x | y)) for x, y in zip(base_of, labels_of)]),
                    pa.array(np.where(best > 0, 1 - 2 ** (-best / 2), 0.0)), pa.array(spans, span),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(find, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, stop: long>>").withColumnRenamed("id", id_col)


def as_regex(template: str) -> str:
    """The template as a regular expression over words that are each followed by a space."""

    def render(parts: list) -> str:
        return "".join(f"{x.text} " if isinstance(x, Word) else f"(?:{render(x.parts)})?" if isinstance(x, Optional) else f"(?:[^ ]+ ){{{x.least},{x.most}}}" for x in parts)

    return " " + render(parse(template))
