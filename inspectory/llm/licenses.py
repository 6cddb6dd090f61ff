"""License scan: template-markup matching.

Templates are mandatory words with markup: ``[[ ... ]]`` is optional and ``<<n>>`` stands for up to n words of any kind
(names, years, owners). Each compiles to an automaton over words, which is run from every place where the template's
first words stand; it accepts only if all mandatory wording matches exactly. Fixed phrases are counted beside it and
their labels always stay.

A null or empty text has no words, no labels and score 0; an empty table gives no rows. Very long texts are read whole.
Repeated rows are treated alike; of several templates or places all count, and labels are sorted, so ties do not matter.
Further columns of any name are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, arrow_map, utf8

#: ASCII letters and digits and all bytes beyond ASCII are words' own; A-Z are lower-cased; the rest parts words.
TO_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)

# Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
CC_END = "[[international]] [[unported]] [[generic]] [[public]] license"

# A statement ("licensed under ...") names its licence to the end, so no other one's name goes on from it; a text stands in full.
TEMPLATES = {
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions [[1]] the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software [[2]] the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "[[released]] [[licensed]] [[distributed]] under the [[terms of the]] mit license"],
    "isc": ["permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "bsd-2-clause": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] [[a]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] [[b]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by <<10>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<10>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"],
    "apache-2": ["licensed under the apache license version 2 [[0]] [[the license]]"],
    "gpl-3": ["this program is free software [[you can]] redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation [[either]] version 3 of the license", *(f"[[licensed]] under the [[terms of the]] gnu general public license {v}" for v in ("version 3", "v3"))],
    "cc-by": [f"licensed under [[the]] [[a]] creative commons attribution {v} {CC_END}" for v in ("", *CC_VERSIONS)],
    "cc-by-nc": [*(f"licensed under [[the]] [[a]] cc by nc {v}" for v in ("license", *CC_VERSIONS)), *(f"creative commons attribution {nc} {v} {CC_END}" for nc in ("noncommercial", "non commercial") for v in ("", *CC_VERSIONS))],
    "all-rights-reserved": ["[[copyright [[c]] <<6>>]] all rights reserved"],
}

Node = tuple[str, object]


def parse(markup: str) -> list[Node]:
    """Markup as nested nodes: ('word', w), ('any', most) and ('maybe', nodes)."""
    stack: list[list[Node]] = [[]]
    for part in re.findall(r"\[\[|\]\]|<<\d+>>|[^\s\[\]<>]+", markup):
        if part == "[[":
            stack.append([])
        elif part == "]]":
            inner = stack.pop()
            stack[-1].append(("maybe", inner))
        elif part[0] == "<":
            stack[-1].append(("any", int(part[2:-2])))
        else:
            stack[-1].append(("word", part.encode()))
    if len(stack) != 1:
        raise ValueError("brackets do not pair up")
    return stack[0]


class Automaton:
    """States with a word (None: any) to the next one, and free moves."""

    def __init__(self, markup: str) -> None:
        self.on: list[tuple[bytes | None, int] | None] = [None]
        self.free: list[list[int]] = [[]]
        nodes = parse(markup)
        self.end = self._build(nodes, 0)
        while nodes and nodes[0][0] == "maybe":  # leading options cannot start a match: it is found without them
            nodes = nodes[1:]
        self.key = b" ".join(w for _, w in _leading(nodes))

    def _state(self) -> int:
        self.on.append(None)
        self.free.append([])
        return len(self.on) - 1

    def _build(self, nodes: list[Node], at: int) -> int:
        for kind, what in nodes:
            if kind == "word":
                self.on[at] = (what, nxt := self._state())
                at = nxt
            elif kind == "maybe":
                self.free[at].append(inner := self._state())
                out = self._build(what, inner)
                end = self._state()
                self.free[out].append(end)
                self.free[at].append(end)
                at = end
            else:
                end_of = [at]
                for _ in range(what):
                    self.free[at].append(step := self._state())
                    self.on[step] = (None, nxt := self._state())
                    at = nxt
                    end_of.append(at)
                end = self._state()
                for x in end_of:
                    self.free[x].append(end)
                at = end
        return at

    def _closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    def accepts(self, words: list[bytes], at: int) -> bool:
        """True if some run of words that starts here matches."""
        states = self._closed({0})
        while True:
            if self.end in states:
                return True
            if at >= len(words) or not states:
                return False
            states = self._closed({to for s in states if (e := self.on[s]) and e[0] in (None, words[at]) for to in (e[1],)})
            at += 1


def _leading(nodes: list[Node]) -> list[Node]:
    out = []
    for n in nodes[:3]:
        if n[0] != "word":
            break
        out.append(n)
    return out


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase's words stand; ``joined`` has a space before and after each word."""
    out, at, key, done, seen = [], -1, b" " + phrase + b" ", 0, 0
    while (at := joined.find(key, at + 1)) >= 0:
        seen += joined.count(b" ", done, at)
        done = at
        out.append(seen)
    return out


def scan_text(text: bytes, automata: dict[str, list[Automaton]]) -> tuple:
    words = text.translate(TO_WORDS).split()
    joined = b" " + b" ".join(words) + b" "
    found = {label: places(joined, phrase.encode()) for phrase, label in BASE.items()}
    at = [x for xs in found.values() for x in xs]
    base = sorted(label for label, xs in found.items() if xs)
    own = sorted(label for label, each in automata.items() if any(a.accepts(words, p) for a in each for p in places(joined, a.key)))
    score = 1.0 if own else 0.5 if base else 0.0
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *own})), score


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: word count, base phrases' places, labels, and score (1: a template matched whole; 0.5: only a phrase)."""
    kind, names = dict(docs.dtypes)[id_col], ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

    def make():
        automata = {label: [Automaton(m) for m in each] for label, each in templates.items()}

        def each(batch):
            rows = [scan_text(t or b"", automata) for t in utf8(batch.column(1))]
            yield {"doc_id": batch.column(0)} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

        return each

    return arrow_map(docs.select(F.col(id_col), F.col(text_col)), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", make)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
