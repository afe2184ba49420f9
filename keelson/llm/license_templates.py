"""License scans by template matching.

A template is wording with markup: what stands between <<optional>> and <<end>> may be
left out, also within another such region, and a replaceable region is <<words a-b>> (any a to b words) or <<one of x|y>> (one
of these words). Templates compile to automata over words; a text is accepted where some stretch
of its words leads an automaton from start to end, so all mandatory wording
stands there exactly. The longest run of mandatory words is looked up first, and the automaton
runs only from the places that can reach it.

Words are maximal runs of digits, letters a-z and anything beyond ASCII, after A-Z are lower-cased.

Defined results: a null text counts as empty: no words, no labels, null first_word and
last_word; null ids and repeated rows are rows of their own; a text of any length is scanned whole; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, in_slices

# Phrases of the base scan, and templates of the method: grants and opening sentences first, then whole notices and licences.
PHRASES = {b"cc by": "cc-by", b"general public license": "gpl", b"all rights reserved": "reserved"}
TEMPLATES = {
    "apache-2.0": "licensed under the <<optional>> terms of the <<end>> apache license <<optional>> version <<end>> 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "licensed under <<optional>> a <<end>> cc by 4 0",
    "cc-by-nc-4.0": "licensed under <<optional>> a <<end>> cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under <<optional>> a <<end>> cc by sa 4 0",
    "copyright-notice": "copyright <<optional>> c <<end>> <<words 1-8>> all rights reserved",
    "gpl-3.0": "<<one of licensed|released|distributed>> under the <<optional>> terms of the <<end>> gnu general public license <<optional>> as published by the free software foundation either <<end>> version 3",
    "mit": "<<one of licensed|released|distributed>> under the <<optional>> terms of the <<end>> mit license",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this <<words 1-2>> and associated documentation files",
}
TEMPLATES |= {
    "bsd-2-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>> 1 <<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<optional>> and <<end>> <<optional>> 2 <<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by <<words 1-12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<words 1-12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-3-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>> 1 <<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<optional>> and <<end>> <<optional>> 2 <<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<optional>> 3 <<end>> neither the name of <<words 1-12>> nor the names of <<one of its|the>> contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by <<words 1-12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<words 1-12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "gpl-3.0-notice": "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license <<optional>> or at your option any later version <<end>> <<words 1-8>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "gpl-3.0-title": "gnu general public license version 3 29 june 2007",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this <<words 1-2>> and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<words 1-12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
}
TEMPLATES |= {
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<optional>> <<one of http|https>> <<optional>> www <<end>> apache org licenses license 2 0 <<end>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<words 1-8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<words 1-8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "mit-file": "mit license <<optional>> mit <<end>> copyright <<optional>> c <<end>> <<words 1-8>> <<optional>> all rights reserved <<end>> " + TEMPLATES["mit-text"],
    "bsd-3-file": "copyright <<optional>> c <<end>> <<words 1-8>> <<optional>> all rights reserved <<end>> " + TEMPLATES["bsd-3-clause"],
}
# End of fixed values.

_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_MARKUP = re.compile(r"<<(.*?)>>|(\S+)")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


@dataclass
class Automaton:
    """States 0..end; step[state] lists (words that lead on or None for any, next state); skip[state] are states reached for free."""

    step: list[list[tuple[frozenset[bytes] | None, int]]]
    skip: list[list[int]]
    anchor: bytes
    before: tuple[int, int]  # fewest and most words ahead of the anchor

    @classmethod
    def compile(cls, template: str) -> Automaton:
        step: list = [[]]
        skip: list = [[]]
        opened: list[int] = []
        least = most = 0
        runs: list[tuple[list[bytes], int, int]] = []

        def add(words: frozenset[bytes] | None) -> None:
            step[-1].append((words, len(step)))
            step.append([])
            skip.append([])

        fresh = True  # whether the next mandatory word starts a new run
        for mark, word in _MARKUP.findall(template):
            if word:
                word = word.encode()
                if not opened:
                    if fresh:
                        runs.append(([], least, most))
                    runs[-1][0].append(word)
                    least, fresh = least + 1, False
                most += 1
                add(frozenset([word]))
                continue
            fresh = True
            if mark == "optional":
                opened.append(len(step) - 1)
            elif mark == "end":
                skip[opened.pop()].append(len(step) - 1)
            elif mark.startswith("one of "):
                add(frozenset(x.encode() for x in mark[7:].split("|")))
                least, most = least + (not opened), most + 1
            else:
                low, high = map(int, mark.removeprefix("words ").split("-"))
                for k in range(high):
                    if k >= low:
                        opened.append(len(step) - 1)
                    add(None)
                for _ in range(high - low):
                    skip[opened.pop()].append(len(step) - 1)
                least, most = least + low * (not opened), most + high
        run, *before = max(runs, key=lambda r: len(r[0]))
        return cls(step, skip, b" ".join(run), tuple(before))

    def _free(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accepts_from(self, words: list[bytes], i: int) -> bool:
        """Whether some stretch that begins at word i leads to the end."""
        end, states = len(self.step) - 1, self._free({0})
        while states and end not in states and i < len(words):
            states = self._free({to for s in states for ok, to in self.step[s] if ok is None or words[i] in ok})
            i += 1
        return end in states

    def found(self, words: list[bytes], spaced: bytes) -> bool:
        """Whether the automaton accepts anywhere; spaced: the words with one space around each."""
        tried = 0
        for at in places(spaced, self.anchor):
            for i in range(max(at - self.before[1], tried), at - self.before[0] + 1):
                if self.accepts_from(words, i):
                    return True
            tried = max(tried, at - self.before[0] + 1)
        return False


def places(spaced: bytes, phrase: bytes):
    """Word indexes where a phrase stands; the spaced text has one space around each word."""
    sought, at, index, counted = b" " + phrase + b" ", 0, 0, 0
    while (at := spaced.find(sought, at)) >= 0:
        index += spaced.count(b" ", counted, at)
        counted = at
        yield index
        at += 1


def scan(text: bytes, templates: dict[str, Automaton]) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, all labels and score of one text."""
    words = words_of(text)
    spaced = b" " + b" ".join(words) + b" "
    at, base = [], set()
    for phrase, label in PHRASES.items():
        if here := list(places(spaced, phrase)):
            at += here
            base.add(label)
    found = {name for name, a in templates.items() if a.found(words, spaced)}
    score = 1.0 if found else 0.5 if base else 0.0
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), score


def label(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What `scan` finds in every document. score: 1 if a template is accepted, 1/2 if only a base phrase stands there, else 0."""
    markup = TEMPLATES if templates is None else templates

    def rows(batches):
        compiled = {k: Automaton.compile(v) for k, v in markup.items()}
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        for b in in_slices(batches, "t"):
            found = [scan(t, compiled) for t in as_bytes(b.column("t"))]
            cols = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(
        rows, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
