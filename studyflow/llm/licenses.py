"""License scans: phrases, and license templates compiled into token automata.

A template is written in a small markup: ``[[...]]`` holds optional wording and may be nested, ``<<a-b:regex>>`` a
replaceable region of a to b words that each match the regex, everything else is mandatory wording.  It compiles into
an automaton over words whose states are held as sets (epsilon moves skip optional regions).  A text carries the
template's label where the automaton accepts: all the mandatory wording stands there exactly, in order, with only
optional or replaceable words between.

Automata run only where they can succeed.  The rarest-looking mandatory word of each template is its anchor: texts
without the anchor are passed over with one vectorised lookup, and in others the automaton starts within the fixed
distance before the anchor that the template allows.

Words: A-Z lowered, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, of the whole text.  Defined results: null and
empty texts have no words and no labels; repeated rows get equal results; an empty table has an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import lists, map_text, text_bytes
from .tokens import ALNUM_LOWER, Words, split_words

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Base phrases and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates by label (fixed values): short notices of well-known public licenses, and the whole wording of some.
TEMPLATES = {
    "apache-2.0": "[[this [[work|file|software]] is]] licensed under the apache license [[version]] 2 0 [[the license]]",
    "cc-by-version": "[[this work is]] licensed under [[a|the]] [[creative commons]] cc by <<1-1:[1-4]>> 0",
    "cc-by-nc-version": "[[this work is]] licensed under [[a|the]] [[creative commons]] cc by nc <<1-1:[1-4]>> 0",
    "gpl-2.0": "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] version 2 [[of the license]]",
    "gpl-3.0": "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] version 3 [[of the license]]",
    "mit": "released under the [[terms of the]] mit license",
    "notice": "copyright [[c]] <<1-4:[0-9]{4}|[a-z]+>> <<0-8:.+>> all rights reserved",
    "apache-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<0-1:https?>> www apache org licenses license 2 0 "
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
    "see the license for the specific language governing permissions and limitations under the license",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice "
    "this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials "
    "provided with the distribution [[[[3]] neither the name of <<1-10:.+>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission]] "
    "this software is provided by the <<1-6:.+>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the <<1-6:.+>> "
    "be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused "
    "and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version <<1-1:[23]>> of the license "
    "or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
    "see the gnu general public license for more details",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and <<1-6:.+>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<1-6:.+>> be liable for any special direct indirect "
    "or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights "
    "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<1-8:.+>> be liable for any claim "
    "damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mpl-header": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<0-1:https?>> mozilla org mpl 2 0",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software "
    "for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software "
    "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
    "[[3]] this notice may not be removed or altered from any source distribution",
}


@dataclass(frozen=True)
class _Word:
    word: bytes


@dataclass(frozen=True)
class _Region:
    least: int
    most: int
    pattern: re.Pattern


def parse_template(text: str) -> list:
    """Markup to a list of words, regions and ("optional", alternatives) parts."""

    def sequence(at: int, depth: int) -> tuple[list[list], int]:
        ways: list[list] = [[]]
        while at < len(text):
            if text.startswith("[[", at):
                inner, at = sequence(at + 2, depth + 1)
                ways[-1].append(("optional", inner))
            elif text.startswith("]]", at):
                if not depth:
                    raise ValueError(f"]] without [[ in template: {text!r}")
                return ways, at + 2
            elif text.startswith("<<", at):
                end = text.index(">>", at)
                m = re.fullmatch(r"(\d+)-(\d+):(.+)", text[at + 2 : end])
                if not m or int(m[1]) > int(m[2]):
                    raise ValueError(f"bad region in template: {text[at : end + 2]!r}")
                ways[-1].append(_Region(int(m[1]), int(m[2]), re.compile(m[3].encode())))
                at = end + 2
            elif text[at] == "|" and depth:
                ways.append([])
                at += 1
            else:
                m = re.compile(r"[^\[\]<|]+").match(text, at)
                if not m:
                    raise ValueError(f"bad markup at {at} in template: {text!r}")
                ways[-1] += [_Word(w) for w in _WORD.findall(m[0].lower().encode())]
                at = m.end()
        if depth:
            raise ValueError(f"[[ without ]] in template: {text!r}")
        return ways, at

    return sequence(0, 0)[0][0]


#: Mandatory words from the beginning of a template among which its anchor is chosen, so that few starts lie before it however long it is.
ANCHOR_WORDS = 600


class Automaton:
    """Word automaton of a template: per state its word moves, region moves and empty moves."""

    def __init__(self, label: str, template: str):
        self.label = label
        self.moves: list[list[tuple[object, int]]] = [[]]
        self.empty: list[list[int]] = [[]]
        parts = parse_template(template)
        self.mandatory = [p.word for p in parts if isinstance(p, _Word)]
        if not self.mandatory:
            raise ValueError(f"template {label} has no mandatory word")
        #: Mandatory words read on the way to each state of the main line.
        self.progress = {0: 0}
        self.end = self._build(parts, 0, main=True)
        self.closed = [self._closure({s}) for s in range(len(self.moves))]
        self.anchor = max(self.mandatory[:ANCHOR_WORDS], key=lambda w: (len(w), w))
        first = next(i for i, p in enumerate(parts) if isinstance(p, _Word) and p.word == self.anchor)
        self.before = sum(map(self._longest, parts[:first]))
        #: Words that an accepted run has at most.
        self.most = sum(map(self._longest, parts))

    def _state(self) -> int:
        self.moves.append([]), self.empty.append([])
        return len(self.moves) - 1

    def _build(self, parts: list, at: int, main: bool = False) -> int:
        read = 0
        for part in parts:
            after = self._state()
            if isinstance(part, _Word):
                self.moves[at].append((part.word, after))
            elif isinstance(part, _Region):
                for k in range(part.most):
                    if k >= part.least:
                        self.empty[at].append(after)
                    step = self._state()
                    self.moves[at].append((part.pattern, step))
                    at = step
                self.empty[at].append(after)
            else:
                self.empty[at].append(after)
                for way in part[1]:
                    self.empty[self._build(way, at)].append(after)
            at = after
            read += isinstance(part, _Word)
            if main:
                self.progress[at] = read
        return at

    def _longest(self, part: object) -> int:
        if isinstance(part, tuple):
            return max(sum(map(self._longest, way)) for way in part[1])
        return part.most if isinstance(part, _Region) else 1

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s), todo.append(s)
        return frozenset(seen)

    def longest(self, words: list[bytes], at: int) -> tuple[int | None, int]:
        """Where the longest accepted run of words from ``at`` ends (None: not accepted), and the most mandatory words read."""
        states, end, read, k = self.closed[0], None, 0, at
        while states:
            read = max(read, *(self.progress.get(s, 0) for s in states))
            if self.end in states:
                end, read = k, len(self.mandatory)
            if k == len(words):
                break
            word = words[k]
            after = {s for state in states for x, s in self.moves[state] if (x == word if isinstance(x, bytes) else x.fullmatch(word))}
            states = frozenset().union(*(self.closed[s] for s in after)) if after else frozenset()
            k += 1
        return end, read


def _hashes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    return split_words(data, np.array([0, len(data)]), ALNUM_LOWER).hash


class LicenseScan:
    """Phrases and automata over the words of a step's texts."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(_hashes(_WORD.findall(p.lower().encode())), p.lower().encode(), label) for p, label in phrases.items()]
        self.automata = [Automaton(label, t) for label, t in templates.items()]
        self.anchors = _hashes([a.anchor for a in self.automata])

    def base(self, words: Words) -> Iterator[tuple[int, int, str]]:
        """(text, first word, label) of every place of a phrase."""
        text_of, last = words.text_of(), np.repeat(words.first[1:], words.counts)
        for hashes, phrase, label in self.phrases:
            place = np.flatnonzero(words.hash == hashes[0])
            place = place[place + len(hashes) <= last[place]]
            for k in range(1, len(hashes)):
                place = place[words.hash[place + k] == hashes[k]]
            for p in place.tolist():
                if words.words(p, p + len(hashes)) == b" ".join(_WORD.findall(phrase)):
                    yield int(text_of[p]), p - int(words.first[text_of[p]]), label

    def templates(self, words: Words) -> Iterator[tuple[int, str, int, int, float]]:
        """(text, label, first word, word after, share of the mandatory wording): accepted runs have share 1."""
        text_of = words.text_of()
        for automaton, anchor in zip(self.automata, self.anchors):
            accepted_until: dict[int, int] = {}
            for p in np.flatnonzero(words.hash == anchor).tolist():
                text = int(text_of[p])
                first, last = int(words.first[text]), int(words.first[text + 1])
                low = max(first, p - automaton.before, accepted_until.get(text, 0))
                # A run from any start up to the anchor reads no more than the automaton's longest one.
                around = words.words(low, min(last, p + 1 + automaton.most)).split(b" ")
                best: tuple[float, int, int] = (0.0, 0, 0)
                for start in range(low, p + 1):
                    end, read = automaton.longest(around, start - low)
                    share = read / len(automaton.mandatory) if end is None else 1.0
                    if share > best[0]:
                        best = share, start, low + end if end is not None else start
                    if end is not None:
                        accepted_until[text] = low + end
                        break
                if best[0]:
                    yield text, automaton.label, best[1] - first, best[2] - first, best[0]


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, spans of accepted templates, score.

    ``score`` is the largest share of a template's mandatory wording that an automaton read in a row (1: accepted); a
    phrase alone counts 0.5 at least, and a text with neither 0.  Templates may come as a table (label, template), which
    has a row a license and is compiled on the driver.
    """
    if isinstance(templates, DataFrame):
        templates = {r.label: r.template for r in templates.collect()}
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    scan = LicenseScan(phrases, templates)

    def step(batch: pa.RecordBatch, column: pa.Array) -> dict[str, object]:
        n = len(column)
        words = split_words(*text_bytes(column), ALNUM_LOWER)
        places: list[list[int]] = [[] for _ in range(n)]
        base: list[set[str]] = [set() for _ in range(n)]
        labels: list[set[str]] = [set() for _ in range(n)]
        spans: list[list[dict]] = [[] for _ in range(n)]
        score = np.zeros(n)
        for text_, place, label in scan.base(words):
            places[text_].append(place), base[text_].add(label), labels[text_].add(label)
            score[text_] = max(score[text_], 0.5)
        for text_, label, a, b, share in scan.templates(words):
            score[text_] = max(score[text_], share)
            if share == 1.0:
                labels[text_].add(label), spans[text_].append({"label": label, "first": a, "after": b})
        return {
            "doc_id": batch.column(0), "n_words": words.counts, "n_base": [len(p) for p in places],
            "first_word": [min(p, default=None) for p in places], "last_word": [max(p, default=None) for p in places],
            "base_labels": [",".join(sorted(s)) for s in base], "labels": [",".join(sorted(s)) for s in labels],
            "spans": lists(pa.array([x for s in spans for x in s], pa.struct([("label", pa.string()), ("first", pa.int64()), ("after", pa.int64())])), np.array([len(s) for s in spans])),
            "score": score,
        }

    rest = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, spans array<struct<label:string,first:bigint,after:bigint>>, score double"
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *T._parse_datatype_string(rest).fields])
    return map_text(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", schema, step)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """Contract query: phrase places, labels and score of every document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
