"""Licence scans: matching statistics of a text against a generalised suffix automaton of licence templates.

The words of all templates and of the base phrases make one automaton. A text is streamed through it once: after each
word the state gives the longest string of words ending there that occurs in a template. Where such a match cannot be
extended and is long enough, it is mapped to its places in the templates; matches of one template that follow each other
in order in both are chained, and a chain that covers enough of the template adds the template's label, unless the same
words belong to a longer chain of another: sister licences share most of their text, and a word speaks for one of them.

Base: every place where a phrase's words stand consecutively. A phrase ends at a word if its own state is the matched
state or one of its suffix links.

Edge cases: null and empty texts have no words; words are as in decontamination; a text of a million words keeps only its
long matches in memory; repeated rows give repeated results; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.base import given_id, keyed_texts, record, text_bytes, word_bytes

# Base phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Texts and notices of common licences, by label.
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "apache-2": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file "
        "distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to "
        "You under the Apache License, Version 2.0"),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",),
    "bsd-2": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED.",),
    "bsd-3": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY "
        "THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS "
        "IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS.",),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions",),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more "
        "details."),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more "
        "details."),
    "mpl-2": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at",),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License",),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",),
    "cc-by-nd": ("This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License",),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License",),
    "cc-by-nc-sa": ("This work is licensed under a Creative Commons Attribution NonCommercial ShareAlike 4.0 International License",),
    "cc-by-nc-nd": ("This work is licensed under a Creative Commons Attribution NonCommercial NoDerivatives 4.0 International License",),
    "unlicense": (
        "This is free and unencumbered software released into the public domain",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."),
}

#: Words of a match that is chained, words a chain may skip on either side, share of a template that it must cover.
MIN_MATCH, MAX_GAP, MIN_COVER = 4, 8, 0.6


class SuffixAutomaton:
    """Generalised suffix automaton over words, with every state's places in the templates and phrases that end in it."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.labels = [label for label, _ in templates]
        self.sizes: list[int] = []
        ends: list[tuple[int, int, int]] = []
        for t, (_, text) in enumerate(templates):
            words = word_bytes(text.encode())
            self.sizes.append(len(words))
            last = 0
            for k, word in enumerate(words):
                last = self._extend(last, word)
                ends.append((last, t, k))
        marks: list[tuple[int, int, str]] = []
        for phrase, label in phrases.items():
            words = word_bytes(phrase.encode())
            last = 0
            for word in words:
                last = self._extend(last, word)
            if words:
                marks.append((last, len(words), label))
        # Places and phrases belong to a state and to all whose suffix links lead to it or from it, respectively.
        self.places: list[set[tuple[int, int]]] = [set() for _ in self.next]
        for state, t, k in ends:
            while state > 0:
                self.places[state].add((t, k))
                state = self.link[state]
        own: dict[int, list[tuple[int, str]]] = {}
        for state, size, label in marks:
            own.setdefault(state, []).append((size, label))
        self.phrases: list[tuple[tuple[int, str], ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.phrases[state] = (*self.phrases[self.link[state]], *own.get(state, ()))

    def _new(self, length: int, link: int, edges: dict[bytes, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, word: bytes) -> int:
        """The state of the string so far with ``word`` after it; ``last`` is 0 at the start of a string."""
        known = self.next[last].get(word)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._split(last, word, known)
        new = self._new(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            known = self.next[at][word]
            self.link[new] = known if self.length[known] == self.length[at] + 1 else self._split(at, word, known)
        return new

    def _split(self, at: int, word: bytes, known: int) -> int:
        copy = self._new(self.length[at] + 1, self.link[known], dict(self.next[known]))
        self.link[known] = copy
        while at >= 0 and self.next[at].get(word) == known:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def statistics(self, words: list[bytes]):
        """(last word, state, matched length) wherever a match cannot be extended by the next word, and
        (last word, state, length) wherever a phrase may end: one pass, each word moves or shortens the match."""
        follow, link, length, phrases = self.next, self.link, self.length, self.phrases
        root = follow[0]
        matches, ended = [], []
        state = matched = 0
        for k, word in enumerate(words):
            if state == 0:
                to = root.get(word)
                if to is None:
                    continue
                state, matched = to, 1
            else:
                to = follow[state].get(word)
                if to is None:
                    if matched >= MIN_MATCH:
                        matches.append((k - 1, state, matched))
                    while state and to is None:
                        state = link[state]
                        matched = length[state]
                        to = follow[state].get(word)
                    if to is None:
                        continue
                state, matched = to, matched + 1
            if phrases[state]:
                ended.append((k, state, matched))
        if matched >= MIN_MATCH:
            matches.append((len(words) - 1, state, matched))
        return matches, ended


class Span(NamedTuple):
    """A licence found: its words in the text, the share of the template that they cover, and whether it is a base phrase."""

    label: str
    first: int
    last: int
    cover: float
    base: bool


def base_places(machine: SuffixAutomaton, ended) -> list[Span]:
    """The base phrases, by place."""
    return sorted((Span(label, k - size + 1, k, 1.0, True) for k, state, matched in ended for size, label in machine.phrases[state]
                   if matched >= size), key=lambda s: (s.first, s.label))


def chained(machine: SuffixAutomaton, matches) -> list[tuple[int, int, int, int]]:
    """(template, first word, last word, words covered) of chains: of a chain and what extends it, all are listed.

    ``matches`` come in order of the text. A match extends the best chain of the template that ends at most ``MAX_GAP`` words
    before it in both; chains that nothing can extend any more are put aside, so few are looked at.
    """
    open_: dict[int, list[tuple[int, int, int, int]]] = {}
    out = []
    for k, state, matched in matches:
        for t, end in machine.places[state]:
            first, start = k - matched + 1, end - matched + 1
            alive = [c for c in open_.get(t, ()) if first - c[1] <= MAX_GAP + 1]
            before = max((c for c in alive if c[1] < first and c[2] < start <= c[2] + MAX_GAP + 1), key=lambda c: (c[3], c[0]), default=None)
            chain = (first, k, end, matched) if before is None else (before[0], k, end, before[3] + matched)
            open_[t] = [*alive, chain]
            out.append((t, chain[0], k, chain[3]))
    return out


def scan(machine: SuffixAutomaton, words: list[bytes]) -> tuple[list[Span], float]:
    """Base phrases and licences of a text by place, and the best cover of any template.

    What sister licences share proves none of them, so a word of the text speaks for one licence only: of chains that
    cover enough of their template the one with most words goes first, among equals the one that covers more of its
    template, and chains that overlap an earlier one are dropped.
    """
    matches, ended = machine.statistics(words)
    chains = chained(machine, matches)
    covers = [n / machine.sizes[t] for t, _, _, n in chains]
    order = sorted(((-n, -cover, machine.labels[t], first, last) for (t, first, last, n), cover in zip(chains, covers) if cover >= MIN_COVER))
    starts: list[int] = []
    taken: list[Span] = []
    for _, cover, label, first, last in order:
        at = bisect_right(starts, last)
        if not at or taken[at - 1].last < first:
            starts.insert(at, first)
            taken.insert(at, Span(label, first, last, min(1.0, -cover), False))
    return sorted(base_places(machine, ended) + taken, key=lambda s: (s.first, s.label)), min(1.0, max(covers, default=0.0))


@lru_cache(maxsize=1)
def default_automaton() -> SuffixAutomaton:
    """Built once in each worker."""
    return SuffixAutomaton([(label, text) for label, texts in TEMPLATES.items() for text in texts], BASE_PHRASES)


_SPAN = "struct<label:string,first:long,last:long,cover:double,base:boolean>"
_FOUND = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("best_cover", pa.float64()), ("spans", pa.list_(pa.struct(
    [("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64()), ("base", pa.bool_())])))])


def license_spans(docs: DataFrame) -> DataFrame:
    """(id, n_words, best_cover, spans) per row: the licences found, by place, as structs of :class:`Span`."""
    def run(batches):
        machine = default_automaton()
        for batch in batches:
            counts, covers, spans = [], [], []
            for text in text_bytes(batch.column("text")):
                words = word_bytes(text)
                found, cover = scan(machine, words)
                counts.append(len(words))
                covers.append(cover)
                spans.append([s._asdict() for s in found])
            yield record(_FOUND, id=batch.column("id"), n_words=counts, best_cover=covers, spans=spans)
    return keyed_texts(docs).mapInArrow(run, f"id long, n_words long, best_cover double, spans array<{_SPAN}>")


def license_report(docs: DataFrame) -> DataFrame:
    """The columns of query op3. ``score``: 1 with a base phrase, else the best cover of a template by a chain."""
    base = F.filter("spans", lambda s: s["base"])

    def labels(spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    firsts = F.transform(base, lambda s: s["first"])
    return license_spans(docs).select(
        given_id(), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.when(F.size(base) > 0, 1.0).otherwise(F.col("best_cover")).alias("score"))
