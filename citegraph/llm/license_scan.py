"""Licence scan with a positional index of rare words.

Licence notices are templates of words; the index holds, for every word of any
template, its postings (template, position). Corpus statistics come first: a
pass counts the documents that hold each of these words, and a word's weight
is its inverse document frequency.

A key phrase is found from the postings of its highest-IDF word in the file:
every place of that word gives a start, starts are intersected with the
places of the next rarest words by relative position, until all words stand
in a row. The phrases of ``BASE`` are templates that are nothing but a key
phrase, so each of their places is found.

A longer template is looked up in the files that hold enough of its words by
weight. The file's highest-IDF words of the template vote for the template's
start, place less position; starts near the one with most votes align the
template, words inserted or left out shift it by ``SLACK`` at most. It gives
its label if all its key phrases stand at their places in the alignment and
the words that do carry ``SHARE`` of its weight.

Work is one pass of counting and one of matching over whole texts, no
shuffle but that of the counts (one row a template word and task).

Edge cases: null and empty texts have no words, no labels and score 0; words
are compared with A-Z folded only; rows that repeat a doc_id, also with a
null one, are scanned each for itself; a tie of votes goes to the earliest
start; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.textscan import Texts, chunks

#: fixed values of the contract: label and phrase
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: fixed values: label, notice as licences publish it, phrases that must stand in it
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("to deal in the software without restriction", "free of charge")),
    ("mit", "SPDX-License-Identifier: MIT", ("spdx license identifier mit",)),
    ("mit", "Licensed under the MIT License", ("the mit license",)),
    ("mit", "Released under the MIT licence", ("the mit licence",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee is hereby granted",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("may be used to endorse or promote products derived from this software",)),
    ("bsd-3", "SPDX-License-Identifier: BSD-3-Clause", ("spdx license identifier bsd 3 clause",)),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license version 2", "except in compliance with the license")),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0", ("spdx license identifier apache 2",)),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license as published by", "either version 3 of the license")),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("gnu general public license as published by", "either version 2 of the license")),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("agpl-3", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    ("gpl-3", "SPDX-License-Identifier: GPL-3.0", ("spdx license identifier gpl 3",)),
    ("gpl-2", "SPDX-License-Identifier: GPL-2.0", ("spdx license identifier gpl 2",)),
    ("gpl", "Licensed under the GNU General Public License", ("gnu general public license",)),
    ("gpl-3", "Licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    ("gpl-2", "Licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license v 2",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("has waived all copyright and related or neighboring rights",)),
    ("cc0", "CC0 1.0 Universal", ("cc0 1 0 universal",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international license",)),
    ("cc-by", "licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    ("cc-by-nd", "licensed under CC BY-ND 4.0", ("cc by nd",)),
    ("all-rights-reserved", "All rights reserved", ("all rights reserved",)),
    ("proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited", ("unauthorized copying of this file", "strictly prohibited")),
)

#: words of a template that a file looks up, its rarest ones first
ANCHORS = 8
#: share of a template's weight that its aligned words carry, at least
SHARE = 0.7
#: words by which inserted or missing words may shift a part of a template
SLACK = 6

_IN_WORD = np.ones(256, bool)
_IN_WORD[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

MATCHES = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, match_labels array<string>, match_starts array<long>, match_shares array<double>"
_KINDS = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.float64())]
_NAMES = [f.split()[0] for f in MATCHES.split(", ")]


def _words(text: str) -> list[str]:
    t = Texts(pa.array([text]), lower=True)
    return [t.data[a:b].tobytes().decode() for a, b, _ in zip(*t.runs(_IN_WORD[t.data]))]


class Template:
    """A notice as word numbers, with its key phrases as (position in it, word numbers)."""

    def __init__(self, label: str, text: str, keys: tuple[str, ...], number: dict[str, int]):
        words = _words(text)
        self.label, self.words = label, np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        self.keys = []
        for key in keys:
            k = _words(key)
            at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
            self.keys.append((at, self.words[at : at + len(k)]))


class Index:
    """All templates over one numbering of their words."""

    def __init__(self):
        number: dict[str, int] = {}
        self.base = [Template(label, phrase, (phrase,), number) for label, phrase in BASE]
        self.templates = [Template(label, text, keys, number) for label, text, keys in TEMPLATES]
        self.vocabulary = list(number)
        t = Texts(pa.array(self.vocabulary))
        keys = t.hashes(t.off[:-1], t.off[1:])
        self._order = np.argsort(keys)
        self._keys = keys[self._order]

    def __len__(self):
        return len(self.vocabulary)

    def read(self, column: pa.Array) -> File:
        """The words of some texts, numbered; -1 for words of no template."""
        t = Texts(column, lower=True)
        start, end, doc = t.runs(_IN_WORD[t.data])
        number = np.full(len(start), -1, np.int64)
        if len(start):
            h = t.hashes(start, end)
            at = np.minimum(np.searchsorted(self._keys, h), len(self._keys) - 1)
            known = self._keys[at] == h
            number[known] = self._order[at[known]]
        return File(self, number, doc, t.n)


class File:
    """Numbered words of some texts end to end, and the postings of the licence words."""

    def __init__(self, index: Index, number: np.ndarray, doc: np.ndarray, n: int):
        self.index, self.number, self.doc, self.n = index, number, doc, n
        self.n_words = np.bincount(doc, minlength=n)
        self.first = np.cumsum(self.n_words) - self.n_words
        known = np.flatnonzero(number >= 0)
        order = np.argsort(number[known], kind="stable")
        self._places = known[order]
        self._starts = np.searchsorted(number[self._places], np.arange(len(index) + 1))

    def places(self, word: int) -> np.ndarray:
        """Where a template word stands, ascending."""
        return self._places[self._starts[word] : self._starts[word + 1]]

    def documents_with(self) -> np.ndarray:
        """Texts that hold each template word."""
        return np.array([len(np.unique(self.doc[self.places(w)])) for w in range(len(self.index))], np.int64)

    def phrase(self, words: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Starts of a phrase: the rarest word's places, less those where the next rarest is not in its place."""
        by_weight = np.argsort(-weight[words], kind="stable")
        start = self.places(words[by_weight[0]]) - by_weight[0]
        start = start[(start >= 0) & (start + len(words) <= len(self.number))]
        start = start[self.doc[start] == self.doc[start + len(words) - 1]]
        for k in by_weight[1:]:
            start = start[self.number[start + k] == words[k]]
        return start

    def holding(self, t: Template, weight: np.ndarray) -> np.ndarray:
        """Texts whose words carry SHARE of the template's weight."""
        total = np.zeros(self.n)
        times = np.bincount(t.words, minlength=len(weight)) * weight
        for w in np.unique(t.words):
            total[np.unique(self.doc[self.places(w)])] += times[w]
        return np.flatnonzero(total >= SHARE * times.sum())

    def align(self, t: Template, d: int, weight: np.ndarray, keys: list[np.ndarray]) -> tuple[int, float] | None:
        """(start in the text, share of the weight that is aligned) of the template in text ``d``, if its key phrases stand."""
        lo, hi = self.first[d], self.first[d] + self.n_words[d]
        votes, used = [], 0
        for w in sorted(set(t.words.tolist()), key=lambda w: (-weight[w], w)):
            p = self.places(w)
            p = p[np.searchsorted(p, lo) : np.searchsorted(p, hi)]
            if len(p):
                votes.append(np.unique((p[:, None] - np.flatnonzero(t.words == w)[None, :]).ravel()))
                used += 1
                if used == ANCHORS:
                    break
        origin, n = np.unique(np.concatenate(votes), return_counts=True)
        at = origin[np.argmax(n)]
        near = origin[np.abs(origin - at) <= SLACK]
        place = near[:, None] + np.arange(len(t.words))[None, :]
        inside = (place >= lo) & (place < hi)
        stands = (inside & (self.number[np.clip(place, lo, hi - 1)] == t.words[None, :])).any(0)
        share = float(weight[t.words[stands]].sum() / weight[t.words].sum())
        held = all((np.abs(k - at - offset) <= SLACK).any() for k, (offset, _) in zip(keys, t.keys))
        return (max(0, int(at - lo)), share) if held and share >= SHARE else None

    def matches(self, weight: np.ndarray) -> list[tuple[int, str, int, float, bool]]:
        """(text, label, start, share, whether of BASE) of all that is found."""
        found = []
        for t in self.index.base:
            for at in self.phrase(t.words, weight).tolist():
                d = int(self.doc[at])
                found.append((d, t.label, at - int(self.first[d]), 1.0, True))
        for t in self.index.templates:
            keys = [self.phrase(words, weight) for _, words in t.keys]
            there = reduce(np.intersect1d, [self.doc[k] for k in keys])
            for d in np.intersect1d(there, self.holding(t, weight)).tolist():
                got = self.align(t, d, weight, [k[self.doc[k] == d] for k in keys])
                if got:
                    found.append((d, t.label, *got, False))
        return found


@cache
def index() -> Index:
    return Index()


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold each template word, all documents), over whole texts."""

    def count(batches):
        total, n = np.zeros(len(index()), np.int64), 0
        for batch in batches:
            for part in chunks(batch):
                file = index().read(part.column("text"))
                total += file.documents_with()
                n += file.n
        words = [-1, *np.flatnonzero(total).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.int32()), pa.array([n, *total[words[1:]].tolist()], pa.int64())], names=["word", "n"])

    out, n = np.zeros(len(index()), np.int64), 0
    # one row for each template word
    for word, k in docs.select("text").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n")).collect():
        if word < 0:
            n = k
        else:
            out[word] = k
    return out, n


def weights(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of every template word."""
    held, n = document_frequencies(docs)
    return np.log((1 + n) / (1 + held)) + 1e-6


def scan(docs: DataFrame) -> DataFrame:
    """Labels, places and shares of the licence notices in every document."""
    weight = weights(docs)

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                file = index().read(part.column("text"))
                per: list[list] = [[] for _ in range(file.n)]
                for d, *match in file.matches(weight):
                    per[d].append(match)
                rows = []
                for doc_id, n, found in zip(part.column("doc_id").to_pylist(), file.n_words.tolist(), per):
                    found.sort(key=lambda m: (m[1], m[0], -m[2]))
                    base = [m for m in found if m[3]]
                    joined = lambda ms: ",".join(sorted({m[0] for m in ms}))
                    first, last = (base[0][1], base[-1][1]) if base else (None, None)
                    rows.append((doc_id, n, len(base), first, last, joined(base), joined(found), max((m[2] for m in found), default=0.0), *([m[k] for m in found] for k in range(3))))
                cols = list(zip(*rows)) or [()] * len(_NAMES)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], names=_NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, MATCHES)


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
