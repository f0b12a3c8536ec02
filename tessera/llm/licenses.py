"""Licence scanning with a generalised suffix automaton of licence tokens.

The automaton holds all word sequences of the templates. A text is streamed through it once and
gives matching statistics: at each word the length of the longest run ending there that stands in
some template. Runs that cannot grow are maximal matches; those of ``min_match`` words or more
are chained, per template, where the gap between them is at most ``max_gap`` words, and a chain that
covers enough of its template is a span with that template's label. Base phrases are templates
too: a match whose run ends on a whole phrase is a base place.

Words are runs of ASCII letters, digits and non-ASCII characters after lowering A-Z.

Defined results: NULL and wordless texts have no words, no labels, NULL first and last word and score
0; equal rows all stay; an empty table gives no rows; extra columns are ignored. Whole texts are
scanned in time linear in their length.
"""

from __future__ import annotations

import hashlib
import pathlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIN_MATCH, MAX_GAP, MIN_WORDS, MIN_COVER = 3, 6, 6, 0.5

# Base phrases and the labels that the result contract names.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices and granting passages of public licences, by SPDX-like label; whole licences are in licences/.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "Licensed under the GNU General Public License"),
    ("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("reserved", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
]


def words(text: str | None) -> list[str]:
    text = text or ""
    return _WORD.findall(text.lower() if text.isascii() else text.translate(_LOWER))


class Automaton:
    """Suffix automaton of several token sequences; a state knows which sequences hold its runs."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.holds, self.ends = [-1], [0], [0], [0]
        for k, tokens in enumerate(sequences):
            last = 0
            for token in tokens:
                last = self._grow(last, token)
                at = last
                while at > 0 and not self.holds[at] >> k & 1:
                    self.holds[at] |= 1 << k
                    at = self.link[at]
            if tokens:
                self.ends[last] |= 1 << k

    def _state(self, length: int, like: int | None = None) -> int:
        self.next.append(dict(self.next[like]) if like is not None else {})
        self.link.append(self.link[like] if like is not None else -1)
        self.holds.append(self.holds[like] if like is not None else 0)
        self.ends.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, at: int, token: int, old: int) -> int:
        copy = self._state(self.length[at] + 1, old)
        self.link[old] = copy
        while at >= 0 and self.next[at].get(token) == old:
            self.next[at][token] = copy
            at = self.link[at]
        return copy

    def _grow(self, last: int, token: int) -> int:
        old = self.next[last].get(token)
        if old is not None:
            return old if self.length[old] == self.length[last] + 1 else self._split(last, token, old)
        new = self._state(self.length[last] + 1)
        at = last
        while at >= 0 and token not in self.next[at]:
            self.next[at][token] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            old = self.next[at][token]
            self.link[new] = old if self.length[old] == self.length[at] + 1 else self._split(at, token, old)
        return new

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest run that ends here and stands in some sequence) per token."""
        state = size = 0
        for token in tokens:
            if token < 0:
                state = size = 0
            else:
                while state and token not in self.next[state]:
                    state = self.link[state]
                    size = self.length[state]
                to = self.next[state].get(token)
                state, size = (to, size + 1) if to is not None else (0, 0)
            yield state, size


class Scanner:
    def __init__(self, templates=TEMPLATES, base=BASE):
        self.base = [(words(p), label) for p, label in base.items()]
        self.templates = [(words(t), label) for label, t in templates]
        sequences = [w for w, _ in self.base] + [w for w, _ in self.templates]
        vocabulary = sorted({w for s in sequences for w in s})
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        self.automaton = Automaton([[self.ids[w] for w in s] for s in sequences])
        # a base phrase ends at a state if it is a suffix of that state's runs: walk the suffix links once
        m, phrases = self.automaton, (1 << len(self.base)) - 1
        self.suffixes = [0] * len(m.next)
        for s in sorted(range(len(m.next)), key=m.length.__getitem__):
            self.suffixes[s] = (m.ends[s] & phrases) | (self.suffixes[m.link[s]] if m.link[s] >= 0 else 0)

    def scan(self, text: str | None) -> dict:
        """n_words, base places [(start, phrase)], spans [(start, end, label, cover)]."""
        got = words(text)
        ids = [*map(self.ids.get, got)]
        matches, places, n = [], [], len(got)
        at = 0
        while at < n:
            if ids[at] is None:
                at += 1
                continue
            end = at
            while end < n and ids[end] is not None:
                end += 1
            if end - at > 1:
                before = (0, 0)
                for k, now in enumerate(self.automaton.statistics(ids[at:end]), at):
                    state, size = now
                    if before[1] >= MIN_MATCH and size <= before[1]:
                        matches.append((k - before[1], k, before[0]))
                    marks, i = self.suffixes[state], 0
                    while marks:
                        if marks & 1 and size >= len(self.base[i][0]):
                            places.append((k - len(self.base[i][0]) + 1, i))
                        marks, i = marks >> 1, i + 1
                    before = now
                if before[1] >= MIN_MATCH:
                    matches.append((end - before[1], end, before[0]))
            at = end
        return {"n_words": n, "base": sorted(places), "spans": self._chains(matches)}

    def _chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
        out = []
        for k, (template, label) in enumerate(self.templates, len(self.base)):
            chain = None  # start, end, words covered
            for start, end, state in [*(x for x in matches if self.automaton.holds[x[2]] >> k & 1), (1 << 62, 1 << 62, 0)]:
                if chain and start - chain[1] <= MAX_GAP:
                    chain = (chain[0], max(chain[1], end), chain[2] + max(0, end - max(start, chain[1])))
                    continue
                if chain and chain[2] >= min(MIN_WORDS, len(template)) and chain[2] >= MIN_COVER * len(template):
                    out.append((chain[0], chain[1], label, min(1.0, chain[2] / len(template))))
                chain = (start, end, end - start)
        return sorted(out)


def whole_texts() -> list[tuple[str, str]]:
    """(label, text) of the whole public licences in the folder beside this module, read on the driver."""
    folder = pathlib.Path(__file__).with_name("licences")
    return [(p.stem.lower(), p.read_text(encoding="utf-8")) for p in sorted(folder.glob("*.txt"))]


_SCANNERS: dict[str, Scanner] = {}


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string,cover:double>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("cover", pa.float64())])


def _run(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, templates = shared.value
        if key not in _SCANNERS:
            _SCANNERS.clear()
            _SCANNERS[key] = Scanner(templates)
        yield from _scanned(_SCANNERS[key], batches)

    return run


def _scanned(scanner: Scanner, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for text in batch.column(1).to_pylist():
            found = scanner.scan(text)
            starts, base = [p[0] for p in found["base"]], {scanner.base[p[1]][1] for p in found["base"]}
            spans = found["spans"]
            row = (found["n_words"], len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s[2] for s in spans})), max([1.0] * bool(base) + [s[3] for s in spans], default=0.0), [dict(zip(("start", "end", "label", "cover"), s, strict=True)) for s in spans])
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(_SPAN)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], names=["doc_id", *out])


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per row: word count, base places, labels, score and the covered template spans.

    Without ``templates``, (label, text) pairs, these are the notices above and the whole licences.
    """
    templates = TEMPLATES + whole_texts() if templates is None else templates
    shared = docs.sparkSession.sparkContext.broadcast((hashlib.sha256(repr(templates).encode()).hexdigest(), templates))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_run(shared), _SCHEMA)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
