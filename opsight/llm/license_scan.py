"""License scans: winnowed fingerprints pick candidates, banded alignment confirms them.

Templates are token sequences (words without punctuation, A-Z lower-cased). Their k-token
grams are hashed and winnowed: of every ``window`` consecutive hashes the least is a
fingerprint, so any run of ``window + gram - 1`` equal tokens shares one with its template.
The fingerprints form an inverted index (hash to templates and places). A document's tokens
are fingerprinted in the same way; a hit on a template that lies in no match of it yet is a
candidate, and a sequence alignment in a band around its diagonal, between the matches on
either side, tells how many template tokens are matched and where in the text the match
begins and ends.

The index holds the templates only, whose number and length are known: it travels with the
task. Documents are independent of each other, so there is no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.llm.wordhash import mix64

# Notices of well-known licenses, as their publishers word them.
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} "
    "as published by the Free Software Foundation, either version {1} of the License, or (at your option) any "
    "later version."
)
_GNU_2 = (
    "This {2} is free software; you can redistribute it and/or modify it under the terms of the GNU {0} as "
    "published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
    "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        _GNU.format("General Public License", "3"),
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        _GNU_2.format("General Public License", "2", "program"),
    ],
    "AGPL-3.0": [_GNU.format("Affero General Public License", "3")],
    "LGPL-3.0": [_GNU.format("Lesser General Public License", "3")],
    "LGPL-2.1": [_GNU_2.format("Lesser General Public License", "2.1", "library")],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "BSD-3-Clause": [
        _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-2-Clause": [_BSD],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "MPL-1.1": [
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may "
        "not use this file except in compliance with the License.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    ],
}
# What tells licenses of like wording apart. Of each row of alternatives one has to stand in or
# right beside the matched text; none of the others may.
_NOT_GNU, _NOT_CC = ["affero", "lesser", "library general"], ["sharealike", "noderivatives", "noderivs", "sa", "nd"]
TELLING = {
    "Apache-2.0": ([["apache"], ["2 0"]], []),
    "MIT": ([["mit", "permission is hereby granted free of charge"]], []),
    "GPL-3.0": ([["gnu"], ["version 3", "v3"]], _NOT_GNU),
    "GPL-2.0": ([["gnu"], ["version 2", "v2"]], [*_NOT_GNU, "version 2 1"]),
    "AGPL-3.0": ([["affero"], ["version 3"]], []),
    "LGPL-3.0": ([["lesser"], ["version 3"]], []),
    "LGPL-2.1": ([["lesser"], ["version 2 1"]], []),
    "CC-BY-NC-4.0": ([["4 0"], ["nc", "noncommercial"], ["by", "attribution"]], _NOT_CC),
    "CC-BY-4.0": ([["4 0"], ["by", "attribution"]], [*_NOT_CC, "nc", "noncommercial"]),
    "CC-BY-SA-4.0": ([["4 0"], ["sa", "sharealike"]], ["nc", "noncommercial", "nd", "noderivatives"]),
    "BSD-3-Clause": ([["neither the name"]], []),
    "MPL-2.0": ([["mozilla"], ["2 0"]], []),
    "MPL-1.1": ([["mozilla"], ["1 1"]], []),
    "EPL-2.0": ([["eclipse public"], ["2 0"]], []),
}
BESIDE = 2

_TOKEN = re.compile(r"[^\W_]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Tokens and their places (code points) in the text."""
    found = list(_TOKEN.finditer(text))
    return [m.group().translate(_UPPER) for m in found], [m.span() for m in found]


def grams(numbers: np.ndarray, gram: int) -> np.ndarray:
    out = np.zeros(max(len(numbers) - gram + 1, 0), dtype=np.uint64)
    for i in range(gram):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + numbers[i : i + len(out)])
    return out


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash (the last of equals) of every window; of all, if there are fewer."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))])
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(axis=1))


@dataclass
class Template:
    license: str
    number: int
    tokens: np.ndarray


class Index:
    """Tokens of all templates as numbers from 1 on (0: any other token), and their fingerprints."""

    def __init__(self, templates: dict[str, list[str]], gram: int, window: int):
        self.gram, self.window = gram, window
        self.numbers: dict[str, int] = {}
        self.templates: list[Template] = []
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for name, texts in templates.items():
            for number, text in enumerate(texts):
                words, _ = tokens_of(text)
                seq = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], dtype=np.uint64)
                hashes = grams(seq, gram)
                for at in winnow(hashes, window).tolist():
                    self.postings[int(hashes[at])].append((len(self.templates), at))
                self.templates.append(Template(name, number, seq))
        self.known = np.array(sorted(self.postings), dtype=np.uint64)


def align(
    template: np.ndarray, text: np.ndarray, diagonal: int, band: int, low: int = 0, high: int | None = None
) -> tuple[int, int, int]:
    """Longest common subsequence inside the band around ``diagonal`` (text place less template place).

    Only text places from ``low`` on and below ``high`` count. Returns matched tokens and the first and last matched place of the text; of equal
    alignments the one that ends earliest, then that which begins latest.
    """
    width = 2 * band + 1
    high = len(text) if high is None else high
    score = np.zeros(width + 1, dtype=np.int64)
    begin = np.full(width + 1, -1, dtype=np.int64)
    end = np.full(width + 1, -1, dtype=np.int64)
    for i, token in enumerate(template.tolist()):
        new_score, new_begin, new_end = score.copy(), begin.copy(), end.copy()
        # Column c is text place i + diagonal - band + c; the row before had it one further on.
        new_score[:-1], new_begin[:-1], new_end[:-1] = score[1:], begin[1:], end[1:]
        new_score[-1] = 0
        for c in range(width):
            j = i + diagonal - band + c
            if low <= j < high and text[j] == token:
                best = (score[c] + 1, begin[c] if score[c] else j, j)
                if best[0] > new_score[c]:
                    new_score[c], new_begin[c], new_end[c] = best
            if c and new_score[c - 1] > new_score[c]:
                new_score[c], new_begin[c], new_end[c] = new_score[c - 1], new_begin[c - 1], new_end[c - 1]
        score, begin, end = new_score, new_begin, new_end
    best = int(score.max())
    if not best:
        return 0, -1, -1
    last, first = min((int(e), -int(b)) for s, b, e in zip(score, begin, end, strict=True) if s == best)
    return best, -first, last


def told(license: str, words: list[str]) -> bool:
    """Whether the matched words name this license and no other of like wording."""
    needs, never = TELLING.get(license, ([], []))
    line = " " + " ".join(words) + " "
    return all(any(f" {x} " in line for x in row) for row in needs) and not any(f" {x} " in line for x in never)


def scan(text: str, index: Index, band: int, least: float) -> list[tuple[str, int, int, int, float, int, int]]:
    """license, template, template tokens, matched tokens, coverage, first and end code point of each match."""
    words, places = tokens_of(text)
    if not words:
        return []
    seq = np.array([index.numbers.get(w, 0) for w in words], dtype=np.uint64)
    hashes = grams(seq, index.gram)
    marks = winnow(hashes, index.window)
    marks = marks[np.isin(hashes[marks], index.known)]
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for at in marks.tolist():
        for template, place in index.postings[int(hashes[at])]:
            hits[template].append((at, at - place))
    found = []
    for template, of in hits.items():
        t = index.templates[template]
        for matched, first, end in _matches(t.tokens, seq, of, band, least):
            if not told(t.license, words[max(0, first - BESIDE) : end + 1 + BESIDE]):
                continue
            coverage = matched / len(t.tokens)
            found.append((t.license, t.number, len(t.tokens), matched, coverage, places[first][0], places[end][1]))
    return _best(found)


def _matches(
    template: np.ndarray, text: np.ndarray, hits: list[tuple[int, int]], band: int, least: float
) -> list[tuple[int, int, int]]:
    """Matched tokens, first and last text place of the matches of one template, none over another.

    A hit (text place, diagonal) inside a match is done. Any other is aligned in the gap
    between matches that it lies in, and again on its side of a match found beside it.
    """
    found: list[tuple[int, int, int]] = []
    begins: list[int] = []
    tried: set[tuple[int, int, int]] = set()
    for at, diagonal in hits:
        while True:
            i = bisect_right(begins, at)
            if i and at <= found[i - 1][2]:
                break
            low = found[i - 1][2] + 1 if i else 0
            high = begins[i] if i < len(found) else len(text)
            if (diagonal, low, high) in tried:
                break
            tried.add((diagonal, low, high))
            match = align(template, text, diagonal, band, low, high)
            if match[0] / len(template) < least:
                break
            found.insert(i, match)
            begins.insert(i, match[1])
    return found


def _best(found: list[tuple]) -> list[tuple]:
    """Of matches that overlap in the text, the one with most matched tokens, then the best covered."""
    kept: list[tuple] = []
    for m in sorted(found, key=lambda m: (-m[3], -m[4], m[5], m[0], m[1])):
        if all(m[6] <= k[5] or m[5] >= k[6] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: (m[5], m[0], m[1]))


MATCH = "license string, template int, template_tokens int, matched_tokens int, coverage double, span_start long, span_end long"


def _scanner(templates: dict[str, list[str]], gram: int, window: int, band: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, gram, window)
        for batch in batches:
            ids, rows = [], []
            for at, text in enumerate(batch.column(1)):
                matches = scan(text.as_py() or "", index, band, least)
                ids += [at] * len(matches)
                rows += matches
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
            names = ["license", "template", "template_tokens", "matched_tokens", "coverage", "span_start", "span_end"]
            key = batch.column(0).take(pa.array(ids, pa.int64()))
            arrays = [key, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["_id", *names])

    return run


def license_scan(
    docs: DataFrame,
    templates: dict[str, list[str]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    gram: int = 3,
    window: int = 2,
    band: int = 8,
    least_coverage: float = 0.8,
) -> DataFrame:
    """One row per license text found: id, ``license``, ``template`` (its number there),
    ``template_tokens``, ``matched_tokens``, ``coverage`` (their share), ``span_start`` and
    ``span_end`` (code points of the text, the end exclusive).

    A template is found wherever at least ``least_coverage`` of its tokens are aligned; a
    text may hold several, also of one license. Licenses of like wording are told apart by words
    that must or must not stand in a match (``TELLING``). Matches that overlap count once: most
    matched tokens, then coverage, then place decide. Null and empty texts give no row,
    whole texts of any length are read. Repeated rows and null ids are documents of their
    own. Other columns are not read. Templates of fewer than ``gram`` tokens are never
    found. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    body = _scanner(templates or TEMPLATES, gram, window, band, least_coverage)
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string"))
    return chosen.mapInArrow(body, f"_id {kind}, {MATCH}").withColumnRenamed("_id", id_col)
