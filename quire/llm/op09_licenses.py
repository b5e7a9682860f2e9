"""License scans: winnowed fingerprints of templates in an inverted index, then banded alignment.

Words are runs of ASCII letters and digits and of bytes beyond ASCII, A-Z lower-cased. The templates are whole licenses
(``license_texts``), and headers, notices and disclaimers, which also stand alone. Of each template the least hash in
every ``WINDOW`` neighbouring ``GRAM``-word shingles goes into the index, so an exact run of ``GRAM + WINDOW - 1`` template
words always holds an entry. Templates below ``SHORT`` words have all shingles of a size that a notice with as many changed
words as ``COVERAGE`` allows still holds. Every shingle of a text is looked up. Hits of one template on near diagonals are
one candidate; if its words, block by block, can reach the coverage, it is
aligned word by word within ``BAND`` of its diagonal. A match reports the template, the share of its words
that the alignment matched, and the span in code points. Of overlapping matches the one with most matched words stays.

The templates are a fixed list, so index and alignment are bounded; texts are read whole. Edge cases: null and empty
texts have no match; templates shorter than a shingle are one shingle of their length; ties go to the template first in
the list; repeated rows are scanned alike; an empty table gives no rows. Other columns are kept; names that clash with
result columns are replaced.
"""

from __future__ import annotations

import math
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm import words as W

# fixed values: public license texts and notices
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "mit-notice": "Released under the MIT License",
    "mit-notice-2": "Licensed under the MIT License",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation""",
    "agpl": """you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by
        the Free Software Foundation""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software""",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "all-rights-reserved": "All rights reserved",
} | {p.stem: p.read_text("utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
GRAM, WINDOW, BAND, COVERAGE = 3, 4, 8, 0.7
SHORT, BLOCK = 2 * (GRAM + WINDOW), 64
MATCH, OTHER = 2, -1
NEW = ["n_licenses", "license", "coverage", "licenses"]

APART = np.ones(256, bool)
APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Match(NamedTuple):
    name: str
    matched: int
    coverage: float
    first: int
    last: int


def cut(texts: list[str] | pa.Array) -> tuple[W.Words, np.ndarray]:
    """(words, hashes) with A-Z lower-cased."""
    words = W.split(*W.texts(pa.array(texts, pa.string()) if isinstance(texts, list) else texts), APART)
    return words, W.span_hashes(W.LOWER[words.data], words.start, words.end)


class Index:
    """Fingerprints of all templates: sorted hashes with their template and place."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE):
        self.names = list(templates)
        words, hashes = cut([templates[n] for n in self.names])
        self.words = [hashes[a:b] for a, b in zip(words.first, words.first[1:])]
        entries = set()
        for t, own in enumerate(self.words):
            size, window = min(GRAM, len(own)), WINDOW
            if len(own) < SHORT:
                # the longest run of matched words, if the others are spread as evenly as can be
                matched = max(1, math.ceil(coverage * len(own) - 1e-9))
                size, window = max(1, min(size, math.ceil(matched / (len(own) - matched + 1)))), 1
            grams = W.windows(own, size)
            for start in range(max(1, len(grams) - window + 1)):
                place = start + int(np.argmin(grams[start: start + window]))
                entries.add((int(grams[place]), t, place, size))
        ordered = sorted(entries)
        self.hash = np.array([e[0] for e in ordered], np.uint64)
        self.template, self.place, self.size = (np.array([e[k] for e in ordered], np.int64) for k in (1, 2, 3))

    def hits(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, diagonal, place) of every shingle of a text that is in the index."""
        out = []
        for size in np.unique(self.size):
            grams = W.windows(hashes, int(size))
            a, b = np.searchsorted(self.hash, grams, "left"), np.searchsorted(self.hash, grams, "right")
            for at in np.flatnonzero(b > a):
                out += [(int(self.template[e]), int(at - self.place[e]), int(at)) for e in range(a[at], b[at]) if self.size[e] == size]
        return sorted(out)


def reach(template: np.ndarray) -> int:
    """The band of a template: short ones, which may stand one after another, have a narrower one."""
    return min(BAND, len(template) // 2)


def reachable(template: np.ndarray, text: np.ndarray, diagonal: int, spread: int, least: float) -> bool:
    """Whether so many words can match near the diagonals: no more than the words that each block and its place share."""
    low, width, left, found = diagonal - reach(template), 2 * reach(template) + 1 + spread, len(template), 0
    for a in range(0, len(template), BLOCK):
        own, n = np.unique(template[a: a + BLOCK], return_counts=True)
        there = text[max(0, a + low): max(0, min(a + BLOCK, len(template)) + low + width)]
        at = np.minimum(np.searchsorted(own, there), len(own) - 1)
        found += int(np.minimum(n, np.bincount(at[own[at] == there], minlength=len(own))).sum())
        left -= min(BLOCK, left)
        if found + left < least:
            return False
    return True


def align(template: np.ndarray, text: np.ndarray, diagonal: int, spread: int = 0) -> tuple[int, int, int]:
    """(matched words, first, last place in the text) of the best local alignment near the diagonals from ``diagonal`` on."""
    low, width = diagonal - reach(template), 2 * reach(template) + 1 + spread
    # a cell is (score, matched, first place or -1, last place)
    empty = (0, 0, -1, -1)
    best, row = empty, [empty] * width
    for i in range(len(template)):
        now: list[tuple[int, int, int, int]] = []
        for k in range(width):
            j = i + low + k
            if not 0 <= j < len(text):
                now.append(empty)
                continue
            score, matched, first, last = row[k]
            if template[i] == text[j]:
                cell = (score + MATCH, matched + 1, j if first < 0 else first, j)
            else:
                cell = (score + OTHER, matched, first, last)
            if k + 1 < width and row[k + 1][0] + OTHER > cell[0]:
                cell = (row[k + 1][0] + OTHER, *row[k + 1][1:])
            if k and now[k - 1][0] + OTHER > cell[0]:
                cell = (now[k - 1][0] + OTHER, *now[k - 1][1:])
            cell = cell if cell[0] > 0 else empty
            now.append(cell)
            if cell[0] > best[0]:
                best = cell
        row = now
    return best[1:]


def scan(index: Index, hashes: np.ndarray, coverage: float = COVERAGE) -> list[Match]:
    """Matches in the words of one text, by place."""
    candidates: list[list[int]] = []  # template, least and greatest diagonal, last place
    for template, diagonal, place in index.hits(hashes):
        last = candidates[-1] if candidates else None
        near = reach(index.words[template])
        if last and last[0] == template and diagonal - last[2] <= near and diagonal - last[1] <= 4 * near:
            last[2] = diagonal
        else:
            candidates.append([template, diagonal, diagonal])
    found = []
    for template, low, high in candidates:
        own = index.words[template]
        if not reachable(own, hashes, low, high - low, coverage * len(own) - 1e-6):
            continue
        matched, first, last = align(own, hashes, low, high - low)
        share = matched / len(own)
        if share >= coverage:
            found.append((-matched, template, first, last, share))
    kept: list[Match] = []
    for matched, template, first, last, share in sorted(found):
        if all(last < m.first or m.last < first for m in kept):
            kept.append(Match(index.names[template], -matched, share, first, last))
    return sorted(kept, key=lambda m: m.first)


def licenses(documents: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, text: str = "text") -> DataFrame:
    """Documents with n_licenses, the license with most matched words, its coverage, and all matches with their spans."""
    W.arrow_batches(documents.sparkSession)
    kept = documents.select(*[c for c in documents.columns if c not in NEW])
    place = kept.columns.index(text)

    def run(batches):
        index = Index(templates, coverage)
        grams = {int(s): index.hash[index.size == s] for s in np.unique(index.size)}
        for batch in batches:
            words, hashes = cut(batch.column(place))
            found: list[list[Match]] = [[] for _ in range(batch.num_rows)]
            text_of = words.text()
            maybe = [text_of[np.flatnonzero(np.isin(W.windows(hashes, s), own))] for s, own in grams.items()]
            rows, best = [[] for _ in found], [None] * len(found)
            for t in np.unique(np.concatenate(maybe)) if maybe else []:
                a, b = words.first[t], words.first[t + 1]
                found[t] = scan(index, hashes[a:b], coverage)
                for m in found[t]:
                    raw = words.data[words.begin[t]: words.end[a + m.last]]
                    chars = np.cumsum((raw & 0xC0) != 0x80)
                    start, end = words.start[a + m.first] - words.begin[t], words.end[a + m.last] - words.begin[t]
                    rows[t].append({"name": m.name, "coverage": m.coverage, "start": int(chars[start]) - 1, "end": int(chars[end - 1])})
                if found[t]:
                    best[t] = max(found[t], key=lambda m: (m.matched, m.coverage))
            kind = pa.list_(pa.struct([("name", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array([len(r) for r in rows], pa.int64()), pa.array([m and m.name for m in best], pa.string()),
                pa.array([m.coverage if m else 0.0 for m in best], pa.float64()), pa.array(rows, kind)], [*batch.schema.names, *NEW])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    added = "n_licenses bigint, license string, coverage double, licenses array<struct<name:string,coverage:double,start:bigint,end:bigint>>"
    return kept.mapInArrow(run, f"{schema}, {added}")


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    """The licenses that every text names or quotes, with coverage and spans."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return licenses(documents).drop("text")
