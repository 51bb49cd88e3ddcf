"""License scans: MinHash bands over overlapping text windows, then exact containment.

Words are lower-cased, outer punctuation and comment marks are dropped, and
five-word shingles are hashed.  A template of t shingles belongs to the scale b
with b < t <= 2b.  Each text is cut into aligned blocks of b shingles, and every
three neighbouring blocks make a window, so any run of 2b shingles lies in one.
A window retrieves a template when one of 32 bands (one MinHash row each)
agrees.  A run that holds 0.8 of a template has a Jaccard similarity of at
least 0.25 with it in its window, so it is retrieved with probability
1 - 0.75**32 > 0.9998; a full copy (0.33) with 0.999997.  The retrieved windows
are verified exactly: the share of the template's distinct shingles that occur
in the window must reach the threshold.

A text with fewer template shingles than the smallest template of a scale needs
leaves before that scale's MinHash pass.  Everything is one pass over the texts
without a shuffle.  The template table is a parameter of bounded size, sent to
the tasks.

Short wordings ("licensed under the MIT License", "SPDX-License-Identifier:
GPL-2.0-only") are too short for windows: an opening and a name behind it are
found word by word in tables of all prefixes, the longest wins, and count as
containment 1.0 of the ``-line`` of their licence.

Versions compete: where windows overlap, a template of another licence is
reported beside the one with more shingles found only if its own shingles, those
which the stronger template lacks, reach the threshold too.  So a GPL-2.0
notice is not a GPL-3.0 notice, and what a whole text says about another licence
is not a match of that one.  Parts of the same licence (notice, whole text) do
not compete.

Defined results: null, empty or short texts match nothing; very long texts are
scanned whole; repeated rows repeat their matches; of tied windows the first is
reported; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.llm import licensenames, textscan

SHINGLE, BANDS, THRESHOLD = 5, 32, 0.8
SLICE_BYTES = 1 << 19
NOTICES = ("-line", "-header")

# Public notices by which works are licensed.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    ),
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "GPL-2.0-only-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License version 2 as published by the Free Software Foundation."
    ),
    "GPL-1.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 1, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "LGPL-2.0-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, or (at "
        "your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at "
        "your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "LGPL-3.0-header": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "GFDL-1.2-header": (
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free "
        "Documentation License, Version 1.2 or any later version published by the Free Software Foundation"
    ),
    "GFDL-1.3-header": (
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free "
        "Documentation License, Version 1.3 or any later version published by the Free Software Foundation"
    ),
    "MPL-1.1-header": (
        'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use '
        "this file except in compliance with the License. You may obtain a copy of the License at "
        'http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an "AS IS" basis, WITHOUT '
        "WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and "
        "limitations under the License."
    ),
    "EPL-1.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"
    ),
    "EPL-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "BSL-1.0-header": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
        "https://www.boost.org/LICENSE_1_0.txt)"
    ),
    "OFL-1.1-header": (
        "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and "
        "is also available with a FAQ at: https://scripts.sil.org/OFL"
    ),
}

# Whole texts: one file per licence, without copyright lines, instructions and appendices.
TEMPLATES |= {
    f"{f.name[:-4]}-text": f.read_text("utf-8")
    for f in sorted(resources.files("tenderlens.llm").joinpath("license_texts").iterdir(), key=lambda f: f.name)
    if f.name.endswith(".txt")
}
WORDINGS = licensenames.WORDINGS

_OUTER = np.zeros(256, bool)
_OUTER[[ord(c) for c in ".,;:!?()[]{}<>\"'`*#/-_="]] = True


def scan(texts: pa.Array) -> textscan.Words:
    """Lower-cased words without outer punctuation; words of punctuation alone are dropped."""
    data, offsets = textscan.buffer_of(texts)
    data = textscan.lowered(data)
    start, end, doc = textscan.spans(data, offsets)
    start, end = start.copy(), end.copy()
    active = np.arange(len(start))
    while len(active):
        active = active[(end[active] > start[active])]
        active = active[_OUTER[data[end[active] - 1]]]
        end[active] -= 1
    active = np.arange(len(start))
    while len(active):
        active = active[(end[active] > start[active])]
        active = active[_OUTER[data[start[active]]]]
        start[active] += 1
    some = end > start
    start, end, doc = start[some], end[some], doc[some]
    return textscan.Words(data, offsets, start, end, doc, textscan.span_hashes(data, start, end))


def licence_of(name: str) -> str:
    """The licence that a template is a part or a wording of."""
    return re.sub(r"(-only)?-(line|header|text)$", "", name)


class Templates:
    """Shingle sets and MinHash rows of the templates, by scale, and the prefixes of the short wordings."""

    def __init__(self, texts: dict[str, str], wordings: licensenames.Wordings | None = None):
        members = sorted(texts)
        named = wordings.names | wordings.phrases if wordings else {}
        self.names = members + sorted(set(named) - set(texts))
        self.licences = [licence_of(n) for n in self.names]
        column = pa.array([texts[n] for n in members], pa.string())
        words = scan(column)
        if np.any(np.diff(words.first) < SHINGLE):
            raise ValueError(f"a template needs {SHINGLE} words at least")
        values, cuts = textscan.shingle_sets(words, SHINGLE)
        self.sets = [values[a:b] for a, b in zip(cuts, cuts[1:])]
        self.all = np.unique(values)
        self.factors = np.random.default_rng(7).integers(0, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.scales: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            block = 1 << max(0, (len(s) - 1).bit_length() - 1)
            self.scales.setdefault(block, []).append(i)
        self.rows = [np.array([(s * f).min() for f in self.factors], np.uint64) for s in self.sets]
        self.openings = self.spellings = self.phrases = []
        if wordings:
            number = {n: i for i, n in enumerate(self.names)}
            self.openings = prefixes([(o, 0) for o in wordings.openings])
            self.spellings = prefixes([(t, number[n]) for n, texts in wordings.names.items() for t in texts])
            self.phrases = prefixes([(t, number[n]) for n, texts in wordings.phrases.items() for t in texts])
        # The licences that each template's text names in a short wording.
        self.mentions: list[set[str]] = [set() for _ in members]
        for d, m, *_ in wordings_in(words, self):
            self.mentions[d].add(self.licences[m])


def extended(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a run of words and the word behind it."""
    return textscan.mix(h * np.uint64(0xD6E8FEB86659FD93) + word)


def prefixes(wordings: list[tuple[str, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """By number of words: the sorted hashes of all prefixes, and the value of the wording that ends there or -1."""
    words = scan(pa.array([t for t, _ in wordings], pa.string()))
    value = np.array([v for _, v in wordings], np.int64)
    first, count = words.first[:-1], np.diff(words.first)
    if np.any(count == 0):
        raise ValueError("a wording needs a word")
    out, h = [], np.zeros(len(first), np.uint64)
    for n in range(1, int(count.max(initial=0)) + 1):
        some = count >= n
        h[some] = extended(h[some], words.hash[first[some] + n - 1])
        ended = np.where(count[some] == n, value[some], -1)
        order = np.lexsort((-ended, h[some]))
        keys, at = np.unique(h[some][order], return_index=True)
        out.append((keys, ended[order][at]))
    return out


def walk(words: textscan.Words, begin: np.ndarray, table: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into ``begin``, end word, value) of the table's wordings that begin at these words."""
    origin, at, h = np.arange(len(begin)), begin, np.zeros(len(begin), np.uint64)
    found = [(origin[:0], at[:0], at[:0])]
    for keys, ended in table:
        inside = at < len(words.hash)
        inside[inside] = words.doc[at[inside]] == words.doc[begin[origin[inside]]]
        origin, at, h = origin[inside], at[inside], h[inside]
        h = extended(h, words.hash[at])
        place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        known = keys[place] == h
        origin, at, h, value = origin[known], at[known] + 1, h[known], ended[place[known]]
        found.append((origin[value >= 0], at[value >= 0], value[value >= 0]))
    return tuple(map(np.concatenate, zip(*found)))


def wordings_in(words: textscan.Words, templates: Templates) -> list[tuple[int, int, int, int]]:
    """(text index, template index, first word, end word) of the short wordings, without those inside a longer one."""
    every = np.arange(len(words.hash))
    opening, behind, _ = walk(words, every, templates.openings)
    # A name behind the text's end belongs to the next text.
    inside = behind < len(words.hash)
    inside[inside] = words.doc[behind[inside]] == words.doc[opening[inside]]
    opening, behind = opening[inside], behind[inside]
    of, end, name = walk(words, behind, templates.spellings)
    start, more_end, more_name = walk(words, every, templates.phrases)
    start, end, name = np.concatenate([opening[of], start]), np.concatenate([end, more_end]), np.concatenate([name, more_name])
    order = np.lexsort((-end, start))
    start, end, name = start[order], end[order], name[order]
    outer = np.ones(len(end), bool)
    outer[1:] = end[1:] > np.maximum.accumulate(end)[:-1]
    start, end, name = start[outer], end[outer], name[outer]
    doc = words.doc[start]
    first = words.first[doc]
    return list(zip(doc.tolist(), name.tolist(), (start - first).tolist(), (end - first).tolist()))


def window_bounds(first: np.ndarray, count: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each window of three blocks, texts given by first shingle and number of shingles."""
    blocks = -(-count // block)
    n = np.maximum(blocks - 2, np.minimum(blocks, 1))
    doc = np.repeat(np.arange(len(first)), n)
    order = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = first[doc] + order * block
    return start, np.minimum(start + 3 * block, first[doc] + count[doc]), doc


def matches_in(texts: pa.Array, templates: Templates, threshold: float, every_window: bool = False) -> list[tuple]:
    """(text index, template index, containment, first word, end word) of each text's best window per template.

    ``every_window`` skips the bands and verifies all windows: the brute-force form of the tests.
    """
    words = scan(texts)
    short = wordings_in(words, templates)
    shingles, doc = textscan.windows(words, SHINGLE)
    place = np.minimum(np.searchsorted(templates.all, shingles), max(len(templates.all) - 1, 0))
    hit = templates.all[place] == shingles if len(templates.all) else np.zeros(len(shingles), bool)
    with_hit, hits = np.unique(doc[hit], return_counts=True)
    word_first = words.first
    found: dict[tuple[int, int], tuple] = {}
    for block, members in sorted(templates.scales.items()):
        # A text or window with fewer hits than the smallest template needs cannot reach the threshold.
        least = min(len(templates.sets[m]) for m in members)
        texts_here = with_hit[hits / least >= threshold]
        first = np.searchsorted(doc, texts_here)
        count = np.searchsorted(doc, texts_here, side="right") - first
        local = np.cumsum(count) - count
        taken = np.repeat(first - local, count) + np.arange(count.sum())
        near, running = shingles[taken], np.concatenate([[0], np.cumsum(hit[taken])])
        start, end, index = window_bounds(local, count, block)
        enough = (running[end] - running[start]) / least >= threshold
        start, end, index = start[enough], end[enough], index[enough]
        pairs = []
        if every_window:
            pairs = [(w, m) for w in range(len(start)) for m in members]
        elif len(start):
            agreed = np.zeros((len(start), len(members)), bool)
            for band, factor in enumerate(templates.factors):
                values = np.append(near * factor, np.uint64(2**64 - 1))
                lowest = np.minimum.reduceat(values, np.stack([start, end], 1).ravel())[::2]
                for k, m in enumerate(members):
                    agreed[:, k] |= lowest == templates.rows[m][band]
            pairs = [(w, members[k]) for w, k in np.argwhere(agreed)]
        for w, m in pairs:
            wanted = templates.sets[m]
            has = np.isin(wanted, near[start[w]: end[w]])
            share = has.sum() / len(wanted)
            key = (int(texts_here[index[w]]), m)
            if share >= threshold and share > found.get(key, (0.0,))[0]:
                offset = int(start[w] - local[index[w]])
                length = int(end[w] - start[w]) + SHINGLE - 1
                ends = min(offset + length, int(word_first[key[0] + 1] - word_first[key[0]]))
                found[key] = (float(share), offset, ends, wanted[has])
    return best_versions(found, short, templates, threshold)


def best_versions(found: dict[tuple[int, int], tuple], short: list[tuple], templates: Templates, threshold: float) -> list[tuple]:
    """The matches without those which a stronger match of another licence explains."""
    by_text: dict[int, list[tuple]] = {}
    for (d, m), (share, first, end, has) in found.items():
        by_text.setdefault(d, []).append((-len(has), -share, templates.names[m], m, first, end, has))
    said: dict[int, list[tuple]] = {}
    for d, m, first, end in short:
        said.setdefault(d, []).append((m, first, end))
    out: dict[tuple[int, int], tuple] = {}
    for d, matches in by_text.items():
        kept: list[tuple] = []
        says = said.get(d, [])
        for match in sorted(matches, key=lambda x: x[:3]):
            *_, m, first, end, has = match
            if templates.names[m].endswith(NOTICES) and templates.licences[m] in templates.mentions[m]:
                # The notice names its licence; a text that names only others there is another notice.
                here = {templates.licences[n] for n, start, stop in says if start < end and first < stop}
                if here and not here & templates.mentions[m]:
                    continue
            for *_, n, start, stop, _ in kept:
                if templates.licences[m] != templates.licences[n] and first < stop and start < end:
                    own = len(np.setdiff1d(templates.sets[m], templates.sets[n], assume_unique=True))
                    if not own or len(np.setdiff1d(has, templates.sets[n], assume_unique=True)) < threshold * own:
                        break
            else:
                kept.append(match)
        by_text[d] = kept
        out |= {(d, m): (-share, first, end) for _, share, _, m, first, end, _ in kept}
    for d, m, first, end in short:
        explained = any(
            templates.licences[m] != templates.licences[n] and templates.licences[m] in templates.mentions[n]
            and start <= first and end <= stop
            for *_, n, start, stop, _ in by_text.get(d, [])
        )
        if not explained and out.get((d, m), (0.0,))[0] < 1.0:
            out[d, m] = (1.0, first, end)
    return [(d, m, *rest) for (d, m), rest in sorted(out.items())]


def license_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD,
                    id_col: str = "doc_id", text_col: str = "text",
                    wordings: licensenames.Wordings | None = WORDINGS) -> DataFrame:
    """Rows (id, license_id, containment, first_word, end_word) for each template found in each text."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    prepared = Templates(templates, wordings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch, 1, SLICE_BYTES):
                found = matches_in(part.column(1), prepared, threshold)
                if found:
                    d, m, share, a, b = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(d)), pa.array([prepared.names[x] for x in m]),
                         pa.array(share, pa.float64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                        names=["_id", "license_id", "containment", "first_word", "end_word"],
                    )

    schema = f"_id {id_type}, license_id string, containment double, first_word bigint, end_word bigint"
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
