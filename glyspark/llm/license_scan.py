"""License scans by patience alignment of texts with license templates.

Words that occur once in both a text window and a template are anchors; the longest increasing subsequence
of their places is kept, and the gaps between anchors are aligned in the same way, after equal words at
their ends. A template's coverage is the share of its words that are aligned; a match covers LEAST of it, and
aligns the words that name its license and version (NAMES) one right after the other. A short template without
such words is covered whole.

A text is looked at only for templates of which it holds enough distinct words for that coverage (an
exact bound). Windows lie around the occurrences of several of the template's rarest words in that text, wherever
they are: one of the template's own length where its words stand in place, so that notices one right after the other are
told apart, and one that leaves room for a quarter of its words and four more on either side, where words were left out or
put in. A notice stretched beyond that is none. Very long texts are searched whole.

Null text counts as empty (no match). Repeated rows and null ids keep their rows. Of matches that overlap the one with
more aligned words counts, then the shorter, the earlier, and the first by the template's name. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._io import Workspace, byte_chunks, text_buffers
from ._words import LETTERS, LOWER, distinct, prefix_hash, range_hash, split

#: Share of a template's words that a match aligns.
LEAST = 0.8
#: Most words of a template that a match must cover whole where nothing in it is known to name the license.
SHORT = 8
#: Rarest words of a template that windows are laid around.
GUIDES = 3

#: Public license notices, as their texts give them.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-notice": "Released under the MIT License",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "MIT-0-notice": "Released under the MIT No Attribution License",
    "BSD-notice": "Released under the BSD License",
    "ISC-notice": "Released under the ISC License",
    "Apache-notice": "Released under the Apache License",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3",
    "MPL-2.0-notice": "This work is licensed under the Mozilla Public License, version 2.0",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0",
    "CC-BY-3.0": "Licensed under CC BY 3.0",
    "CC-BY-SA-3.0": "Licensed under CC BY-SA 3.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
}

#: The words of a template that name its license and version: another license's notice has others there.
NAMES = {
    "MIT-notice": ("MIT License",),
    "MIT-0-notice": ("MIT No Attribution License",),
    "BSD-notice": ("BSD License",),
    "ISC-notice": ("ISC License",),
    "Apache-notice": ("Apache License",),
    "Apache-2.0": ("Apache License", "2.0"),
    "Apache-2.0-notice": ("Apache License", "2.0"),
    "GPL-2.0": ("GNU General Public License", "version 2"),
    "GPL-3.0": ("GNU General Public License", "version 3"),
    "GPL-2.0-notice": ("GNU General Public License", "2"),
    "GPL-3.0-notice": ("GNU General Public License", "3"),
    "LGPL-2.1": ("GNU Lesser General Public License", "version 2.1"),
    "LGPL-2.1-notice": ("GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License", "version 3"),
    "AGPL-3.0": ("GNU Affero General Public License", "version 3"),
    "LGPL-3.0-notice": ("GNU Lesser General Public License", "3"),
    "AGPL-3.0-notice": ("GNU Affero General Public License", "3"),
    "MPL-2.0": ("Mozilla Public License", "2.0"),
    "MPL-2.0-notice": ("Mozilla Public License", "2.0"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0",),
    "CC-BY-4.0-notice": ("CC BY 4.0",),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0",),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0",),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0",),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",),
    "CC-BY-3.0": ("CC BY 3.0",),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0",),
}


def words_of(text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Lower-cased words of letters and digits with their starts and ends in bytes."""
    raw = np.frombuffer(text, np.uint8)
    s, e, _ = split(raw, np.array([0, len(raw)]), LETTERS)
    low = LOWER[raw].tobytes()
    return [low[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)], s, e


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by their first, whose seconds increase (patience piles)."""
    tops: list[int] = []
    pile: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        if at == len(tops):
            tops.append(b)
            pile.append(k)
        else:
            tops[at], pile[at] = b, k
        back[k] = pile[at - 1] if at else -1
    out, k = [], pile[-1] if pile else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b) in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: k for k, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = increasing([(k, place[w]) for k, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place])
        if not anchors:
            continue
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        out += anchors
        todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str):
        self.name, (self.words, *_) = name, words_of(text.encode())
        self.kinds = Counter(self.words)
        self.places: dict[bytes, list[int]] = {}
        for k, w in enumerate(self.words):
            self.places.setdefault(w, []).append(k)
        #: Ranges of words that name the license.
        self.names = []
        for phrase in NAMES.get(name, ()):
            p = words_of(phrase.encode())[0]
            self.names += [(k, k + len(p)) for k in range(len(self.words) - len(p) + 1) if self.words[k : k + len(p)] == p][:1]

    def least(self, least: float) -> float:
        """The share of the words that a match covers."""
        return 1.0 if not self.names and len(self.words) <= SHORT else least

    def named(self, pairs: list[tuple[int, int]]) -> bool:
        """Whether aligned pairs (in a text, in the template) hold its name with nothing in between."""
        at = {y: x for x, y in pairs}
        return all(lo in at and all(at.get(k) == at[lo] + k - lo for k in range(lo, hi)) for lo, hi in self.names)


def matches(words: list[bytes], template: Template, least: float = LEAST) -> list[tuple[int, int, float]]:
    """(first word, end word, coverage) of the template's matches in a text."""
    n, t = len(template.words), template
    least = t.least(least)
    here: dict[bytes, list[int]] = {}
    for k, w in enumerate(words):
        if w in t.kinds:
            here.setdefault(w, []).append(k)
    # The guides: of the words that a match may miss, even all but one cannot be the rarest and missing.
    guides = sorted(here, key=lambda w: (len(here[w]), t.places[w][0]))[: max(GUIDES, int(n * (1 - least)) + 1)]
    starts = sorted({k - j for w in guides for k in here[w] for j in t.places[w]})
    # Windows of the template's own length, where enough words stand in their places.
    windows = [[lo, lo + n] for lo in starts if lo >= 0 and sum(map(bytes.__eq__, words[lo : lo + n], t.words)) >= least * n]
    slack = n // 4 + 4
    wide: list[list[int]] = []
    for lo in starts:
        if wide and lo - slack - wide[-1][0] <= slack:
            wide[-1][1] = max(wide[-1][1], lo + n + slack)
        else:
            wide.append([lo - slack, lo + n + slack])
    windows += wide
    found = []
    for lo, hi in windows:
        lo, hi = max(lo, 0), min(hi, len(words))
        pairs = align(words[lo:hi], t.words)
        if len(pairs) >= least * n and t.named(pairs):
            # Strays far from the rest do not stretch the span.
            at = [lo + x for x, _ in pairs]
            found.append((at[0], at[-1] + 1, len(pairs) / n))
    return found


def _best(found: list[tuple[int, int, float, str]], words: dict[str, int]) -> list[tuple[int, int, float, str]]:
    """Matches that do not overlap, the ones with more aligned words first; words: those of each template."""
    out: list[tuple[int, int, float, str]] = []
    for m in sorted(found, key=lambda m: (-round(m[2] * words[m[3]]), m[1] - m[0], m[0], m[3])):
        if all(m[1] <= o[0] or m[0] >= o[1] for o in out):
            out.append(m)
    return sorted(out)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """Per row: doc_id, n_licenses, licenses (names, distinct, sorted) and spans (name, start, stop in characters, coverage)."""
    Workspace(docs.sparkSession, "license")
    table = dict(templates or TEMPLATES)

    def run(batches):
        ts = [Template(k, v) for k, v in sorted(table.items())]
        vocabulary = sorted({w for t in ts for w in t.kinds})
        where = {w: i for i, w in enumerate(vocabulary)}
        h = []
        for w in vocabulary:
            raw = np.frombuffer(w, np.uint8)
            h.append(range_hash(prefix_hash(raw), np.array([0]), np.array([len(raw)]))[0])
        h = np.array(h, np.uint64)
        order = np.argsort(h)
        keys = h[order]
        weight = np.zeros((len(vocabulary), len(ts)))
        for k, t in enumerate(ts):
            for w, c in t.kinds.items():
                weight[where[w], k] = c
        sizes = {t.name: len(t.words) for t in ts}
        needed = np.array([t.least(least) * len(t.words) for t in ts])
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for lo, hi in byte_chunks(offsets):
                part, own = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                s, e, begin = split(part, own, LETTERS)
                u, _, inverse = distinct(range_hash(prefix_hash(part), s, e))
                at = np.minimum(np.searchsorted(keys, u), len(keys) - 1)
                word = np.where(keys[at] == u, order[at], -1)[inverse]
                hit = np.flatnonzero(word >= 0)
                doc = np.repeat(np.arange(hi - lo), np.diff(begin))[hit]
                pair = np.unique(doc * len(vocabulary) + word[hit])
                present = np.zeros((hi - lo, len(ts)))
                np.add.at(present, pair // len(vocabulary), weight[pair % len(vocabulary)])
                counts, names, spans = [], [], []
                for i in range(hi - lo):
                    found = []
                    able = np.flatnonzero(present[i] >= needed)
                    if len(able):
                        text = part[own[i] : own[i + 1]].tobytes()
                        words, a, b = words_of(text)
                        for k in able:
                            found += [(*m, ts[k].name) for m in matches(words, ts[k], least)]
                        found = _best(found, sizes)
                    out = []
                    for x, y, c, name in found:
                        start = len(text[: a[x]].decode())
                        out.append({"name": name, "start": start, "stop": start + len(text[a[x] : b[y - 1]].decode()), "coverage": c})
                    counts.append(len(out))
                    names.append(",".join(sorted({o["name"] for o in out})))
                    spans.append(out)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int32()), pa.array(names, pa.string()), pa.array(spans, _SPANS)], names=["doc_id", "n_licenses", "licenses", "spans"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_licenses int, licenses string, spans array<struct<name:string,start:int,stop:int,coverage:double>>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


_SPANS = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("coverage", pa.float64())]))
