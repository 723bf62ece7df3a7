"""License scans by patience alignment.

A document and a template are compared as sequences of words. Words that occur once in both are anchors; the longest
increasing run of anchors is kept, and the gaps between its members are aligned the same way, with equal words at the
edges of a gap taken first. Coverage is the share of the template's words that are aligned. In a long document the
places dense in a template's words are found first, so that a license that stands twice is still anchored; long
templates are then aligned with what is left between these places, gaps of any length. The words that name a license
and its version must all be there.
"""

from __future__ import annotations

import math
import pkgutil
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")

def _text(name: str) -> str:
    return pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode("utf-8")


def _gnu(name: str, version: str, comma: str = ",") -> str:
    return f"This program is free software{':' if comma == ',' else ';'} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version."


def _short(name: str, version: str) -> tuple[str, ...]:
    versions = [version] if "." in version else [version, version + ".0"]
    return tuple(f"{lead} under the {name}{link}{v}." for lead in ("This work is licensed", "Licensed") for link in (", version ", " v") for v in versions)


_GPL, _LGPL, _AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"

#: Notices and whole texts of public licenses, by SPDX id.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        _text("Apache-2.0"),
    ),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", _text("MIT")),
    "GPL-3.0": (*_short(_GPL, "3"), _gnu(_GPL, "3"), _text("GPL-3.0")),
    "GPL-2.0": (*_short(_GPL, "2"), _gnu(_GPL, "2", ";"), _text("GPL-2.0")),
    "LGPL-3.0": (*_short(_LGPL, "3"), _gnu(_LGPL, "3"), _text("LGPL-3.0")),
    "LGPL-2.1": (*_short(_LGPL, "2.1"), _gnu(_LGPL, "2.1", ";").replace("This program", "This library"), _text("LGPL-2.1")),
    "AGPL-3.0": (*_short(_AGPL, "3"), _gnu(_AGPL, "3")),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        _text("MPL-2.0"),
    ),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", _text("BSD-3-Clause")),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", _text("BSD-2-Clause")),
    # the sentence that both share, without the conditions that tell them apart
    "BSD-2-Clause OR BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "ISC": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", _text("ISC")),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "Licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.",),
    "CC0-1.0": ("Released into the public domain under CC0 1.0.", _text("CC0-1.0")),
    "Zlib": ("Licensed under the zlib License.", "Released under the zlib License.", _text("Zlib")),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", _text("BSL-1.0")),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", _text("Unlicense")),
}

#: Phrases that tell a license from its neighbours: those that stand in a template must be found word by word, so that
#: no share of coverage makes up for another name or version.
NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("apache license version 2.0",),
    "MIT": ("mit license",),
    **{f"{k}-{v}.0": (f"{n} version {v}", f"{n} version {v}.0", f"{n} v{v}", f"{n} v{v}.0", n, f"either version {v} of") for k, n in (("GPL", _GPL), ("LGPL", _LGPL), ("AGPL", _AGPL)) for v in "23"},
    "LGPL-2.1": (f"{_LGPL} version 2.1", f"{_LGPL} v2.1", _LGPL, "either version 2.1 of"),
    "MPL-2.0": ("mozilla public license v 2.0", "mozilla public license version 2.0"),
    "BSD-3-Clause": ("bsd 3 clause", "neither the name of"),
    "BSD-2-Clause": ("bsd 2 clause",),
    "ISC": ("isc license", "provided that the above copyright notice"),
    "CC-BY-4.0": ("cc by 4.0", "creative commons attribution 4.0"),
    "CC-BY-SA-4.0": ("cc by sa 4.0", "creative commons attribution sharealike 4.0"),
    "CC-BY-NC-4.0": ("cc by nc 4.0", "creative commons attribution noncommercial 4.0"),
    "CC-BY-ND-4.0": ("cc by nd 4.0",),
    "CC0-1.0": ("cc0 1.0",),
    "Zlib": ("zlib license", "altered source versions must be plainly marked"),
    "BSL-1.0": ("boost software license version 1.0",),
    "Unlicense": ("free and unencumbered software",),
}

#: Templates of so many words are also looked for over the whole text, however far their words lie apart.
_LONG = 40


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (i, j) of a and b, increasing in both, by recursive patience alignment."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        in_a, in_b = Counter(a[i0:i1]), Counter(b[j0:j1])
        place = {w: j for j, w in enumerate(b[j0:j1], j0) if in_b[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[i0:i1], i0) if in_a[w] == 1 and w in place]
        if not anchors:
            continue
        tails, tail_at, before = [], [], [-1] * len(anchors)
        for k, (_, j) in enumerate(anchors):
            p = bisect_left(tails, j)
            before[k] = tail_at[p - 1] if p else -1
            tails[p : p + 1], tail_at[p : p + 1] = [j], [k]
        k, chain = tail_at[-1], []
        while k >= 0:
            chain.append(anchors[k])
            k = before[k]
        out += chain
        edges = [(i0 - 1, j0 - 1), *reversed(chain), (i1, j1)]
        todo += [(p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(edges, edges[1:])]
    return sorted(out)


def _places(phrase: list[str], t: list[str]) -> list[int]:
    return [j for j in range(len(t) - len(phrase) + 1) if t[j : j + len(phrase)] == phrase]


class Scanner:
    """Finds templates in texts. A template is tried where enough of its words occur, repeats counted."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = 0.8):
        self.items = []
        for name, texts in templates.items():
            for t in map(tokens, texts):
                phrases = [(len(p), at) for p in map(tokens, NAMES.get(name, ())) if (at := _places(p, t))]
                self.items.append((name, t, Counter(t), least * len(t) - 1e-9, phrases))

    @staticmethod
    def _named(pairs: list[tuple[int, int]], phrases: list[tuple[int, list[int]]]) -> bool:
        at = {j: i for i, j in pairs}
        return all(any(j in at and all(at.get(j + d) == at[j] + d for d in range(n)) for j in places) for n, places in phrases)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, first word, last word + 1, aligned words) of every place where a template is covered, best template of each place."""
        doc = tokens(text or "")
        seen = set(doc)
        found = []
        for name, t, count, need, phrases in self.items:
            lack = len(t) - need
            for w in count:
                if w not in seen:
                    lack -= count[w]
                    if lack < 0:
                        break
            if lack < 0:
                continue
            here = [i for i, w in enumerate(doc) if w in count]
            if len(here) < need:
                continue

            def aligned(s: int, e: int) -> list[tuple[int, int]]:
                """Pairs (word of doc, word of t) among here[s:e]."""
                return [(here[s + i], j) for i, j in align([doc[i] for i in here[s:e]], t)]

            spread = max(len(t) // 2, 4) + len(t)
            s, e, least_e, window, both, ends = 0, 0, 0, Counter(), 0, [0]
            while s < len(here):  # a place: hits close enough together that the template could span them
                while e < len(here) and here[e] - here[s] < spread:
                    w = doc[here[e]]
                    both += window[w] < count[w]
                    window[w] += 1
                    e += 1
                to = s + 1
                if both >= need and e >= least_e:
                    pairs = aligned(s, e)
                    if len(pairs) >= need:  # again from the first aligned word, for the end may lie behind the window
                        a = bisect_left(here, pairs[0][0])
                        again = aligned(a, bisect_left(here, here[a] + spread))
                        pairs = max(again, pairs, key=len)
                    if len(pairs) >= need and self._named(pairs, phrases):
                        found.append((name, len(pairs) / len(t), pairs[0][0], pairs[-1][0] + 1, len(pairs)))
                        to = bisect_left(here, pairs[-1][0] + 1)
                        ends += [bisect_left(here, pairs[0][0]), to]
                    elif len(t) >= _LONG and len(pairs) < need:  # each further hit aligns one word more at most
                        least_e = e + math.ceil(need - len(pairs))
                while s < to:
                    if s < e:
                        w = doc[here[s]]
                        window[w] -= 1
                        both -= window[w] < count[w]
                    s += 1
                e = max(e, s)
            if len(t) >= _LONG:
                for s, e in zip(ends[::2], [*ends[1::2], len(here)]):
                    if e - s >= need and sum((Counter(doc[i] for i in here[s:e]) & count).values()) >= need:
                        pairs = aligned(s, e)
                        if len(pairs) >= need and self._named(pairs, phrases):
                            found.append((name, len(pairs) / len(t), pairs[0][0], pairs[-1][0] + 1, len(pairs)))
        found.sort(key=lambda f: (-f[4] * f[1], f[2], f[0]))
        kept: list = []
        for f in found:
            if all(f[3] <= g[2] or f[2] >= g[3] for g in kept):
                kept.append(f)
        return sorted(kept, key=lambda f: f[2])


def scan_docs(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """(doc_id, license, coverage, n_matches, matches) of every row.

    matches are array<struct(license, coverage, start, stop)> in text order, start and stop counted in words; license
    and coverage are those of the best match (ties to the earliest), null without one. Null, empty and unlicensed texts
    have no matches. Repeated rows each get their result; other columns are ignored.
    """
    match = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for b in slices(batches):
            rows = [scanner.scan(t) for t in b.column(1).to_pylist()]
            best = [max(r, key=lambda f: (f[1], -f[2])) if r else (None, None) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in best], pa.string()), pa.array([x[1] for x in best], pa.float64()), pa.array([len(r) for r in rows], pa.int64()), pa.array([[dict(zip(("license", "coverage", "start", "stop"), f)) for f in r] for r in rows], pa.list_(match))],
                ["doc_id", "license", "coverage", "n_matches", "matches"],
            )

    schema = "doc_id long, license string, coverage double, n_matches long, matches array<struct<license:string,coverage:double,start:long,stop:long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
