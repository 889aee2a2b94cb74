"""License scans by patience alignment.

Templates are whole license texts, the notices that stand in source files and
short grant lines; a license has several.  A template is looked for in regions of
a text that are little longer than itself:

1. A region is opened where so many of the template's words stand within its
   width that the least coverage can be reached (no such region is left out).
2. Region and template are aligned on the words that are unique in both: the
   longest increasing subsequence of those anchors is kept, the gaps between them
   are aligned the same way, and equal words beside an anchor are joined to it.  A
   gap without such words (a notice that stands twice) is aligned by its longest
   common subsequence.
3. Coverage is the share of the template's words that are aligned.  Names and
   versions, in brackets below, must be among them.

A text has all licenses with a template at or above the least coverage, but for
those whose aligned words a longer match aligns as well.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from itertools import product
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaplate.llm import common as C

#: One-sentence notices (fixed values); texts without a license report their best whole-text coverage of these.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "CC-BY": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}
#: Least coverage of a found license.
COVERAGE = 0.8
#: A region has a quarter more words than the template, and at least so many more.
SLACK = 4
#: Templates with more words are aligned at every 16th part of their length instead of at every word.
LONG = 64
#: Regions that a worker remembers, in bytes.
SEEN_BYTES = 32 << 20

#: How licenses are named after "under the" or "terms of the"; words in brackets must be aligned.
_NAMES = {
    "Apache-2.0": ["[Apache] License Version [2] 0", "[Apache] License [2] 0", "[Apache] [2] 0 License", "[Apache] Software License Version [2] 0", "[Apache] License [v2] 0"],
    "MIT": ["[MIT] License", "[MIT] X11 License", "[Expat] License"],
    "ISC": ["[ISC] License"],
    "BSD": ["[BSD] License", "[BSD] style License"],
    "BSD-2-Clause": ["[BSD] [2] Clause License", "[2] Clause [BSD] License", "[Simplified] [BSD] License"],
    "BSD-3-Clause": ["[BSD] [3] Clause License", "[3] Clause [BSD] License", "[New] [BSD] License", "[Modified] [BSD] License"],
    "MPL-2.0": ["[Mozilla] Public License Version [2] 0", "[Mozilla] Public License v [2] 0", "[Mozilla] Public License [2] 0", "[MPL] [2] 0"],
    "CC0-1.0": ["[CC0] 1 0 Universal", "Creative Commons [CC0] License", "Creative Commons [Zero] License"],
}
_GNU = {"": "GPL", "[Lesser] ": "LGPL", "[Affero] ": "AGPL"}
for _kind, _short in _GNU.items():
    _NAMES[_short] = [f"GNU {_kind}[General] [Public] License", f"[{_short}] License", f"GNU [{_short}]"]
    for _v, _words in (("2.0", ["[2]", "[2] 0"]), ("2.1", ["[2] [1]"]), ("3.0", ["[3]", "[3] 0"])):
        for _w in _words if (_short, _v) not in (("GPL", "2.1"), ("AGPL", "2.0"), ("AGPL", "2.1")) else ():
            _tight = _w.replace("[", "[v", 1)
            _NAMES.setdefault(f"{_short}-{_v}", []).extend(
                [f"GNU {_kind}[General] [Public] License {m}{w}" for m, w in (("version ", _w), ("", _w), ("v ", _w), ("", _tight))]
                + [f"[{_short}] {m}{w}" for m, w in (("version ", _w), ("", _w), ("", _tight))]
                + [_tight.replace("[v", f"[{_short}v", 1) + " License"]
            )
for _kind in ("", "SA", "NC", "ND", "NC SA", "NC ND"):
    _long = {"SA": "[ShareAlike]", "NC": "[NonCommercial]", "ND": "[NoDerivatives]"}
    _tail = "".join(f" {_long[k]}" for k in _kind.split())
    _codes = "".join(f" [{k}]" for k in _kind.split())
    _id = "-".join(["CC-BY", *_kind.split()])
    _NAMES[_id] = [f"[CC] [BY]{_codes} License", f"Creative Commons [Attribution]{_tail} License"]
    _NAMES[f"{_id}-4.0"] = [f"[CC] [BY]{_codes} [4] 0", f"Creative Commons [Attribution]{_tail} [4] 0 International License", f"Creative Commons [Attribution]{_tail} [4] 0 International Public License"]

#: The notices that licenses ask for in source files.
_HEADERS = {
    "GPL": [NOTICES["GPL"].replace("GNU General Public", "GNU [General] Public")],
    "MIT": [NOTICES["MIT"] + " and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the [MPL] was not distributed with this file, You can obtain one at"],
    "CC0-1.0": ["To the extent possible under law, the author has [waived] all copyright and related or neighboring rights to this work"],
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'],
    "BSD": [NOTICES["BSD"] + " provided that the following conditions are met"],
}
for _what, _kind, _id, _v in (("program", "", "GPL", "2"), ("program", "", "GPL", "3"), ("library", "[Lesser] ", "LGPL", "2 1"), ("program", "[Lesser] ", "LGPL", "3"), ("program", "[Affero] ", "AGPL", "3")):
    _HEADERS.setdefault(f"{_id}-{'.'.join([*_v.split(), '0'][:2])}", []).append(
        f"This {_what} is free software: you can redistribute it and/or modify it under the terms of the GNU {_kind}[General] Public License "
        f"as published by the Free Software Foundation, either version {' '.join(f'[{x}]' for x in _v.split())} of the License, or (at your option) any later version"
    )
#: Words of a whole text that must be aligned, and words that make it another license.
_TEXT_NEEDS = {"BSD-3-Clause": {"endorse"}, "CC-BY-SA-4.0": {"sharealike"}}
_TEXT_VETO = {"CC-BY-4.0": {"noncommercial", "noderivatives", "sharealike"}, "CC-BY-SA-4.0": {"noncommercial"}}

_WORD = re.compile(r"[a-z0-9]+")
_BYTES = np.zeros(256, bool)
_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_VALUES = C.lowered_table(_BYTES)


class Template(NamedTuple):
    """One wording of a license; ``needs`` are places in ``words`` that must be aligned."""

    license: str
    words: tuple[str, ...]
    needs: frozenset[int] = frozenset()
    veto: frozenset[str] = frozenset()

    @property
    def least(self) -> int:
        """The fewest aligned words that reach COVERAGE."""
        n = int(len(self.words) * COVERAGE)
        return n if n >= len(self.words) * COVERAGE else n + 1

    @property
    def width(self) -> int:
        """Words of a region."""
        return len(self.words) + max(SLACK, len(self.words) // 4)


def _line(license: str, text: str) -> Template:
    words = re.findall(r"\[?[a-z0-9]+\]?", text.lower())
    return Template(license, tuple(w.strip("[]") for w in words), frozenset(i for i, w in enumerate(words) if w[0] == "["))


@lru_cache(1)
def templates() -> tuple[Template, ...]:
    """All templates: the files of ``license_texts``, the notices and the grant lines."""
    out = []
    for file in sorted(Path(__file__).with_name("license_texts").glob("*.txt")):
        words = tuple(_WORD.findall(file.read_text(encoding="utf-8").lower()))
        needs = _TEXT_NEEDS.get(file.stem, ())
        out.append(Template(file.stem, words, frozenset(words.index(w) for w in needs), frozenset(_TEXT_VETO.get(file.stem, ()))))
    out += [_line(k, t) for k, lines in _HEADERS.items() for t in lines]
    out += [_line(k, f"{start} {name}") for k, names in _NAMES.items() for name, start in product(names, ("under the", "under a", "under an", "terms of the", "under"))]
    out += [_line(k, "SPDX License Identifier " + " ".join(f"[{w}]" for w in _WORD.findall(k.lower()))) for k in _NAMES]
    return tuple(dict.fromkeys(out))


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by bit rows."""
    masks: dict = {}
    for k, w in enumerate(b):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(b)) - 1
    row, rows = full, []
    for w in a:
        u = row & masks.get(w, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of ``a`` and ``b``, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, ie, j, je = todo.pop()
        while i < ie and j < je and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            out.append((ie, je))
        if i >= ie or j >= je:
            continue
        na, nb = Counter(a[i:ie]), Counter(b[j:je])
        at = {w: k for k, w in enumerate(a[i:ie], i) if na[w] == 1 and nb.get(w) == 1}
        anchors = [(at[w], k) for k, w in enumerate(b[j:je], j) if w in at]
        if not anchors:
            out += [(i + x, j + y) for x, y in _common(a[i:ie], b[j:je])]
            continue
        tops, ends, back = [], [], []
        for n, (x, _) in enumerate(anchors):
            p = bisect_left(tops, x)
            tops[p:p + 1], ends[p:p + 1] = [x], [n]
            back.append(ends[p - 1] if p else -1)
        n, chain = ends[-1], []
        while n >= 0:
            chain.append(anchors[n])
            n = back[n]
        chain.reverse()
        out += chain
        x, y = i, j
        for p, q in [*chain, (ie, je)]:
            todo.append((x, p, y, q))
            x, y = p + 1, q + 1
    return sorted(out)


class Match(NamedTuple):
    """A region's alignment: ``places`` are the aligned words of the text, ``named`` those of them that must be."""

    license: str
    coverage: float
    places: frozenset[int]
    named: frozenset[int]


def _match(t: Template, pairs: list[tuple[int, int]], start: int = 0) -> Match:
    return Match(t.license, len(pairs) / len(t.words), frozenset(start + x for x, _ in pairs), frozenset(start + x for x, y in pairs if y in t.needs))


def separate(matches: list[Match]) -> list[Match]:
    """Matches without those of other licenses that lie in a longer one, or in one with more names.

    One lies in another where all its names do; without names, where less than a fifth of its aligned words is its own.
    """
    kept: list[Match] = []
    for m in sorted(matches, key=lambda m: (len(m.places) <= LONG, -len(m.named) if len(m.places) <= LONG else 0, -len(m.places), -m.coverage, m.license)):
        inside = (k for k in kept if k.license != m.license and (m.named <= k.places if m.named else 5 * len(m.places - k.places) < len(m.places)))
        if next(inside, None) is None:
            kept.append(m)
    return kept


class Scanner:
    """The templates as word numbers, and the scan of a step of texts."""

    def __init__(self, all_templates: tuple[Template, ...]):
        self.templates = all_templates
        names = sorted({w for t in all_templates for w in (*t.words, *t.veto)} | {w for x in NOTICES.values() for w in _WORD.findall(x.lower())})
        data = pa.array([" ".join(names)], pa.string())
        hashes, _ = C.word_hashes(C.TextStep(data), _BYTES, _VALUES)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        number = {names[k]: n for n, k in enumerate(order.tolist())}
        self.words = [[number[w] for w in t.words] for t in all_templates]
        self.notices = [[number[w] for w in _WORD.findall(x.lower())] for x in NOTICES.values()]
        self.veto = [{number[w] for w in t.veto} for t in all_templates]
        self.needs = [np.unique([w[i] for i in t.needs]).astype(np.int64) for t, w in zip(all_templates, self.words, strict=True)]
        self.counts = []
        for w in self.words:
            used, often = np.unique(w, return_counts=True)
            self.counts.append((used, often))
        self.member = np.zeros((len(all_templates), len(names)), bool)
        for k, w in enumerate(self.words):
            self.member[k, w] = True
        self.in_notice = np.zeros((len(NOTICES), len(names)), bool)
        for k, w in enumerate(self.notices):
            self.in_notice[k, w] = True
        self.seen: dict = {}
        self.seen_bytes = 0

    def _align(self, k: int, region: np.ndarray) -> list[tuple[int, int]] | None:
        """The best alignment of template ``k`` in ``region`` within the template's width; equal regions are aligned once."""
        key = (k, region.tobytes())
        if key in self.seen:
            return self.seen[key]
        t, words, got = self.templates[k], self.words[k], None
        used, often = self.counts[k]
        here = np.bincount(region + 1, minlength=len(self.hashes) + 1)[1:]
        if np.minimum(here[used], often).sum() >= t.least and (here[self.needs[k]] > 0).all() and not any(here[w] for w in self.veto[k]):
            pairs = align(region.tolist(), words)
            lo = best = 0
            cut = (0, 0)
            for hi in range(len(pairs)):
                while pairs[hi][0] - pairs[lo][0] >= t.width:
                    lo += 1
                if hi + 1 - lo > best:
                    best, cut = hi + 1 - lo, (lo, hi + 1)
            pairs = pairs[slice(*cut)]
            if best >= t.least and t.needs <= {y for _, y in pairs}:
                got = pairs
        self.seen_bytes += len(key[1]) + 200
        if self.seen_bytes > SEEN_BYTES:
            self.seen.clear()
            self.seen_bytes = 0
        self.seen[key] = got
        return got

    def scan(self, texts: C.TextStep) -> list[list[Match]]:
        """All matches of each text of the step, and in ``self.ids`` and ``self.first`` the word numbers they were read from."""
        hashes, first = C.word_hashes(texts, _BYTES, _VALUES)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        ids = np.where(self.hashes[at] == hashes, at, -1)
        self.ids, self.first = ids, first
        out: list[list[Match]] = [[] for _ in range(texts.n)]
        known = np.flatnonzero(ids >= 0)
        number = ids[known]
        there = np.zeros(len(self.hashes), bool)
        there[number] = True
        doc = np.searchsorted(first, known, "right") - 1
        for k, t in enumerate(self.templates):
            if not there[self.needs[k]].all():
                continue
            here = self.member[k, number]
            p, d = known[here], doc[here]
            n = t.least
            if len(p) < n:
                continue
            opens = (p[n - 1 :] - p[: len(p) - n + 1] < t.width) & (d[n - 1 :] == d[: len(p) - n + 1])
            stride = 1 if len(t.words) <= LONG else len(t.words) // 16
            last = -stride
            for s, x in zip(p[: len(p) - n + 1][opens].tolist(), d[: len(p) - n + 1][opens].tolist(), strict=True):
                if s < last + stride:
                    continue
                last = s
                pairs = self._align(k, ids[s : min(s + t.width + stride - 1, int(first[x + 1]))])
                if pairs:
                    out[x].append(_match(t, pairs, s - int(first[x])))
        return out

    def best_notice(self, i: int) -> float:
        """The best whole-text coverage of the one-sentence notices by text ``i`` of the last step (their words alone)."""
        ids = self.ids[self.first[i] : self.first[i + 1]]
        ids = ids[ids >= 0]
        return max(len(align(ids[own[ids]].tolist(), n)) / len(n) for own, n in zip(self.in_notice, self.notices, strict=True))


@lru_cache(1)
def _scanner(all_templates: tuple[Template, ...]) -> Scanner:
    return Scanner(all_templates)


_FIELDS = [
    T.StructField("license", T.StringType()),
    T.StructField("coverage", T.DoubleType()),
    T.StructField("licenses", T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType())]))),
]


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``licenses`` (all found, each with its best coverage), and ``license`` and ``coverage`` of the best covered.

    Equal coverage goes to the one with more aligned words.  Texts without a
    license have a null ``license``, no ``licenses`` and their best coverage of
    the one-sentence notices; null and empty texts cover nothing.
    """
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64())]))

    def step(texts: C.TextStep) -> list[pa.Array]:
        scanner = _scanner(templates())
        found = []
        for matches in scanner.scan(texts):
            best: dict[str, tuple] = {}
            for m in separate(matches):
                best[m.license] = max(best.get(m.license, (0.0, 0)), (m.coverage, len(m.places)))
            found.append([{"license": k, "coverage": c[0]} for k, c in sorted(best.items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))])
        return [
            pa.array([f[0]["license"] if f else None for f in found], pa.string()),
            pa.array([f[0]["coverage"] if f else scanner.best_notice(i) for i, f in enumerate(found)], pa.float64()),
            pa.array(found, kind),
        ]

    return C.add_columns(docs, _FIELDS, text_col, step)


def digest(scanned: DataFrame) -> DataFrame:
    """One row per document."""
    return scanned.select("doc_id", "license", F.col("coverage"), "licenses")


def brute_force(text: str) -> set[str]:
    """The rule read literally, for tests: every notice and line in every region of its width, by longest common subsequences."""
    words = _WORD.findall(text.lower())
    matches = []
    for t in templates():
        if len(t.words) > LONG or not {t.words[i] for i in t.needs} <= set(words):
            continue
        for s in range(len(words)):
            region = words[s : s + t.width]
            if len(region) < t.least or t.veto & set(region):
                continue
            table = [[0] * (len(t.words) + 1)]
            for w in region:
                row = [0]
                for j, v in enumerate(t.words):
                    row.append(table[-1][j] + 1 if w == v else max(row[j], table[-1][j + 1]))
                table.append(row)
            if table[-1][-1] < t.least:
                continue
            i, j, pairs = len(region), len(t.words), []
            while i and j:
                if region[i - 1] == t.words[j - 1]:
                    i, j = i - 1, j - 1
                    pairs.append((i, j))
                elif table[i - 1][j] >= table[i][j - 1]:
                    i -= 1
                else:
                    j -= 1
            if t.needs <= {y for _, y in pairs}:
                matches.append(_match(t, pairs, s))
    return {m.license for m in separate(matches)}
