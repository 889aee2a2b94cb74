from __future__ import annotations

import random
from pathlib import Path

from tests.llm import edge
from vitaplate.llm import licenses


def test_alignment_recurses_between_anchors():
    assert licenses.align("x a b c y".split(), "a b z c".split()) == [(1, 0), (2, 1), (3, 3)]
    assert licenses.align([], ["a"]) == [] and licenses.align(["a"], ["a"]) == [(0, 0)]


def test_scan_edges(spark):
    texts = [*edge.TEXTS, "Intro.\nLICENSED under the apache license,\n Version 2.0 (the rest)"]
    got = licenses.scan(edge.frame(spark, texts)).collect()
    assert [r.license for r in got if r.license] == ["Apache-2.0"] and len(got) == len(texts)
    assert licenses.scan(edge.empty(spark)).count() == 0


#: One grant line or notice of every license that has one.
LINES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "Distributed under the terms of the GNU General Public License v2",
    "LGPL-2.1": "under the GNU Lesser General Public License version 2.1",
    "LGPL-3.0": "SPDX-License-Identifier: LGPL-3.0-or-later",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3",
    "GPL": "under the GNU General Public License",
    "BSD-2-Clause": "under the BSD 2-Clause License",
    "BSD-3-Clause": "Available under the 3-clause BSD license",
    "BSD": "released under the BSD license",
    "ISC": "under the terms of the ISC License",
    "MPL-2.0": "subject to the terms of the Mozilla Public License, v. 2.0",
    "CC0-1.0": "under the Creative Commons Zero License",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0",
    "CC-BY-NC-SA-4.0": "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
}
FILLER = "It stands under the tree and the public may read all of it in version 7 of the terms. "
WHOLE = sorted(Path(licenses.__file__).with_name("license_texts").glob("*.txt"))


def found(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.license == (r.licenses[0].license if r.licenses else None) for r in rows)
    return [{x.license for x in r.licenses} for r in sorted(rows)]


def test_lines_of_every_license_against_brute_force(spark):
    texts = [FILLER + line + " " + FILLER for line in LINES.values()]
    texts += [FILLER + f"{line} {line} {FILLER}{line} " + FILLER for line in LINES.values()]
    texts += [FILLER, "the MIT review under way", LINES["MIT"] + " " + FILLER + LINES["GPL-3.0"]]
    got = found(spark, texts)
    assert got[: len(LINES)] == [{k} for k in LINES] and got[len(LINES) : 2 * len(LINES)] == [{k} for k in LINES]
    assert got[-3:] == [set(), set(), {"MIT", "GPL-3.0"}]
    assert got == [licenses.brute_force(t) for t in texts]


def test_whole_texts_with_edits_repeats_and_neighbours(spark):
    rng = random.Random(2)
    edited = [" ".join(w if rng.random() > 0.05 else "changed" for w in p.read_text().split()) for p in WHOLE]
    mit = next(p for p in WHOLE if p.stem == "MIT").read_text()
    apache = next(p for p in WHOLE if p.stem == "Apache-2.0").read_text()
    texts = [FILLER + p.read_text() + FILLER for p in WHOLE] + [FILLER + t + FILLER for t in edited]
    texts += [FILLER + mit + mit + FILLER, FILLER + mit + FILLER + apache, apache[:5000] + " Released under the MIT License. " + apache[5000:]]
    want = [{p.stem} for p in WHOLE]
    assert found(spark, texts) == want + want + [{"MIT"}, {"MIT", "Apache-2.0"}, {"MIT", "Apache-2.0"}]


def test_gaps_without_unique_words_are_aligned_by_their_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1)]
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(table[-1][j] + 1 if x == y else max(row[j], table[-1][j + 1]))
            table.append(row)
        pairs = sorted(licenses._common(a, b))
        assert len(pairs) == table[-1][-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
