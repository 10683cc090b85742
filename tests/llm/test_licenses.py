import random

import pytest

from cairn.llm import licenses as L


@pytest.fixture(scope="module")
def model():
    from conftest import texts

    return L.train([L.words(line) for t in texts(60) for line in t.split(". ")])


def test_templates_are_recognised(model):
    for family, lines in L.TEMPLATES.items():
        for t in lines:
            if len(t.split()) > 3:
                found = L.find(model, t)
                assert found and found[0][1] == family or t == L._WARRANTY, (family, t, found)


def test_variants_held_out(model):
    rng = random.Random(77)
    right = total = 0
    for family, lines in L.TEMPLATES.items():
        for t in lines:
            w = t.split()
            if len(w) > 8:
                v = [x for x in w if rng.random() > 0.07]
                found = L.find(model, "Copyright 2019 Example\n" + " ".join(v).capitalize() + ".")
                right += any(f[1] == family and f[0] == 1 for f in found)
                total += 1
    assert right >= 0.9 * total


def test_other_text_is_unknown(model):
    from conftest import texts

    rng = random.Random(5)
    other = texts(300, seed=11) + ["We licensed the photo from the agency.", "The general public may use the library free of charge.", "He was granted permission to leave.", "", "\n\n"]
    assert not [t for t in other if L.find(model, t)]
    words = [w for lines in L.TEMPLATES.values() for t in lines for w in t.split()]
    noise = [" ".join(rng.choices(words, k=25)) for _ in range(200)]
    assert sum(bool(L.find(model, t)) for t in noise) <= 6  # template comparison


def test_probabilities_are_calibrated(model):
    p = model.probabilities([L.words(t) for lines in L.TEMPLATES.values() for t in lines] + [["zzz", "yyy"]])
    assert abs(p.sum(axis=1) - 1).max() < 1e-9 and p[-1].argmax() == len(L.FAMILIES) - 1 and 0 < model.limit < 1


def test_frames_and_batches(spark, docs_of, odd_rows, model):
    text = "first\n\nReleased under the MIT License\nThis work is licensed under the GNU General Public License version 3.0\nlast"
    rows = [*odd_rows, (50, text), (50, text), (51, "x\n" * 3000 + "Released under the MIT License"), (None, text)]
    docs = docs_of(rows)
    got = [tuple(r) for r in L.scan_licenses(docs, model).collect()]
    want = [(i, k, f, round(p, 6), round(s, 6)) for i, t in rows for k, f, p, s in L.find(model, t or "")]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {(r[0], r[1], r[2]) for r in got} == {(50, 1, "mit"), (50, 2, "gpl"), (51, 3000, "mit"), (None, 1, "mit"), (None, 2, "gpl")}
    assert L.scan_licenses(docs_of([]), model).count() == 0
    assert L.train_on(docs_of([])).limit > 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def test_wrapped_lines_are_one_paragraph(model):
    assert len(L.paragraphs(MIT)) == 3
    commented = "\n".join("# " + line for line in MIT.split("\n"))
    for text in (MIT, commented, commented.replace("#", " *")):
        found = L.find(model, text)
        assert [f[1] for f in found] == ["mit"] * 3 and all(f[3] > 0.9 for f in found)
    assert L.paragraphs("a line\nThis one\n\nand this") == [["a", "line"], ["this", "one"], ["and", "this"]]


@pytest.mark.parametrize("family, text", [
    ("epl", "Eclipse Public License - v 2.0"),
    ("gpl", "You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and\nappropriately publish on each copy an appropriate copyright notice; keep intact all notices stating that this License applies"),
    ("apache", "You must cause any modified files to carry prominent notices\nstating that You changed the files"),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
])
def test_bodies_and_more_families(model, family, text):
    assert [f[1] for f in L.find(model, text)] == [family]


def test_the_limit_follows_the_whole_corpus(spark, docs_of, model):
    """Brute force over all paragraphs; what makes the limit rise stands in the last of many rows."""
    from dataclasses import replace

    from conftest import texts

    start = replace(model, limit=0.2)
    rows = [(i, t) for i, t in enumerate(texts(200, seed=21))] + [(900 + i, "the license of the software " + t) for i, t in enumerate(texts(30, seed=22, low=1, high=3))]
    for share in (0.0, 0.02, 0.2):
        got = L.calibrate(docs_of(rows), start, share=share).limit
        lines = [w for _, t in rows for w in L.paragraphs(t)]
        top = model.probabilities(lines)[:, :-1].max(axis=1)
        other = [p for w, p in zip(lines, top) if not (p >= start.limit and start.resembles(w))]
        want = next(c / L.BINS for c in range(L.BINS + 2) if sum(int(p * L.BINS) >= c for p in other) <= share * len(other))
        assert got == max(0.2, want)
    assert L.calibrate(docs_of([]), start).limit == 0.2
