"""License scans: a trained paragraph classifier whose findings templates confirm.

A paragraph is a line that isn't blank, with the lines it wraps into: a line of ``WRAPPED`` characters or more that
doesn't end a sentence goes on in the next one if that begins with a small letter or both are in capitals (comment
marks before a line don't count).  Its features are its distinct word unigrams and bigrams
(words: runs of lower-cased letters, digits and inner dots), each with weight one over the root of their
number, so that words never seen in training dilute a paragraph.  A multinomial logistic regression over licence
families and ``unknown`` is fitted on variants of the templates below (words dropped, cut short,
continued with other text) against paragraphs of the corpus and scrambled templates.  A held-out
part sets the temperature of the probabilities and the limit under which a paragraph is unknown.  The limit is then raised
over the whole corpus: of all its paragraphs that don't resemble a template, at most ``FALSE_SHARE`` may reach it.  A finding
counts when the share of the paragraph's bigrams found in the family's nearest template, or of
that template's bigrams found in the paragraph, is at least ``CONFIRM``.

Paragraphs of the corpus used for fitting are labelled rows made from ``MAX_TEXTS`` whole texts picked by a hash of their ids:
those that resemble a template are left out, the others stand for unknown.  Calibrating and scanning cover every row and every
paragraph.

Defined results: null and empty texts have no paragraphs and no rows.  Repeated rows are scanned each.  With an empty
corpus the scrambled templates alone stand for unknown text.  The sections that the GNU licences share count as ``gpl``.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TEXTS = 400
CONFIRM = 0.6
WRAPPED = 50
FALSE_SHARE, BINS = 1e-4, 200
VARIANTS = 24
UNKNOWN = "unknown"

_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_REDIST = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_SOURCE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_BINARY = "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"


def _gnu(name: str, short: str, versions: tuple[str, ...]) -> list[str]:
    out = [
        f"this program is free software you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation either version {versions[0]} of the license or at your option any later version",
        f"you should have received a copy of the {name} along with this program if not see https www.gnu.org licenses",
        f"this work is licensed under the {name}",
        f"distributed under the terms of the {name}",
        name,
    ]
    for v in versions:
        out += [f"this work is licensed under the {name} version {v}", f"released under the {name} {v}", f"{name} version {v}", f"licensed under the {short} v{v.removesuffix('.0')}", f"spdx license identifier {short} {v} or later", f"spdx license identifier {short} {v} only"]
    return out


TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        _WARRANTY, "released under the mit license", "licensed under the mit license", "this project is licensed under the terms of the mit license", "the mit license mit", "spdx license identifier mit",
    ],
    "apache": [
        "licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license 2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license to make have made use offer to sell sell import and otherwise transfer the work",
        "you may reproduce and distribute copies of the work or derivative works thereof in any medium with or without modifications and in source or object form provided that you meet the following conditions",
        "you must give any other recipients of the work or derivative works a copy of this license", "you must cause any modified files to carry prominent notices stating that you changed the files",
        "unless you explicitly state otherwise any contribution intentionally submitted for inclusion in the work by you to the licensor shall be under the terms and conditions of this license without any additional terms or conditions",
        "this license does not grant permission to use the trade names trademarks service marks or product names of the licensor except as required for reasonable and customary use in describing the origin of the work and reproducing the content of the notice file",
        "apache license version 2.0 january 2004", "released under the apache license 2.0", "spdx license identifier apache 2.0",
        "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    ],
    "gpl": [
        *_gnu("gnu general public license", "gpl", ("2.0", "3.0", "2", "3")),
        "you may convey verbatim copies of the program s source code as you receive it in any medium provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice keep intact all notices stating that this license and any non permissive terms added in accord with section 7 apply to the code keep intact all notices of the absence of any warranty and give all recipients a copy of this license along with the program",
        "you may copy and distribute verbatim copies of the program s source code as you receive it in any medium provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice and disclaimer of warranty keep intact all the notices that refer to this license and to the absence of any warranty and give any other recipients of the program a copy of this license along with the program",
        "you may convey a work based on the program or the modifications to produce it from the program in the form of source code under the terms of section 4 provided that you also meet all of these conditions",
        "you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program or any part thereof to be licensed as a whole at no charge to all third parties under the terms of this license",
        "you may not propagate or modify a covered work except as expressly provided under this license any attempt otherwise to propagate or modify it is void and will automatically terminate your rights under this license",
        "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
        "each time you convey a covered work the recipient automatically receives a license from the original licensors to run modify and propagate that work subject to this license you are not responsible for enforcing compliance by third parties with this license",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        "the gnu general public license is a free copyleft license for software and other kinds of works",
    ],
    "lgpl": _gnu("gnu lesser general public license", "lgpl", ("2.1", "3.0")),
    "agpl": _gnu("gnu affero general public license", "agpl", ("3.0",)),
    "bsd": [_BSD_REDIST, _BSD_SOURCE, _BSD_BINARY, "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "use of this source code is governed by a bsd style license that can be found in the license file", "released under the bsd 3 clause license", "licensed under the bsd 2 clause license", "spdx license identifier bsd 3 clause", "spdx license identifier bsd 2 clause"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "released under the isc license", "spdx license identifier isc"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v. 2.0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0", "covered software is provided under this license on an as is basis without warranty of any kind either expressed implied or statutory including without limitation warranties that the covered software is free of defects merchantable fit for a particular purpose or non infringing", "all distribution of covered software in source code form including any modifications that you create or to which you contribute must be under the terms of this license", "mozilla public license version 2.0", "licensed under the mozilla public license 2.0", "spdx license identifier mpl 2.0"],
    "epl": [
        "eclipse public license v 2.0", "eclipse public license version 1.0", "the accompanying program is provided under the terms of this eclipse public license agreement any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0", "spdx license identifier epl 2.0",
    ],
    "boost": ["boost software license version 1.0 august 17th 2003", "distributed under the boost software license version 1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", "spdx license identifier bsl 1.0"],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", "spdx license identifier zlib"],
    "cc": [
        *(f"licensed under cc {k} {v}" for k in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd") for v in ("4.0", "3.0")),
        *(f"this work is licensed under a creative commons {k} {v} international license" for k in ("attribution", "attribution sharealike", "attribution noncommercial", "attribution noncommercial sharealike") for v in ("4.0",)),
        "this work is licensed under a creative commons license", "to view a copy of this license visit https creativecommons.org licenses",
    ],
    "public domain": ["this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work cc0 1.0 universal", "this work is dedicated to the public domain", "spdx license identifier cc0 1.0", "spdx license identifier unlicense"],
    "proprietary": ["all rights reserved", "copyright all rights reserved", "all rights reserved unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential", "no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher"],
}
FAMILIES = [*TEMPLATES, UNKNOWN]
_WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")


_MARKS = re.compile(r"^[\s#/*;%!<>|-]+")


def paragraphs(text: str) -> list[list[str]]:
    """The words of each paragraph."""
    out: list[list[str]] = []
    before, length, shout = "", 0, False
    for line in text.split("\n"):
        if not line.strip():
            before = ""
            continue
        bare = _MARKS.sub("", line).rstrip()
        loud = bare.isupper()
        if before and length >= WRAPPED and before[-1] not in ".!?:;" and bare and (bare[0].islower() or loud and shout):
            out[-1] += words(line)
        else:
            out.append(words(line))
        before, length, shout = bare, len(line.rstrip()), loud
    return out


def words(line: str) -> list[str]:
    return _WORD.findall(line.lower())


def grams(w: list[str]) -> set[str]:
    return {*w, *map(" ".join, zip(w, w[1:]))}


def bigrams(w: list[str]) -> set[tuple[str, str]]:
    return set(zip(w, w[1:])) or {(x, "") for x in w}


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray  # (n-grams, families)
    bias: np.ndarray
    temperature: float = 1.0
    limit: float = 0.5
    shapes: dict[str, list[set]] = field(default_factory=dict)
    known: frozenset = frozenset()  # the templates' bigrams

    def resembles(self, w: list[str]) -> bool:
        own = bigrams(w)
        return len(own & self.known) >= 0.3 * len(own)

    def probabilities(self, lines: list[list[str]]) -> np.ndarray:
        at, starts, scale = [], [], []
        for w in lines:
            g = grams(w)
            starts.append(len(at))
            at.extend([i for i in map(self.index.get, g) if i is not None])
            scale.append(max(1, len(g)) ** -0.5)
        # A row of zeros closes every run, so that runs without known n-grams sum to 0.
        flat = np.concatenate((self.weights, np.zeros((1, len(FAMILIES)), self.weights.dtype)))
        runs = np.insert(np.array(at, np.int64), starts, len(flat) - 1)
        logits = np.add.reduceat(flat[runs], np.array(starts) + np.arange(len(starts)), axis=0) if lines else np.zeros((0, len(FAMILIES)))
        logits = (logits * np.array(scale)[:, None] + self.bias) / self.temperature
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def similarity(self, family: str, w: list[str]) -> float:
        own = bigrams(w)
        best = 0.0
        for shape in self.shapes[family]:
            common = len(own & shape)
            # A short notice within a long line counts as far as the line's own text allows.
            best = max(best, common / len(own), common / len(shape) if len(shape) > 1 or len(own) < 4 else 0.0)
        return best


def _variants(rng: random.Random, noise: list[list[str]]) -> tuple[list[list[str]], list[int]]:
    lines, label = [], []
    for k, (family, texts) in enumerate(TEMPLATES.items()):
        for text in texts:
            w = words(text)
            for _ in range(VARIANTS):
                v = [x for x in w if len(w) < 5 or rng.random() > 0.08]
                if len(v) > 12 and rng.random() < 0.4:
                    a = rng.randrange(len(v) // 2)
                    v = v[a : a + max(8, int(len(v) * rng.uniform(0.4, 0.9)))]
                if rng.random() < 0.25:
                    v = ["copyright", str(rng.randrange(1990, 2025)), rng.choice(["acme", "authors", "contributors", "example"]), *v]
                if noise and rng.random() < 0.2:
                    v = [*v, *rng.choice(noise)[: rng.randrange(1, 4)]]
                lines.append(v)
                label.append(k)
    return lines, label


def train(noise: list[list[str]], seed: int = 7) -> Model:
    """A model of the templates against paragraphs of other text."""
    rng = random.Random(seed)
    shapes = {f: [bigrams(words(t)) for t in texts] for f, texts in TEMPLATES.items()}
    known = frozenset().union(*(s for of in shapes.values() for s in of))
    other = [w for w in noise if w and len(bigrams(w) & known) < 0.3 * len(bigrams(w))]
    lines, label = _variants(rng, other)
    vocabulary = [words(t) for texts in TEMPLATES.values() for t in texts]
    mixed = []
    for w in vocabulary * 6:  # the same words in no order, or strewn over other text
        v = rng.sample(w, len(w))
        mixed.append(v if not other or rng.random() < 0.5 else [x for pair in zip(v, rng.choice(other) * 50) for x in pair])
    unknown = [w for w in other + mixed if w]
    lines += unknown
    label += [len(FAMILIES) - 1] * len(unknown)
    y = np.array(label)
    held = np.array([rng.random() < 0.25 for _ in lines])
    index: dict[str, int] = {}
    for w in vocabulary:
        for g in sorted(grams(w)):
            index.setdefault(g, len(index))
    rows, cols, vals = [], [], []
    for i, w in enumerate(lines):
        g = grams(w)
        hit = sorted(index[x] for x in g if x in index)
        rows += [i] * len(hit)
        cols += hit
        vals += [len(g) ** -0.5] * len(hit)
    rows_, cols_, vals_ = np.array(rows), np.array(cols), np.array(vals)
    fit = ~held[rows_]
    rows_, cols_, vals_ = rows_[fit], cols_[fit], vals_[fit]
    n, classes = len(lines), len(FAMILIES)
    target = np.eye(classes)[y]
    share = np.where(held, 0.0, 1.0) / np.bincount(y[~held], minlength=classes)[y] / classes
    w, b = np.zeros((len(index), classes)), np.zeros(classes)
    m, v = np.zeros((len(index) + 1, classes)), np.zeros((len(index) + 1, classes))
    for t in range(1, 161):
        z = np.stack([np.bincount(rows_, w[cols_, k] * vals_, n) for k in range(classes)], axis=1) + b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        d = (e / e.sum(axis=1, keepdims=True) - target) * share[:, None]
        g = np.stack([np.bincount(cols_, d[rows_, k] * vals_, len(index)) for k in range(classes)], axis=1) + 1e-6 * w
        g = np.concatenate((g, d.sum(axis=0, keepdims=True)))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w -= step[:-1]
        b -= step[-1]
    model = Model(index, w, b, shapes=shapes, known=known)
    test, truth = [x for x, h in zip(lines, held) if h], y[held]
    best = (np.inf, 1.0)
    for temperature in np.geomspace(0.25, 8, 31):
        model.temperature = float(temperature)
        p = model.probabilities(test)
        best = min(best, (float(-np.log(np.maximum(p[np.arange(len(test)), truth], 1e-12)).mean()), float(temperature)))
    model.temperature = best[1]
    p = model.probabilities(test)
    top, guess = p[:, :-1].max(axis=1), p[:, :-1].argmax(axis=1)
    cuts = np.linspace(0.2, 0.98, 79)
    good = [(((top >= c) & (guess == truth)) | ((top < c) & (truth == classes - 1))).mean() for c in cuts]
    most = [c for c, g in zip(cuts, good) if g >= max(good) - 1e-12]
    model.limit = float((most[0] + most[-1]) / 2)
    return model


def find(model: Model, text: str) -> list[tuple[int, str, float, float]]:
    """(paragraph, family, probability, similarity) of the confirmed ones; paragraphs count from 0."""
    lines = paragraphs(text)
    return _confirmed(model, lines, model.probabilities(lines)) if lines else []


def _confirmed(model: Model, lines: list[list[str]], p: np.ndarray) -> list[tuple[int, str, float, float]]:
    out = []
    best = p[:, :-1].argmax(axis=1)
    for i in np.flatnonzero(p[np.arange(len(p)), best] >= model.limit).tolist():
        if lines[i] and (s := model.similarity(FAMILIES[best[i]], lines[i])) >= CONFIRM:
            out.append((i, FAMILIES[best[i]], float(p[i, best[i]]), s))
    return out


def train_on(docs: DataFrame, max_texts: int = MAX_TEXTS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model whose unknown class knows the corpus, from a bounded sample of whole texts, and whose limit suits all of it."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null")
    ids = own.select(F.col("id").alias("picked")).distinct().orderBy(F.xxhash64("picked"), "picked").limit(max_texts)
    sample = own.join(F.broadcast(ids), F.expr("id <=> picked"))  # at most max_texts ids
    noise = sorted({" ".join(w) for r in sample.collect() for w in paragraphs(r["t"])})
    return calibrate(docs, train([w.split(" ") for w in noise]), text_col)


def _batches(column: pa.Array):
    """Of some texts at a time: the paragraphs' words and the number of the text that each belongs to."""
    lines, owner, size = [], [], 0
    for k, text in enumerate(column.to_pylist()):
        own = paragraphs(text or "")
        lines += own
        owner += [k] * len(own)
        size += len(text or "")
        if size > 1 << 20:
            yield lines, owner
            lines, owner, size = [], [], 0
    if lines:
        yield lines, owner


def calibrate(docs: DataFrame, model: Model, text_col: str = "text", share: float = FALSE_SHARE) -> Model:
    """The model with its limit raised until at most ``share`` of the corpus's paragraphs that are like no template reach it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, total = shared.value, np.zeros(BINS + 1, np.int64)
        for b in batches:
            for lines, _ in _batches(b.column(0)):
                top = m.probabilities(lines)[:, :-1].max(axis=1)
                bins = (top * BINS).astype(np.int64)
                # Only those near the limit need the comparison; the others are beneath it either way.
                near = np.flatnonzero(top >= m.limit)
                like = np.array([i for i in near.tolist() if m.resembles(lines[i])], np.int64)
                total += np.bincount(bins, minlength=BINS + 1) - np.bincount(bins[like], minlength=BINS + 1)
        yield pa.record_batch([pa.array(np.arange(BINS + 1)), pa.array(total)], ["bin", "n"])

    # One row of each bin from each task.
    counts = np.zeros(BINS + 1, np.int64)
    for bin_, n in docs.select(text_col).mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n")).collect():
        counts[bin_] = n
    above = counts[::-1].cumsum()[::-1]
    allowed = np.flatnonzero(above <= share * max(1, counts.sum()))
    least = allowed[0] / BINS if len(allowed) else 1.0
    return replace(model, limit=max(model.limit, float(least)))


def scan_licenses(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph, family, probability, similarity) of each confirmed paragraph, both figures rounded to 6 places."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            ids, rows = [], []
            own = b.column(0).to_pylist()
            for lines, owner in _batches(b.column(1)):
                first = {}
                for k, o in enumerate(owner):
                    first.setdefault(o, k)
                for k, family, p, s in _confirmed(m, lines, m.probabilities(lines)):
                    ids.append(own[owner[k]])
                    rows.append((k - first[owner[k]], family, round(p, 6), round(s, 6)))
            if rows:
                yield pa.record_batch(
                    [pa.array(ids, b.column(0).type), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.float64(), pa.float64())))],
                    [id_col, "paragraph", "family", "probability", "similarity"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, paragraph int, family string, probability double, similarity double")
