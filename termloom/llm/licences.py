"""Licence scans: a trained paragraph classifier, confirmed by templates.

A paragraph is a ``\\n``-split line, and besides a run of hard-wrapped lines joined: neighbouring
lines without a blank one between, each but the last as long as lines are wrapped.  A
run that is a notice is one paragraph; the lines of any other run are judged one by one.  Comment
signs and blank comment lines do not count as words.

A sparse logistic regression over
hashed word 1- to 3-grams gives the probability of each licence family, of ``unknown`` (a
licence notice of no known family) and of ``none`` (no notice).  It is trained here, on
licence texts, on names in the frames below and on counter-examples.  Whole frames are held out, with all
of their variants, to fit the temperature that calibrates it and the threshold, and to
measure it (``held_out_frames``, ``held_out_families``).  A family is reported when its calibrated
probability passes the
threshold and the paragraph shares enough word pairs with one of the family's texts or names;
any other paragraph that is more likely a notice than not is reported as ``unknown``.

The training set is fixed: it takes no rows from the corpus and does not depend on it.
Nulls and empties have no paragraphs; repeated rows are scanned alike, a null doc_id is kept; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import textkernel as tk
from termloom.llm.quality import line_ranges
from termloom.llm.storage import arrow

U64 = np.uint64

#: Family -> texts of the licences themselves and their usual headers.
BODIES: dict[str, list[str]] = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache-2.0": [
        "You may not use this file except in compliance with the Apache License. You may obtain a copy of the License at the site of the foundation.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see the GNU licenses page.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at the Mozilla site."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "cc-by": [],
    "cc-by-sa": [],
    "cc-by-nc": [],
}

#: Family -> names, as they stand in a notice.
NAMES: dict[str, list[str]] = {
    "mit": ["MIT License", "MIT licence", "MIT/X11 license", "Expat License", "MIT license agreement"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 licence", "Apache Software License, Version 2.0", "Apache v2 license"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License version 2", "GNU GPL v3", "GPL, version 2 or later", "GNU General Public License v2.0", "GPLv3 license"],
    "lgpl": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License version 2.1", "GNU LGPL v3", "LGPL, version 2.1 or later", "GNU Library General Public License"],
    "agpl": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPL, version 3 or later", "Affero General Public License"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause licence", "New BSD License", "3-clause BSD license", "Simplified BSD License", "BSD-style license"],
    "mpl": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "Mozilla Public License, v. 2.0"],
    "isc": ["ISC License", "ISC licence", "ISC software license"],
    "public-domain": ["CC0 1.0 Universal", "CC0 1.0 public domain dedication", "Unlicense", "public domain dedication", "Creative Commons Zero"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "Creative Commons Attribution license", "CC BY 3.0 licence", "Creative Commons Attribution 3.0 Unported License"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 3.0 licence"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial license", "CC BY-NC 3.0 licence"],
}
IDS = {"mit": ["MIT"], "apache-2.0": ["Apache-2.0"], "gpl": ["GPL-3.0-or-later", "GPL-2.0-only"], "lgpl": ["LGPL-2.1-only", "LGPL-3.0-or-later"], "agpl": ["AGPL-3.0", "AGPL-3.0-or-later"], "bsd": ["BSD-3-Clause", "BSD-2-Clause"], "mpl": ["MPL-2.0"], "isc": ["ISC"], "public-domain": ["CC0-1.0", "Unlicense"], "cc-by": ["CC-BY-4.0"], "cc-by-sa": ["CC-BY-SA-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"]}
#: Notices without their names; whole frames are held out to measure the model.
FRAMES = [
    "This project is licensed under the terms of the {l}.",
    "Distributed under the {l}, see the file LICENSE for details.",
    "You can redistribute this file under the {l}.",
    "Made available under the {l}.",
    "This file is covered by the {l}.",
    "The code is provided under {l}.",
    "Use of this source code is governed by the {l}.",
    "License: {l}",
    "Published by {a} under a {l}.",
    "All content here is licensed as {l} unless otherwise noted.",
    "Copyright {n} {a}, {l}.",
    "Subject to the terms and conditions of the {l}.",
    "Text and data are available under the {l}; additional terms may apply.",
    "The documentation of {a} is shared under the {l}.",
    "Contributions are accepted under {l}.",
    "See {l} for the full text of the license.",
]
ID_FRAMES = ["SPDX-License-Identifier: {l}", "license = \"{l}\"", "@license {l}", "License-Expression: {l}"]

UNKNOWN_NAMES = ["{a} License", "{a} Public License, version {n}", "{a} Software Licence", "{a} Community License {n}", "{a} end user license agreement", "{a} Source Licence", "license of {a}", "{a} terms of use"]
UNKNOWN = [
    "All rights reserved. No part of this publication may be reproduced without written permission of the publisher.",
    "Copyright {n} {a}. All rights are reserved by the author.",
    "This file is proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    "You may use this material for personal use under the {a} terms of license.",
    "No license is granted to any patent or copyright of {a}.",
    "Copyright (c) {n} by {a}, all rights reserved worldwide.",
    "The rights to copy, distribute and modify this work are reserved.",
]

NONE = [
    "He had lost his driver's license on the way to {a} and had to walk home.",
    "The license plate of the car was covered with mud.",
    "Students of the MIT built a {a} robot that could climb stairs.",
    "The Apache people lived in the mountains of the south west.",
    "The council was granted permission to build a road through {a}.",
    "The general public was not allowed to see version {n} of the {a} report.",
    "A creative team works in common rooms and gives attribution to its authors.",
    "Software and documentation of the {a} project were copied and distributed to the office.",
    "The bar lost its licence to sell {a} after the fire in {n}.",
    "The foundation gave free books to every school under the new terms.",
    "She published a copy of the letter with the notice that it was a fake.",
    "In the following conditions the {a} engine runs without warranty of success.",
    "See the file list in the project root for the {a} sources.",
    "The weather in {a} was fine and the harvest of {n} good.",
    "Please read the instructions before you use the machine.",
    "Released in {n}, the film was a great success in {a}.",
    "This work is about the history of {a} and its people.",
    "The law of the state required a written agreement of both parties.",
    "All of the seats were reserved for guests of {a}.",
    "The terms of the peace were published in {n}.",
    "Content with the rest of the work, {a} left for the coast.",
    "The file of version {n} was lost under the general confusion.",
    "Attribution of the painting to {a} is not certain.",
    "She released the bird and it flew over the {a} hills.",
    "Data of the {n} survey are available on request.",
    "His rights were reserved by the court until {n}.",
]

#: Lengths in bytes of a line that a writer's editor wrapped.
WRAPPED = (40, 110)

CLASSES = [*BODIES, "unknown", "none"]
_TRIM = np.zeros(256, bool)
_TRIM[list(b".,;:!?\"'()[]{}<>*#`/-_")] = True
_BITS = 20


def _token_hashes(flat: tk.Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, document) of the words without the signs at their ends, A-Z folded; what
    is signs alone is no word."""
    w = tk.words(flat)
    start, end = w.start.copy(), w.end.copy()
    for _ in range(4):
        start += (end > start) & _TRIM[flat.data[np.minimum(start, max(len(flat.data) - 1, 0))]] if len(start) else 0
        end -= (end > start) & _TRIM[flat.data[np.maximum(end - 1, 0)]] if len(end) else 0
    real = end > start
    doc = np.repeat(np.arange(flat.n), np.diff(w.at))
    start, end = start[real], end[real]
    return tk.range_hashes(flat.data, start, end, True), start, doc[real]


def _grams(h: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of the 1-, 2- and 3-grams that lie in one line."""
    values, owners = [tk.mix(h + U64(1))], [line]
    for size in (2, 3):
        n = len(h) - size + 1
        if n > 0:
            x = np.full(n, size, U64)
            for k in range(size):
                x = tk.mix(x * U64(0x9FB21C651E98DF25) + h[k : k + n])
            same = line[:n] == line[size - 1 :]
            values.append(x[same])
            owners.append(line[:n][same])
    return np.concatenate(values), np.concatenate(owners)


class Model(NamedTuple):
    features: np.ndarray  # sorted hashes
    weights: np.ndarray  # features x classes
    bias: np.ndarray
    temperature: float
    threshold: float
    accuracy: float  # on held-out frames
    templates: dict[str, list[np.ndarray]]  # word pairs of each text and name


def _logits(model: Model, grams: np.ndarray, owner: np.ndarray, words: np.ndarray) -> np.ndarray:
    """lines x classes; ``words`` has the words of each line."""
    table = np.zeros(1 << _BITS, bool)
    table[(model.features >> U64(64 - _BITS)).astype(np.int64)] = True
    near = table[(grams >> U64(64 - _BITS)).astype(np.int64)]
    grams, owner = grams[near], owner[near]
    at = np.minimum(np.searchsorted(model.features, grams), len(model.features) - 1)
    known = model.features[at] == grams
    # a feature counts once in a line, however often it occurs
    pairs = np.unique(owner[known] * len(model.features) + at[known])
    owner, at = pairs // len(model.features), pairs % len(model.features)
    scale = (1 / np.sqrt(np.maximum(words, 4))).astype(np.float32)
    out = np.zeros((len(words), len(CLASSES)), np.float32)
    for k in range(0, len(at), 200_000):
        a, o = at[k : k + 200_000], owner[k : k + 200_000]
        first = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
        out[o[first]] += np.add.reduceat(model.weights[a], first, axis=0)
    return out * scale[:, None] + model.bias


def _probabilities(logits: np.ndarray, temperature: float) -> np.ndarray:
    z = logits / temperature
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _variants(seed: int) -> tuple[list[str], list[int], list[int]]:
    """The training paragraphs, their classes, and the number of the frame, counter-example or
    prose each was made of; -1 for texts of licences."""
    r = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ten", "ra", "sol", "vi", "den", "or", "mar", "the", "er", "an", "bri"]

    def name() -> str:
        return "".join(r.choices(syllables, k=r.randint(2, 4))).capitalize()

    def noise(n: int) -> list[str]:
        return ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(n)]

    def fill(t: str) -> str:
        return t.replace("{a}", name()).replace("{n}", str(r.randint(1, 2024)))

    def change(t: str) -> str:
        w = t.split()
        if len(w) > 12 and r.random() < 0.5:  # a window of a long paragraph
            n = r.randint(max(8, len(w) // 2), len(w))
            k = r.randint(0, len(w) - n)
            w = w[k : k + n]
        if len(w) > 8:
            w = [x for x in w if r.random() > 0.06]
        if r.random() < 0.25:
            w = f"Copyright (c) {r.randint(1980, 2024)} {name()} {name()}.".split() + w
        if r.random() < 0.15:
            w = noise(r.randint(1, 6)) + w
        if r.random() < 0.15:
            w = w + noise(r.randint(1, 6))
        t = " ".join(w)
        return t.upper() if r.random() < 0.1 else t

    texts, labels, made = [], [], []

    def add(text: str, c: int, template: int) -> None:
        texts.append(change(fill(text)))
        labels.append(c)
        made.append(template)

    for c, family in enumerate(BODIES):
        for k in range(110):
            if k % 5 == 4:
                f = r.randrange(len(ID_FRAMES))
                add(ID_FRAMES[f].replace("{l}", r.choice(IDS[family])), c, f)
            else:
                f = r.randrange(len(FRAMES))
                add(FRAMES[f].replace("{l}", r.choice(NAMES[family])), c, f)
        for body in BODIES[family]:
            for _ in range(12):
                add(body, c, -1)
    for k in range(300):
        f = r.randrange(len(FRAMES))
        if k % 2:
            add(FRAMES[f].replace("{l}", r.choice(UNKNOWN_NAMES)), len(BODIES), f)
        else:
            f = r.randrange(len(UNKNOWN))
            add(UNKNOWN[f], len(BODIES), f)
    for _ in range(600):
        f = r.randrange(len(NONE))
        add(NONE[f], len(BODIES) + 1, f)
    common = "the of and to in is it that was for on are as with they at be this have from or had by but not what all were we when your can there an "
    common = (common + "mit der die und das nicht von auf ist für la le les des une est que el los por con para en un se").split()
    for k in range(700):  # prose without meaning: common words between invented ones
        w = noise(r.randint(1, 60))
        w = [r.choice(common) if r.random() < 0.4 else x for x in w]
        add((" ".join(w) + ".").capitalize(), len(BODIES) + 1, k)
    return texts, labels, made


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, text of each, words of each text), a paragraph a text."""
    data, offsets = tk.flatten(pa.array(texts, pa.large_string()))
    h, _, doc = _token_hashes(tk.Flat(0, data, offsets))
    return *_grams(h, doc), np.bincount(doc, minlength=len(texts))


def _pairs(text: str) -> np.ndarray:
    data, offsets = tk.flatten(pa.array([text], pa.large_string()))
    h = _token_hashes(tk.Flat(0, data, offsets))[0]
    return np.unique(tk.mix(h[:-1] * U64(3) + h[1:])) if len(h) > 1 else np.unique(h)


#: Parts into which the frames and counter-examples fall, to be held out in turn.
FOLDS = 3


@functools.cache
def _training(seed: int) -> tuple[list[str], np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, classes, fold of each text's frame, n-grams).  Texts of licences are in no fold:
    one that was never seen is another licence."""
    texts, labels, made = _variants(seed)
    return texts, np.array(labels), np.array([k % FOLDS if k >= 0 else -1 for k in made]), _flat(texts)


class Sparse(NamedTuple):
    """A matrix of texts and features by its entries, in the order of both."""

    text: np.ndarray
    feature: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    def times(self, w: np.ndarray) -> np.ndarray:
        """texts x classes"""
        return _sums(self.text, w[self.feature] * self.value[:, None], self.shape[0])

    def transposed_times(self, d: np.ndarray, order: np.ndarray) -> np.ndarray:
        """features x classes; ``order`` sorts the entries by feature"""
        return _sums(self.feature[order], d[self.text[order]] * self.value[order, None], self.shape[1])


def _sums(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of each key, which ascend."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(keys):
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        out[keys[first]] = np.add.reduceat(rows, first, axis=0)
    return out


def _inputs(features: np.ndarray, grams: np.ndarray, owner: np.ndarray, n: np.ndarray) -> Sparse:
    """A feature counts once in a text, however often it occurs."""
    at = np.minimum(np.searchsorted(features, grams), len(features) - 1)
    known = features[at] == grams
    pairs = np.unique(owner[known] * len(features) + at[known])
    text = pairs // len(features)
    return Sparse(text, pairs % len(features), (1 / np.sqrt(np.maximum(n, 4))).astype(np.float32)[text], (len(n), len(features)))


def _fitted(seed: int, turns: int, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weights, bias) from the training texts of the mask ``fit``."""
    _, y, _, (grams, owner, n) = _training(seed)
    features, times = np.unique(grams[fit[owner]], return_counts=True)
    features = features[times >= 3]
    x = _inputs(features, grams, owner, n)
    keep = fit[x.text]
    x = Sparse(x.text[keep], x.feature[keep], x.value[keep], x.shape)
    order = np.argsort(x.feature, kind="stable")
    wanted = np.eye(len(CLASSES), dtype=np.float32)[y]
    weights, bias = np.zeros((len(features), len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32)
    m = [np.zeros_like(weights), np.zeros_like(bias)]
    v = [np.zeros_like(weights), np.zeros_like(bias)]
    for t in range(1, turns + 1):  # full-batch Adam with a small L2 penalty
        d = (_probabilities(x.times(weights) + bias, 1.0) - wanted) * fit[:, None] / np.float32(fit.sum())
        for p, g, a, b in ((weights, x.transposed_times(d, order) + 1e-5 * weights, m[0], v[0]), (bias, d.sum(0), m[1], v[1])):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= 0.15 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    return features, weights, bias


@functools.cache
def _held_out(seed: int, turns: int) -> tuple[np.ndarray, np.ndarray]:
    """(logits, classes) of the texts made of frames, each from a model that saw no text of its frame."""
    _, y, fold, (grams, owner, n) = _training(seed)
    z = np.zeros((len(y), len(CLASSES)), np.float32)
    for k in range(FOLDS):
        features, weights, bias = _fitted(seed, turns, fold != k)
        z[fold == k] = (_inputs(features, grams, owner, n).times(weights) + bias)[fold == k]
    return z[fold >= 0], y[fold >= 0]


@functools.cache
def trained(seed: int = 7, turns: int = 80) -> Model:
    """The model; the same for the same arguments.  It is fitted on all frames; the
    temperature and the threshold come from models that did not see the frame they judge."""
    z, y = _held_out(seed, turns)
    loss = lambda s: -np.log(_probabilities(z, s)[np.arange(len(y)), y] + 1e-12).mean()
    temperature = min((0.5 * 1.15**k for k in range(20)), key=loss)
    p = _probabilities(z, temperature)
    best = p.argmax(1)
    wrong = p.max(1)[(best != y) & (best < len(BODIES))]
    threshold = float(max(0.5, np.quantile(wrong, 0.5) if len(wrong) else 0.5))
    features, weights, bias = _fitted(seed, turns, np.ones(len(_training(seed)[1]), bool))
    return Model(features, weights, bias, float(temperature), threshold, float((best == y).mean()), {k: [_pairs(t) for t in (*BODIES[k], *NAMES[k], *IDS[k])] for k in BODIES})


def held_out_frames(seed: int = 7, turns: int = 80) -> dict[str, float]:
    """Accuracy by class on texts of frames that the judging model never saw."""
    z, y = _held_out(seed, turns)
    best = z.argmax(1)
    return {c: float((best[y == k] == k).mean()) for k, c in enumerate(CLASSES)}


def held_out_families(seed: int = 7, turns: int = 80, groups: int = 4) -> dict[str, float]:
    """For each family, the share of its variants that a model which never saw the family
    does not report as another one: it says ``unknown`` or ``none``."""
    texts, y, _, (grams, owner, n) = _training(seed)
    whole, out = trained(seed, turns), {}
    for k in range(groups):
        gone = [c for c in range(len(BODIES)) if c % groups == k]
        features, weights, bias = _fitted(seed, turns, ~np.isin(y, gone))
        p = _probabilities(_inputs(features, grams, owner, n).times(weights) + bias, whole.temperature)
        for c in gone:
            mine, right = np.flatnonzero(y == c), 0
            for t in mine.tolist():
                best = int(p[t, :-1].argmax())
                right += best >= len(BODIES) or p[t, -1] >= 0.5 or p[t, best] < whole.threshold or template_score(whole, CLASSES[best], texts[t]) < SHARED
            out[CLASSES[c]] = right / len(mine)
    return out


#: Share of the smaller side's word pairs that a paragraph and a template must have in common.
SHARED = 0.6


def template_score(model: Model, family: str, text: str) -> float:
    own = _pairs(text)
    return max((len(np.intersect1d(own, t, assume_unique=True)) / max(1, min(len(own), len(t))) for t in model.templates[family]), default=0.0)


_NAMES = ["doc_id", "line", "n_lines", "start", "end", "family", "probability", "template_score"]


def wrapped_runs(start: np.ndarray, end: np.ndarray, n: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first line, last line) of the runs of hard-wrapped lines, two lines at least; ``n``
    has the words of each line."""
    size = end - start
    on = (n[:-1] > 0) & (n[1:] > 0) & (doc[:-1] == doc[1:]) & (size[:-1] >= WRAPPED[0]) & (size[:-1] <= WRAPPED[1])
    edge = np.diff(np.concatenate(([0], on.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def notices(model: Model, flat: tk.Flat) -> list[tuple]:
    """(document, first line, lines, start byte, end byte, family, probability, template score)."""
    h, at_byte, _ = _token_hashes(flat)
    start, end, at = line_ranges(flat)
    first = np.searchsorted(at_byte, start)
    n = np.searchsorted(at_byte, end) - first
    line = np.repeat(np.arange(len(start)), n)
    doc = np.repeat(np.arange(flat.n), np.diff(at))
    a, b = wrapped_runs(start, end, n, doc)
    run = np.full(len(start), -1)
    for x, y in zip(a.tolist(), b.tolist()):
        run[x : y + 1] = x
    inside = run[line] >= 0
    number = np.searchsorted(a, run[line][inside])
    words = np.bincount(number, minlength=len(a))
    joined = _probabilities(_logits(model, *_grams(h[inside], number), words), model.temperature)
    alone = _probabilities(_logits(model, *_grams(h, line), n), model.temperature)

    def judged(p: np.ndarray, x: int, y: int) -> tuple:
        text = flat.data[start[x] : end[y]].tobytes().decode()
        best = int(p[:-1].argmax())
        family, score, sure = CLASSES[best], 0.0, float(p[best])
        if best < len(BODIES):
            score = template_score(model, family, text)
            if sure < model.threshold or score < SHARED:
                family = "unknown"
        if family == "unknown":
            sure = float(1 - p[-1])
        d = int(doc[x])
        return d, x - int(at[d]), y - x + 1, int(start[x]), int(end[y]), family, round(sure, 4), round(score, 4)

    out, done = [], np.zeros(len(start), bool)
    for k in np.flatnonzero(joined[:, -1] < 0.5).tolist():
        x, y = int(a[k]), int(b[k])
        while x < y and alone[x, -1] >= 0.5:  # prose that runs into the notice
            x += 1
        while x < y and alone[y, -1] >= 0.5:
            y -= 1
        row = judged(joined[k], x, y)
        if x < y and row[5] != "unknown":  # a run is one notice only if it is of a known family
            out.append(row)
            done[x : y + 1] = True
    out += [judged(alone[k], k, k) for k in np.flatnonzero((alone[:, -1] < 0.5) & (n > 0) & ~done).tolist()]
    return sorted(out)


def _scan(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for flat in tk.chunks(b.column("text")):
                rows = notices(model, flat)
                if rows:
                    signs = np.append(0, np.cumsum(flat.data & 0xC0 != 0x80))
                    d, line, lines, lo, hi, *rest = (np.array(c) for c in zip(*rows))
                    before = signs[flat.offsets[d]]
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64())
                    values = (line, lines, signs[lo] - before, signs[hi] - before, *rest)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(flat.first + d)), *(pa.array(c.tolist(), t) for c, t in zip(values, kinds))], _NAMES)

    return run


def scan_licences(docs: DataFrame) -> DataFrame:
    """(doc_id, line, n_lines, start, end, family, probability, template_score), a row a paragraph
    that is a licence notice.  ``line`` counts from 0, offsets are code points."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow(texts, _scan(trained()), "doc_id long, line long, n_lines long, start long, end long, family string, probability double, template_score double")
