"""Licence scans by a trained paragraph classifier.

A paragraph is a line with a word; long lines are read in overlapping windows of two cells of CELL
words, so nothing is cut off.  A cell's features are the word 1-, 2- and 3-grams of a vocabulary that it
holds, each counted once; a sparse multinomial logistic regression (L1) gives each licence family, `unknown` (a
licence, no known family) and `none` a probability.  It is trained here on the notices in NOTICES,
cropped, thinned and set among other words, and the names in NAMES set in WORDINGS, against lines of a bounded sample of SAMPLE documents
that mention no licence.  A temperature, fitted on held-out variants and on wordings that the fit never
saw, calibrates the probabilities; a family whose calibrated probability stays below the level that
MISSED of the held-out notices miss counts as `unknown`.  A predicted family is confirmed where the
window holds AGREE or more of the word pairs of one of the family's notices or names, or where that
share of a window of WRAPPED words or more stands in a notice, as in wrapped licence texts; an unconfirmed one counts as `unknown` if it is
surely a licence (SURE), else as none.

The scan is narrow: no shuffle, and the model that goes to the tasks is bounded by NOTICES.
Defined cases: null, empty and blank texts have no paragraphs and no licence; a null doc_id and
repeated rows each get their row; other columns are not read; words are compared with ASCII
capitals folded and ASCII punctuation as space.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import coded_words

CELL = 24
SAMPLE, SAMPLE_LINES, SAMPLE_CHARS = 200, 20, 400
VARIANTS, NAMED_VARIANTS = 32, 4
MISSED = 0.01
AGREE = 0.7
SURE = 0.9
WRAPPED = 8
L1 = 5e-5
#: Bytes of text handled at a time.
SLICE = 4 << 20
FOUND = "doc_id bigint, paragraph int, family string, probability double, similarity double, confirmed boolean"
SUMMARY = "doc_id bigint, n_paragraphs bigint, n_licensed bigint, n_unknown bigint, families string"

#: Public licence notices by family.
NOTICES = {
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.",
        "Dedicated to the public domain under CC0 1.0.",
    ),
    "EPL": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.',
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "unknown": (
        "All rights reserved. No part of this work may be reproduced or distributed without prior written permission.",
        "Licensed under a proprietary license; see the license agreement for terms and conditions.",
        "The use of this material is subject to the terms of the license agreement.",
        "Distributed under the terms of the license that accompanies this work.",
    ),
}
#: Names of licences by family.  Each also counts as a template.
NAMES = {
    "AGPL": ("GNU Affero General Public License", "GNU AGPL", "AGPLv3", "AGPL-3.0"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0", "Apache Software License"),
    "BSD": ("BSD license", "BSD 3-Clause License", "BSD-2-Clause", "New BSD License", "BSD-style license"),
    "CC-BY": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 3.0"),
    "CC-BY-NC": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC BY-NC 3.0"),
    "CC-BY-SA": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC BY-SA 3.0"),
    "CC0": ("CC0", "CC0 1.0 Universal", "Creative Commons Zero"),
    "EPL": ("Eclipse Public License 2.0", "Eclipse Public License", "EPL-2.0"),
    "GPL": ("GNU General Public License", "GNU GPL", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0", "GPL version 2"),
    "ISC": ("ISC License", "ISC licence"),
    "LGPL": ("GNU Lesser General Public License", "GNU LGPL", "LGPLv3", "LGPL-2.1"),
    "MIT": ("MIT License", "MIT licence", "MIT-licensed"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License", "MPL 2.0"),
}
#: Wordings that names are set into for the fit, and others that only calibrate.
WORDINGS = (
    "{}", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.",
    "Available under {}.", "This software is {} licensed.", "License: {}", "Copyright 2020 the authors, {}.", "under a {} licence",
    "It is free software under the {}, either version 2 of the license, or any later version.", "{} or later", "dedicated to the public domain ({})",
)
HELD_WORDINGS = (
    "Made available under the {}.", "The code is published under the {} or later.", "All files are covered by the {}.",
    "Use of this file is governed by the {}.", "Our library is {} and free to use.",
)
#: Sentences that mention such words and are no licence.
OTHER = (
    "He lost his driving license on the way home and had to apply for a new one.",
    "The general public was invited to see the work of the foundation.",
    "Students at MIT released a version of the report under the title of the first lecture.",
    "The software project was free for any person in the public library.",
    "The terms of the agreement and the following conditions were published by the state.",
    "An apache helicopter flew over the valley in the morning.",
    "The above list of the source and the copy of the file were of use to the author.",
    "A license plate was found with the following numbers on it.",
    "This version of the work is permitted to be used without a fee in the state.",
)
MENTIONS = r"(?i)licen[sc]|copyright|spdx|hereby granted|rights reserved|redistribut|public domain"
FAMILIES = sorted(set(NOTICES) - {"unknown"})
CLASSES = ["none", "unknown", *FAMILIES]
_SPACED = bytes(c if chr(c).isalnum() or c > 127 or c == 10 else 32 for c in range(256))


def plain(text: str | bytes | None) -> bytes:
    """ASCII capitals folded, ASCII punctuation and white space but \\n as space."""
    data = text.encode() if isinstance(text, str) else text or b""
    return data.lower().translate(_SPACED)


def _pairs(words: list[bytes]) -> set:
    return set(itertools.pairwise(words)) if len(words) > 1 else set(words)


class Model:
    """Vocabulary of n-grams (as numbers over word numbers), weights by class, temperature, level."""

    def __init__(self, words: dict[bytes, int], keys: np.ndarray) -> None:
        self.words, self.keys = words, keys
        self.weights = np.zeros((len(keys) + 1, len(CLASSES)), np.float32)
        self.bias = np.zeros(len(CLASSES), np.float32)
        self.temperature, self.level = 1.0, 0.5

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of the texts in turn (0: not in the vocabulary), and where each text's begin."""
        found, numbers, places = coded_words(texts)
        own = np.fromiter((self.words.get(w, 0) for w in found), np.int64, len(found))
        return (own[numbers] if len(numbers) else np.zeros(0, np.int64)), places

    def grams(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first word, feature) of every n-gram of the vocabulary inside one owner."""
        base, at, out = len(self.words) + 1, np.flatnonzero(ids), []
        key = ids[at]
        for n in range(3):
            if n:
                nxt = at + n
                ok = nxt < len(ids)
                at, key, nxt = at[ok], key[ok], nxt[ok]
                ok = (ids[nxt] > 0) & (owner[nxt] == owner[at])
                at, key = at[ok], key[ok] * base + ids[nxt[ok]]
            where = np.minimum(np.searchsorted(self.keys, key + n * base**3), len(self.keys) - 1)
            hit = self.keys[where] == key + n * base**3
            out.append((at[hit], where[hit]))
        return np.concatenate([a for a, _ in out]), np.concatenate([f for _, f in out])

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        z = scores / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _variants(words: list[bytes], fill: list[list[bytes]], rng: np.random.Generator, count: int) -> list[list[bytes]]:
    out = [list(words)]
    while len(out) < count:
        n = len(words)
        keep = n if n < 12 else int(rng.integers(8, n + 1))
        first = int(rng.integers(0, n - keep + 1))
        own = [w for w in words[first : first + keep] if n < 8 or rng.random() > 0.04]
        if fill and rng.random() < 0.5:
            more = fill[int(rng.integers(len(fill)))]
            cut = int(rng.integers(0, min(len(more), 2 * CELL - 8) + 1))
            own = more[:cut] + own if rng.random() < 0.5 else own + more[:cut]
        out.append(own)
    return out


def train(lines: list[str], seed: int = 7) -> Model:
    """Fits the classifier to the notices against `lines`, which hold no licence."""
    rng = np.random.default_rng(seed)
    notices = [(c, plain(t).split()) for c, ts in NOTICES.items() for t in ts]
    named = [(c, plain(w.format(n)).split()) for c, ns in NAMES.items() for n in ns for w in WORDINGS]
    calibrating = [(c, plain(w.format(n)).split()) for c, ns in NAMES.items() for n in ns for w in HELD_WORDINGS]
    other = [plain(t).split() for t in OTHER]
    words = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in notices + named for w in ws} | {w for ws in other for w in ws}))}
    base = len(words) + 1
    keys = set()
    for ws in [ws for _, ws in notices + named] + other:
        ids = [words[w] for w in ws]
        for i in range(len(ids)):
            keys.add(ids[i])
            if i + 1 < len(ids):
                keys.add(base**3 + ids[i] * base + ids[i + 1])
            if i + 2 < len(ids):
                keys.add(2 * base**3 + (ids[i] * base + ids[i + 1]) * base + ids[i + 2])
    model = Model(words, np.array(sorted(keys), np.int64))
    fill = [ws for ws in (plain(x).split() for x in lines) if ws]
    rows = [(CLASSES.index(c), v) for c, ws in notices for v in _variants(ws, fill, rng, VARIANTS)]
    rows += [(CLASSES.index(c), v) for c, ws in named for v in _variants(ws, fill, rng, NAMED_VARIANTS)]
    rows += [(0, v) for ws in other for v in _variants(ws, fill, rng, VARIANTS)]
    rows += [(0, ws[i : i + 2 * CELL]) for ws in fill for i in range(0, len(ws), 2 * CELL)]
    rng.shuffle(rows)
    fitted = len(rows)
    rows += [(CLASSES.index(c), v) for c, ws in calibrating for v in _variants(ws, fill, rng, NAMED_VARIANTS)]
    ids, places = model.numbers([b" ".join(v) for _, v in rows])
    owner = np.repeat(np.arange(len(rows)), np.diff(places))
    at, feature = model.grams(ids, owner)
    x = np.zeros((len(rows), len(model.keys)), np.float32)
    x[owner[at], feature] = 1
    y = np.array([c for c, _ in rows])
    held = (np.arange(len(rows)) % 5 == 0) | (np.arange(len(rows)) >= fitted)
    hot = np.eye(len(CLASSES), dtype=np.float32)[y[~held]]
    xt, w, b = x[~held], np.zeros((len(model.keys), len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32)
    step = 1.0 / (0.25 * np.mean((xt * xt).sum(axis=1)) + 1)
    vw, vb = w.copy(), b.copy()
    for t in range(500):  # accelerated proximal gradient: L1 keeps the weights sparse
        z = xt @ vw + vb
        z = np.exp(z - z.max(axis=1, keepdims=True))
        slope = (z / z.sum(axis=1, keepdims=True) - hot) / len(xt)
        new = vw - 4 * step * (xt.T @ slope)
        new = np.sign(new) * np.maximum(np.abs(new) - 4 * step * L1, 0)
        nb = vb - 4 * step * slope.sum(axis=0)
        vw, vb, w, b = new + t / (t + 3) * (new - w), nb + t / (t + 3) * (nb - b), new, nb
    model.weights[:-1], model.bias = w, b
    scores = x[held] @ w + b
    truth = y[held]

    def loss(temperature: float) -> float:
        model.temperature = temperature
        return -float(np.log(np.maximum(model.probabilities(scores)[np.arange(len(truth)), truth], 1e-9)).mean())

    model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
    known = truth > 1
    own = model.probabilities(scores)[np.flatnonzero(known), truth[known]]
    model.level = float(np.clip(np.quantile(own, MISSED), 0.2, 0.9)) if len(own) else 0.5
    return model


def sample_lines(docs: DataFrame) -> list[str]:
    """Lines of SAMPLE documents without mention of a licence; the bound is documents x lines x characters.
    A bound on the hash leaves about twice as many documents, whose texts alone are split and sorted."""
    order = F.pmod(F.xxhash64("doc_id", F.lit("licence")), F.lit(1 << 40))
    share = min(1.0, 2 * (SAMPLE + 50) / max(1, docs.count()))
    few = (
        docs.filter(F.col("text").isNotNull() & (order < int(share * (1 << 40))))
        .select(order.alias("h"), "text")
        .select("h", F.transform(F.slice(F.split("text", "\n", SAMPLE_LINES + 1), 1, SAMPLE_LINES), lambda x: F.substring(x, 1, SAMPLE_CHARS)).alias("lines"))
        .select("h", F.filter("lines", lambda x: ~x.rlike(MENTIONS)).alias("lines"))
        .orderBy("h", "lines")
        .limit(SAMPLE)
    )
    return [x for row in few.collect() for x in row["lines"]]


class Scanner:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.templates = {c: [_pairs(plain(t).split()) for t in (*ts, *NAMES.get(c, ()))] for c, ts in NOTICES.items()}

    def similarity(self, family: str, words: list[bytes]) -> float:
        """The most of a template that the words hold; for WRAPPED words or more also the most of theirs that a template holds."""
        pairs = _pairs(words)
        own, most = pairs | set(words), len(pairs) if len(words) >= WRAPPED else 1 << 30
        return max(max(len(t & own) / len(t), len(t & pairs) / most) for t in self.templates[family])

    def scan(self, texts: list[bytes]) -> tuple[list[int], list[tuple[int, int, str, float, float, bool]]]:
        """Paragraphs of each text, and (text, line, family, probability, similarity, confirmed) in order."""
        m = self.model
        lines, of, nth = [], [], []
        for i, t in enumerate(texts):
            own = plain(t).split(b"\n")
            lines += own
            of += [i] * len(own)
            nth += range(len(own))
        counts = np.zeros(len(texts), np.int64)
        ids, places = m.numbers(lines)
        lens = np.diff(places)
        # a line of punctuation alone still has a word
        blank = np.flatnonzero(lens == 0)
        filled = lens > 0
        if len(blank):
            raw = [x for t in texts for x in t.split(b"\n")]
            filled[blank] = [bool(raw[j].split()) for j in blank]
        np.add.at(counts, np.array(of, np.int64)[filled], 1)
        if not len(ids):
            return counts.tolist(), []
        line = np.repeat(np.arange(len(lines)), lens)
        # cells of CELL words within each line; a window is a cell and the next of its line
        cells_of = np.maximum((lens + CELL - 1) // CELL, 0)
        first = np.concatenate(([0], np.cumsum(cells_of)))
        cell = first[line] + (np.arange(len(ids)) - places[line]) // CELL
        at, feature = m.grams(ids, line)
        if not len(at):
            return counts.tolist(), []
        held = np.unique(cell[at] * len(m.keys) + feature)
        starts = np.flatnonzero(np.diff(held // len(m.keys), prepend=-1))
        live = held[starts] // len(m.keys)
        sums = np.add.reduceat(m.weights[held % len(m.keys)], starts)
        cell_line = np.repeat(np.arange(len(lines)), cells_of)
        nxt = np.searchsorted(live, live + 1)
        joined = (nxt < len(live)) & (live[np.minimum(nxt, len(live) - 1)] == live + 1) & (cell_line[live] == cell_line[np.minimum(live + 1, len(cell_line) - 1)])
        scores = sums + m.bias
        scores[joined] += sums[nxt[joined]]
        p = m.probabilities(scores)
        best: dict[tuple[int, int, str], tuple[float, float, bool]] = {}
        for k in np.flatnonzero(p[:, 0] < 0.5).tolist():
            j = int(cell_line[live[k]])
            begin = (int(live[k]) - int(first[j])) * CELL
            words = lines[j].split()[begin : begin + 2 * CELL]
            c = 1 + int(np.argmax(p[k, 1:]))
            name, probability, licence = CLASSES[c], float(p[k, c]), 1 - float(p[k, 0])
            likeness = self.similarity(name, words)
            confirmed = name != "unknown" and probability >= m.level and likeness >= AGREE
            if not confirmed:
                if licence < SURE:
                    continue
                name, probability = "unknown", licence
            at_ = (of[j], nth[j], name)
            best[at_] = max(best.get(at_, (0.0, 0.0, False)), (probability, likeness, confirmed))
        # a paragraph with a confirmed family has no unknown one beside it
        sure = {k[:2] for k, v in best.items() if v[2]}
        return counts.tolist(), [(*k, *v) for k, v in sorted(best.items()) if v[2] or k[:2] not in sure]


def _batches(batch: pa.RecordBatch):
    ids, texts = batch.column(0), batch.column(1)
    at, n = 0, len(texts)
    while at < n:
        part, size, first = [], 0, at
        while at < n and size < SLICE:
            part.append(texts[at].as_py() or b"")
            size += len(part[-1])
            at += 1
        yield ids.slice(first, at - first).to_pylist(), part


def _mapped(docs: DataFrame, model: Model | None, rows, schema: str) -> DataFrame:
    model = model or train(sample_lines(docs))
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    types_ = [kinds[x.split()[1]] for x in schema.split(", ")]

    def scan(batches):
        own = Model.__new__(Model)
        own.__dict__.update(sent.value)
        scanner = Scanner(own)
        for batch in batches:
            for ids, texts in _batches(batch):
                out = list(zip(*rows(ids, *scanner.scan(texts)), strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types_, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(scan, schema)


def findings(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per paragraph and family found in it."""
    return _mapped(docs, model, lambda ids, counts, found: [(ids[i], *rest) for i, *rest in found], FOUND)


def summary(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: paragraphs, those with a licence, those with an unknown one, families."""

    def rows(ids, counts, found):
        of: dict[int, list] = {}
        for f in found:
            of.setdefault(f[0], []).append(f)
        for i, (doc_id, n) in enumerate(zip(ids, counts, strict=True)):
            own = of.get(i, [])
            yield doc_id, n, len({f[1] for f in own}), len({f[1] for f in own if f[2] == "unknown"}), ",".join(sorted({f[2] for f in own}))

    return _mapped(docs, model, rows, SUMMARY)


def query(docs: DataFrame) -> DataFrame:
    return summary(docs)
