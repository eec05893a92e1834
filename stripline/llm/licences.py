"""Licence scan: a trained paragraph classifier whose findings are confirmed by templates.

Paragraphs are lines.  A sparse multinomial logistic regression over hashed word n-grams tells the licence families apart from an unknown class, which it
learns from paragraphs of the documents themselves.  A temperature fitted on held-out paragraphs calibrates its probabilities, and the acceptance
threshold is the lowest that lets through at most a given share of held-out unknown paragraphs.  An accepted paragraph counts once the word pairs of a
template of that family confirm it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripline.llm.common import LOWER, documents, flat, groups, mix, slices, span_hashes

# Notices by which works name their licence, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0"),
    "mit": (
        "Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT"),
    "bsd": (
        "Licensed under the BSD 3-Clause License.", "Released under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause"),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later"),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0"),
    "cc-by": (
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License."),
    "public-domain": (
        "Released under CC0 1.0 Universal.", "This work is in the public domain.", "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "proprietary": (
        "All rights reserved.", "Copyright. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "This material may not be published, broadcast, rewritten, or redistributed without permission.",
        "Confidential and proprietary. Unauthorized copying is strictly prohibited."),
}
BITS, ORDERS = 16, 3
SAMPLE_DOCS, SAMPLE_LINES = 2000, 6000   # bound of the sample that the unknown class is learned from
LINE_CHARS = 2000                        # of a longer line, a stretch of so many characters is learned from
COPIES = 40                              # altered copies of each template
FALSE_ACCEPTS, CONFIRMED = 0.001, 0.6

# A word is a run of ASCII letters and digits or of other bytes above ASCII.
INK = np.zeros(256, bool)
INK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def line_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of some texts: row of each, its start in the bytes; and hash and line of each word."""
    breaks = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate([breaks + 1, off[:-1]]), kind="stable")
    row = np.repeat(np.arange(len(off) - 1), 1 + np.diff(np.searchsorted(breaks, off)))
    if not len(buf):
        return row, starts, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ink = INK[buf]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    cut = off[(off > 0) & (off < len(buf))]
    first[cut] |= ink[cut]
    last[cut - 1] |= ink[cut - 1]
    a, z = np.flatnonzero(first), np.flatnonzero(last) + 1
    return row, starts, span_hashes(LOWER[buf], a, z), np.searchsorted(starts, a, "right") - 1


def ngrams(word: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and line of all word n-grams up to ``ORDERS`` words that stay in one line, ordered by line."""
    hashes, lines, h = [word], [line], word
    for k in range(1, ORDERS):
        h = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[k:])
        same = line[k:] == line[:-k]
        hashes.append(h[same])
        lines.append(line[:-k][same])
    x = np.concatenate(lines)
    order = np.argsort(x, kind="stable")
    return np.concatenate(hashes)[order], x[order]


def pairs(text: str) -> frozenset[int]:
    """Hashes of the word pairs of a line, and of its single words if it has one only."""
    b = np.frombuffer(text.encode(), np.uint8)
    _, _, word, line = line_words(b, np.array([0, len(b)]))
    if len(word) < 2:
        return frozenset(word.tolist())
    return frozenset(mix(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:]).tolist())


def confirmed(text: str, proofs: Sequence[frozenset[int]]) -> tuple[float, int]:
    """Best overlap of a paragraph with some templates (shared word pairs over those of the shorter one), and the number of that template."""
    p = pairs(text)
    score = [len(p & q) / max(1, min(len(p), len(q))) if p and len(p & q) >= min(2, len(q)) else 0.0 for q in proofs]
    best = max(range(len(score)), key=lambda i: (score[i], -i))
    return score[best], best


class Model:
    """Weights by hashed n-gram (column 0: unknown), temperature and threshold."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias, self.temperature, self.threshold = weights, bias, 1.0, 0.5

    def logits(self, h: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
        out = np.tile(self.bias, (n, 1))
        if len(h):
            at = groups(line)
            count = np.diff(np.append(at, len(line)))
            out[line[at]] += np.add.reduceat(self.weights[(h & np.uint64((1 << BITS) - 1)).astype(np.int64)], at) / np.sqrt(count)[:, None]
        return out

    def probabilities(self, *args) -> np.ndarray:
        z = self.logits(*args) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def altered(text: str, rng: np.random.Generator, words: Sequence[str]) -> str:
    """A template with years, names or other words around it, and now and then a word less."""
    w = text.split()
    if len(w) > 4 and rng.random() < 0.4:
        w.pop(int(rng.integers(len(w))))
    if len(w) > 12 and rng.random() < 0.4:
        w = w[:int(rng.integers(8, len(w)))]
    if rng.random() < 0.3:
        w = ["Copyright", str(int(rng.integers(1980, 2030))), *w]
    if rng.random() < 0.4 and words:
        extra = [str(x) for x in rng.choice(words, int(rng.integers(1, 5)))]
        w = [*extra, *w] if rng.random() < 0.5 else [*w, *extra]
    return " ".join(w)


def train(unknown: Sequence[str], templates: Mapping[str, tuple[str, ...]] = TEMPLATES, seed: int = 5, rounds: int = 80) -> Model:
    """Fit on altered templates and unknown lines; one line in four is held out for temperature and threshold."""
    families = tuple(templates)
    rng = np.random.Generator(np.random.PCG64(seed))
    every = [pairs(t) for v in templates.values() for t in v]
    unknown = [x for x in unknown if confirmed(x, every)[0] < CONFIRMED]  # notices among the documents' lines aren't unknown
    words = sorted({w for x in unknown[:500] for w in x.split()})[:2000]
    lines = [(altered(t, rng, words) if k else t, i + 1) for i, f in enumerate(families) for t in templates[f] for k in range(COPIES)]
    lines += [(x, 0) for x in unknown] + [(" ".join(rng.choice(words, 6)), 0) for _ in range(200 if words else 0)]
    text, y = "\n".join(x.replace("\n", " ") for x, _ in lines), np.array([k for _, k in lines])
    b = np.frombuffer(text.encode(), np.uint8)
    h, line = ngrams(*line_words(b, np.array([0, len(b)]))[2:])
    held = np.arange(len(y)) % 4 == 3
    classes = len(families) + 1
    model = Model(np.zeros((1 << BITS, classes), np.float32), np.zeros(classes, np.float32))
    use = ~held[line]
    col, at = (h[use] & np.uint64((1 << BITS) - 1)).astype(np.int64), line[use]
    size = np.sqrt(np.bincount(at, minlength=len(y)))[:, None]
    target = np.eye(classes)[y]
    weight = np.where(held, 0, 1 / np.bincount(y[~held], minlength=classes)[y] / classes)[:, None]  # each class counts the same
    distinct, inverse = np.unique(col, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    bounds = groups(inverse[order])
    seen_w, seen_b = np.full((len(distinct), classes), 1e-8), np.full(classes, 1e-8)
    for _ in range(rounds):  # AdaGrad on the whole sample
        p = model.probabilities(h[use], at, len(y))
        g = (p - target) * weight
        g_w = np.add.reduceat((g / np.maximum(size, 1))[at][order], bounds) + 1e-6 * model.weights[distinct]
        seen_w += g_w ** 2
        seen_b += g.sum(0) ** 2
        model.weights[distinct] -= (0.5 * g_w / np.sqrt(seen_w)).astype(np.float32)
        model.bias -= (0.1 * g.sum(0) / np.sqrt(seen_b)).astype(np.float32)
    z = model.logits(h, line, len(y))[held]
    truth = y[held]

    def loss(temperature: float) -> float:
        s = z / temperature
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(truth)), truth]).mean())
    model.temperature = min((0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    p = model.probabilities(h, line, len(y))[held]
    wrong = np.sort(p[truth == 0][:, 1:].max(1))[::-1] if (truth == 0).any() else np.zeros(1)
    model.threshold = float(min(0.99, max(0.5, wrong[int(FALSE_ACCEPTS * len(wrong))] + 1e-6)))
    return model


SCHEMA = ("doc_id long, n_paragraphs long, n_licence long, n_unconfirmed long, families string, probability double, "
          "found array<struct<start:long,family:string,probability:double,template:int>>")


def scan_licences(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES,
                  line_chars: int = LINE_CHARS) -> DataFrame:
    """Licence notices of every document.

    docs: ``doc_id, text`` (null or empty: one empty paragraph); ``templates``: notices by family.  Returns a row for each row: ``n_paragraphs``, ``n_licence`` (confirmed notices),
    ``n_unconfirmed`` (accepted by the classifier, not by a template), ``families`` (confirmed, sorted, by comma), the largest ``probability`` of a
    confirmed one (null: none) and the confirmed notices ``found``: byte ``start``, ``family``, ``probability`` and the ``template`` that is nearest.
    The unknown class is learned from at most ``sample_lines`` lines, picked by a hash from all lines of about ``sample_docs`` documents, which a hash picks too;
    of a line longer than ``line_chars`` the hash picks a stretch.  All else covers all.
    """
    # an even sample by hash, of about the size asked for at any number of documents, so that few rows reach the driver
    share = min(1.0, 1.5 * sample_docs / max(1, docs.count()))
    place = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "text"), F.lit(1 << 40))
    some = docs.filter(F.col("text").isNotNull()).select(place.alias("o"), "text").filter(F.col("o") < int(share * (1 << 40)))
    each = some.select("o", F.posexplode(F.split("text", "\n")).alias("at", "line")).filter(F.trim("line") != "").withColumn("h", F.xxhash64("o", "at", "line"))
    begin = F.pmod("h", F.greatest(F.lit(1), F.length("line") - line_chars + 1)).cast("int")
    picked = each.select("h", F.substring("line", begin + 1, F.lit(line_chars)).alias("line")).orderBy("h", "line").limit(sample_lines)
    lines = [r.line for r in picked.collect()]
    model, families = train(lines, templates), tuple(templates)
    proofs = {f: [pairs(t) for t in v] for f, v in templates.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = flat(batch.column(1))
            total, found, doubtful = [], [], []
            for i, j in slices(off):
                part, local = buf[off[i]:off[j]], off[i:j + 1] - off[i]
                row, starts, word, line = line_words(part, local)
                total += np.bincount(row, minlength=j - i).tolist()
                got: list[list[dict]] = [[] for _ in range(j - i)]
                no = [0] * (j - i)
                if len(word):
                    p = model.probabilities(*ngrams(word, line), len(starts))
                    best = p[:, 1:].argmax(1) + 1
                    sure = (p[np.arange(len(p)), best] >= model.threshold) & (best > 0)
                    data = part.tobytes()
                    for k in np.flatnonzero(sure).tolist():
                        end = starts[k + 1] if k + 1 < len(starts) and row[k + 1] == row[k] else local[row[k] + 1]
                        family = families[best[k] - 1]
                        score, template = confirmed(data[starts[k]:end].decode(errors="replace"), proofs[family])
                        if score >= CONFIRMED:
                            got[row[k]].append({"start": int(starts[k] - local[row[k]]), "family": family, "probability": float(p[k, best[k]]), "template": template})
                        else:
                            no[row[k]] += 1
                found += got
                doubtful += no
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(total, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array(doubtful, pa.int64()),
                pa.array([",".join(sorted({y["family"] for y in x})) for x in found], pa.string()),
                pa.array([max((y["probability"] for y in x), default=None) for x in found], pa.float64()),
                pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("template", pa.int32())])))],
                [c.split()[0] for c in SCHEMA.split(", ")])

    return documents(docs).mapInArrow(run, SCHEMA)
