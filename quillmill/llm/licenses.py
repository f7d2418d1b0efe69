"""Licence families of paragraphs, by sparse n-gram logistic regression confirmed against templates.

A paragraph (a line of the text, or adjacent lines that share 2-grams with the templates, as a wrapped notice has
them; comment marks are no words) is classified by softmax regression over the word 1- to 3-grams that occur in
any template; class 0 is ``unknown``, trained on corpus paragraphs and on shuffled licence words, and all
probabilities are calibrated by temperature on a fold that training doesn't see. The likeliest family counts only
if one of its templates is largely contained in the paragraph, with the words that no other family's templates have.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

UNKNOWN = "unknown"
#: Usual public notices of each family.
TEMPLATES = {
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-NC-ND": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ],
    "CC-BY-NC-SA": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "EPL": [
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "reserved": [
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission.",
    ],
}
#: Words of the templates at most whose distinctive words must be there; longer ones tell by their 2-grams alone.
BRIEF = 20
FAMILIES = [UNKNOWN, *sorted(TEMPLATES)]


def _grams(h: np.ndarray, of: np.ndarray):
    """(paragraph, hash) of all 1- to 3-grams that lie in one paragraph."""
    out, at = [T.mix64(h)], [of]
    for n in (2, 3):
        if len(h) < n:
            break
        g = T.ngram_hashes(h, n)
        same = of[: len(g)] == of[n - 1 :]
        out.append(g[same] + np.uint64(n))
        at.append(of[: len(g)][same])
    return np.concatenate(at), np.concatenate(out)


def paragraphs(parts: list):
    """Document, start and end byte of every paragraph with a word; the words' paragraph and hash; the raw bytes and offsets."""
    raw, off = T.joined(parts)
    data = T.LOWER[raw]
    p_start, p_end = T.words(data, np.arange(256) != 10)
    starts, ends = T.words(data, T.WORDY)
    of = np.searchsorted(p_start, starts, side="right") - 1
    used, of = np.unique(of, return_inverse=True)
    doc = np.searchsorted(off, p_start[used], side="right") - 1
    return doc, p_start[used], p_end[used], of, T.word_hashes(data, starts, ends), raw, off


@dataclass
class Model:
    vocabulary: np.ndarray
    weights: np.ndarray  # a row for each n-gram, the bias last
    temperature: float
    templates: list  # (family index, sorted 2-gram hashes, of a brief template the sorted hashes of words that no other family's templates have)
    _table: np.ndarray | None = None

    def hits(self, of: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (paragraph, n-gram index) of the n-grams in the vocabulary."""
        if self._table is None:
            self._table = np.zeros(1 << 20, dtype=bool)
            self._table[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        at, g = _grams(h, of)
        maybe = self._table[(g & np.uint64((1 << 20) - 1)).astype(np.int64)]
        at, g = at[maybe], g[maybe]
        i = np.minimum(np.searchsorted(self.vocabulary, g), len(self.vocabulary) - 1)
        found = self.vocabulary[i] == g
        keys = np.unique(at[found] * np.int64(len(self.vocabulary)) + i[found])
        return keys // len(self.vocabulary), keys % len(self.vocabulary)

    def probabilities(self, at: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
        z = np.stack([np.bincount(at, weights=self.weights[gram, c], minlength=n) for c in range(self.weights.shape[1])], axis=1) + self.weights[-1]
        return _softmax(z / self.temperature)

    def contained(self, h: np.ndarray) -> np.ndarray:
        """For each family, of its template that is most like the paragraph (Dice index of 2-grams): likeness and contained share.

        A brief template counts only if the paragraph has half of its distinctive words at least.
        """
        own, words, out = np.unique(T.ngram_hashes(h, 2)), np.unique(h), np.zeros((len(FAMILIES), 2))
        for f, t, name in self.templates:
            if 2 * np.isin(name, words, assume_unique=True).sum() >= len(name):
                both = np.isin(t, own, assume_unique=True).sum()
                out[f] = max(tuple(out[f]), (2 * both / (len(t) + len(own)), both / len(t)))
        return out

    def runs(self, doc: np.ndarray, start: np.ndarray, end: np.ndarray, of: np.ndarray, h: np.ndarray) -> list[tuple[int, int]]:
        """First and last line of each run of two adjacent lines or more, if every pair of neighbours or line has a template's 2-gram.

        A line without a word, such as a blank one, ends a run; so does one that has no template's 2-gram inside or
        across its ends.
        """
        if len(doc) < 2:
            return []
        known = np.unique(np.concatenate([t for _, t, _ in self.templates]))
        hit = np.isin(T.ngram_hashes(h, 2), known) if len(h) > 1 else np.zeros(0, dtype=bool)
        near = (doc[1:] == doc[:-1]) & (start[1:] == end[:-1] + 1)
        a, b = of[:-1][hit], of[1:][hit]
        same = (a == b) | near[np.minimum(a, len(near) - 1)]
        some = np.zeros(len(doc), dtype=bool)
        some[a[same]] = some[b[same]] = True
        linked = near & some[1:] & some[:-1]
        step = np.diff(linked.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))

    def likeness(self, h: np.ndarray, family: int) -> float:
        return float(self.contained(h)[family, 0])

    def confirmed(self, p: np.ndarray, h: np.ndarray, share: float) -> int:
        """The classifier's likeliest family, if one of its templates is contained to ``share``; else 0.

        Another family's template that fits better by a tenth or more speaks against it.
        """
        like, inside = self.contained(h).T
        family, like = int(np.argmax(p)), np.where(inside >= share, like, 0)
        return family if family and like[family] > 0 and like[family] >= like.max() - 0.1 else 0


def _parts(runs: list[tuple[int, int]], alone: dict):
    """What is left of each run between the lines that are findings by themselves, if that is two lines or more."""
    for i, j in runs:
        first = i
        for k in range(i, j + 2):
            if k > j or k in alone:
                if k - first > 1:
                    yield first, k - 1
                first = k + 1


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _template_words() -> list[tuple[int, np.ndarray]]:
    return [(FAMILIES.index(f), paragraphs([t.encode()])[4]) for f in sorted(TEMPLATES) for t in TEMPLATES[f]]


def _examples(rng: np.random.Generator, copies: int):
    """Damaged copies of templates, and shuffled licence words as unknown."""
    known = _template_words()
    pool = np.concatenate([h for _, h in known])
    for family, h in known:
        yield family, h
        for _ in range(copies):
            keep = h[rng.random(len(h)) > rng.choice([0.0, 0.1, 0.2])]
            noise = rng.integers(0, 1 << 63, size=(2, rng.integers(0, 12)), dtype=np.uint64)
            yield family, np.concatenate([noise[0], keep, noise[1]])
            yield 0, rng.permutation(pool)[: rng.integers(2, 25)]


def fit(docs: DataFrame, sample: int = 1000, copies: int = 40, steps: int = 150, seed: int = 4) -> Model:
    """Trains on the templates and on the paragraphs of at most ``sample`` documents (least seeded hash).

    Sampled paragraphs in which a template is half contained are not used as unknown. An empty table is fine.
    """
    every = _template_words()
    used = {f: np.unique(np.concatenate([h for g, h in every if g == f])) for f, _ in every}
    others = {f: np.concatenate([w for g, w in used.items() if g != f]) for f in used}
    templates = [(f, np.unique(T.ngram_hashes(h, 2)), np.setdiff1d(h, others[f]) if len(h) <= BRIEF else h[:0]) for f, h in every]
    grams = np.unique(np.concatenate([_grams(h, np.zeros(len(h), dtype=int))[1] for _, h in _template_words()]))
    model = Model(grams, np.zeros((len(grams) + 1, len(FAMILIES))), 1.0, templates)

    def negatives(batches):
        import pyarrow as pa

        for batch in batches:
            parts, rows = T.binaries(batch.column(0)), []
            for a, z in T.chunks(parts):
                doc, _, _, of, h, _, _ = paragraphs(parts[a:z])
                at, gram = model.hits(of, h)
                cut, words = np.searchsorted(at, np.arange(len(doc) + 1)), np.searchsorted(of, np.arange(len(doc) + 1))
                for i in range(len(doc)):
                    own = h[words[i] : words[i + 1]]
                    if cut[i + 1] - cut[i] < 2 or model.contained(own)[:, 1].max() < 0.5:
                        rows.append(gram[cut[i] : cut[i + 1]].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], names=["grams"])

    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    ids = docs.select("doc_id").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample).distinct()
    chosen = docs.join(F.broadcast(ids), "doc_id").select("text")  # ``sample`` ids at most
    rows = chosen.mapInArrow(negatives, "grams array<int>").groupBy("grams").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("grams").cast("string")).toArrow()
    x = [(0, np.asarray(g.values, dtype=np.int64), float(min(n, 50))) for g, n in zip(rows["grams"].combine_chunks(), rows["n"].to_pylist(), strict=True)]
    rng = np.random.default_rng(seed)
    x += [(f, model.hits(np.zeros(len(h), dtype=int), h)[1], 1.0) for f, h in _examples(rng, copies)]
    y, weight = np.array([f for f, _, _ in x]), np.array([w for _, _, w in x])
    at, gram = np.repeat(np.arange(len(x)), [len(g) for _, g, _ in x]), np.concatenate([g for _, g, _ in x])
    fold = np.arange(len(x)) % 5 == 4
    train = np.where(fold, 0, weight)
    target = np.eye(len(FAMILIES))[y]
    w, m, v = model.weights, np.zeros_like(model.weights), np.zeros_like(model.weights)
    for t in range(1, steps + 1):
        pull = (model.probabilities(at, gram, len(x)) - target) * train[:, None] / train.sum()
        g = np.stack([np.append(np.bincount(gram, weights=pull[at, c], minlength=len(grams)), pull[:, c].sum()) for c in range(len(FAMILIES))], axis=1) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)

    def loss(temperature: float) -> float:
        model.temperature = temperature
        p = model.probabilities(at, gram, len(x))[np.arange(len(x)), y]
        return float(-(np.log(p + 1e-12) * weight)[fold].sum())

    model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    return model


def scan(docs: DataFrame, model: Model, threshold: float = 0.5, share: float = 0.6) -> DataFrame:
    """doc_id, n_paragraphs and findings (family, start, end, score) for every row and its whole text.

    Paragraphs are lines; a run of adjacent lines is tried as one too, so that wrapped notices are found. Its finding
    reaches from the first line to the last and replaces those of its lines, if a template is more like the run than
    like any of them; otherwise the parts between its findings are tried.
    A finding is a paragraph whose likeliest family isn't unknown and has at least ``threshold`` probability, if
    a template of that family has ``share`` of its 2-grams there. Its score is that family's calibrated probability. Offsets are code points, end exclusive. Null and empty texts have no paragraphs
    and no findings; repeated rows each get the same; an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        kind = pa.struct([("family", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            parts, count, found = T.binaries(batch.column(1)), [], []
            for a, z in T.chunks(parts):
                doc, start, end, of, h, raw, off = paragraphs(parts[a:z])
                at, gram = model.hits(of, h)
                rows: list[list] = [[] for _ in range(z - a)]
                count += np.bincount(doc, minlength=z - a).tolist()
                some, local = np.unique(at, return_inverse=True)
                p = model.probabilities(local, gram, len(some)) if len(some) else np.zeros((0, len(FAMILIES)))
                best = p.argmax(axis=1)
                good = np.flatnonzero((best > 0) & (p.max(axis=1, initial=0) >= threshold))
                wrapped = model.runs(doc, start, end, of, h)
                if len(good) or wrapped:
                    before = T.code_points_before(raw)
                    words = np.searchsorted(of, np.arange(len(doc) + 1))
                    alone = {}
                    for k in good:
                        i = some[k]
                        family = model.confirmed(p[k], h[words[i] : words[i + 1]], share)
                        if family:
                            base = before[off[doc[i]]]
                            rows[doc[i]].append({"family": FAMILIES[family], "start": int(before[start[i]] - base), "end": int(before[end[i]] - base), "score": float(p[k, family])})
                            alone[int(i)] = rows[doc[i]][-1], model.likeness(h[words[i] : words[i + 1]], family)
                    tries = [(i, j, True) for i, j in wrapped]
                    while tries:
                        i, j, whole = tries.pop()
                        own = h[words[i] : words[j + 1]]
                        one = np.zeros(len(own), dtype=np.int64)
                        q = model.probabilities(*model.hits(one, own), 1)[0]
                        family = model.confirmed(q, own, share) if q.argmax() > 0 and q.max() >= threshold else 0
                        inside = [alone[k] for k in range(i, j + 1) if k in alone]
                        if family and all(model.likeness(own, family) > like for _, like in inside):
                            rows[doc[i]] = [x for x in rows[doc[i]] if not any(x is y for y, _ in inside)]
                            base = before[off[doc[i]]]
                            rows[doc[i]].append({"family": FAMILIES[family], "start": int(before[start[i]] - base), "end": int(before[end[j]] - base), "score": float(q[family])})
                        elif whole and inside:
                            tries += [(first, last, False) for first, last in _parts([(i, j)], alone)]
                    for listed in rows:
                        listed.sort(key=lambda x: x["start"])
                found += rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(found, pa.list_(kind))], names=["doc_id", "n_paragraphs", "findings"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_paragraphs long, findings array<struct<family:string,start:long,end:long,score:double>>")
