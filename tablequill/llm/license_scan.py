"""Licence notices in documents: a trained paragraph classifier, confirmed by templates.

A paragraph is a line of the text, or several lines of one block (lines without
a blank one between them) over which a notice is wrapped. Multinomial logistic regression on the
presence of words, word pairs and triples gives each paragraph a licence family
or "unknown"; its probabilities are calibrated on examples it was not fitted
on. A prediction is confirmed if the paragraph holds most of the word pairs of
one of the family's templates.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablequill.llm import textkernel as tk

# Documents whose paragraphs stand for "unknown" in the fit, at most about so many.
BACKGROUND_DOCUMENTS = 200
BACKGROUND_LINES = 1500
CONFIRMED = 0.6
UNKNOWN = "unknown"

# Usual wordings of notices, by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
        " and associated documentation files, to deal in the Software without restriction",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except"
        " in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the"
        " GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GPL, version 2 or later.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the"
        " GNU Lesser General Public License",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted"
        " provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC0": [
        "Released under CC0 1.0 Universal, public domain dedication.",
        "To the extent possible under law, the author has waived all copyright and related or"
        " neighboring rights to this work.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
    ],
}

# Identifier lines of source files.
SPDX = {
    "MIT": ["MIT"], "Apache-2.0": ["Apache-2.0"], "GPL": ["GPL-2.0-only", "GPL-3.0-or-later"],
    "LGPL": ["LGPL-2.1-or-later"], "AGPL": ["AGPL-3.0-only"], "BSD": ["BSD-2-Clause", "BSD-3-Clause"],
    "MPL-2.0": ["MPL-2.0"], "CC-BY-NC": ["CC-BY-NC-4.0"], "CC-BY-SA": ["CC-BY-SA-4.0"],
    "CC-BY": ["CC-BY-4.0"], "CC0": ["CC0-1.0"], "Unlicense": ["Unlicense"],
}
for _family, _ids in SPDX.items():
    TEMPLATES[_family] += [f"SPDX-License-Identifier: {i}" for i in _ids]

# Sentences about licences that name none.
OTHER = [
    "All rights reserved.", "See the license file for details.", "The license fee is due every year.",
    "Her driver license had expired.", "A licensed electrician must check the work.",
    "Released to the public last week.", "This version was released under another name.",
    "Please read the terms of use.", "The general public may attend.", "Version 2.0 of the report",
    "The commission granted the license to the operator.", "under the terms of the agreement",
    "Permission to enter is granted to staff.", "He studied at MIT and at Berkeley.",
    "The source and the binary are on the server.", "creative work of the commons", "version 3",
]

STOP = set("the of and to in a is this that for on with be by or as it at an are was you may any can".split())


def terms(text: str) -> list[str]:
    return re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text.lower())


def _ngrams(words: list[str]) -> set[str]:
    out = set()
    for n in (1, 2, 3):
        for i in range(len(words) - n + 1):
            if not all(w in STOP or len(w) < 2 and not w.isdigit() for w in words[i : i + n]):
                out.add(" ".join(words[i : i + n]))
    return out


def _hash_ngrams(grams: list[str]) -> np.ndarray:
    """Hashes as ``_features`` makes them from whole texts."""
    out = np.empty(len(grams), np.uint64)
    for i, gram in enumerate(grams):
        [(_, data, offsets)] = tk.slices(pa.array([gram]))
        found = tk.words(data, offsets, terms=True)
        n = len(found.starts)
        out[i] = tk.mix(tk.windows(tk.word_hashes(data, found), found.bounds, n)[0] + np.uint64(n))[0]
    return out


@dataclass
class Model:
    families: list[str]  # the last is UNKNOWN
    keys: np.ndarray  # sorted hashes of the n-grams
    weights: np.ndarray  # n-gram x family
    bias: np.ndarray
    temperature: float
    limit: float  # least probability of a prediction
    templates: list[tuple[int, np.ndarray, int]]  # (family, places of its word pairs, words)

    def probabilities(self, row: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        logits = np.column_stack([
            np.bincount(row, self.weights[place, k], n) for k in range(len(self.families))
        ]) + self.bias
        logits /= self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True)


def _variants(rng: random.Random, text: str, filler: list[str]) -> list[str]:
    """A template as it stands, with words lost, and inside other words."""
    words = text.split()
    out = [text]
    for _ in range(12):
        kept = [w for w in words if rng.random() > 0.08] or words
        before = [rng.choice(filler) for _ in range(rng.randint(0, 4))]
        after = [rng.choice(filler) for _ in range(rng.randint(0, 4))]
        out.append(" ".join(before + kept + after))
    return out


def fit(background: list[str], seed: int = 3, rounds: int = 300, ridge: float = 1e-3) -> Model:
    """Fit on variants of the templates against OTHER, scraps of templates and ``background``."""
    rng = random.Random(seed)
    families = [*TEMPLATES, UNKNOWN]
    filler = [w for line in background[:200] for w in line.split()] or ["word"]
    examples: list[tuple[str, int]] = []
    for k, name in enumerate(TEMPLATES):
        for text in TEMPLATES[name]:
            examples += [(v, k) for v in _variants(rng, text, filler)]
    unknown = len(families) - 1
    for text in OTHER:
        examples += [(v, unknown) for v in _variants(rng, text, filler)[:5]]
    examples += [(line, unknown) for line in background]
    vocabulary = sorted(set().union(*[_ngrams(terms(t)) for ts in TEMPLATES.values() for t in ts],
                                    *[_ngrams(terms(t)) for t in OTHER]))
    place = {g: i for i, g in enumerate(vocabulary)}
    held = [i % 5 == 4 for i in range(len(examples))]

    def sparse(chosen: list[tuple[str, int]]):
        rows, columns = [], []
        for i, (text, _) in enumerate(chosen):
            at = [place[g] for g in _ngrams(terms(text)) if g in place]
            rows += [i] * len(at)
            columns += at
        x = np.zeros((len(chosen), len(vocabulary)), np.float32)
        x[rows, columns] = 1
        return x, np.array([k for _, k in chosen])

    x, y = sparse([e for e, h in zip(examples, held) if not h])
    target = np.eye(len(families), dtype=np.float32)[y]
    w = np.zeros((len(vocabulary), len(families)), np.float32)
    bias = np.log(target.mean(axis=0) + 1e-3)
    rate = 4 / np.maximum(np.linalg.norm(x, 2) ** 2 / len(x), 1)
    ahead, before, speed = w, w, 1.0
    for _ in range(rounds):
        logits = x @ ahead + bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - rate * (x.T @ (p - target) / len(x) + ridge * ahead)
        bias = bias - 0.5 * (p - target).mean(axis=0)
        faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        ahead, before, speed = new + (speed - 1) / faster * (new - before), new, faster
    w = before
    # calibration on what was held out: the temperature, then the limit for "unknown"
    xh, yh = sparse([e for e, h in zip(examples, held) if h])
    raw = xh @ w + bias

    def scaled(t: float) -> np.ndarray:
        z = raw / t
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    temperature = min(np.linspace(0.2, 3, 57),
                      key=lambda t: -np.log(scaled(t)[np.arange(len(yh)), yh] + 1e-12).mean())
    false = scaled(temperature)[yh == unknown][:, :unknown].max(axis=1)
    limit = float(max(0.5, np.quantile(false, 0.995)))

    keys = _hash_ngrams(vocabulary)
    order = np.argsort(keys)
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.arange(len(order))
    templates = []
    for k, name in enumerate(TEMPLATES):
        for text in TEMPLATES[name]:
            pairs = [g for g in _ngrams(terms(text)) if g.count(" ") == 1]
            templates.append((k, np.sort(inverse[[place[g] for g in pairs]]), len(terms(text))))
    return Model(families, keys[order], w[order].astype(np.float64), bias.astype(np.float64),
                 float(temperature), min(limit, 0.95), templates)


def _features(hashes: np.ndarray, bounds: np.ndarray, vocabulary: np.ndarray):
    """(line, place in the vocabulary), each once, of the n-grams of lines given as hashes of words."""
    own = tk.owners(bounds)
    rows, places = [], []
    for n in (1, 2, 3):
        keys, at = tk.windows(hashes, bounds, n)
        keys = tk.mix(keys + np.uint64(n))
        place = np.minimum(np.searchsorted(vocabulary, keys), len(vocabulary) - 1)
        hit = vocabulary[place] == keys
        rows.append(own[at[hit]])
        places.append(place[hit])
    once = np.unique(np.concatenate(rows).astype(np.int64) * len(vocabulary) + np.concatenate(places))
    return once // len(vocabulary), once % len(vocabulary)


def _passages(at: list[int], places: list[int], reach: int, least: float) -> list[tuple[int, int, int]]:
    """(first word, last word, distinct pairs) of the passages that hold ``least`` pairs of a template.

    ``at`` are the words, in order, at which one of its pairs begins; a passage
    reaches over at most ``reach`` words. One pass, passages do not overlap.
    """
    counts, held, end = [], {}, 0
    for i, word in enumerate(at):
        while end < len(at) and at[end] < word + reach:
            held[places[end]] = held.get(places[end], 0) + 1
            end += 1
        counts.append(len(held))
        held[places[i]] -= 1
        if not held[places[i]]:
            del held[places[i]]
    out, i = [], 0
    while i < len(at):
        if counts[i] < least:
            i += 1
            continue
        best = j = i
        while j < len(at) and at[j] < at[i] + reach:
            if counts[j] >= counts[best]:
                best = j
            j += 1
        seen, last = set(), best
        while len(seen) < counts[best]:
            seen.add(places[last])
            last += 1
        out.append((at[best], at[last - 1] + 1, counts[best]))
        i = last
    return out


def _wrapped(model: Model, hashes: np.ndarray, bounds: np.ndarray, new_text: np.ndarray):
    """(first line, last line, pairs) of passages over several lines of a block that follow a template."""
    blank = np.diff(bounds) == 0
    starts = new_text | blank | np.concatenate([[True], blank[:-1]])
    first = np.flatnonzero(starts)
    blocks = np.append(bounds[:-1][first], bounds[-1])
    keys, at = tk.windows(hashes, blocks, 2)
    keys = tk.mix(keys + np.uint64(2))
    place = np.minimum(np.searchsorted(model.keys, keys), len(model.keys) - 1)
    hit = model.keys[place] == keys
    place, at = place[hit], at[hit]
    block = tk.owners(blocks)[at]
    out = []
    for _, pairs, n_words in model.templates:
        mine = np.flatnonzero(np.isin(place, pairs))
        if len(mine) == 0:
            continue
        once = np.unique(block[mine] * len(model.keys) + place[mine]) // len(model.keys)
        found, counts = np.unique(once, return_counts=True)
        for b in found[counts >= CONFIRMED * len(pairs)].tolist():
            lo, hi = np.searchsorted(block[mine], [b, b + 1])
            rows = mine[lo:hi]
            for begin, end, n in _passages(
                at[rows].tolist(), place[rows].tolist(), 2 * n_words, CONFIRMED * len(pairs)
            ):
                top, bottom = (np.searchsorted(bounds, [begin, end], "right") - 1).tolist()
                if bottom > top:
                    out.append((top, bottom, n))
    return out


def _predicted(model: Model, row: np.ndarray, place: np.ndarray, n: int):
    """(row, family, probability, similarity, pairs of the template found) of the rows that are notices."""
    p = model.probabilities(row, place, n)
    best = p[:, :-1].argmax(axis=1)
    score = p[np.arange(n), best]
    bounds = np.searchsorted(row, np.arange(n + 1))
    out = []
    for i in np.flatnonzero((score >= model.limit) & (score >= p[:, -1])).tolist():
        here = place[bounds[i] : bounds[i + 1]]
        similarity, pairs = max(
            (len(common) / len(pairs), len(common))
            for k, pairs, _ in model.templates if k == best[i]
            for common in [np.intersect1d(here, pairs, assume_unique=True)]
        )
        out.append((i, int(best[i]), float(score[i]), float(similarity), pairs))
    return out


def _line_notices(model: Model, hashes: np.ndarray, bounds: np.ndarray) -> dict[int, tuple]:
    """First line -> (last line, family, probability, similarity, pairs) of notices in one line."""
    row, place = _features(hashes, bounds, model.keys)
    # lines without a known n-gram are all alike: unknown
    some = np.unique(row)
    if len(some) == 0:
        return {}
    to = np.full(len(bounds) - 1, -1)
    to[some] = np.arange(len(some))
    keep = to[row] >= 0
    return {
        int(some[i]): (int(some[i]), *rest)
        for i, *rest in _predicted(model, to[row[keep]], place[keep], len(some))
    }


def _join_lines(model: Model, hashes: np.ndarray, bounds: np.ndarray, new_text: np.ndarray,
                spans: list[tuple[int, int, int]], notices: dict[int, tuple]) -> None:
    """Puts notices over several lines in the place of what was found in these lines one by one.

    The longest match goes first. A line that holds as much of a template by
    itself stays a notice of its own.
    """
    taken = set()
    for top, bottom, n in sorted(spans, key=lambda s: (-s[2], s[1] - s[0], s[0])):
        inside = range(top, bottom + 1)
        if any(i in taken for i in inside) or any(
            notices[i][3] >= CONFIRMED and notices[i][4] >= n for i in inside if i in notices
        ):
            continue
        words = slice(int(bounds[top]), int(bounds[bottom + 1]))
        row, place = _features(hashes[words], np.array([0, words.stop - words.start]), model.keys)
        whole = _predicted(model, row, place, 1)
        if not whole or whole[0][3] < CONFIRMED:
            continue
        _, k, *rest = whole[0]

        def scattered(i: int) -> bool:
            return i in notices and i not in taken and notices[i][1] == k and notices[i][3] < CONFIRMED

        # the notice goes on in lines of the same family that hold no template
        while not new_text[top] and scattered(top - 1):
            top -= 1
        while bottom + 2 < len(bounds) and not new_text[bottom + 1] and scattered(bottom + 1):
            bottom += 1
        for i in range(top, bottom + 1):
            taken.add(i)
            notices.pop(i, None)
        notices[top] = (bottom, k, *rest)


def _scanner(model: Model):
    names = ["_id", "paragraph", "start", "length", "family", "probability", "similarity", "confirmed"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            if texts.null_count:
                texts = texts.fill_null("")
            for first, data, offsets in tk.slices(texts):
                begins = np.zeros(len(data) + 1, bool)
                begins[offsets] = True
                begins[np.flatnonzero(data == 10) + 1] = True
                lines = np.flatnonzero(begins)
                if len(lines) < 2:
                    continue
                low = data.copy()
                upper = (low >= 65) & (low <= 90)
                low[upper] += 32
                found = tk.words(low, lines, terms=True)
                hashes = tk.word_hashes(low, found)
                notices = _line_notices(model, hashes, found.bounds)
                new_text = np.isin(lines[:-1], offsets)
                spans = _wrapped(model, hashes, found.bounds, new_text)
                _join_lines(model, hashes, found.bounds, new_text, spans, notices)
                if not notices:
                    continue
                head = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                feeds = np.concatenate([[0], np.cumsum(data == 10)])
                out = []
                for top, (bottom, k, score, similarity, _) in sorted(notices.items()):
                    doc = int(np.searchsorted(offsets, lines[top], "right")) - 1
                    lo, hi = lines[top], lines[bottom + 1]
                    hi -= bool(hi > lo and data[hi - 1] == 10)
                    out.append((
                        first + doc, int(feeds[lo] - feeds[offsets[doc]]), int(head[lo] - head[offsets[doc]]),
                        int(head[hi] - head[lo]), model.families[k], score, similarity, similarity >= CONFIRMED,
                    ))
                columns = list(zip(*out))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").take(pa.array(columns[0], pa.int64()))]
                    + [pa.array(c, k) for c, k in zip(columns[1:], kinds)], names,
                )

    return scan


def background(docs: DataFrame, text: str = "text", documents: int = BACKGROUND_DOCUMENTS) -> list[str]:
    """Lines of about ``documents`` documents that hold no template, BACKGROUND_LINES at most."""
    total = docs.count()
    share = int((1 << 40) * min(1.0, documents / max(total, 1)))
    rows = (
        docs.where(F.pmod(F.xxhash64(F.col(text), F.lit(5)), F.lit(1 << 40)) < share)
        .select(F.explode(F.split(F.col(text), "\n")).alias("line"))
        .distinct().orderBy(F.md5("line")).limit(2 * BACKGROUND_LINES).collect()
    )
    pairs = [{g for g in _ngrams(terms(t)) if g.count(" ") == 1} for ts in TEMPLATES.values() for t in ts]
    out = []
    for r in rows:
        grams = _ngrams(terms(r["line"]))
        own = sum(g.count(" ") == 1 for g in grams)
        # neither most of a template nor, as in a wrapped notice, mostly a piece of one
        if all(len(grams & p) < 0.5 * len(p) and (own < 4 or len(grams & p) < 0.5 * own) for p in pairs):
            out.append(r["line"])
    return out[:BACKGROUND_LINES]


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, paragraph, start, length, family, probability, similarity, confirmed), one row per notice.

    ``paragraph`` counts the lines of the text from 0, a wrapped notice has that
    of its first line; ``start`` and ``length`` are characters. A document with several notices has several rows, one
    without (NULL and empty texts too) has none; repeated rows and NULL ids are
    scanned like any other row.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    schema = T.StructType([
        rows.schema["_id"], *T._parse_datatype_string(
            "paragraph int, start long, length long, family string, probability double,"
            " similarity double, confirmed boolean").fields,
    ])
    found = rows.mapInArrow(_scanner(model), schema)
    return found.withColumnRenamed("_id", id_col)


def op1_rows(docs: DataFrame) -> DataFrame:
    return scan(docs, fit(background(docs)))
