"""License scan: a trained paragraph classifier in DataFrame operations only.

Paragraphs (lines, and windows of neighbouring lines, as notices are wrapped) are scored by a sparse multinomial logistic regression over word n-grams (one and two words, presence): licence
families, a class ``unknown`` for licence talk that is none of them, and ``none``. It is trained here, on the driver, from the
notices below (whole, cut to windows, with words dropped) and a bounded sample of the corpus' own lines as background; its
temperature is calibrated on notices held back. A predicted family must be confirmed by its templates: a share of a
template's word pairs occurs in the paragraph; a family that isn't confirmed, or isn't probable enough, becomes ``unknown``.

A window goes from one line with an anchor word to another of the same run of lines that hold words: to each of the next
``WINDOW`` such lines, and over the whole run. Of confirmed paragraphs, those that grant a licence go before "proprietary", as notices often say
"All rights reserved." too.

The main path is native: an array expression keeps a text's paragraphs that have an anchor word (a word of the vocabulary that
background lines hardly use; every n-gram of the vocabulary contains one, so no other paragraph could score); their
n-grams are exploded, joined with the weights and summed. Work beyond the one pass over the texts follows the number of
such paragraphs. The weights are at most ``MAX_FEATURES`` rows, the only broadcast.

Edge cases: null and empty texts are ``none`` with probability 0 and no paragraph; equally probable families go by name; rows that
repeat are scored one by one; a null ``doc_id`` is kept; very long texts are taken whole.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Well-known wordings of licence notices, by family.
NOTICES = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Affero General Public License version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "This work is licensed under the AGPL version 3.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD License.",
        "Licensed under the BSD 2-Clause License.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Available under the Creative Commons Attribution License.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Available under CC BY NC for noncommercial use.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is marked with CC0 1.0 Universal.",
        "Released into the public domain under CC0.",
    ),
    "gpl": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "Released under the GNU GPL version 2 or later.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Released under the LGPL.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.",
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright 2020 the authors. All rights reserved.",
        "This document is confidential and proprietary; no part may be reproduced without prior written permission.",
        "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential.",
    ),
}
#: Licence talk of no listed family.
UNLISTED = (
    "Licensed under the terms agreed with the vendor.",
    "This file is distributed under the terms of its own license.",
    "See the license file for details.",
    "Released under a custom license.",
    "This work is licensed under the terms of the European Union Public Licence.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the Eclipse Public License 2.0.",
    "Released under the zlib license.",
    "Your driving license was renewed.",
    "The licensed technician repaired the copy machine.",
    "License fees are due each year.",
    "A license is required to use this product.",
    "Subject to the license terms.",
)
UNKNOWN, NONE = "unknown", "none"
CLASSES = (*NOTICES, UNKNOWN, NONE)

MAX_FEATURES = 4000
#: Background lines used in training at most, and the longest such line in characters.
MAX_BACKGROUND, BACKGROUND_CHARS = 2000, 1000
#: A word or word pair of more than this share of background lines is no evidence.
COMMON = 0.005
MIN_PROBABILITY, MIN_CONFIRM = 0.5, 0.6
#: Anchor lines after the first one to which windows go; the whole run is one more window.
WINDOW = 8
#: Lines without a word part runs.
BLANK = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
SPLIT = r"[^\p{L}\p{N}]+"


def words_of(line: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", line.lower()) if w]


def features_of(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}


def _examples(rng: np.random.Generator) -> tuple[list[tuple[set[str], str]], list[tuple[set[str], str]]]:
    """Training and calibration examples: notices whole, as windows and with a few words dropped."""
    fit, held = [], []
    for name, notices in (*NOTICES.items(), (UNKNOWN, UNLISTED)):
        for notice in notices:
            words = words_of(notice)
            for turn in range(24):
                some = words
                if turn and len(words) > 6:
                    size = int(rng.integers(max(6, len(words) // 2), len(words) + 1))
                    at = int(rng.integers(0, len(words) - size + 1))
                    some = words[at : at + size]
                if turn % 3 == 2:
                    some = [w for w in some if rng.random() > 0.1] or words
                (held if turn % 6 == 5 else fit).append((features_of(some), name))
    return fit, held


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(background: list[str], seed: int = 11) -> tuple[dict[str, list[float]], list[float], list[str]]:
    """(weights per n-gram and class, intercepts, anchor words), divided by the calibrated temperature."""
    rng = np.random.default_rng(seed)
    fit, held = _examples(rng)
    plain = [(features_of(words_of(line)), NONE) for line in background]
    seen: dict[str, int] = {}
    for feats, _ in plain:
        for f in feats:
            seen[f] = seen.get(f, 0) + 1
    # Stop words of the notices' own language are no anchors even where the background is foreign or empty.
    stop = set("a about above all an and any are as at be by can each either except following for form forms found have in into is its it may more no not of on one only or other own part person prior provided related should that the their these this to use used was where which with without work you your year free file files program copy available version terms details see due".split())
    most = COMMON * max(len(plain), 1)
    anchors = {w for feats, _ in fit for f in feats for w in [f] if " " not in f and seen.get(f, 0) <= most and w not in stop and not w.isdigit()}
    vocabulary = sorted({f for feats, _ in fit for f in feats if seen.get(f, 0) <= most and any(w in anchors for w in f.split(" "))})[:MAX_FEATURES]
    place = {f: i for i, f in enumerate(vocabulary)}

    def matrix(rows: list[tuple[set[str], str]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(vocabulary)), np.float32)
        for i, (feats, _) in enumerate(rows):
            x[i, [place[f] for f in feats if f in place]] = 1
        return x, np.array([CLASSES.index(c) for _, c in rows])

    # Paragraphs with no or one stray feature are background too.
    x, y = matrix([*fit, *plain, *[(set(), NONE)] * 200, *[({w}, NONE) for w in sorted(anchors) for _ in range(2)]])
    one = np.eye(len(CLASSES), dtype=np.float32)[y]
    share = np.bincount(y, minlength=len(CLASSES)).astype(np.float32)
    importance = (np.where(y == CLASSES.index(NONE), 4, 1) / share[y]).astype(np.float32)
    importance /= importance.sum()
    w, b = np.zeros((len(vocabulary), len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32)
    rate, lasso = 3.0, 1e-5
    for _ in range(300):
        p = (_softmax(x @ w + b) - one) * importance[:, None]
        w -= rate * (x.T @ p)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * lasso, 0)
        b -= rate * p.sum(axis=0)
    xh, yh = matrix(held)
    z = xh @ w + b
    loss = lambda t: -np.log(np.clip(_softmax(z / t)[np.arange(len(yh)), yh], 1e-9, 1)).mean()
    temperature = min((0.25 * 1.15**k for k in range(30)), key=loss)
    kept = {f: (w[i] / temperature).round(5).tolist() for f, i in place.items() if np.abs(w[i]).max() > 1e-4}
    return kept, (b / temperature).round(5).tolist(), sorted(a for a in anchors if any(a in f.split(" ") for f in kept))


def _background(docs: DataFrame, text: str) -> list[str]:
    """At most MAX_BACKGROUND distinct lines without licence words, from documents chosen by hash of their text."""
    n = docs.count()
    every = max(1, n // (MAX_BACKGROUND // 4))
    lines = docs.where(F.pmod(F.xxhash64(F.lit("background"), text), F.lit(every)) == 0).select(F.explode(F.split(text, "\n")).alias("line"))
    lines = lines.where(F.length("line").between(1, BACKGROUND_CHARS) & ~F.col("line").rlike(r"(?i)licen[cs]e|licensed|copyright|rights reserved|creative commons|\bGNU\b|\bCC\b|SPDX"))
    return [r.line for r in lines.distinct().orderBy(F.xxhash64("line"), "line").limit(MAX_BACKGROUND).collect()]


def _table(spark: SparkSession, rows: list, kind: str) -> DataFrame:
    """A small constant table as a literal: no RDD behind it."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<{kind}>")).alias("r")).select("r.*")


@lru_cache(maxsize=1)
def _pairs() -> dict[str, list[list[str]]]:
    return {name: [sorted(f for f in features_of(words_of(n)) if " " in f) for n in notices] for name, notices in NOTICES.items()}


def _confirm(pairs: Column, family: Column) -> Column:
    """The largest share of a template's word pairs, over the family's templates, that the paragraph holds."""
    out = F.lit(0.0)
    for name, templates in _pairs().items():
        shares = [F.size(F.array_intersect(pairs, F.array(*map(F.lit, t)))) / F.lit(float(len(t))) for t in templates if t]
        out = F.when(family == name, F.greatest(*shares) if len(shares) > 1 else shares[0]).otherwise(out)
    return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, probability, similarity, confirmed, n_paragraphs) of every document: its best licence paragraph and their number."""
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    weights, bias, anchors = train(_background(slim, "text"))
    split = lambda p: F.filter(F.split(F.lower(p), SPLIT), lambda w: w != "")
    wanted = F.array(*map(F.lit, anchors)) if anchors else F.array().cast("array<string>")
    anchored = lambda p: F.arrays_overlap(F.split(F.lower(p), SPLIT), wanted)
    runs = F.filter(F.split(F.coalesce("text", F.lit("")), BLANK), anchored)
    rows = materialize(slim.select("doc_id", runs.alias("runs")).withColumn("row", F.monotonically_increasing_id()), "license-runs")
    held = rows.select("row", F.posexplode("runs").alias("run", "text")).select("row", "run", F.split("text", "\n").alias("lines"))
    held = held.withColumn("at", F.filter(F.transform("lines", lambda p, i: F.when(anchored(p), i)), lambda i: i.isNotNull()))
    # (first, last) of each window, as places in "at"; a single line is the window from itself to itself.
    ends = held.select("row", "run", "lines", "at", F.posexplode("at").alias("k", "first"))
    last = F.slice("at", F.col("k") + 1, F.lit(WINDOW + 1))
    last = F.when(F.col("k") == 0, F.array_union(last, F.slice("at", -1, 1))).otherwise(last)
    each = ends.select("row", "run", "lines", "first", F.explode(last).alias("last"))
    # The shortest and earliest is the largest.
    place = F.struct((F.col("first") - F.col("last")).alias("size"), (-F.col("run")).alias("run"), (-F.col("first")).alias("first"))
    each = each.select("row", place.alias("para"), F.array_join(F.slice("lines", F.col("first") + 1, F.col("last") - F.col("first") + 1), " ").alias("line")).withColumn("words", split("line"))
    pairs = F.zip_with(F.col("words"), F.slice(F.concat("words", F.array(F.lit(""))), 2, F.size("words")), lambda a, b: F.concat(a, F.lit(" "), b))
    grams = each.select("row", "para", F.explode(F.array_distinct(F.concat("words", pairs))).alias("f"))
    table = F.broadcast(_table(spark, [{"f": f, "w": w} for f, w in weights.items()], "struct<f:string,w:array<double>>"))
    sums = grams.join(table, "f").groupBy("row", "para").agg(*(F.sum(F.col("w")[k]).alias(f"z{k}") for k in range(len(CLASSES))))
    logits = [F.col(f"z{k}") + F.lit(bias[k]) for k in range(len(CLASSES))]
    best = F.array_max(F.array(*(F.struct(z.alias("z"), F.lit(-k).alias("k")) for k, z in enumerate(logits))))
    scored = sums.withColumn("best", best).select("row", "para", F.element_at(F.array(*map(F.lit, CLASSES)), 1 - F.col("best.k")).alias("family"), (1 / sum((F.exp(z - F.col("best.z")) for z in logits), F.lit(0.0))).alias("probability"))
    found = scored.where(F.col("family") != NONE).join(each.select("row", "para", F.array_distinct(pairs).alias("pairs")), ["row", "para"])
    found = found.withColumn("similarity", F.round(_confirm(F.col("pairs"), F.col("family")), 6)).withColumn("probability", F.round("probability", 6))
    sure = (F.col("family") != UNKNOWN) & (F.col("probability") >= MIN_PROBABILITY) & (F.col("similarity") >= MIN_CONFIRM)
    found = found.withColumn("license", F.when(sure, F.col("family")).otherwise(F.lit(UNKNOWN)))
    # The surest paragraph of a document: confirmed ones first, grants before "proprietary", then by probability, similarity and name.
    order = F.struct(sure.cast("int").alias("c"), (F.col("license") != "proprietary").alias("g"), F.col("probability").alias("p"), F.col("similarity").alias("s"), F.col("para").alias("n"), F.col("license").alias("l"))
    per_row = found.groupBy("row").agg(F.max(order).alias("b"), F.count_distinct("para.run", "para.first").alias("n"))
    whole = rows.select("row", "doc_id").join(per_row, "row", "left")
    return whole.select(
        "doc_id",
        F.coalesce("b.l", F.lit(NONE)).alias("license"),
        F.coalesce("b.p", F.lit(0.0)).alias("probability"),
        F.coalesce("b.s", F.lit(0.0)).alias("similarity"),
        (F.coalesce("b.c", F.lit(0)) == 1).alias("confirmed"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_paragraphs"),
    )


def classify(line: str, model: tuple[dict[str, list[float]], list[float], list[str]]) -> tuple[str, float]:
    """One line by the trained model in plain Python: the reading that tests hold against the native path."""
    weights, bias, _ = model
    z = list(bias)
    hits = [weights[f] for f in features_of(words_of(line)) if f in weights]
    if not hits:
        return NONE, 0.0
    for w in hits:
        z = [a + b for a, b in zip(z, w)]
    top = max(range(len(z)), key=lambda k: (z[k], -k))
    return CLASSES[top], 1 / sum(math.exp(v - z[top]) for v in z)
