"""Licence notices in documents by MinHash bands over overlapping windows (operator 9).

A text is its words without punctuation, in lower case, and a window is four neighbouring shingles of
three words; windows begin at every second one, so each overlaps the next by half. A window's minhash
in each band is looked up among the minhashes of the templates' pieces: a piece is a run of three
shingles of a template, or all of a shorter one. Any piece lies in some window as a whole, and then
both have the same minhash with probability 3/4; ``bands_for`` gives so many bands of one row that a
piece is missed with a probability of one in a hundred at most. Longer templates have many pieces.

What is found is verified exactly: the shingles of the template that occur within a stretch of twice
its length must be at least ``containment`` of all its shingles. With ``whole_versions`` the stretch
must also hold all shingles that name a version or tell the template from a similar one.

Everything is column functions on the rows as they are scanned; only the verified hits of the few
documents that have any are grouped. The template tables are fixed and go into the plan as literals.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 3
WINDOW = 4
STEP = 2
PIECE = WINDOW - STEP + 1
MISS = 0.01

# The texts of licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
    'software and associated documentation files (the "Software"), to deal in the Software without '
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use '
    "this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
    'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the "
    "terms of the GNU General Public License as published by the Free Software Foundation, either "
    "version 3 of the License, or (at your option) any later version.",
    "BSD-disclaimer": "Redistribution and use in source and binary forms, with or without modification, "
    "are permitted provided that the following conditions are met: Redistributions of source code must "
    "retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
    "International License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or "
    "neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the "
    "terms of the GNU General Public License as published by the Free Software Foundation; either "
    "version 2 of the License, or (at your option) any later version.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
    "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
    "without fee is hereby granted, provided that the above copyright notice and this permission notice "
    "appear in all copies.",
    "MIT-conditions": "The above copyright notice and this permission notice shall be included in all copies "
    'or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
    "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR "
    "A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "BSD-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY '
    "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
}


def bands_for(shortest: int, miss: float = MISS) -> int:
    """Bands of one row after which a piece of ``shortest`` shingles is missed with probability ``miss``."""
    share = min(shortest, PIECE) / WINDOW
    return math.ceil(math.log(miss) / math.log(1 - share))


def piece_starts(shingles_: int) -> list[int]:
    """Where the pieces of a template begin: any window inside it holds a whole one."""
    last = max(0, shingles_ - PIECE)
    return [*range(0, last, STEP), last]


def seed(band: int) -> int:
    """The number whose nearest shingle, in exclusive-or distance, is the minhash of a band."""
    value = (0x9E3779B97F4A7C15 * (2 * band + 1)) & 0xFFFFFFFFFFFFFFFF
    return value - (1 << 64) if value >> 63 else value


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often and deep it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles(text: Column) -> Column:
    """Hashes of all shingles, in order; empty if there are fewer words than a shingle has."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    # a text that begins or ends with punctuation splits off an empty word there
    return _let(F.array_remove(words, ""), _hashes)


def _hashes(words: Column) -> Column:
    numbers = F.sequence(F.lit(0), F.size(words) - SHINGLE)
    hashes = F.transform(numbers, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
    return F.when(F.size(words) >= SHINGLE, hashes).otherwise(F.array().cast("array<long>"))


def _minhashes(hashes: Column, band: int, size: int, step: int) -> Column:
    """Of every window, in one band."""
    turned = F.transform(hashes, lambda x: x.bitwiseXOR(F.lit(seed(band))))
    last = F.greatest(F.size(hashes) - size + step - 1, F.lit(0))
    starts = F.sequence(F.lit(1), last - last % step + 1, F.lit(step))
    found = _let(turned, lambda t: F.transform(starts, lambda p: F.array_min(F.slice(t, p, size))))
    return F.when(F.size(hashes) > 0, found).otherwise(F.array().cast("array<long>"))


def _longs(values) -> Column:
    """One literal for all values, so that plans stay small."""
    return F.lit(np.array(list(values), np.int64))


def telling_shingles(spark: SparkSession, own: dict[str, list], templates: dict[str, str], containment: float) -> dict[str, set[int]]:
    """Of each template, the shingles with a number in them, and those that a template lacks which would
    otherwise pass for it."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string")
    words = F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), "")
    cut = {r["name"]: r["w"] for r in rows.select("name", words.alias("w")).collect()}
    out = {}
    for name, h in own.items():
        w = cut[name]
        told = {x for i, x in enumerate(h) if any(v.isdigit() for v in w[i : i + SHINGLE])}
        for other in own.values():
            lacks = set(h) - set(other)
            if lacks and len(lacks) <= (1 - containment) * len(set(h)) + 1e-9:
                told |= lacks
        out[name] = told
    return out


def template_tables(spark: SparkSession, templates: dict[str, str]) -> tuple[dict, list[dict[int, list[str]]]]:
    """The shingles of each template, and per band the templates behind each minhash."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string")
    own = {r["name"]: r["h"] for r in rows.select("name", shingles(F.col("text")).alias("h")).collect()}
    short = [name for name, h in own.items() if not h]
    if short:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    bands: list[dict[int, list[str]]] = []
    for band in range(bands_for(min(len(h) for h in own.values()))):
        found: dict[int, list[str]] = {}
        for name, h in own.items():
            turned = [x ^ seed(band) for x in h]
            for s in piece_starts(len(h)):
                names = found.setdefault(min(turned[s : s + PIECE]), [])
                if name not in names:
                    names.append(name)
        bands.append(found)
    return own, bands


def scan(
    docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, key: str = "doc_id", text: str = "text",
    whole_versions: bool = False,
) -> DataFrame:
    """One row per document and template found: key, license, containment, first_word, hits.

    With ``whole_versions`` a stretch counts only if it holds all :func:`telling_shingles`; without, a
    notice of another version can be found as well.

    ``hits`` is how many of the template's shingles the best stretch holds, ``first_word`` where the
    first shingle of the first such stretch begins. A null or empty text, or one of fewer than three
    words, has none. Repeated rows each give their rows, null keys are kept, other columns ignored.
    An empty table gives no rows.
    """
    templates = templates or TEMPLATES
    own, bands = template_tables(docs.sparkSession, templates)
    names = sorted(own)
    rows = docs.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("t"))

    pairs = sorted({(v, names.index(n)) for band in bands for v, found in band.items() for n in found})
    values, behind = _longs(v for v, _ in pairs), _longs(t for _, t in pairs)
    places = F.sequence(F.lit(0), F.lit(len(pairs) - 1))

    def named(met: Column) -> Column:
        found = F.filter(places, lambda i: F.array_contains(met, F.get(values, i)))
        found = F.array_distinct(F.transform(found, lambda i: F.get(behind, i).cast("int")))
        return F.when(F.size(met) > 0, found)

    def retrieved(h: Column) -> Column:
        met = [F.array_intersect(_minhashes(h, b, WINDOW, STEP), _longs(bands[b])) for b in range(len(bands))]
        return _let(F.concat(*met), named)

    candidates = _let(shingles(F.col("t")), retrieved)
    rows = rows.select("id", "row", "t", F.explode(candidates).alias("template"))

    sets = F.array(*[_longs(set(own[n])) for n in names])
    sizes = F.array(*[F.lit(len(own[n])) for n in names])
    distinct = F.array(*[F.lit(len(set(own[n]))) for n in names])

    def matching(h: Column) -> Column:
        numbered = F.transform(h, lambda x, i: F.struct(i.alias("at"), x.alias("x")))
        return _let(F.get(sets, F.col("template")), lambda s: F.filter(numbered, lambda n: F.array_contains(s, n["x"])))

    hits = _let(shingles(F.col("t")), matching)
    rows = rows.select("id", "row", "template", F.explode(hits).alias("hit"))
    stretch = F.floor(F.col("hit.at") / F.get(sizes, F.col("template")))
    rows = rows.select("id", "row", "template", "hit", F.explode(F.array(stretch - 1, stretch)).alias("stretch"))
    count = []
    if whole_versions:
        told = telling_shingles(docs.sparkSession, own, templates, containment)
        telling = F.array_contains(F.get(F.array(*[_longs(told[n]) for n in names]), F.col("template")), F.col("hit.x"))
        count = [F.count_distinct(F.when(telling, F.col("hit.x"))).alias("told")]
    found = rows.groupBy("id", "row", "template", "stretch").agg(
        F.count_distinct("hit.x").alias("hits"), F.min("hit.at").alias("first_word"), *count
    )
    if whole_versions:
        found = found.where(F.col("told") == F.get(F.array(*[F.lit(len(told[n])) for n in names]), F.col("template")))
    best = found.groupBy("id", "row", "template").agg(F.max(F.struct("hits", (-F.col("first_word")).alias("back"))).alias("best"))
    share = F.col("best.hits") / F.get(distinct, F.col("template"))
    return best.where(share >= containment).select(
        F.col("id").alias(key),
        F.get(F.array(*[F.lit(n) for n in names]), F.col("template")).alias("license"),
        F.round(share, 6).alias("containment"),
        (-F.col("best.back")).cast("long").alias("first_word"),
        F.col("best.hits").alias("hits"),
    )
