"""Operator 7: license scans by MinHash bands over text windows.

A text's words make shingles of five, which are hashed. Every STEP shingles are
a block and two neighbouring blocks a window, so windows overlap by half. A
window's signature is its least hash under each of BANDS permutations, found
from the least ones of its blocks; each is a band of one row. Templates have
the signatures of all windows at all offsets, or of themselves if they are
shorter. A window that agrees with a template in one band retrieves it; the
share of the template's shingles that the text has decides. DataFrame functions
only, and all but what templates retrieve stays within a row.

A passage longer than a window and a half holds a whole window, which agrees in
all bands if those shingles are untouched. One of t < 2 * STEP shingles is
missed by a window that holds it with probability (1 - t / (2 * STEP)) ** BANDS,
and lies in two windows: with STEP 2 and BANDS 8 that is 0.01 for one shingle,
0.00002 for two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.common import text_or_empty

#: Words of a shingle; shingles of a block; permutations, each a band of one row.
WIDTH, STEP, BANDS = 5, 2, 8
#: Share of a template's shingles that a text must have.
LEAST = 0.8

#: Passages of public license texts and the notices by which works name them.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "MIT": ["Released under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: Multiples of the golden ratio, as signed 64-bit numbers: a hash under one of these masks orders like a random permutation.
MASKS = [((0x9E3779B97F4A7C15 * (2 * k + 1)) + (1 << 63)) % (1 << 64) - (1 << 63) for k in range(BANDS)]


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hashes of the shingles of a text's lower-case words, which are letters and digits; a text with fewer words is one shingle, one without words none."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.aggregate(
        F.array(words),
        F.array().cast("array<bigint>"),
        lambda _, w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, width)))),
    )


def signatures(hashes: Column, step: int = STEP) -> Column:
    """The least values of all windows under all masks, in one array; each value tells its mask by itself."""

    def under(h: Column, mask: int) -> Column:
        many = F.ceil(F.size(h) / F.lit(step)).cast("int")
        part = lambda b: F.least(*[F.get(h, b * step + k).bitwiseXOR(F.lit(mask)) for k in range(step)])
        blocks = F.transform(F.sequence(F.lit(0), many - 1), part)
        return F.aggregate(F.array(blocks), F.array().cast("array<bigint>"), lambda _, b: F.transform(F.sequence(F.lit(0), F.greatest(F.size(b) - 2, F.lit(0))), lambda i: F.least(F.get(b, i), F.get(b, i + 1))))

    return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(F.aggregate(F.array(hashes), F.array().cast("array<bigint>"), lambda _, h: F.concat(*[under(h, m) for m in MASKS])))


def template_table(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    """at, license, passage, mine (distinct shingles) and signs (signatures of the windows at all offsets) of each passage."""
    rows = [(name, i, t) for name, texts in sorted(templates.items()) for i, t in enumerate(texts)]
    rows = [(at, *row) for at, row in enumerate(rows)]
    shingles = shingle_hashes(F.col("_t"))
    offsets = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(2 * STEP)), lambda o: signatures(F.slice("all", o, F.greatest(F.size("all") - o + 1, F.lit(0))))))
    return spark.createDataFrame(rows, "at int, license string, passage int, _t string").withColumn("all", shingles).select("at", "license", "passage", F.array_distinct("all").alias("mine"), F.array_distinct(offsets).alias("signs"))


def license_scan(df: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, license, passage, n_shingles, containment: a row for each passage of a license of whose n_shingles a text has at least `least`.

    The signatures of the templates, whose number the parameter sets, go into
    the query as constants. Null, empty and wordless texts have no license;
    rows that repeat each count; a null id stays null; no templates or an empty
    table give no rows.
    """
    known = template_table(df.sparkSession, TEMPLATES if templates is None else templates)
    pairs = sorted({(v, r["at"]) for r in known.collect() for v in r["signs"]})
    values, owners = [v for v, _ in pairs], [at for _, at in pairs]
    rows = df.select(F.col(id_col).alias("doc_id"), shingle_hashes(text_or_empty(text_col)).alias("hashes"))
    rows = rows.withColumn("hits", F.array_distinct(F.filter(signatures(F.col("hashes")), lambda v: v.isin(values)))).where(F.size("hits") > 0)
    index = F.arrays_zip(F.lit(values).cast("array<bigint>").alias("v"), F.lit(owners).cast("array<int>").alias("at"))
    found = F.array_distinct(F.transform(F.filter(index, lambda x: F.array_contains(F.col("hits"), x["v"])), lambda x: x["at"]))
    rows = rows.select("doc_id", "hashes", F.explode(found).alias("at")).join(F.broadcast(known), "at")
    share = F.size(F.array_intersect("mine", "hashes")) / F.size("mine")
    return rows.select("doc_id", "license", "passage", F.size("mine").cast("long").alias("n_shingles"), share.alias("containment")).where(F.col("containment") >= least)
