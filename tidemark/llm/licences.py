"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies. Native throughout."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, let, tidy
from .lines import _mask

SHINGLE = 5
CONTAINED = 0.8
#: Bands of one row. A window is at most four times as long as a template, of which it holds 0.8 or more: their
#: similarity is at least 0.19, and forty bands bring 99.97 % of such pairs together.
BANDS = 40
#: Shingles of all templates together, at most: what is broadcast stays small.
MOST_SHINGLES = 100_000
TOKEN = r"[\p{L}\p{N}]+"

# Public license notices.
LICENCES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def shingle_hashes(tokens: Column) -> Column:
    """The hash of every run of five words, in order; none for fewer."""
    every = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))
    return let(tokens, lambda w: F.when(F.size(w) >= SHINGLE, every(w)).otherwise(F.array().cast("array<bigint>")))


def _bands(hashes: Column) -> Column:
    """The least hash under each mask."""
    masks = F.array(*[F.lit(_mask(i)) for i in range(BANDS)])
    return let(hashes, lambda own: F.transform(masks, lambda m: F.array_min(F.transform(own, lambda h: h.bitwiseXOR(m)))))


def template_frame(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``name, block, hashes``: a template belongs to windows of two blocks, a block being the least power of two of its shingles."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, notice string").select("name", F.array_distinct(shingle_hashes(words(F.col("notice")))).alias("hashes"), F.size(shingle_hashes(words(F.col("notice")))).alias("n"))
    block = F.pow(F.lit(2), F.ceil(F.log2(F.greatest("n", F.lit(1)).cast("double")) - 1e-9)).cast("int")
    return rows.select("name", block.alias("block"), "hashes")


@tidy
def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Templates that documents hold: ``doc_id, template, containment, from_word``, one row per document and template.

    A document's words are cut into windows of two blocks of shingles, each overlapping half of the next, for every block
    length that a template has. A window and a template that share a band's least shingle are compared; a match holds 0.8
    of the template's distinct shingles. Only windows with a shingle of any template are hashed: no others can share a
    least one. ``containment`` is the best window's share, ``from_word`` the start of the first matching one.
    Templates are broadcast; ``MOST_SHINGLES`` bounds them. Documents don't shuffle, only matches do.

    Null and empty texts, and those of fewer than five words, hold none. Repeated rows count as one; a null id is an id
    of its own. Long texts are scanned whole. An empty table gives no rows. Other columns aren't read. Templates
    need five words or more.
    """
    spark = docs.sparkSession
    templates = LICENCES if templates is None else templates
    sizes = {name: len(re.findall(r"[^\W_]+", text)) for name, text in templates.items()}
    if short := [n for n, s in sizes.items() if s < SHINGLE]:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    if sum(sizes.values()) > MOST_SHINGLES:
        raise ValueError(f"templates have more than {MOST_SHINGLES} words")
    known = template_frame(spark, templates)
    rows = known.collect()  # bounded above
    blocks = sorted({r.block for r in rows})
    every = F.array(*[F.lit(h) for h in sorted({h for r in rows for h in r.hashes})])
    hashed = docs.select(F.col(id_col).cast("long").alias("doc_id"), shingle_hashes(words(F.col(text_col))).alias("hashes"))
    held = Stage(hashed.filter(F.arrays_overlap("hashes", every)), "shingles")
    at = F.filter(F.sequence(F.lit(0), F.size("hashes") - 1), lambda i: F.array_contains(every, F.element_at("hashes", i + 1)))
    hit = held.df.withColumn("block", F.explode(F.array(*map(F.lit, blocks)))).withColumn("at", at)
    mine = F.flatten(F.transform("at", lambda i: F.array(F.floor(i / F.col("block")), F.floor(i / F.col("block")) - 1)))
    windows = hit.withColumn("window", F.explode(F.array_distinct(F.filter(mine, lambda w: w >= 0)))).drop("at")
    part = F.slice("hashes", (F.col("window") * F.col("block") + 1).cast("int"), 2 * F.col("block"))
    cut = windows.select("doc_id", "block", (F.col("window") * F.col("block")).cast("long").alias("from_word"), part.alias("held"))
    banded = cut.select("*", F.posexplode(_bands(F.col("held"))).alias("band", "least"))
    keys = known.select("name", "block", F.col("hashes").alias("wanted"), F.posexplode(_bands(F.col("hashes"))).alias("band", "least"))
    found = banded.join(F.broadcast(keys), ["block", "band", "least"])  # BANDS rows a template
    share = F.size(F.array_intersect("held", "wanted")) / F.size("wanted")
    checked = found.select("doc_id", F.col("name").alias("template"), "from_word", share.alias("containment")).filter(F.col("containment") >= CONTAINED)
    return checked.groupBy("doc_id", "template").agg(F.max("containment").alias("containment"), F.min("from_word").alias("from_word"))


def oracle() -> str:
    """The same by exact containment in every window, in DuckDB SQL."""
    quoted = ", ".join(f"('{n}', '{t.replace(chr(39), chr(39) * 2)}')" for n, t in LICENCES.items())
    return f"""
WITH t AS (SELECT * FROM (VALUES {quoted}) v(name, notice)),
tw AS (SELECT name, regexp_extract_all(lower(notice), '[\\p{{L}}\\p{{N}}]+') AS w FROM t),
tb AS (SELECT name, w, CAST(pow(2, ceil(log2(len(w) - 4))) AS INTEGER) AS block FROM tw),
ts AS (SELECT DISTINCT name, block, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT name, block, w, unnest(range(1, len(w) - 3)) AS i FROM tb)),
tn AS (SELECT name, count(*) AS n FROM ts GROUP BY name),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
h AS (SELECT DISTINCT doc_id, name, block, p // block - o AS win, ds.s FROM ds JOIN ts ON ds.s = ts.s CROSS JOIN (VALUES (0), (1)) x(o) WHERE p // block - o >= 0),
c AS (SELECT doc_id, h.name, win * block AS from_word, count(*) / any_value(tn.n) AS containment FROM h JOIN tn ON h.name = tn.name GROUP BY doc_id, h.name, block, win)
SELECT doc_id, name AS template, max(containment) AS containment, CAST(min(from_word) AS BIGINT) AS from_word FROM c WHERE containment >= 0.8 GROUP BY doc_id, name"""
