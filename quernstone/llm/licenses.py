"""License scans in DataFrame functions only: MinHash bands over overlapping text windows, verified by exact shingle containment.

Templates are grouped by their number of five-word shingles. A group's windows are long enough, and overlap enough, that every
run of a template's length lies whole in one of them. A window is retrieved for a template if the two agree in one band, a
band being one MinHash value; from the least Jaccard similarity that a window with PIECE of a template's shingles can have, the number
of bands is set so that such a window is missed with a chance below MISS. What is retrieved is verified exactly over the
window and NEIGHBOURS windows' lengths on either side, so that a match which is broken in two, or has words put into it, is found too.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS, THRESHOLD, MISS = 5, 0.8, 1e-6
#: The share of a template that one window must hold to be retrieved: half a match.
PIECE, NEIGHBOURS = 0.4, 2
#: Code points of all templates' shingles, once for each band, up to which templates are broadcast; beyond, Spark chooses the join.
BROADCAST_CHARS = 16 << 20

# Notices and passages of public licenses.
TEMPLATES = {
    "MIT-notice": ("MIT", "Released under the MIT License."),
    "MIT-grant": (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "MIT-warranty": (
        "MIT",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "Apache-notice": ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    "Apache-header": (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-notice": ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    "GPL-header": (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD-redistribution": (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "MPL-header": (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-notice": ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-notice": ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-notice": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    "ISC-grant": (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
}


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def shingles_of(text: str) -> list[str]:
    words = words_of(text)
    return [" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)] or ([" ".join(words)] if words else [])


def least_shared(total: int, share: float = THRESHOLD) -> int:
    return next(m for m in range(1, total + 1) if m / total >= share)


@dataclass(frozen=True)
class Group:
    """Templates of least to most distinct shingles; windows of size shingles, a new one every stride; so many bands."""

    names: tuple[str, ...]
    most: int
    stride: int
    size: int
    bands: int
    anchors: tuple[str, ...]


def anchors_of(text: str) -> set[str]:
    """Words of which a window that holds PIECE of a template's shingles has one: so many shingles hold one of them that those without are too few."""
    shingles = sorted(set(shingles_of(text)))
    spare = least_shared(len(shingles), PIECE) - 1
    chosen: set[str] = set()
    while len(left := [s for s in shingles if not chosen & set(s.split())]) > spare:
        counts: dict[str, int] = {}
        for s in left:
            for w in s.split():
                counts[w] = counts.get(w, 0) + 1
        chosen.add(max(counts, key=lambda w: (len(w) >= 6, counts[w], len(w), w)))  # long words are rare ones
    return chosen


def groups_of(templates: dict[str, tuple[str, str]]) -> list[Group]:
    """Groups by 1, 2, 3-4, 5-8 ... distinct shingles."""
    by: dict[int, list[str]] = {}
    sizes = {name: len(set(shingles_of(text))) for name, (_, text) in templates.items()}
    for name, n in sizes.items():
        if n:
            by.setdefault(1 << (n - 1).bit_length(), []).append(name)
    out = []
    for most, names in sorted(by.items()):
        stride = most if most > 4 else 1
        size = most + stride - 1
        close = min(p / (size + sizes[n] - p) for n in names for p in [least_shared(sizes[n], PIECE)])
        bands = 1 if close >= 1 else math.ceil(math.log(MISS) / math.log(1 - close))
        anchors = sorted(set().union(*(anchors_of(templates[n][1]) for n in names)))
        out.append(Group(tuple(names), most, stride, size, bands, tuple(anchors)))
    return out


def _shingles(words: Column) -> Column:
    several = F.transform(F.sequence(F.lit(1), F.size(words) - WORDS + 1), lambda i: F.array_join(F.slice(words, i, WORDS), " "))
    return F.when(F.size(words) >= WORDS, several).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def _bands(shingles: Column, n: int) -> Column:
    """MinHash values, one a band: hash functions are one 64-bit hash, mixed with the band's number."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b))))


def _near_windows(words: Column, group: Group) -> Column:
    """A group's windows (words of the window, and of it with its neighbours), those with an anchor."""
    last = F.greatest(F.size(words) - WORDS + 1 - group.most, F.lit(0))
    starts = F.sequence(F.lit(0), F.ceil(last / group.stride).cast("int") * group.stride, F.lit(group.stride))
    anchors = F.array(*map(F.lit, group.anchors))
    near = F.filter(starts, lambda s: F.arrays_overlap(F.slice(words, s + 1, group.size + WORDS - 1), anchors))
    wide = NEIGHBOURS * group.size
    first = lambda s: F.greatest(s - wide, F.lit(0))
    return F.transform(near, lambda s: F.struct(F.slice(words, s + 1, group.size + WORDS - 1).alias("window"), F.slice(words, first(s) + 1, s - first(s) + group.size + wide + WORDS - 1).alias("around")))


def scan_licenses(df: DataFrame, templates: dict[str, tuple[str, str]] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, template, license, n_shared, n_template, containment): documents that hold THRESHOLD or more of a template's distinct shingles.

    Shingles are five lower-cased words (runs of letters and digits); a text of fewer words is one shingle. n_shared is the most
    that a window that was retrieved and its neighbours hold. A match of which no window holds PIECE, or whose parts are further apart than
    NEIGHBOURS windows, is not found. Null and empty texts have none. Each row has its own results, rows that share an id, null included,
    too. Other columns don't matter; an empty table gives no rows. Windows without any of their templates' anchors (words of which
    every window with PIECE has one) are left out before hashing. A text's words are one array, so the longest single text
    bounds the memory. The templates are a list on the driver, broadcast only if they are small.
    """
    spark = df.sparkSession
    groups = groups_of(templates)
    if not groups:
        raise ValueError("there are no templates")
    lowered = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.lower(F.col(f"`{text}`")).alias("text"))
    anchors = sorted({a for g in groups for a in g.anchors})
    some = F.lit(False)
    for a in anchors:
        some = some | F.contains("text", F.lit(a))
    listed = lowered.filter(some).select("row", "doc_id", F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("words"))
    numbered = list(enumerate(groups))
    windows = F.concat(*(_tagged(_near_windows(F.col("words"), group), number) for number, group in numbered))
    near = listed.filter(F.size("words") > 0).select("row", "doc_id", F.explode(windows).alias("w")).select("row", "doc_id", F.col("w.group").alias("group"), F.col("w.near.around").alias("around"), F.array_distinct(_shingles(F.col("w.near.window"))).alias("shingles"))
    values = F.coalesce(*(F.when(F.col("group") == number, _bands(F.col("shingles"), group.bands)) for number, group in numbered))
    banded = near.select("row", "doc_id", "group", "around", F.posexplode(values).alias("band", "value"))
    known = _template_bands(spark, templates, numbered)
    # A window meets a template in several bands: verifying again costs little, and nothing has to be shuffled for it.
    shared = F.size(F.array_intersect(_shingles(F.col("around")), "template_shingles")).cast("long")
    pairs = banded.join(known, ["group", "band", "value"]).select("row", "doc_id", "template", "license", "n_template", shared.alias("n_shared"))
    best = pairs.filter(F.col("n_shared") / F.col("n_template") >= THRESHOLD).groupBy("row", "doc_id", "template", "license", "n_template").agg(F.max("n_shared").alias("n_shared"))
    return best.select("doc_id", "template", "license", "n_shared", "n_template", (F.col("n_shared") / F.col("n_template")).alias("containment"))


def _tagged(windows: Column, number: int) -> Column:
    return F.transform(windows, lambda w: F.struct(F.lit(number).alias("group"), w.alias("near")))


def _template_bands(spark: SparkSession, templates: dict[str, tuple[str, str]], groups: list[tuple[int, Group]]) -> DataFrame:
    """A row for each template and band, broadcast if all rows together are within BROADCAST_CHARS."""
    rows = [(number, group.bands, name, templates[name][0], sorted(set(shingles_of(templates[name][1])))) for number, group in groups for name in group.names]
    names = ("group", "bands", "template", "license", "template_shingles")
    literal = lambda x: F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x)
    listed = spark.range(1).select(F.inline(F.array(*(F.struct(*(literal(x).alias(n) for x, n in zip(row, names, strict=True))) for row in rows))))
    values = F.coalesce(*(F.when(F.col("group") == number, _bands(F.col("template_shingles"), group.bands)) for number, group in groups))
    known = listed.select("group", "template", "license", "template_shingles", F.size("template_shingles").cast("long").alias("n_template"), F.posexplode(values).alias("band", "value"))
    return F.broadcast(known) if sum(bands * sum(map(len, shingles)) for _, bands, _, _, shingles in rows) <= BROADCAST_CHARS else known


def oracle(templates: dict[str, tuple[str, str]] = TEMPLATES) -> str:
    """DuckDB SQL that holds every whole document against every template, without windows."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = [f"({quoted(name)}, {quoted(license)}, [{', '.join(map(quoted, sorted(set(shingles_of(text)))))}])" for name, (license, text) in templates.items()]
    return rf"""
WITH t(template, license, ts) AS (VALUES {", ".join(rows)}),
words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
shingles AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
counted AS (SELECT doc_id, template, license, len(list_intersect(s, ts))::BIGINT AS n_shared, len(ts)::BIGINT AS n_template FROM shingles, t)
SELECT doc_id, template, license, n_shared, n_template, n_shared / n_template AS containment FROM counted WHERE n_shared / n_template >= {THRESHOLD}
"""
