"""License notices in documents: MinHash bands over overlapping windows, in DataFrame functions only.

Texts and templates are sequences of five-word shingles of lower-case letters and
digits.  For each template length, windows of that many shingles start every eighth of
it, so some window shares at least 7/9 of its union with a template that is there.
Sixteen bands of two minima then collide with probability above 0.9999999, retrieving
the template; the share of the template's shingles in the window and an eighth on
either side is counted exactly.  A window without any shingle of a template cannot
collide, so only windows around such shingles are formed.

A template of fewer than five words is one shingle of all its words, and a window of it
that many words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
BANDS, ROWS = 16, 2
#: Wording of common license notices.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                      "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
                      "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                  "Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
           "following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "rights-reserved": "All rights reserved. No part of this work may be reproduced without permission.",
    "rights-reserved-short": "All rights reserved.",
    "MIT-conditions": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
                    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
                    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
                    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
                      "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
                    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
           "provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                   "Public License as published by the Free Software Foundation",
    "AGPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
                   "Public License as published by the Free Software Foundation",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def _words(column: str) -> str:
    """SQL: the lower-case words of a text."""
    return f"filter(split(regexp_replace(lower({column}), '[^a-z0-9]+', ' '), ' '), w -> w <> '')"


def _shingles(words: str) -> str:
    """SQL: the shingles of a word array, in order; fewer words than a shingle make none."""
    parts = ", ".join(f"{words}[i + {k}]" for k in range(SHINGLE))
    return f"CASE WHEN size({words}) < {SHINGLE} THEN array() ELSE transform(sequence(0, size({words}) - {SHINGLE}), i -> concat_ws(' ', {parts})) END"


def _bands(shingles: str) -> str:
    """SQL: one key for each band, from the minima of salted hashes."""
    least = [f"array_min(transform({shingles}, s -> xxhash64({salt}, s)))" for salt in range(BANDS * ROWS)]
    return "array(" + ", ".join(f"xxhash64({b}, " + ", ".join(least[b * ROWS:(b + 1) * ROWS]) + ")" for b in range(BANDS)) + ")"


def templates(spark, texts: dict[str, str]) -> DataFrame:
    """(license, shingles, width, length, step): `length` shingles of `width` words, five or all that a shorter template has."""
    rows = spark.createDataFrame(sorted(texts.items()), "license string, template string").withColumn("words", F.expr(_words("template")))
    whole = F.when(F.size("words") == 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join("words", " ")))
    return rows.withColumn("shingles", F.when(F.size("words") < SHINGLE, whole).otherwise(F.expr(_shingles("words")))).select(
        "license", "shingles", F.least(F.lit(SHINGLE), F.size("words")).alias("width"), F.size("shingles").alias("length"),
        F.greatest(F.lit(1), F.floor(F.size("shingles") / 8)).cast("int").alias("step"))


def scan(docs: DataFrame, texts: dict[str, str] | None = None, share: float = 0.8) -> DataFrame:
    """doc_id, license, containment and first_word of every template at least `share` of whose shingles a window holds.

    `first_word` is where the best, then first, window starts.  Null and empty texts
    and texts of fewer words than any template give no rows; repeated rows give their
    rows again; null ids are carried; an empty table gives no rows; no column but doc_id
    and text is read.  The templates are a parameter of bounded size and are broadcast.
    """
    known = templates(docs.sparkSession, TEMPLATES if texts is None else texts)
    listed = known.collect()  # one row per template
    if any(not r["length"] for r in listed):
        raise ValueError("a template needs a word")
    classes = sorted({(r["length"], r["step"]) for r in listed if r["width"] == SHINGLE})
    every = sorted({s for r in listed if r["width"] == SHINGLE for s in r["shingles"]})
    brief = sorted({(r["width"], r["shingles"][0]) for r in listed if r["width"] < SHINGLE})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.expr(_words("text")).alias("words"))
    shingled = rows.select("doc_id", "row", "words", F.expr(_shingles("words")).alias("shingles"))
    at = F.filter(F.transform("shingles", lambda s, i: F.when(s.isin(every), i)), lambda i: i.isNotNull())
    held = shingled.withColumn("at", at if every else F.array().cast("array<int>"))
    none = F.array().cast("array<struct<width: int, length: int, start: int>>")
    wide = [F.expr(f"""flatten(transform(at, i -> transform(
            sequence(greatest(0, ceil((i - {length} + 1) / {step})), greatest(0, floor(i / {step}))), k -> struct({SHINGLE} AS width, {length} AS length, int(k * {step}) AS start))))""")
            for length, step in classes]
    padded = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    narrow = [F.when(padded.contains(f" {text} "), F.expr(f"""transform(
            filter(sequence(0, size(words) - {width}), i -> concat_ws(' ', slice(words, i + 1, {width})) = '{text}'), i -> struct({width} AS width, 1 AS length, i AS start))""")
                     ).otherwise(none) for width, text in brief]
    placed = held.withColumn("starts", F.when(F.size("at") > 0, F.array_distinct(F.flatten(F.array(none, *wide)))).otherwise(none)).withColumn(
        "starts", F.concat("starts", none, *narrow)).filter(F.size("starts") > 0)
    windows = placed.select("doc_id", "row", "words", "shingles", F.explode("starts").alias("w")).filter(f"w.width < {SHINGLE} OR w.start < size(shingles)")
    whole = "array(concat_ws(' ', slice(words, w.start + 1, w.width)))"
    banded = windows.select(
        "doc_id", "row", "w", F.expr(f"IF(w.width < {SHINGLE}, {whole}, slice(shingles, w.start + 1, w.length))").alias("inside"), F.expr(
            f"IF(w.width < {SHINGLE}, {whole}, slice(shingles, greatest(1, w.start + 1 - ceil(w.length / 8)), w.length + 2 * ceil(w.length / 8)))").alias("around"))
    keyed = banded.withColumn("key", F.explode(F.array_distinct(F.expr(_bands("inside")))))
    index = known.select("license", F.col("shingles").alias("template"), F.col("width").alias("template_width"), F.col("length").alias("template_length"),
                         F.explode(F.expr(_bands("shingles"))).alias("template_key"))
    hit = keyed.join(F.broadcast(index), (keyed["key"] == index["template_key"]) & (keyed["w.length"] == index["template_length"])
                     & (keyed["w.width"] == index["template_width"]))
    part = F.size(F.array_intersect("template", "around")) / F.size(F.array_distinct("template"))
    checked = hit.select("doc_id", "row", "license", part.alias("containment"), F.col("w.start").alias("start")).filter(F.col("containment") >= share)
    best = checked.groupBy("row", "doc_id", "license").agg(F.max(F.struct("containment", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("doc_id", "license", F.col("best.containment").alias("containment"), (-F.col("best.back")).alias("first_word"))
