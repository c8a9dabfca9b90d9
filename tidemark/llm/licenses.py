"""Licence scan (operator 3): MinHash bands over overlapping windows, then exact containment.

Only DataFrame functions.  Templates and text windows are sets of five-word shingles; a window
retrieves a template if they agree on a band of MinHash values, and matches it if it contains
enough of the template's shingles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

SHINGLE = 5
CONTAINMENT = 0.8
# Chance that a window which holds enough of a template collides in no band.
MISS = 1e-4
# The template table is sent to every task; this bounds it.
MAX_TEMPLATES = 5000
MAX_TEMPLATE_WORDS = 500_000
_WORD = r"[\p{L}\p{N}]+"

# Short notices of common licences, and whole texts of the short ones.
NOTICES = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column) -> Column:
    """Hashes of the five-word shingles of a text, in order, repeats included.

    Words are runs of letters and digits in lower case; fewer than five words have no shingle.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(_WORD), F.lit(0))

    def hashes(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0)))
        each = F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
        return F.when(F.size(w) >= SHINGLE, each).otherwise(F.array().cast("array<bigint>"))

    return let(words, hashes)


def bands_for(overlap: float, miss: float = MISS) -> int:
    """One-value bands with which sets of at least this similarity collide almost surely."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-min(overlap, 1 - 1e-9))))


def band_values(shingle_set: Column, bands: int) -> Column:
    """MinHash value of the set for every band."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda b: F.array_min(F.transform(shingle_set, lambda h: F.xxhash64(h, b))),
    )


def _templates(spark: SparkSession, templates: DataFrame, containment: float) -> tuple[DataFrame, list[int], list[int], int]:
    """(templates by band, their reach classes, the shingles that can retrieve them, bands).

    A template of n shingles has reach r, the power of two from n; its windows are 2r shingles
    long and begin every r, so one window holds any occurrence whole.  More than half of r are
    the template's own, which bounds the similarity from below for every length.
    """
    rows = templates.select("license", "notice").limit(MAX_TEMPLATES + 1).collect()
    words = sum(len((r["notice"] or "").split()) for r in rows)
    if len(rows) > MAX_TEMPLATES or words > MAX_TEMPLATE_WORDS:
        raise ValueError("too many templates to send to every task")
    numbered = [(i, r["license"], r["notice"]) for i, r in enumerate(rows)]
    table = spark.createDataFrame(numbered, "template_no int, license string, notice string")
    sets = table.select("template_no", "license", F.array_distinct(shingle_hashes(F.col("notice"))).alias("template"))
    sets = sets.where(F.size("template") > 0)
    # Containment c: c n shingles shared, at most 2 r + (1 - c) n in the union, n > r / 2.
    bands = bands_for(containment * 0.5 / (2 + (1 - containment) * 0.5))
    n = F.size("template")
    reach = F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")) - 1e-9)).cast("int")
    whole = sets.withColumn("reach", reach).withColumn("values", band_values(F.col("template"), bands))
    # The shingle behind each band value: only windows that hold it can collide there.
    anchors = F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda b: F.filter("template", lambda h: F.xxhash64(h, b) == F.get(F.col("values"), b)),
    )))
    local = whole.withColumn("anchors", anchors).collect()
    fixed = spark.createDataFrame(
        [(r["template_no"], r["license"], r["template"], r["reach"], r["values"]) for r in local],
        "template_no int, license string, template array<bigint>, reach int, values array<bigint>",
    )
    return fixed, sorted({r["reach"] for r in local}), sorted({a for r in local for a in r["anchors"]}), bands


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTICES, "license string, notice string")


def matches(docs: DataFrame, templates: DataFrame | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, template_no, window_at, shared, containment) of every matching window.

    ``templates`` has license and notice (the built-in notices by default).  A window matches if
    it holds at least ``containment`` of the distinct five-word shingles of the template;
    window_at is its first word, shared are those shingles, ascending.  Windows that hold no shingle behind a template's band value
    collide with none, so their bands are not computed.  Null, empty and short texts match
    nothing, notices below five words match nothing, repeated rows match each, an empty table
    gives an empty one; columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    table, reaches, anchors, bands = _templates(spark, notices(spark) if templates is None else templates, containment)
    if not anchors:
        docs, anchors, reaches = docs.limit(0), [0], [1]

    def hits(h: Column) -> Column:
        places = F.filter(F.transform(h, lambda x, i: F.when(x.isin(anchors), i)), lambda i: i.isNotNull())
        found = F.array(F.struct(h.alias("hashes"), places.alias("places")))
        return F.when(F.exists(h, lambda x: x.isin(anchors)), found).otherwise(F.slice(found, 1, 0))

    # Exploding the zero or one hit drops the other rows; texts are hashed once.
    hit = docs.select("doc_id", F.explode(let(shingle_hashes(F.col("text")), hits)).alias("hit")).select("doc_id", "hit.*")
    each = hit.withColumn("reach", F.explode(F.array(*map(F.lit, reaches))))
    numbers = F.flatten(F.transform(
        "places", lambda i: F.array(F.floor(i / F.col("reach")), F.greatest(F.floor(i / F.col("reach")) - 1, F.lit(0).cast("long")))
    ))
    windows = each.withColumn("window", F.explode(F.array_distinct(numbers))).withColumn("window_at", F.col("window") * F.col("reach"))
    held = F.array_distinct(F.slice("hashes", (F.col("window_at") + 1).cast("int"), 2 * F.col("reach")))
    banded = F.explode(F.array(let(held, lambda x: F.struct(x.alias("shingles"), band_values(x, bands).alias("values")))))
    sets = windows.select("doc_id", "reach", "window_at", banded.alias("set")).select("doc_id", "reach", "window_at", "set.*")
    keyed = sets.select("doc_id", "reach", "window_at", "shingles", F.posexplode("values").alias("band", "value"))
    by_band = table.select("template_no", "license", "template", "reach", F.posexplode("values").alias("band", "value"))
    found = keyed.join(F.broadcast(by_band), ["reach", "band", "value"])
    shared = found.withColumn("shared", F.array_sort(F.array_intersect("template", "shingles")))
    verified = shared.withColumn("containment", F.size("shared") / F.size("template")).where(F.col("containment") >= containment)
    # A window that agrees on several bands is found several times.
    return verified.select("doc_id", "license", "template_no", "window_at", "shared", "containment").distinct()


def scan(docs: DataFrame, templates: DataFrame | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, template_no, window_at, containment) of every matching window."""
    return matches(docs, templates, containment).drop("shared")


def licenses(docs: DataFrame, templates: DataFrame | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment): the licences of each document, with the best match.

    Licences share much of their wording.  A match goes if another one of the document shares all
    its shingles and more, or the same ones with a higher containment.  Rows of one doc_id are one
    document here.
    """
    found = matches(docs, templates, containment).groupBy("doc_id", "license", "shared").agg(F.max("containment").alias("containment"))
    found = cut(found, "license-matches")
    # A match that holds all of another's shingles holds the least of them.
    wider = found.select(
        F.col("doc_id").alias("__id"), F.col("shared").alias("__shared"), F.col("containment").alias("__containment"),
        F.explode("shared").alias("__shingle"),
    )
    n, m = F.size("shared"), F.size("__shared")
    within = (F.size(F.array_except("shared", "__shared")) == 0) & ((m > n) | (F.col("__containment") > F.col("containment")))
    meets = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.get("shared", F.lit(0)) == F.col("__shingle")) & within
    # Both sides grow with the corpus: neither is broadcast.
    return found.join(wider.hint("merge"), meets, "left_anti").groupBy("doc_id", "license").agg(F.max("containment").alias("containment"))


def check_sql() -> str:
    """The same by comparing every window with every template, for an SQL engine."""
    values = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(NOTICES))
    words = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
    return f"""
WITH t AS (SELECT * FROM (VALUES {values}) AS v(template_no, license, notice)),
tw AS (SELECT template_no, license, {words.format("notice")} AS w FROM t),
ts AS (SELECT DISTINCT template_no, license, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM tw)),
tn AS (SELECT template_no, count(*) AS n, pow(2, ceil(log2(count(*)) - 1e-9))::INT AS reach FROM ts GROUP BY template_no),
dw AS (SELECT doc_id, {words.format("text")} AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM dw)),
hit AS (SELECT doc_id, template_no, license, n, reach, s, pos // reach AS b FROM ds JOIN ts USING (s) JOIN tn USING (template_no)),
win AS (SELECT *, b AS win FROM hit UNION ALL SELECT *, b - 1 FROM hit WHERE b > 0),
got AS (SELECT doc_id, template_no, license, win, count(DISTINCT s) / max(n) AS containment, list_sort(list(DISTINCT s)) AS shared FROM win GROUP BY ALL),
ok AS (SELECT doc_id, license, shared, max(containment) AS containment FROM got WHERE containment >= {CONTAINMENT} GROUP BY ALL)
SELECT doc_id, license, max(containment) AS containment FROM ok AS a WHERE NOT EXISTS (
  SELECT 1 FROM ok AS b WHERE a.doc_id IS NOT DISTINCT FROM b.doc_id AND list_has_all(b.shared, a.shared)
    AND (len(b.shared) > len(a.shared) OR b.containment > a.containment)
) GROUP BY ALL
"""
