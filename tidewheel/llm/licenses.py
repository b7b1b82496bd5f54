"""Licence scans: MinHash over overlapping windows retrieves templates, exact containment verifies them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import once

SHINGLE = 5
CONTAINMENT = 0.8
#: A window spans two blocks of as many shingles as the template has; a template falls within one.
BAND_TARGET = 0.9999
#: Templates are broadcast within the plan; more characters than this are refused.
MAX_TEMPLATE_CHARS = 4_000_000

#: Shingles of a text that are looked at together; a slice also holds what its last windows need.
SLICE = 2048

#: Notices of public licences, as their stewards publish them for use in source files and pages, and whole texts of short ones.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]


def _word_array(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _shingle_hashes(words: Column) -> Column:
    """Hashes of all runs of ``SHINGLE`` words; a shorter text has one, the whole; an empty one none."""
    n = F.size(words)
    at = lambda i, k: F.get(words, i + k)
    runs = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[at(i, k) for k in range(SHINGLE)]))
    return F.when(n >= SHINGLE, runs).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))


def bands_for(n: int, target: float = BAND_TARGET) -> int:
    """Bands of one MinHash value each that retrieve a contained template of ``n`` shingles with probability ``target``.

    A window has 2 n shingles at most. If it holds ``CONTAINMENT`` of the template, their Jaccard
    similarity is at least J = c n / (2 n + (1 - c) n) = c / (3 - c), and b bands of one row miss it with
    probability (1 - J) ** b.
    """
    j = CONTAINMENT / (3 - CONTAINMENT)
    return math.ceil(math.log(1 - target) / math.log(1 - j))


def default_templates(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("template_id"), F.lit(a).alias("license"), F.lit(b).alias("template")) for i, (a, b) in enumerate(TEMPLATES)])
    return spark.range(1).select(F.inline(rows))


def _least(hashes: Column, band: int) -> Column:
    """The MinHash value of a band: each band hashes the hashes anew, so that its order of shingles is independent of the others'."""
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band))))


def _least_shingle(hashes: Column, band: int) -> Column:
    """The shingle hash that :func:`_least` is the value of."""
    return F.array_min(F.transform(hashes, lambda h: F.struct(F.xxhash64(h, F.lit(band)).alias("v"), h.alias("h"))))["h"]


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, containment: float = CONTAINMENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Licence templates in whole texts: ``id_col, template_id, license, containment, word_start, word_end``.

    A template (rows ``template_id, license, template``; a bounded table, see ``MAX_TEMPLATE_CHARS``) is
    found in a text when a window of it holds at least ``containment`` of the template's five-word
    shingles.  One row for each document and template found, for its best window (the first of
    equals), with the span of that window's matching shingles in words; documents without a licence have no row.

    Windows overlap by half and are two template lengths long, so that any passage as long as the template lies
    whole in one.  A window's MinHash value in a band is the least of its shingle hashes when hashed again
    with the band's number; each value is a band, and :func:`bands_for` sets their number.  As a window can share a band with a template only
    if it holds the very shingle that is the template's least, slices without any of those shingles are
    passed over first, by a lookup in a hash set: that is implied by the bands and loses nothing.
    Windows retrieved by a band meet the templates by an equal join on (length, band, value) and are verified by exact containment.  No shuffle of texts, no Python.

    A text is cut into words once; what follows holds slices of ``SLICE`` of them, each with as many more as the longest template's windows need, so a row stays
    small however long the text (tested with 5 MB of text in one row). A window belongs to the slice in which it begins.

    Words are runs of letters and digits in lower case.  Null and empty texts have no rows; repeated rows are
    scanned each; a template without words never matches.
    """
    spark = docs.sparkSession
    if templates is None:
        templates = default_templates(spark)
    chars = templates.agg(F.coalesce(F.sum(F.length("template")), F.lit(0))).first()[0]
    if chars > MAX_TEMPLATE_CHARS:
        raise ValueError(f"templates have {chars} characters; at most {MAX_TEMPLATE_CHARS} can be broadcast")
    bands = range(bands_for(1))
    t = once(templates, "words", _word_array(F.col("template"))).select("template_id", "license", F.array_distinct(_shingle_hashes(F.col("words"))).alias("t")).where(F.size("t") > 0)
    t = t.select("*", F.array(*[_least(F.col("t"), i) for i in bands]).alias("bands"), F.array(*[_least_shingle(F.col("t"), i) for i in bands]).alias("least"), F.size("t").alias("n"))
    facts = t.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("least")))).alias("least"), F.sort_array(F.collect_set("n")).alias("lengths")).first()  # bounded by the check above
    least, lengths = list(facts["least"]), list(facts["lengths"])
    if not lengths:
        return docs.where("false").select(id_col, F.lit(0).alias("template_id"), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("word_start"), F.lit(0).alias("word_end"))
    known = t.select("template_id", "license", "t", F.col("n").alias("tn"), F.posexplode("bands").alias("band", "value"))
    probe = F.broadcast(known.groupBy("tn", "band", "value").agg(F.collect_set("template_id").alias("ids")))
    longest = max(lengths)

    words = once(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), "words", _word_array(F.col("_text"))).drop("_text")
    # short texts are one shingle whatever their words, longer ones have words - SHINGLE + 1
    count = F.greatest(F.size("words") - SHINGLE + 1, F.lit(1))
    part = lambda k: F.struct(k.alias("at"), F.slice("words", (k * SLICE + 1).cast("int"), SLICE + 2 * longest + SHINGLE - 1).alias("words"))
    rows = words.where(F.size("words") > 0).withColumn("_row", F.monotonically_increasing_id())
    sliced = rows.select("_id", "_row", F.explode(F.transform(F.sequence(F.lit(0), F.floor((count - 1) / SLICE)), part)).alias("x")).select("_id", "_row", (F.col("x.at") * SLICE).alias("base"), "x.words")
    hashed = once(sliced, "h", _shingle_hashes(F.col("words"))).drop("words")
    near = once(hashed, "some", F.array_intersect(F.col("h"), F.lit(least))).where(F.size("some") > 0)
    # a shingle at i stands in the windows i div n and the one before; those that begin in the slice are its own
    places = F.filter(F.transform("h", lambda h, i: F.when(F.array_contains("some", h), i + F.col("base"))), lambda i: i.isNotNull())
    own = lambda n: lambda k: (k * n >= F.col("base")) & (k * n < F.col("base") + SLICE)
    starts = lambda n: F.filter(F.array_distinct(F.flatten(F.transform("p", lambda i: F.array(F.floor(i / n), F.greatest(F.floor(i / n) - 1, F.lit(0).cast("long")))))), own(n))
    cut = lambda n: lambda k: F.struct(F.lit(n).alias("n"), k.alias("k"), F.slice("h", (k * n - F.col("base") + 1).cast("int"), 2 * n).alias("w"))
    held = [F.transform(starts(n), cut(n)) for n in lengths]
    # windows leave their slice by themselves
    windows = once(near, "p", places).select("_id", "_row", F.explode(F.concat(*held)).alias("x")).select("_id", "_row", "x.n", "x.k", "x.w")
    signed = windows.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(len(bands) - 1)), lambda i: F.array_min(F.transform("w", lambda h: F.xxhash64(h, i))))).alias("band", "value"))
    met = signed.join(probe, (F.col("n") == F.col("tn")) & (signed["band"] == probe["band"]) & (signed["value"] == probe["value"])).select("_id", "_row", "n", "k", "w", F.explode("ids").alias("tid"))
    whole = F.broadcast(t.select(F.col("template_id").alias("tid"), "template_id", "license", "t"))
    # a window that several bands retrieve is verified each time and counted once
    found = met.join(whole, "tid")
    hit = found.withColumn("in", F.size(F.array_intersect("w", "t"))).withColumn("containment", F.col("in") / F.col("n")).where(F.col("containment") >= containment)
    at = F.filter(F.transform("w", lambda h, i: F.when(F.array_contains("t", h), i)), lambda i: i.isNotNull())
    spans = hit.withColumn("at", at).select(
        "_id", "_row", "template_id", "license", "containment",
        (F.col("k") * F.col("n") + F.array_min("at")).cast("long").alias("word_start"),
        (F.col("k") * F.col("n") + F.array_max("at") + SHINGLE).cast("long").alias("word_end"),
    )
    best = spans.groupBy("_row", "template_id").agg(F.first("_id").alias("_id"), F.first("license").alias("license"), F.max_by(F.struct("containment", "word_start", "word_end"), F.struct(F.col("containment"), -F.col("word_start"), F.col("word_end"))).alias("x"))
    return best.select(F.col("_id").alias(id_col), "template_id", "license", "x.containment", "x.word_start", "x.word_end")


def oracle() -> str:
    """DuckDB SQL for :func:`scan_licenses` over ``documents``: every window of every text against every template."""
    values = ", ".join("({}, '{}', '{}')".format(i, a, b.replace("'", "''")) for i, (a, b) in enumerate(TEMPLATES))
    grams = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    return f"""
WITH t AS (SELECT * FROM (VALUES {values}) AS v(template_id, license, template)),
tw AS (SELECT template_id, license, {grams.format("template")} AS w FROM t),
ts AS (SELECT DISTINCT template_id, license, array_to_string(w[i + 1:i + 5], ' ') AS g FROM tw, unnest(range(0, len(w) - 4)) AS r(i)),
tn AS (SELECT template_id, count(*) AS n FROM ts GROUP BY template_id),
dw AS (SELECT doc_id, {grams.format("text")} AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, i AS pos, array_to_string(w[i + 1:i + 5], ' ') AS g FROM dw, unnest(range(0, len(w) - 4)) AS r(i)),
hit AS (SELECT dg.doc_id, dg.pos, dg.g, ts.template_id, ts.license, tn.n FROM dg JOIN ts USING (g) JOIN tn USING (template_id)),
win AS (SELECT *, unnest(CASE WHEN pos >= n THEN [pos // n, pos // n - 1] ELSE [0] END) AS k FROM hit),
per AS (SELECT doc_id, template_id, license, k, count(DISTINCT g) / any_value(n) AS containment, min(pos) AS word_start, max(pos) + 5 AS word_end FROM win GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, template_id ORDER BY containment DESC, word_start, word_end DESC) AS rn FROM per WHERE containment >= {CONTAINMENT})
SELECT doc_id, template_id, license, CAST(containment AS DOUBLE) AS containment, CAST(word_start AS BIGINT) AS word_start, CAST(word_end AS BIGINT) AS word_end FROM best WHERE rn = 1
"""
