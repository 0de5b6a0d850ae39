"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Texts and templates are lower-cased words of a-z and 0-9 and their shingles of ``WIDTH`` words. A template of at most
``c`` words (``c`` a power of two) is looked for in windows of ``2 c`` words that start every ``c`` words, so each
occurrence lies whole in a window. A window that shares no shingle with any template cannot share a MinHash value with one
and is left out beforehand. ``BANDS`` bands of one value each find a window whose shingle set has a similarity of 0.2
with the template's (the least of a whole template in a full window) with probability over 0.999999; a match is a window
that holds at least ``CONTAINMENT`` of the template's shingles.

Defined cases: null and empty texts match nothing; texts are scanned whole; a license found in several windows of a text
is one row with its first window and best containment; rows that repeat an id, or have none, each give their findings; an
empty table gives an empty table; input columns other than id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.plans.scratch import sized_join

WIDTH, BANDS, CONTAINMENT, LEAST_CLASS = 3, 64, 0.8, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: License notices by identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
        LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    "LGPL-notice": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "warranty-as-is": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
}


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))


def class_of(words: int) -> int:
    size = LEAST_CLASS
    while size < words:
        size *= 2
    return size


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[^a-z0-9]+"), lambda w: w != "")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shingles(words: Column) -> Column:
    """A hash for each run of WIDTH words; shorter texts have none."""

    def joined(hashes: Column) -> Column:
        n = F.size(hashes)
        out = F.slice(hashes, 1, n - WIDTH + 1)
        for k in range(1, WIDTH):
            out = F.zip_with(out, F.slice(hashes, k + 1, n - WIDTH + 1), lambda a, b: F.xxhash64(a, b))
        return F.when(n < WIDTH, F.array().cast("array<bigint>")).otherwise(out)

    return _bound(F.transform(words, lambda w: F.xxhash64(w)), joined)


def _signature(shingles: Column) -> Column:
    """Per band its number and the least re-hashed shingle."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda s: F.struct(s.alias("band"), F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, s))).alias("value")))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and license found in it: the id, license, start (first word of the first matching window) and containment.

    templates: notices of at least WIDTH words by license.
    """
    spark = docs.sparkSession
    named = [(name, class_of(len(own)), own) for name, text in sorted((TEMPLATES if templates is None else templates).items()) if len(own := template_words(text)) >= WIDTH]
    listed = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(c).alias("class"), F.array(*[F.lit(w) for w in own]).alias("words")) for name, c, own in named])
    known = spark.range(1).select(F.inline(listed)).select("license", "class", F.array_distinct(_shingles(F.col("words"))).alias("own"))
    bands = known.select("license", "class", "own", F.inline(_signature(F.col("own"))))
    every = known.select(F.array_distinct(F.flatten(F.collect_list("own"))).alias("a"))
    known_hashes = sorted(every.first()["a"])  # of the templates only
    classes = sorted({c for _, c, _ in named})

    def windows(shingles: Column) -> Column:
        """(class, start, found) of each window that holds a template's shingle."""
        hits = F.filter(F.transform(shingles, lambda h, i: F.when(h.isin(known_hashes), i)), F.isnotnull)
        window = lambda c, start: F.struct(c.alias("class"), start.cast("int").alias("start"))
        both = lambda c, i: F.array(window(c, F.floor(i / c) * c), window(c, F.greatest(F.floor(i / c) * c - c, F.lit(0))))
        met = _bound(hits, lambda own: F.array_distinct(F.flatten(F.flatten(F.transform(F.array(*[F.lit(c) for c in classes]), lambda c: F.transform(own, lambda i: both(c, i)))))))
        found = lambda w: F.array_distinct(F.slice(shingles, w["start"] + 1, 2 * w["class"] - WIDTH + 1))
        return F.transform(met, lambda w: F.struct(w["class"].alias("class"), w["start"].alias("start"), found(w).alias("found")))

    # an outer generator and a filter after it: a filter on the arrays before it would make Spark build them again for each use
    # numbers are given in a step of their own, as they would else count windows
    cut = _bound(_shingles(_words(F.col("text"))), windows)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    windowed = numbered.select("row", "id", F.inline_outer(cut)).where("class is not null")
    banded = windowed.select("row", "id", "class", "start", "found", F.inline(_signature(F.col("found"))))
    retrieved = sized_join(banded, bands, ["class", "band", "value"], "inner", len(named) * BANDS)
    contained = F.size(F.array_intersect("own", "found")) / F.size("own")
    sure = retrieved.withColumn("containment", contained).where(F.col("containment") >= CONTAINMENT)
    best = sure.groupBy("row", "license").agg(F.first("id").alias("id"), F.min("start").cast("long").alias("start"), F.max("containment").alias("containment"))
    return best.select(F.col("id").alias(id_col), "license", "start", "containment")
