"""License scans (operator 3), in DataFrame functions only.

A text's words are cut into shingles of SHINGLE words and overlapping windows.
Windows and license templates get HASHES MinHash values; one equal value (a
band of one row) retrieves the template for the window, and the exact share of
the template's shingles in the window verifies it.

Windows are 1.5 times as long as a template's length class and start every
half class, so each occurrence lies in one window whole.  A template that is
there to SHARE = 0.8 then has a Jaccard similarity of 0.8 / (1.5 * 1.25 + 0.2)
= 0.385 at least with that window, and is retrieved with a probability of
1 - (1 - 0.385) ** 32 > 0.9999998.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revspark.llm.common import id_text

SHINGLE = 3
HASHES = 32
SHARE = 0.8
GROWTH = 1.25
#: Templates at most; their MinHash rows and shingles are broadcast.
MAX_TEMPLATES = 10_000

#: License notices to look for (fixed values).  An id names what its notice
#: establishes: where two licenses or versions would share 0.8 of a notice, the
#: template is cut down to the part that tells them apart, or the id has no version.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file is strictly prohibited"),
    ("All-Rights-Reserved", "All rights reserved."),
    ("Proprietary", "This software is the confidential and proprietary information of"),
    ("Apache-2.0", "Licensed under the Apache License 2.0"),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Distributed under the MIT License"),
    ("MIT", "This project is licensed under the terms of the MIT license"),
    ("MIT", "Use of this source code is governed by an MIT-style license"),
    ("BSD", "Use of this source code is governed by a BSD-style license"),
    ("BSD", "Licensed under the BSD License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("GPL-family", "This program is free software: you can redistribute it and/or modify it"),
    ("GPL", "under the terms of the GNU General Public License"),
    ("GPL-2.0", "GNU General Public License version 2"),
    ("GPL-2.0", "GNU General Public License v2"),
    ("GPL-3.0", "GNU General Public License version 3"),
    ("GPL-3.0", "GNU General Public License v3"),
    ("LGPL", "under the terms of the GNU Lesser General Public License"),
    ("LGPL", "under the terms of the GNU Library General Public License"),
    ("LGPL-2.1", "GNU Lesser General Public License version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License version 3"),
    ("AGPL", "under the terms of the GNU Affero General Public License"),
    ("AGPL-3.0", "GNU Affero General Public License version 3"),
    ("MPL-1", "The contents of this file are subject to the Mozilla Public License"),
    ("MPL-2.0", "Licensed under the Mozilla Public License 2.0"),
    ("EPL", "made available under the terms of the Eclipse Public License"),
    ("CDDL", "subject to the terms of the Common Development and Distribution License"),
    ("EUPL", "Licensed under the EUPL"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC", "Licensed under the ISC License"),
    ("0BSD", "without fee is hereby granted. The software is provided"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("WTFPL", "Do What The Fuck You Want To Public License"),
    ("Artistic", "under the terms of the Artistic License"),
    ("PostgreSQL", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("CC0-1.0", "Licensed under CC0 1.0"),
    ("CC0-1.0", "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-ND-4.0", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    *((x, f"SPDX-License-Identifier: {x}") for x in (
        "Apache-2.0", "MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0",
        "MPL-2.0", "EPL-1.0", "EPL-2.0", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense", "Zlib")),
)


def once(value: Column) -> Column:
    """A generator of one row: what it gives is computed once, while a projected
    expression would be copied into every later use, even inside a lambda."""
    return F.explode(F.array(value))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(ws: Column) -> Column:
    """Hash of every run of SHINGLE words; a shorter text is one shingle, no words give none."""
    many = F.transform(F.sequence(F.lit(0), F.size(ws) - SHINGLE), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(SHINGLE)]))
    return (F.when(F.size(ws) >= SHINGLE, many).when(F.size(ws) > 0, F.array(F.xxhash64(F.array_join(ws, " "))))
            .otherwise(F.array().cast("array<bigint>")))


def min_hashes(s: Column) -> Column:
    """HASHES values: the smallest of each of that many hashes of the set, numbered."""
    return F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda k: F.xxhash64(k, F.array_min(F.transform(s, lambda x: F.xxhash64(x, k)))))


def length_class(n: int) -> int:
    """n rounded up to a power of GROWTH, in whole shingles."""
    return math.ceil(GROWTH ** math.ceil(math.log(n, GROWTH) - 1e-9))


def _windows(c: int, half: int, long: int, own: Column) -> Column:
    """Windows of ``long`` shingles, one every ``half``, that hold one of the shingles ``own``."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("s") - 1, F.lit(0)), F.lit(half))
    cut = F.transform(starts, lambda i: F.struct(F.lit(c).alias("class"), i.alias("at"), F.slice(F.col("s"), i + 1, F.lit(long)).alias("w")))
    return F.filter(cut, lambda x: F.arrays_overlap(x["w"], own))


def templates(spark) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license_id string, text string")


def scan(docs: DataFrame, licenses: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and license found: doc_id, license_id, containment, first_word, n_windows.

    licenses: license_id, text; at most MAX_TEMPLATES rows (more raise an
    error).  containment is the largest share of one of the license's
    templates in one window of the document, at least ``share``; first_word
    the first word (from 0) of the first such window; n_windows the windows
    with a verified match.  Null, empty and white texts and templates match
    nothing.  Repeated rows of an id are one document; a null id is reported
    as null.  An empty table gives an empty result; other columns are never
    read."""
    known = licenses.select("license_id", once(words(F.coalesce("text", F.lit("")))).alias("ws")).select("license_id", F.array_distinct(shingles(F.col("ws"))).alias("t")).filter(F.size("t") > 0)
    # A bounded parameter table: its shingle hashes are part of the query.
    rows = known.limit(MAX_TEMPLATES + 1).collect()
    if len(rows) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} license templates")
    spark = docs.sparkSession
    schema = "template int, license_id string, class int, t array<bigint>"
    table = spark.createDataFrame([(i, r.license_id, length_class(len(r.t)), r.t) for i, r in enumerate(rows)], schema)
    by_hash = F.broadcast(table.select("template", "license_id", "class", "t", F.explode(min_hashes(F.col("t"))).alias("h")))

    def literal(hashes: set[int]) -> Column:
        return F.array(*[F.lit(h) for h in sorted(hashes)]).cast("array<bigint>")

    every = literal({h for r in rows for h in r.t})
    texts = id_text(docs, id_col, text_col).select("doc_id", once(words(F.col("text"))).alias("ws")).select("doc_id", once(shingles(F.col("ws"))).alias("s"))
    # A text without any template's shingle can hold no template; the same goes for a window.
    hit = texts.filter(F.arrays_overlap("s", every))
    cuts = []
    for c in sorted({length_class(len(r.t)) for r in rows}):
        own = literal({h for r in rows if length_class(len(r.t)) == c for h in r.t})
        cuts.append(_windows(c, max(1, c // 2), math.ceil(1.5 * c), own))
    none = F.array().cast("array<struct<class:int,at:int,w:array<bigint>>>")
    windows = hit.select("doc_id", F.explode(F.concat(*cuts) if cuts else none).alias("x")).select("doc_id", "x.class", "x.at", once(F.array_distinct("x.w")).alias("w"))
    keyed = windows.select("doc_id", "class", "at", "w", F.explode(min_hashes(F.col("w"))).alias("h"))
    inside = F.size(F.array_intersect("t", "w")) / F.size("t")
    found = keyed.join(by_hash, ["class", "h"]).withColumn("containment", inside).filter(F.col("containment") >= share)
    return (found.groupBy("doc_id", "license_id", "class", "at").agg(F.max("containment").alias("containment"))
            .groupBy("doc_id", "license_id").agg(F.max("containment").alias("containment"), F.min("at").alias("first_word"), F.count("*").alias("n_windows")))
