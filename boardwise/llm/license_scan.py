"""License scans: MinHash bands over overlapping windows of words retrieve templates, exact containment verifies them.

Built from DataFrame functions only. Window sizes double from class to class; a template belongs to the class of its size, so
that wherever it stands, one window holds it whole and is at most four times as large. At the least containment the two then have a
Jaccard similarity of 0.8 / 4.2, or 0.19, or more, and of BANDS bands with one row each, some band collides with a
probability of 1 - (1 - 0.19) ** BANDS, over 0.998. Of a window, only shingles that templates of its class have are kept, and
windows are made where there are such shingles; that loses nothing and makes likeness greater.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, let, text_or_empty

SHINGLE, LEAST, BANDS = 5, 0.8, 32
#: Templates' hashes and bands, up to which their tables go out by broadcast (some 200 MB); larger ones are joined by shuffles.
BROADCAST = 1_000_000
MASK = (1 << 64) - 1

#: Usual notices of public licenses.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
]

#: What the query scans for: more notices, some of under five words, and BSD texts that tell two clauses from three.
_GNU = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {0}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"
_SPDX = [
    "MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC",
    "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0",
]
_CC = {"CC-BY": "Attribution", "CC-BY-SA": "Attribution-ShareAlike", "CC-BY-NC": "Attribution-NonCommercial", "CC-BY-ND": "Attribution-NoDerivatives", "CC-BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "CC-BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
NOTICES = [
    *(t for t in TEMPLATES if t[0] != "BSD-3-Clause"),
    ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", _BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ")),
    ("MIT", "licensed under the MIT License"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    *(("GPL-2.0" if v == "2" else "GPL-3.0", _GNU.format(w, "", v)) for w in ("program", "library") for v in ("2", "3")),
    *((f"LGPL-{v if v == '2.1' else '3.0'}", _GNU.format(w, "Lesser ", v)) for w in ("program", "library") for v in ("2.1", "3")),
    *(("AGPL-3.0", _GNU.format(w, "Affero ", "3")) for w in ("program", "library")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    *((f"{k}-4.0", f"licensed under a Creative Commons {v} 4.0 International License") for k, v in _CC.items()),
    *((f"{k}-4.0", f"Licensed under {k.replace('-', ' ', 1)} 4.0.") for k in _CC if k != "CC-BY-NC"),
    *((k, f"SPDX-License-Identifier: {k}") for k in _SPDX),
]


def _bare(text: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(text), r"[^a-z0-9\x80-\x{10FFFF}]+", " "))


def shingles(text: Column) -> Column:
    """Hashes of five-word shingles, in order, of a text's lower-cased letters and digits."""
    bare = _bare(text)
    of = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))
    return let(F.split(bare, " "), lambda w: F.when(F.size(w) < SHINGLE, F.array().cast("array<bigint>")).otherwise(of(w)))


def _masks(n: int) -> list[int]:
    """Fixed 64-bit words, signed: each orders hashes anew, by exclusive or."""
    out, x = [], 0x9E3779B97F4A7C15
    for _ in range(n):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
        x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
        out.append(x - (1 << 64) if x >> 63 else x)
    return out


def bands(hashes: Column) -> Column:
    """Array of MinHash values, one a band."""

    def least(mask: int) -> Column:
        return F.array_min(F.transform(hashes, lambda x: x.bitwiseXOR(F.lit(mask))))

    return F.array(*map(least, _masks(BANDS)))


def _templates(docs: DataFrame, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """license, template (its number), own (distinct shingles), class (its number of shingles' power of two). Not of short ones."""
    rows = [(name, i, text) for i, (name, text) in enumerate(templates)]
    df = docs.sparkSession.createDataFrame(rows, "license string, template int, text string")
    own = F.array_distinct(shingles(F.col("text")))
    df = df.select("license", "template", own.alias("own")).where("size(own) > 0")
    return df.withColumn("size_class", F.ceil(F.log2(F.size("own"))).cast("int"))


def _short_hits(docs: DataFrame, templates: Sequence[tuple[str, str]]) -> DataFrame | None:
    """Hits of the templates of under five words, each found as a whole sequence of words; None without such templates."""
    rows = docs.sparkSession.createDataFrame([*templates], "license string, text string").select("license", _bare(F.col("text")).alias("words")).collect()
    if any(not r.words for r in rows):
        raise ValueError("a template has no word")
    short = [r for r in rows if len(r.words.split(" ")) < SHINGLE]
    if not short:
        return None
    known = F.array(*[F.struct(F.lit(r.license).alias("license"), F.lit(f" {r.words} ").alias("words")) for r in short])
    each = docs.select("doc_id", F.concat(F.lit(" "), _bare(text_or_empty()), F.lit(" ")).alias("words"))
    at = lambda k: F.instr(F.col("words"), k["words"])
    each = each.select("doc_id", F.inline(F.transform(known, lambda k: F.struct(k["license"].alias("license"), F.when(at(k) > 0, F.regexp_count(F.substr("words", F.lit(1), at(k)), F.lit(" ")) - 1).alias("start")))))
    return each.where("start is not null").select("doc_id", "license", "start", F.lit(1.0).alias("containment"))


def _apart(known: DataFrame, least_shared: float = 0.5) -> DataFrame:
    """template, apart: its shingles that a near template of another license lacks, one array for each such template.

    Near ones share at least `least_shared` of its shingles. Of its rarest shingles, as many as a near one can lack and one
    more, one is in each near template; so only those look for others, and hot shingles join little.
    """
    each = known.select("template", "license", F.explode("own").alias("hash"))
    counts = each.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    order = F.array_sort(F.collect_list(F.struct("n", "hash")))
    rarest = each.join(counts, "hash").groupBy("template", "license").agg(order.alias("order"))
    enough = F.size("order") - F.ceil(least_shared * F.size("order")).cast("int") + 1
    rarest = rarest.select("template", "license", F.explode(F.slice("order", F.lit(1), enough)["hash"]).alias("hash"))
    others = each.select(F.col("template").alias("near"), F.col("license").alias("other"), "hash")
    pairs = rarest.join(others, "hash").where("license <> other").select("template", "near").distinct()
    pairs = pairs.join(known.select("template", "own"), "template").join(known.select(F.col("template").alias("near"), F.col("own").alias("others")), "near")
    lacks = pairs.select("template", F.size("own").alias("n"), F.array_except("own", "others").alias("lacks"))
    near = lacks.where((F.size("lacks") > 0) & (F.col("n") - F.size("lacks") >= least_shared * F.col("n")))
    return near.groupBy("template").agg(F.collect_list("lacks").alias("apart"))


def _windows(docs: DataFrame, of_class: DataFrame, least: float) -> DataFrame:
    """doc_id, copy (a hash of the text), size_class, start and window (its distinct shingles of of_class (size_class, hash)) of
    the windows that have enough of them to hold `least` of a template of their class."""
    text = text_or_empty()
    words = docs.select("doc_id", F.xxhash64(text).alias("copy"), F.posexplode(shingles(text)).alias("at", "hash"))
    hits = words.join(of_class, "hash").withColumn("k", F.expr("shiftright(at, size_class)"))
    holding = F.explode(F.when(F.col("k") > 0, F.array(F.col("k") - 1, F.col("k"))).otherwise(F.array("k"))).alias("k")
    windows = hits.select("doc_id", "copy", "size_class", "hash", holding).groupBy("doc_id", "copy", "size_class", "k").agg(F.collect_set("hash").alias("window"))
    return windows.where(F.size("window") >= least * F.pow(F.lit(2.0), F.col("size_class") - 1)).withColumn("start", F.expr("shiftleft(k, size_class)"))


def _hits(docs: DataFrame, known: DataFrame, least: float, apart: bool) -> DataFrame:
    """doc_id, license, start and containment of each window that holds a template (license, template, own, size_class)."""
    size = known.agg(F.coalesce(F.sum(F.size("own") + BANDS), F.lit(0))).first()[0]
    held = F.broadcast if size <= BROADCAST else lambda df: df
    windows = _windows(docs, held(known.select("size_class", F.explode("own").alias("hash")).distinct()), least)
    keyed = windows.select("doc_id", "size_class", "start", "window", F.posexplode(bands(F.col("window"))).alias("band", "value"))
    of_templates = known.select("template", "size_class", F.posexplode(bands(F.col("own"))).alias("band", "value"))
    met = keyed.join(held(of_templates), ["size_class", "band", "value"]).drop("size_class").join(held(known.drop("size_class")), "template")
    share = F.size(F.array_intersect("own", "window")) / F.size("own")
    met = met.withColumn("containment", share).where(F.col("containment") >= least)
    if apart:
        met = met.where(F.forall("apart", lambda x: 2 * F.size(F.array_intersect(x, F.col("window"))) > F.size(x)))
    return met.select("doc_id", "license", "start", "containment")


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), least: float = LEAST, apart: bool = False) -> DataFrame:
    """doc_id, license, containment (of its best template) and first_word (of the first such window) of each license found.

    A license counts if a window of the text holds at least `least` of the distinct shingles of one of its templates;
    with `apart`, also over half of those that tell it from each near template of another license. Templates of
    under five words are found as whole sequences, each by a search of its own; there can be any number of templates, of any length.
    Windows of class c have 2 * 2^c shingles and start at every 2^c-th. Null and short texts hold none. Repeated rows
    count as one document, null doc_ids too; other columns, whatever their names, don't matter; an empty table gives an empty
    result. A very long text is one row; what is shuffled of it are its shingles that templates have, window by window.
    """
    known = checkpointed(_templates(docs, templates))
    if apart:
        near = known.join(_apart(known), "template", "left")
        known = checkpointed(near.withColumn("apart", F.coalesce("apart", F.array().cast("array<array<bigint>>"))))
    met = _hits(docs, known, least, apart)
    if (short := _short_hits(docs, templates)) is not None:
        met = met.unionByName(short)
    return met.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("start").cast("long").alias("first_word"))
