"""Operator 9: licence scan, with DataFrame functions only.

Texts and templates are cut into shingles of five words (lower case, letters and digits).  Templates are grouped by
length: class c, a power of two, has those with more than c/2 and up to c shingles.  For each class, windows of 2c shingles begin at every c-th
shingle, so any stretch as long as a template lies whole in some window.  Windows and templates are sketched by one
permutation MinHash: shingles fall into ``BANDS`` bins, each bin's least hash is a band of one row.  A band collides if a shingle
of the template is the least of its bin in the window.  A window that holds share s of a template's t shingles misses all
of them with probability of about (1 - s t / (2c + t))**(nonempty bins of t), and far less when bins hold few shingles: 32 bins for windows of up to 32 shingles mostly
hold one each, where any shared shingle collides.  Retrieved pairs are verified by exact containment: the share of the template's
shingles (as text) that are in the window.

Only shingles that are some template's least of a bin can make a band collide, so windows without any are not sketched;
that is a lookup in a set bounded by the number of templates, which are a parameter of at most ``MOST_TEMPLATES`` entries.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BANDS = 32
WORDS = 5
CONTAINMENT = 0.8
MOST_TEMPLATES = 1000

#: Notices by which common licences are declared.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def template_shingles(text: str) -> list[str]:
    """Distinct shingles of a template, in order."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    if len(words) < WORDS:
        raise ValueError(f"a template needs {WORDS} words: {text!r}")
    return list(dict.fromkeys(" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)))


def _signed(shingle: str) -> int:
    """What ``xxhash64`` gives for the words: each word's hash is the seed of the next."""
    h = 42
    for word in shingle.split(" "):
        h = xxhash.xxh64_intdigest(word.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def _bands(shingles: list[str]) -> dict[int, int]:
    least: dict[int, int] = {}
    for h in map(_signed, shingles):
        least[h % BANDS] = min(least.get(h % BANDS, h), h)
    return least


def scan(documents: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, license, containment, first_word``: a row for each document and template it holds.

    ``containment`` is the greatest share of the template in a window and ``first_word`` the place of the
    first of its shingles in a window that holds it.  Null and empty texts and texts under five words hold none.  Rows that share an id give one row for each
    template; rows with a null id give rows with a null id.  An empty table, or no templates, give no rows.  Other columns are not read.
    """
    spark = documents.sparkSession
    templates = TEMPLATES if templates is None else templates
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates")
    known, bands = [], []
    for name, text in sorted(templates.items()):
        sh = template_shingles(text)
        size = 1
        while size < len(sh):
            size *= 2
        known.append((name, size, sh))
        bands += [(name, size, b, h) for b, h in sorted(_bands(sh).items())]
    leasts = sorted({h for *_, h in bands})
    sizes = sorted({s for _, s, _ in known})
    if not sizes:
        return documents.select("doc_id").limit(0).selectExpr("doc_id", "cast(null as string) license", "cast(null as double) containment", "cast(null as long) first_word")
    among = "(" + ", ".join(f"{h}L" if h > -(1 << 63) else f"({h + 1}L - 1L)" for h in leasts) + ")"
    # Lambda variables hold words and shingles, so that neither is made again for every use.
    some = ", ".join(
        f"filter(transform(sequence(0, (size(sh) - 1) div {c}), k -> struct({c} as size, int(k * {c}) as at, slice(sh, int(k * {c} + 1), {2 * c}) as sh,"
        f" slice(ws, int(k * {c} + 1), {2 * c + WORDS - 1}) as words)), w -> exists(w.sh, x -> x in {among}))"
        for c in sizes
    )
    kind = "array<struct<size:int,at:int,sh:array<bigint>,words:array<string>>>"
    words_at = ", ".join(f"get(ws, i + {n})" for n in range(WORDS))
    cut = f"transform(array(transform(sequence(0, size(ws) - {WORDS}), i -> xxhash64({words_at}))), sh -> if(exists(sh, x -> x in {among}), concat({some}), cast(array() as {kind})))"
    words = "split(trim(regexp_replace(lower(text), '[^\\\\p{L}\\\\p{N}]+', ' ')), ' ')"
    found = f"transform(filter(array({words}), ws -> size(ws) >= {WORDS}), ws -> element_at({cut}, 1))"
    windows = documents.select("doc_id", F.explode(F.expr(f"flatten({found})")).alias("w")).select("doc_id", "w.size", "w.at", "w.sh", "w.words")
    sketch = F.expr(f"transform(sequence(0, {BANDS - 1}), b -> array_min(filter(sh, x -> pmod(x, {BANDS}) = b)))")
    sketched = windows.select("doc_id", "size", "at", "words", F.posexplode(sketch).alias("band", "least")).where("least is not null")
    # As many rows as templates have bands: bounded by the parameter.
    table = F.broadcast(spark.createDataFrame(bands, "license string, size_ int, band_ int, least_ long"))
    met = sketched.join(table, (F.col("size") == F.col("size_")) & (F.col("band") == F.col("band_")) & (F.col("least") == F.col("least_")))
    exact = F.broadcast(spark.createDataFrame(known, "license_ string, size__ int, shingles array<string>"))
    own = f"transform(sequence(1, size(words) - {WORDS - 1}), i -> concat_ws(' ', slice(words, i, {WORDS})))"
    compared = met.join(exact, F.col("license") == F.col("license_")).select("doc_id", "license", "at", "shingles", F.expr(own).alias("own"))
    verified = compared.select(
        "doc_id",
        "license",
        F.expr("size(array_intersect(shingles, own)) / size(shingles)").alias("share"),
        F.expr("at + array_min(filter(sequence(0, size(own) - 1), i -> array_contains(shingles, own[i])))").alias("word"),
    )
    return (
        verified.where(F.col("share") >= containment)
        .groupBy("doc_id", "license")
        .agg(F.round(F.max("share"), 6).alias("containment"), F.min("word").cast("long").alias("first_word"))
    )
