"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Templates are a small fixed table. A template of ``m`` shingles belongs to the scale whose window holds 2 to 4 times as
many; windows start every half window, so one of them holds an untouched passage whole, with a Jaccard similarity of at least
a quarter (a half for the longest of a scale): with ``BANDS`` bands of one MinHash each, it is missed with a chance of at
most (3/4)^48 = 1e-6. At containment 0.8 the similarity is at least 0.8/4.2, the chance at most 4e-5. Hits are counted over
the retrieved window and both neighbours, so a passage that edits have stretched up to a window's length counts whole though
two windows share it; either may retrieve it, by one band with a chance of at least 0.8/6.2 (0.8/3.2 for the longest of a
scale), so at containment 0.8 it is missed with a chance of at most 1.4e-3 (1e-6). A document, and
a window, without any template shingle can't match and is left out first, exactly, by a constant array of all templates' shingles
in the plan: the list may be some thousand shingles long. Bands and templates are broadcast tables as long as the list. A template of fewer than ``SHINGLE`` words
is one shingle, its whole word sequence, and is looked for exactly, without windows; one without words is an error.

Everything on the main path is a native expression. Words are lower-cased A-Z, with marks at their edges dropped.

Defined results: null, empty and short texts match nothing and give no row; a template that occurs several times gives one
row with the best containment; repeated rows give repeated results (they carry their own row id); an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATOR_CLASS, let, once, table, written

SHINGLE, BANDS, THRESHOLD = 5, 48, 0.8
#: Well-known license notices (fixed values; public texts).
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def _words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bare = F.regexp_replace(lower, r"[.,;:()\"]+(?=[\x20\x09-\x0D]|$)|(?<![^\x20\x09-\x0D])[(\"]+", "")
    return F.filter(F.split(bare, SEPARATOR_CLASS + "+"), lambda w: w != "")


def _grams(w: Column, k: int) -> Column:
    """Hashes of the k-word shingles, in order; a text of fewer words has none."""
    n = F.greatest(F.size(w) - (k - 1), F.lit(0))
    return F.slice(F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)])), F.lit(1), n)


def _shingles(w: Column) -> Column:
    return _grams(w, SHINGLE)


def _bands(shingles: Column) -> Column:
    """The MinHash of each band: one array of ``BANDS`` minima."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, b))))


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> list[dict]:
    """Name, k, distinct shingle hashes, bands and window of each template (a bounded driver-side table)."""
    rows = spark.createDataFrame(list((templates or TEMPLATES).items()), "name string, text string")
    made = rows.select("name", _words(F.col("text")).alias("w")).select("name", F.least(F.size("w"), F.lit(SHINGLE)).alias("k"), "w")
    whole = lambda w: F.coalesce(*[F.when(F.size(w) == k, _grams(w, k)) for k in range(1, SHINGLE)], _shingles(w))
    found = made.select("name", "k", let(let(F.col("w"), whole), F.array_distinct).alias("shingles")).select("*", let(F.col("shingles"), _bands).alias("bands")).collect()
    if empty := [r["name"] for r in found if not r["k"]]:
        raise ValueError(f"license templates without words: {empty}")
    return [{**r.asDict(), "window": 4 << (len(r["shingles"]) - 1).bit_length() - 1 if len(r["shingles"]) > 1 else 2} for r in found]


def _short_matches(docs: DataFrame, key: str, text: str, short: list[dict]) -> DataFrame:
    """The result rows of templates that are one shingle of fewer than ``SHINGLE`` words: each document that holds it."""
    held = lambda w, t: F.array_contains(_grams(w, t["k"]), F.lit(t["shingles"][0]).cast("long"))
    names = let(_words(docs[text]), lambda w: F.array_compact(F.array(*[F.when(held(w, t), F.lit(t["name"])) for t in short])))
    return docs.select(docs[key].alias(key), F.explode(names).alias("license")).select(key, "license", F.lit(1).cast("long").alias("n_shingles"), F.lit(1).cast("long").alias("hits"), F.lit(1.0).alias("containment"))


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """key, license, n_shingles (of the template), hits (most in a window with its neighbours) and containment, one row per document and template."""
    spark = docs.sparkSession
    known = template_table(spark, templates)
    if short := [t for t in known if t["k"] < SHINGLE]:
        found, rest = _short_matches(docs, key, text, short), {t["name"]: (templates or TEMPLATES)[t["name"]] for t in known if t["k"] == SHINGLE}
        return found.unionByName(license_scan(docs, key, text, rest, threshold)) if rest else found
    long_array = lambda xs: F.expr("array(" + ", ".join(f"{x}L" if x > -(1 << 63) else f"({x + 1}L - 1L)" for x in xs) + ")")
    every = long_array(sorted({h for t in known for h in t["shingles"]}))
    base = once(docs.select(docs[key].alias("__key"), docs[text].alias("__text")), "__sh", let(_words(F.col("__text")), _shingles)).drop("__text")
    # Few documents hold a template shingle; theirs are written once, as every scale reads them.
    base = written(base.where(F.arrays_overlap("__sh", every)).withColumn("__row", F.monotonically_increasing_id()), "license-shingles")
    # Bands and templates are tables as long as the template list, whatever the corpus.
    bands = spark.createDataFrame([(t["name"], b) for t in known for b in t["bands"]], "license string, band long")
    kept = spark.createDataFrame([(t["name"], len(t["shingles"]), t["shingles"]) for t in known], "license string, n_shingles long, template array<long>")
    out = None
    for size in sorted({t["window"] for t in known}):
        here = [t["name"] for t in known if t["window"] == size]
        mine = long_array(sorted({h for t in known if t["window"] == size for h in t["shingles"]}))
        step = max(1, size // 2)
        starts = F.sequence(F.lit(1), F.greatest(F.size("__sh"), F.lit(1)), F.lit(step))
        first = lambda s: F.greatest(s - step, F.lit(1))  # noqa: E731  where the window before starts
        window = lambda s: F.struct(F.array_distinct(F.slice("__sh", s, size)).alias("w"), F.slice("__sh", first(s), s - first(s) + size + step).alias("near"), s.alias("s"))
        windows = base.select("__key", "__row", F.explode(F.filter(F.transform(starts, window), lambda x: F.arrays_overlap(x["w"], mine))).alias("__w"))
        # A minimum is hashed with its band's number, so it meets only its own band.
        banded = once(windows, "__b", let(F.col("__w.w"), _bands)).select("__key", "__row", "__w.s", F.col("__w.near").alias("near"), F.explode(F.array_distinct("__b")).alias("band"))
        met = banded.join(F.broadcast(bands.where(F.col("license").isin(here))), "band")  # BANDS rows a template
        retrieved = met.groupBy("__key", "__row", "s", "license").agg(F.first("near").alias("near"))
        hits = retrieved.join(F.broadcast(kept), "license").select("__key", "__row", "license", "n_shingles", F.size(F.array_intersect("near", "template")).cast("long").alias("hits"))  # one row a template
        out = hits if out is None else out.unionByName(hits)
    best = out.where(F.col("hits") >= F.ceil(F.col("n_shingles") * threshold - 1e-9)).groupBy("__key", "__row", "license", "n_shingles").agg(F.max("hits").alias("hits"))
    return best.select(F.col("__key").alias(key), "license", "n_shingles", "hits", (F.col("hits") / F.col("n_shingles")).alias("containment"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
