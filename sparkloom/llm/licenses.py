"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Whole texts with an anchor word are compared to the licences' full texts (license_texts/, without their copyright
lines); the document frequencies of these terms are those among the full texts. A text takes the licence of
the highest cosine, if that is at least `min_whole`, and is then a licence file, whatever its headers say.

Headers are the lines of a text that hold a template's anchor word; a licence file is also a text of which at
least `file_share` of the words lie in matched headers. Terms are the templates' words (a bounded vocabulary);
their document frequencies are counted over the headers of all texts. A header gets the template of the highest
cosine, if that is at least `min_cosine`, and a text without a whole match the best of its headers. A text without a
licence of its own inherits from the licence file in the nearest directory above it.

Paths are split at '/'. Distinct directories are resolved first and documents joined to them, so a directory
with any number of documents is one row until the last join; all its ancestors are looked at, however deep.

Defined results: a null or empty text has no header; a null path inherits nothing; ties go to the
smaller licence name; repeated rows are scanned each; of several licence files in a directory the
one with the highest cosine counts, then the smaller licence name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_join, table

#: Header texts of well-known licences (fixed values).
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License"),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the conditions are met", "BSD 3-Clause License"),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has dedicated all copyright to the public domain (CC0 1.0).",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "LGPL-3.0": ("under the terms of the GNU Lesser General Public License, version 3",),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}
#: A line without any of these words is no header (fixed values).
ANCHORS = ("licen[cs]e", "licen[cs]ed", "redistribution", "permission", "copyright", "spdx", "public domain")


@dataclass(frozen=True)
class LicenseParams:
    min_cosine: float = 0.6
    file_share: float = 0.5
    min_whole: float = 0.75


_WORD = "[a-z0-9]+(?:[.-][0-9a-z]+)*"


def terms(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def _terms(c):
    return F.regexp_extract_all(F.lower(c), F.lit("(" + _WORD + ")"), F.lit(1))


def full_texts() -> dict[str, list[str]]:
    """Terms of each licence's full text."""
    texts = {f.stem: f.read_text(encoding="utf-8") for f in (Path(__file__).parent / "license_texts").glob("*.txt")}
    return {name: terms(re.sub(r"(?im)^\s*copyright\b.*$", "", t)) for name, t in sorted(texts.items())}


def whole_matches(rows: DataFrame, p: LicenseParams) -> DataFrame:
    """row, whole_license and whole_cosine of the rows (row, words) that are a licence's full text."""
    spark = rows.sparkSession
    full = {name: Counter(ws) for name, ws in full_texts().items()}
    found = Counter(w for c in full.values() for w in c)
    idf = {w: math.log((1 + len(full)) / (1 + n)) + 1 for w, n in found.items()}
    parts = []
    for name, c in full.items():
        v = {w: (1 + math.log(n)) * idf[w] for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        parts += [(name, w, x / norm) for w, x in sorted(v.items())]
    weight = spark.createDataFrame(parts, "license string, term string, t double").groupBy("term").agg(F.collect_list(F.struct("license", "t")).alias("in"))
    value = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    tf = rows.where("words is not null").select("row", F.explode("words").alias("term")).groupBy("row", "term").agg(F.count("*").alias("tf"))
    x = (1 + F.log("tf")) * F.coalesce("idf", F.lit(math.log(1 + len(full)) + 1))
    tf = table(tf.join(F.broadcast(value), "term", "left").withColumn("x", x), "words")
    norm = tf.groupBy("row").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("norm"))
    dot = tf.join(F.broadcast(weight), "term").select("row", "x", F.explode("in").alias("m")).groupBy("row", F.col("m.license").alias("license")).agg(F.sum(F.col("x") * F.col("m.t")).alias("dot"))
    cosine = dot.join(norm, "row").select("row", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("cosine")).where(F.col("cosine") >= p.min_whole)
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "license"))["license"]
    return table(cosine.groupBy("row").agg(F.max("cosine").alias("whole_cosine"), best.alias("whole_license")), "whole")


def scan(docs: DataFrame, p: LicenseParams = LicenseParams(), id_col: str = "doc_id", text: str = "text", path: str = "path", templates: dict = TEMPLATES) -> DataFrame:
    """Per row: id_col, path, license, cosine, license_file, origin (`own`, `inherited` or `none`), from_dir."""
    spark = docs.sparkSession
    names = docs.columns
    d = docs.toDF(*[f"c{i}" for i in range(len(names))]).select(F.col(f"c{names.index(id_col)}").alias("id"), F.col(f"c{names.index(path)}").cast("string").alias("path"), F.col(f"c{names.index(text)}").alias("text"))
    vocabulary = sorted({w for group in templates.values() for t in group for w in terms(t)})
    anchor = "(?i)\\b(" + "|".join(ANCHORS) + ")\\b"
    # one pass over the texts: lines with an anchor, and which template words occur in them
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\\r?\\n"), lambda x: x.rlike(anchor))
    headers = F.transform(F.when(F.col("text").rlike(anchor), lines).otherwise(F.array().cast("array<string>")), _terms)
    words = F.when(F.size("headers") > 0, _terms(F.coalesce("text", F.lit(""))))
    rows = table(d.withColumn("headers", headers).select("id", "path", "headers", words.alias("words")).withColumn("n_words", F.when(F.col("words").isNotNull(), F.size("words"))).withColumn("row", F.monotonically_increasing_id()), "headers")
    n_docs = rows.count()
    # document frequencies over the headers of all texts; a text without headers holds no term
    df = rows.where(F.size("headers") > 0).select(F.explode(F.array_distinct(F.flatten("headers"))).alias("term")).where(F.col("term").isin(vocabulary)).groupBy("term").count()
    found = {r["term"]: r["count"] for r in df.collect()}  # at most the templates' vocabulary
    idf = {w: math.log((1 + n_docs) / (1 + found.get(w, 0))) + 1 for w in vocabulary}

    def vector(words: list[str]) -> dict[str, float]:
        v = {w: (1 + math.log(words.count(w))) * idf[w] for w in set(words)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    unknown = max(idf.values(), default=1.0)
    weight = spark.createDataFrame([(name, k, w, float(x)) for name, group in sorted(templates.items()) for k, t in enumerate(group) for w, x in sorted(vector(terms(t)).items())], "license string, k int, term string, t double")
    value = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    hit = rows.where(F.size("headers") > 0).select("row", F.posexplode("headers").alias("line", "words"))
    tf = hit.select("row", "line", F.size("words").alias("size"), F.explode("words").alias("term")).groupBy("row", "line", "size", "term").agg(F.count("*").alias("tf"))
    tf = tf.join(F.broadcast(value), "term", "left").withColumn("x", (1 + F.log("tf")) * F.coalesce("idf", F.lit(unknown)))
    tf = table(tf, "terms")
    norm = tf.groupBy("row", "line", "size").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("norm"))
    dot = tf.join(F.broadcast(weight), "term").groupBy("row", "line", "license", "k").agg(F.sum(F.col("x") * F.col("t")).alias("dot"))
    cosine = dot.join(norm, ["row", "line"]).select("row", "line", "size", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("cosine")).where(F.col("cosine") >= p.min_cosine)
    per_line = cosine.groupBy("row", "line", "size").agg(F.max("cosine").alias("cosine"), F.min(F.struct((-F.col("cosine")).alias("c"), "license"))["license"].alias("license"))
    own = table(per_line.groupBy("row").agg(F.max("cosine").alias("cosine"), F.min(F.struct((-F.col("cosine")).alias("c"), "license"))["license"].alias("license"), F.sum("size").alias("in_headers")), "own")
    folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(F.when(F.col("path").isNotNull(), ""))
    full = rows.drop("headers", "words").join(own, "row", "left").join(whole_matches(rows, p), "row", "left").withColumn("dir", folder)
    full = full.withColumns({"license": F.coalesce("whole_license", "license"), "cosine": F.coalesce("whole_cosine", "cosine")})
    in_headers = F.coalesce(F.col("in_headers") >= p.file_share * F.col("n_words"), F.lit(False))
    full = table(full.withColumn("license_file", F.col("whole_license").isNotNull() | in_headers), "scanned")

    # directories: the nearest one above (itself included) with a licence file
    files = full.where("license_file and dir is not null").groupBy(F.col("dir").alias("above")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license"))["license"].alias("dir_license"))
    files = table(files, "files")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    dirs = full.where("dir is not null").select("dir").distinct().withColumn("depth", depth)
    parts = F.split("dir", "/")
    above = dirs.withColumn("n", F.explode(F.sequence(F.lit(0), F.col("depth")))).withColumn("above", F.array_join(F.slice(parts, 1, F.col("n")), "/"))
    near = above.join(files, "above").groupBy("dir").agg(F.max_by(F.struct(F.col("above").alias("from_dir"), "dir_license"), "n").alias("near"))
    near = table(near.select("dir", "near.*"), "near")
    out = small_join(full, near, ["dir"], "left")
    mine = F.col("license").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        F.col("path").alias(path),
        F.coalesce("license", "dir_license").alias("license"),
        F.when(mine, F.col("cosine")).alias("cosine"),
        "license_file",
        F.when(mine, "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~mine, F.col("from_dir")).alias("from_dir"),
    )
