"""License notices in documents, with DataFrame functions only.

A document's words are letters and digits in lower case; its text is cut into overlapping windows twice as long as the
longest template of a length class, half of it apart, so that every notice lies whole in a window. MinHash bands (one
row each) of windows and templates retrieve candidates: a window that holds a template has a similarity to it of at
least 1 / 4, and shares none of BANDS values with probability 0.75 ** BANDS (1e-8). Exact containment of
the template's shingles in the window confirms a match. Texts and windows that lack too many of each template's words or
shingles to match are left out first.

Null and short texts match nothing, as does a template under SIZE words. Rows that repeat an id are one document; a null id is a document
of its own; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a shingle, MinHash values of a window, and percent of a template's shingles that a window must hold.
SIZE, BANDS, PERCENT = 3, 64, 80

# Short notices of common licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bound(value: Column, body) -> Column:
    """body(value), with the value worked out once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def shingles(ws: Column) -> Column:
    """Hashes of each SIZE words in order; empty if there are fewer."""
    at = lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(SIZE)])
    return F.when(F.size(ws) >= SIZE, F.transform(F.sequence(F.lit(0), F.size(ws) - SIZE), at)).otherwise(F.array().cast("array<bigint>"))


def min_hashes(sh: Column) -> Column:
    """BANDS minima of scrambled hashes, each with its band's number mixed in."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.array_min(F.transform(sh, lambda h: F.xxhash64(h, b)))))


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """license, template (number), shingles, span (words of its length class: a power of two)."""
    rows = spark.createDataFrame([(name, i, text) for i, (name, text) in enumerate(templates)], "license string, template int, text string")
    ws = rows.withColumn("ws", words(F.col("text")))
    span = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("ws").cast("double")))).cast("int")
    return ws.where(F.size("ws") >= SIZE).select("license", "template", "ws", F.array_distinct(bound(F.col("ws"), shingles)).alias("shingles"), span.alias("span"))


def may_match(text: Column, templates: Sequence[Sequence[str]]) -> Column:
    """Whether a match is possible at all, from the words of each template.

    A match lacks at most 100 - PERCENT in a hundred of the template's shingles, so of any larger choice of them
    it has one, and all the words of that one. The choice is of those with the longest words.
    """
    chosen: set[tuple[str, ...]] = set()
    for ws in templates:
        own = {tuple(ws[k : k + SIZE]) for k in range(len(ws) - SIZE + 1)}
        missing = len(own) * (100 - PERCENT) // 100
        by_length = [tuple(sorted(set(x), key=lambda w: (-len(w), w))) for x in own]
        chosen.update(sorted(by_length, key=lambda x: ([-len(w) for w in x], x))[: missing + 1])
    out = F.lit(False)
    for x in sorted(chosen):
        every = F.lit(True)
        for w in x:
            every = every & F.contains(text, F.lit(w))
        out = out | every
    return out


def kindred(rows: Sequence) -> dict[int, int]:
    """For each template the first of those that it shares half of its shingles with, directly or through others."""
    kin = {r.template: r.template for r in rows}
    for x in rows:
        for y in rows:
            if 2 * len({*x.shingles} & {*y.shingles}) >= min(len(x.shingles), len(y.shingles)):
                low, high = sorted((kin[x.template], kin[y.template]))
                kin = {t: low if k == high else k for t, k in kin.items()}
    return kin


def scan(df: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, license, containment (largest, 0 to 1), first_word (where the first window with a match starts), n_windows."""
    known = template_table(df.sparkSession, templates)
    rows = known.collect()  # one row for each template
    if not rows:
        rows_of = df.limit(0).select(id_column, F.lit("").alias("license"), F.lit(0.0).alias("containment"))
        return rows_of.withColumn("first_word", F.lit(0).cast("bigint")).withColumn("n_windows", F.lit(0).cast("bigint"))
    every = F.array(*[F.lit(h) for h in sorted({h for r in rows for h in r.shingles})])
    spans = sorted({r.span for r in rows})

    # An explode keeps what it makes from being worked out again for each use of it.
    docs = df.select(F.col(id_column).alias("id"), F.explode(F.array(F.lower(text_column))).alias("text")).where(may_match(F.col("text"), [r.ws for r in rows]))
    sh = bound(words(F.col("text")), shingles)
    docs = docs.select("id", F.explode(F.filter(F.array(sh), lambda x: F.arrays_overlap(x, every))).alias("sh"))

    def cut(span: int) -> Column:
        def window(at: Column) -> Column:
            own = F.array_distinct(F.slice("sh", at + 1, 2 * span - SIZE + 1))
            return F.struct(at.alias("at"), F.lit(span).alias("span"), own.alias("own"))

        starts = F.sequence(F.lit(0), F.size("sh") - 1, F.lit(span))
        return F.filter(F.transform(starts, window), lambda w: F.arrays_overlap(w["own"], every))

    windows = docs.select("id", F.explode(F.concat(*map(cut, spans))).alias("w")).select("id", "w.*")

    keys = known.select("template", "span", F.explode(min_hashes(F.col("shingles"))).alias("key"))
    met = windows.select("id", "at", "span", "own", F.explode(min_hashes(F.col("own"))).alias("key")).join(F.broadcast(keys), ["span", "key"])  # templates x BANDS rows
    met = met.groupBy("id", "at", "span", "template", "own").count().join(F.broadcast(known.drop("span", "ws")), "template")
    part = F.size(F.array_intersect("shingles", "own")) / F.size("shingles")
    hits = met.withColumn("containment", part).where(F.col("containment") >= PERCENT / 100)
    found = hits.groupBy("id", "license", "template").agg(F.max("containment").alias("containment"), F.min("at").cast("bigint").alias("first_word"), F.countDistinct("at", "span").alias("n_windows"))
    # Templates that resemble each other: a document holds the one that it holds most of.
    kin = df.sparkSession.createDataFrame(list(kindred(rows).items()), "template int, kin int")
    most = F.max("containment").over(Window.partitionBy("id", "kin"))
    best = found.join(F.broadcast(kin), "template").withColumn("most", most).where("containment = most")
    out = best.groupBy("id", "license").agg(F.max("containment").alias("containment"), F.min("first_word").alias("first_word"), F.sum("n_windows").alias("n_windows"))
    return out.select(F.col("id").alias(id_column), "license", "containment", "first_word", "n_windows")
