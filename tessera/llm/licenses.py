"""Licence scan: a trained paragraph classifier with template confirmation.

A paragraph is a run of lines that hold a letter or digit. Its words are read
in windows of three strides of ``STRIDE`` words; a window reports what starts
in its middle stride, so long paragraphs and wrapped notices are seen whole.
In a window every template is laid at each of its 3-grams: the passage from
there, at most a quarter longer than the template, agrees by the share of the
template's 3-grams it holds. ``MIN_SIMILARITY`` is needed (all of them for the
short ``HEADERS``); of overlapping passages the one that agrees best stays, so
families named side by side are all found.

The passage becomes a sparse binary word 1- to 3-gram vector for a multinomial
logistic regression with one class per licence family and one ``unknown``
class, trained on word-dropout variants of the templates and on a bounded
sample of ordinary paragraphs. A temperature fitted on held-out variants
calibrates the probabilities. A passage counts if its family has
``MIN_PROBABILITY`` or its template agrees in full.

Training rows are bounded by the template list and ``UNKNOWN_SAMPLE``.
Every paragraph of every document is tokenised; one without any distinctive
template token (a token of a template that is rare in the unknown sample) is
unknown by definition, the passages of the others are written once and
scored. JVM-side, without a shuffle.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import materialize

UNKNOWN = "unknown"
SAMPLE_SHARDS = 64
SHARD_ROWS = 32
UNKNOWN_SAMPLE = SAMPLE_SHARDS * SHARD_ROWS
VARIANTS = 12
FEATURES = 1 << 13
MIN_PROBABILITY = 0.5
MIN_SIMILARITY = 0.5
STRIDE = 64  # words; no passage is longer
SAMPLE_WORDS = 80
TEMPERATURES = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]

# Customary notice sentences of the licence families.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Affero General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
]
# Titles and tags that name a family in a few words; all their words must be there.
HEADERS = [
    ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("MIT", "MIT License"),
    ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-3-Clause", "3-Clause BSD License"),
    ("GPL-3.0", "GNU General Public License, version 3"), ("GPL-3.0", "GNU General Public License v3"),
    ("GPL-2.0", "GNU General Public License, version 2"), ("GPL-2.0", "GNU General Public License v2"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"), ("LGPL-3.0", "GNU Lesser General Public License v3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"), ("LGPL-2.1", "GNU Lesser General Public License v2.1"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"), ("AGPL-3.0", "GNU Affero General Public License v3"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"), ("MPL-2.0", "Mozilla Public License, v. 2.0"),
] + [(f, f"SPDX-License-Identifier: {f}") for f in (
    "Apache-2.0", "MIT", "BSD-3-Clause", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0", "MPL-2.0", "CC-BY-4.0",
    "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0")]
# Sentences that speak of licences without naming a family.
OTHER_NOTICES = [
    "All rights reserved.", "Licensed for internal use only.", "A driving license is required.",
    "This work is not licensed for redistribution.", "The license was revoked by the public office.",
    "Released under the terms agreed by both parties.", "Version 2.0 of the report was released in public.",
]


def tokens(text):
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def grams(t: str) -> str:
    """SQL: distinct word 1-, 2- and 3-grams of the token array ``t``."""
    return (f"array_distinct(concat({t}, transform({t}, (x, i) -> concat_ws(' ', get({t}, i - 1), x)), "
            f"transform({t}, (x, i) -> concat_ws(' ', get({t}, i - 2), get({t}, i - 1), x))))")


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, paragraph_no, paragraph``: runs of lines with a letter or
    digit, named by their first line, counted from 0 over all lines. NULL and
    empty texts give no rows."""
    filled = "transform(lines, x -> x RLIKE '[\\\\p{L}\\\\p{N}]')"
    edge = "filter(sequence(0, size(f) - 1), i -> f[i] AND NOT coalesce(get(f, i {} 1), false))"
    df = docs.select("doc_id", F.split("text", "\n").alias("lines")).filter("lines IS NOT NULL")
    df = df.select("doc_id", "lines", F.expr(filled).alias("f"))
    cut = F.expr(f"zip_with({edge.format('-')}, {edge.format('+')}, (a, b) -> "
                 "struct(a AS paragraph_no, array_join(slice(lines, a + 1, b - a + 1), '\n') AS paragraph))")
    return df.select("doc_id", F.explode(cut).alias("x")).select("doc_id", "x.paragraph_no", "x.paragraph")


def _hashed(df: DataFrame) -> DataFrame:
    return HashingTF(inputCol="__grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(df)


def ordinary(paras: DataFrame) -> DataFrame:
    """The paragraphs without a word of licence notices."""
    return paras.filter(~F.col("paragraph").rlike("(?i)licen[sc]|copyright|public domain|redistribut|hereby granted"))


def training_rows(paras: DataFrame) -> DataFrame:
    """``label, text, held``: template variants (every ``k``-th word left
    out) and the bounded unknown sample; a third is held out.

    The sample has the ``SHARD_ROWS`` smallest hashes of each of
    ``SAMPLE_SHARDS`` shards. Every task keeps that many rows per shard before
    the shuffle and no task sees all shards. The hash covers the place of a
    paragraph too, so a line that repeats everywhere fills no more of the
    sample than its share of the corpus."""
    spark = paras.sparkSession
    families = sorted({f for f, _ in TEMPLATES + HEADERS})
    rows = [(float(families.index(f) + 1), t) for f, t in TEMPLATES + HEADERS] + [(0.0, t) for t in OTHER_NOTICES]
    base = spark.createDataFrame(rows, "label double, text string")
    variants = base.select("label", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS))).alias("k"), F.split("text", " ")
                           .alias("w")).select("label", "k", F.expr(
                               "array_join(filter(w, (x, i) -> k = 0 OR (i + 1) % (k + 2) <> 0 OR size(w) < 4), ' ')")
                               .alias("text"))
    unknown = (ordinary(paras)
               .select(F.lit(0.0).alias("label"), F.array_join(F.slice(F.split("paragraph", " ", SAMPLE_WORDS + 1), 1,
                                                                       SAMPLE_WORDS), " ").alias("text"),
                       F.xxhash64("doc_id", "paragraph_no", "paragraph").alias("h")))
    in_shard = Window.partitionBy(F.pmod("h", F.lit(SAMPLE_SHARDS))).orderBy("h", "text")
    unknown = (unknown.withColumn("r", F.row_number().over(in_shard)).filter(F.col("r") <= SHARD_ROWS)
               .select("label", "text", "h"))
    rows = variants.select("label", "text", F.col("k").cast("long").alias("h")).unionByName(unknown)
    return rows.select("label", "text", (F.pmod("h", F.lit(3)) == 1).alias("held"))


def distinctive_tokens(rows: DataFrame, paras: DataFrame) -> list[str]:
    """Template tokens (of the labelled ``rows``) found in at most 1 % of the
    ordinary paragraphs, counted over all of ``paras`` and their whole texts; in
    a small table, in at most 1 % of ``UNKNOWN_SAMPLE``. The tokens are
    bounded by the templates."""
    known = [r["t"] for r in rows.filter("label > 0").select(F.explode(tokens(F.col("text"))).alias("t")).distinct().orderBy("t").collect()]
    has = F.array_intersect(tokens(F.col("paragraph")), F.array(*map(F.lit, known)))
    # the empty token counts the paragraphs
    found = ordinary(paras).select(F.explode(F.concat(has, F.array(F.lit("")))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    found = {r["t"]: r["n"] for r in found.collect()}
    limit = max(UNKNOWN_SAMPLE, found.get("", 0)) // 100
    return [t for t in known if found.get(t, 0) <= limit]


def fit(rows: DataFrame):
    """``(model, temperature, families)`` from the training rows."""
    rows = materialize(rows.withColumn("__tokens", tokens(F.col("text"))).withColumn("__grams", F.expr(grams("__tokens"))))
    rows = _hashed(rows)
    model = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=40).fit(rows.filter("NOT held"))
    raw = model.transform(rows.filter("held")).select("label", vector_to_array("rawPrediction").alias("raw"))
    loss = raw.select("label", "raw", F.explode(F.array(*map(F.lit, TEMPERATURES))).alias("t")).select("t", F.expr(
        "ln(aggregate(raw, 0D, (s, x) -> s + exp((x - array_max(raw)) / t)))"
        " - (raw[CAST(label AS INT)] - array_max(raw)) / t").alias("loss"))
    best = loss.groupBy("t").agg(F.round(F.avg("loss"), 9).alias("loss")).orderBy("loss", "t").first()
    return model, float(best["t"]) if best else 1.0, [UNKNOWN] + sorted({f for f, _ in TEMPLATES + HEADERS})


def runs(t: str, n: str) -> str:
    """SQL: the runs of ``n`` words of the token array ``t``, in order."""
    return f"transform(sequence(0, size({t}) - {n}), i -> array_join(slice({t}, i + 1, {n}), ' '))"


def _templates(spark: SparkSession) -> DataFrame:
    """``family, size, n, wanted, least``: words, gram length, distinct grams
    and agreement needed of every template."""
    rows = [(f, t, MIN_SIMILARITY) for f, t in TEMPLATES] + [(f, t, 1.0) for f, t in HEADERS]
    t = spark.createDataFrame(rows, "family string, template string, least double").withColumn("t", tokens(F.col("template")))
    t = t.withColumn("n", F.expr("least(3, size(t))"))
    return t.select("family", F.size("t").alias("size"), "n", F.expr(f"array_distinct({runs('t', 'n')})").alias("wanted"), "least")


def passages(paras: DataFrame, distinctive: list[str]) -> DataFrame:
    """``doc_id, paragraph_no, paragraph, family, similarity, __tokens``: the
    best agreeing passages of ``paras``, with the lines they lie in."""
    known = F.array(*map(F.lit, distinctive)).cast("array<string>")
    # Every identifier of an SPDX expression gets its tag.
    tagged = F.regexp_replace("paragraph", "(?i)(?<=SPDX-License-Identifier:[^\n]{0,200})[ \t]+(?:OR|AND)[ \t(]+",
                              " SPDX-License-Identifier: ")
    df = paras.filter(F.arrays_overlap(tokens(F.col("paragraph")), known))
    df = df.withColumn("w", F.flatten(F.transform(F.split(tagged, "\n"), lambda x, i: F.transform(
        tokens(x), lambda y: F.struct(y.alias("t"), i.alias("line"))))))
    at = f"greatest(0, (k - 1) * {STRIDE})"
    df = df.withColumn("win", F.explode(F.expr(f"""transform(sequence(0, (size(w) - 1) DIV {STRIDE}), k -> struct(
        k * {STRIDE} - {at} AS first, slice(w, {at} + 1, (k + 2) * {STRIDE} - {at}) AS w))""")))
    df = df.select("doc_id", "paragraph_no", "paragraph", "win.first", "win.w", F.expr("win.w.t").alias("t")).filter(F.arrays_overlap("t", known))
    table = [r.asDict() for r in _templates(paras.sparkSession).collect()]
    rows = paras.sparkSession.createDataFrame(
        [([(r["family"], r["size"], r["n"], r["wanted"], r["least"]) for r in table],)],
        "templates array<struct<family: string, size: int, n: int, wanted: array<string>, least: double>>")
    df = df.withColumn("grams", F.expr(f"transform(array(2, 3), n -> IF(size(t) < n, CAST(array() AS ARRAY<STRING>), {runs('t', 'n')}))"))
    df = df.crossJoin(F.broadcast(rows))
    hits = "filter(transform(grams[x.n - 2], (g, i) -> struct(i AS i, g AS g)), y -> array_contains(x.wanted, y.g))"
    near = ("filter(z, v -> v.i >= y.i AND v.i + x.n <= y.i + x.size + x.size DIV 4 + 2 "
            "AND array_position(x.wanted, v.g) >= array_position(x.wanted, y.g))")
    new = "filter(u, (v, k) -> array_position(u.g, v.g) = k + 1)"  # a gram counts where it stands first
    spans = f"""flatten(transform(filter(templates, x -> size(array_intersect(x.wanted, grams[x.n - 2])) >= x.least * size(x.wanted)),
        x -> filter(transform(array({hits}), z -> transform(z, y -> transform(transform(array({near}), u -> {new}), v -> struct(
            size(v) / size(x.wanted) AS similarity, x.size AS size, -(element_at(v, -1).i + x.n - y.i) AS length,
            -y.i AS at, x.family AS family, x.least AS least))[0]))[0], y -> y.similarity >= x.least)))"""
    df = df.withColumn("spans", F.expr(spans)).withColumn("x", F.explode(F.expr("""filter(spans, a -> NOT exists(spans, b ->
        b > a AND -b.at < -a.at - a.length AND -a.at < -b.at - b.length))""")))
    df = df.filter(f"-x.at >= first AND -x.at < first + {STRIDE}")
    df = df.withColumn("__tokens", F.expr("slice(t, 1 - x.at, -x.length)")).withColumn(
        "a", F.expr("w[-x.at].line")).withColumn("b", F.expr("w[-x.at - x.length - 1].line"))
    return df.select("doc_id", (F.col("paragraph_no") + F.col("a")).alias("paragraph_no"), "x.family", "x.similarity", "__tokens",
                     F.expr("array_join(slice(split(paragraph, '\n'), a + 1, b - a + 1), '\n')").alias("paragraph"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, paragraph_no, family, probability, similarity, paragraph``
    for every confirmed licence passage of ``docs`` (needs ``doc_id, text``;
    other columns are ignored); ``paragraph`` has the lines it lies in and
    ``paragraph_no`` the first of them. NULL ids are kept, repeated rows
    repeat their findings, empty tables and texts give no rows."""
    paras = paragraphs(docs)
    rows = materialize(training_rows(paras))
    found = materialize(passages(paras, distinctive_tokens(rows, paras)).withColumn("__grams", F.expr(grams("__tokens"))))
    model, temperature, families = fit(rows)
    p = model.transform(_hashed(found)).withColumn("raw", vector_to_array("rawPrediction")).withColumn(
        "own", F.array_position(F.array(*map(F.lit, families)), F.col("family")))
    p = p.withColumn("probability", F.expr(
        f"exp((raw[CAST(own - 1 AS INT)] - array_max(raw)) / {temperature}D)"
        f" / aggregate(raw, 0D, (s, x) -> s + exp((x - array_max(raw)) / {temperature}D))"))
    return p.filter((F.col("probability") >= MIN_PROBABILITY) | (F.col("similarity") == 1)).select(
        "doc_id", F.col("paragraph_no").cast("long").alias("paragraph_no"), "family",
        F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), "paragraph")
