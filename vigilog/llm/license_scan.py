"""Licence families of paragraphs by a trained classifier.

Templates of known licences, varied by lost words, cuts and surrounding text, are the positive
examples; mixed templates and general phrases about licences are the unknown class; paragraphs of
the corpus are the rest. A multinomial logistic regression over sparse word n-grams is fitted to
them. A paragraph counts for a family if its chance is above the border at which held-out unknown
examples fall away, and if it has enough of the word triples of one of the family's templates;
otherwise it is reported as unknown. DataFrame functions and Spark's own learners only.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import Registry, documents, staged

ops = Registry()

# Public licence phrases, by family.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Released under the BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved. No part of this publication may be reproduced or distributed without prior written permission."),
)
UNKNOWN = (
    "You must accept the license agreement before using the software.",
    "Copyright the authors.",
    "See the license file for details.",
    "The license fee is due every year.",
    "Distributed under a custom license of the company.",
    "This software is provided as is, without warranty of any kind.",
    "His driving license was released to the public.",
    "Permission was granted by the commission.",
    "The rights of the public are reserved by law.",
    "Modified version of the source code.",
)
NEGATIVES = 2_000  # paragraphs of the corpus at most that the classifier is fitted on
COMMON = 0.002  # share of all paragraphs from which a word is ordinary language
CONFIRM = 0.6  # share of a template's word triples that a paragraph must have
FIT = 80  # iterations at most
SPOKEN = r"(?i)licen[cs]|copyright|rights\s+reserved|permission"  # such paragraphs are no negative examples


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _has_word(text: str, known: Column) -> Column:
    """Whether a text may have one of the known words, which are ASCII: a cheap test before ``_words``."""
    return F.arrays_overlap(F.split(F.lower(F.col(text)), "[^a-z0-9]+"), known)


def _grams(words: str, n: int) -> Column:
    at = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))


def _all_grams(words: str = "words") -> Column:
    return F.array_distinct(F.concat(*[_grams(words, n) for n in (1, 2, 3)]))


def _given(spark: SparkSession, rows: tuple[tuple[str, str], ...]) -> DataFrame:
    """A small table of (family, template, words)."""
    one = [F.struct(F.lit(f).alias("family"), F.lit(i).alias("template"), F.lit(t).alias("text")) for i, (f, t) in enumerate(rows)]
    table = spark.range(1).select(F.explode(F.array(*one)).alias("r")).select("r.*")
    return table.withColumn("words", _words(F.col("text"))).drop("text")


def examples(templates: DataFrame, others: DataFrame, negatives: DataFrame) -> DataFrame:
    """(label text, words, held): varied templates, the unknown class, and paragraphs without a licence."""
    n = F.size("words")
    cuts = [
        F.array(F.col("words")),
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.slice("words", F.lit(1), i), F.slice("words", i + 2, n))),
        F.array(F.slice("words", F.lit(1), F.ceil(0.75 * n).cast("int")), F.slice("words", F.floor(0.25 * n).cast("int") + 1, n)),
    ]
    varied = templates.select("family", F.explode(F.concat(*cuts)).alias("words"))
    some = negatives.limit(20).select(F.col("words").alias("around"))
    # Twenty paragraphs around each template: a few hundred rows.
    inside = templates.join(F.broadcast(some), F.lit(True)).select("family", F.concat("around", "words").alias("words"))
    inside = inside.union(templates.join(F.broadcast(some), F.lit(True)).select("family", F.concat("words", "around").alias("words")))
    a, b = templates.alias("a"), templates.alias("b")
    mixed = a.join(b, F.col("a.family") != F.col("b.family")).select(
        F.lit("unknown").alias("family"),
        F.col("a.words").alias("u"),
        F.col("b.words").alias("v"),
    )
    mixed = mixed.select(
        "family", F.concat(F.filter("u", lambda w, i: i % 2 == 0), F.filter("v", lambda w, i: i % 2 == 1)).alias("words")
    )
    unknown = others.select(F.lit("unknown").alias("family"), "words")
    none = negatives.select(F.lit("none").alias("family"), "words")
    rows = varied.union(inside).union(mixed).union(unknown).union(none)
    return rows.withColumn("held", F.pmod(F.xxhash64("words"), F.lit(5)) == 0)


def _template_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _template_triples(text: str) -> list[str]:
    words = _template_words(text)
    return sorted({" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))})


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in sorted(values)])


def _share(triples: str, text: str) -> Column:
    """Share of a template's word triples among ``triples``."""
    own = _template_triples(text)
    return F.size(F.array_intersect(triples, _literals(own))) / len(own)


def _word_counts(texts: DataFrame) -> dict[str, int]:
    """Over all lines, in how many each word of the templates is; '' has the number of lines.

    Lines that are mostly template, or hold most of one, are left out. Triples are only taken
    where the words allow for either.
    """
    each = [set(_template_words(t)) for _, t in TEMPLATES]

    def fixed(df: DataFrame, **columns: Column) -> DataFrame:
        # Behind a generator, so that later uses don't compute the columns again.
        return df.select(F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))

    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    lines = fixed(lines, line=F.col("line"), own=F.array_distinct(F.split(F.lower("line"), "[^a-z0-9]+")))
    hits = F.array_intersect("own", _literals(set().union(*each)))
    lines = fixed(lines, line=F.col("line"), n=F.size("own"), hits=hits)
    shares = [F.size(F.array_intersect("hits", _literals(w))) / len(w) for w in each]
    many = (F.size("hits") >= 0.5 * F.col("n")) | (F.greatest(*shares) >= 0.4)
    lines = fixed(lines, hits=F.col("hits"), words=F.when(many, _words(F.col("line"))))
    lines = fixed(lines, hits=F.col("hits"), triples=F.when(F.col("words").isNotNull(), F.array_distinct(_grams("words", 3))))
    every = {t for _, text in TEMPLATES for t in _template_triples(text)}
    found = F.array_intersect("triples", _literals(every))
    lines = fixed(lines, hits=F.col("hits"), n=F.size("triples"), found=found)
    held = F.greatest(*[_share("found", text) for _, text in TEMPLATES])
    # No triples were taken where there is nothing to leave out.
    apart = F.col("found").isNotNull() & (F.size("found") > 0) & ((held >= CONFIRM) | (F.size("found") >= 0.5 * F.col("n")))
    lines = lines.where(~apart)
    counts = lines.select(F.explode(F.concat("hits", F.array(F.lit("")))).alias("word"))
    return dict((r[0], r[1]) for r in counts.groupBy("word").agg(F.count("*")).collect())


def _anchors(counts: dict[str, int], confirm: float) -> list[str]:
    """Words that select paragraphs: those that are no ordinary language, and for each template its rarest
    words until more than ``1 - confirm`` of its triples have one: a paragraph that can be confirmed has it too."""
    total = max(1, counts.get("", 0))
    found = {w for _, t in TEMPLATES for w in _template_words(t) if len(w) > 1 and counts.get(w, 0) <= COMMON * total}
    for _, text in TEMPLATES:
        triples = [set(t.split(" ")) for t in _template_triples(text)]
        words = sorted({w for w in _template_words(text) if len(w) > 1}, key=lambda w: (counts.get(w, 0), w))
        for word in words:
            if sum(bool(t & found) for t in triples) > (1 - confirm) * len(triples):
                break
            found.add(word)
    return sorted(found)


def license_paragraphs(docs: DataFrame, confirm: float = CONFIRM) -> DataFrame:
    """A row per paragraph (line) that speaks of a licence: doc_id, paragraph (its number from 0), family,
    chance, overlap with the nearest template of the family, confirmed.

    Null and empty texts have no paragraphs; ids are carried, nulls too; repeated rows give repeated
    rows; other columns don't matter. On an empty table the classifier is fitted on templates alone.
    """
    spark = docs.sparkSession
    templates, others = _given(spark, TEMPLATES), _given(spark, tuple(("unknown", t) for t in UNKNOWN))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Negatives are taken by hash from all rows; those with a licence word are left out below.
    lot = texts.where("text <> ''").select(F.xxhash64("text").alias("h"), "text").orderBy("h").limit(NEGATIVES)
    lot = lot.select(F.get(F.filter(F.split("text", "\n"), lambda x: F.length(x).between(20, 2000)), F.lit(0)).alias("line")).where("line IS NOT NULL")
    lot = lot.where(~F.col("line").rlike(SPOKEN))
    lot = staged(lot.select(_words(F.col("line")).alias("words")), "negatives")
    # At most as many words as the templates have.
    anchors = _anchors(_word_counts(texts), confirm)
    known = F.array(*[F.lit(w) for w in anchors])
    grams = templates.select(F.explode(_all_grams()).alias("gram")).distinct()
    vocabulary = sorted(r[0] for r in grams.where(F.arrays_overlap(F.split("gram", " "), known)).collect())
    terms = F.array(*[F.lit(g) for g in vocabulary])
    negatives = lot.where(~F.arrays_overlap("words", known))
    rows = examples(templates, others, negatives).withColumn("grams", F.array_intersect(_all_grams(), terms))
    families = sorted({f for f, _ in TEMPLATES})
    names = [*families, "unknown", "none"]
    label = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("family")).cast("double") - 1
    rows = staged(rows.select("family", label.alias("label"), "grams", "held"), "examples")
    counted = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    counted.setBinary(True)
    size = F.count("*").over(Window.partitionBy("label"))
    train = counted.transform(rows.where("NOT held")).withColumn("weight", 1.0 / size)
    learner = LogisticRegression(family="multinomial", maxIter=FIT, regParam=1e-4, weightCol="weight", probabilityCol="chances")
    model = learner.fit(train.select("features", "label", "weight"))

    def scored(df: DataFrame) -> DataFrame:
        df = model.transform(counted.transform(df)).withColumn("chances", vector_to_array("chances"))
        own = F.slice("chances", 1, len(families))
        df = df.withColumn("chance", F.array_max(own)).withColumn("none", F.get("chances", F.lit(len(names) - 1)))
        found = F.get(F.array(*[F.lit(x) for x in families]), (F.array_position(own, F.array_max(own)) - 1).cast("int"))
        return df.withColumn("found", found).drop("features", "rawPrediction", "prediction")

    held = scored(rows.where("held AND family = 'unknown'")).agg(F.expr("percentile(chance, 0.95)").alias("x")).first()[0]
    border = min(0.95, max(0.5, held or 0.5))
    lines = texts.where(_has_word("text", known)).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("paragraph", "line"))
    lines = lines.where(_has_word("line", known)).withColumn("words", _words(F.col("line"))).drop("line")
    # Written here: what follows uses the words many times.
    lines = staged(lines.where(F.arrays_overlap("words", known)), "paragraphs")
    lines = lines.withColumn("grams", F.array_intersect(_all_grams(), terms)).withColumn("triples", F.array_distinct(_grams("words", 3)))
    found = staged(scored(lines), "chances").where("none < 0.5")
    shares = [F.when(F.col("found") == family, _share("triples", text)).otherwise(0.0) for family, text in TEMPLATES]
    found = found.withColumn("overlap", F.greatest(*shares))
    sure = (F.col("chance") >= border) & (F.col("overlap") >= confirm)
    return found.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "paragraph",
        F.when(sure, F.col("found")).otherwise("unknown").alias("family"),
        F.round("chance", 3).alias("chance"),
        F.round("overlap", 3).alias("overlap"),
        sure.alias("confirmed"),
    )


@ops.add()
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_paragraphs(documents(spark, folder))
