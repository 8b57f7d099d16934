"""License scan: a sparse n-gram logistic regression over paragraphs, confirmed by comparison with templates.

DataFrame and SQL functions only. A paragraph is a line of a text; notices wrapped over adjoining lines are sought in
joined pieces of lines too, which end at blank lines. Features are the distinct word unigrams and bigrams
that occur in templates; the model is trained on variants of the templates and on a bounded sample of the corpus's own
paragraphs as the class of none, with an L1 penalty, so few weights stay. A class of generic licence wording is trained
as ``unknown``. The least probability of a family is calibrated on sample paragraphs that the model has not seen, and a
prediction counts as confirmed when the paragraph holds enough of the bigrams of one of the family's templates; a
family that fails either test is reported as unknown.

A set of anchor words is derived from the weights such that a paragraph without any can't reach the least probability;
those paragraphs are dropped before any n-gram is built. Nothing is shuffled after training.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE, UNKNOWN = "none", "unknown"

# Notices of well-known licences, in the words they are usually given in.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License.", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    "agpl-3.0": ("This program is licensed under the GNU Affero General Public License.", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "public-domain": ("This work is released into the public domain.", "To the extent possible under law, the author has waived all copyright under CC0 1.0."),
    "proprietary": ("All rights reserved.", "Copyright by the author. All rights reserved."),
    UNKNOWN: ("Licensed under the terms of the license agreement.", "This work is licensed under its own license.", "Released under a custom license, see the file named license.", "Distributed under the house public license, version 1."),
}


@dataclass(frozen=True)
class LicenseFit:
    none_rows: int = 3000  # bound of the corpus sample; a third of it calibrates
    regularization: float = 0.0003
    least_probability: float = 0.5
    similarity: float = 0.7  # share of a template's bigrams that confirms


@dataclass(frozen=True)
class LicenseModel:
    classes: tuple[str, ...]
    features: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]  # by feature, then class
    bias: tuple[float, ...]
    anchors: tuple[str, ...]  # a paragraph without any of these words can't reach the least probability
    least_probability: float
    similarity: float


def _words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def _grams(words: list[str]) -> list[str]:
    return list(dict.fromkeys(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def grams_of(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(words, F.filter(pairs, lambda g: g.isNotNull())))


def paragraphs_of(documents: DataFrame) -> DataFrame:
    """(doc_id, paragraph, body): the lines of each text that hold anything, numbered from 0."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "body")).where(F.length(F.trim("body")) > 0)


#: Characters of a joined piece in its first line, and after it; no template is longer.
REACH = 240


def _needed(similarity: float) -> list[str]:
    """Words of which a text must hold one to reach the similarity with any template; the shortest are left out first."""
    texts = [_pairs(t) for c, ts in TEMPLATES.items() if c != UNKNOWN for t in ts]
    kept = {w for t in texts for g in t for w in g.split(" ")}
    for word in sorted(kept, key=lambda w: (len(w), w)):
        free = kept - {word}
        if all(sum(not free.intersection(g.split(" ")) for g in t) < similarity * len(t) for t in texts):
            kept = free
    return sorted(kept)


def wrapped_of(documents: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, paragraph, body, before): for each line with a line right below it, the end of the line and what follows
    up to a blank line, ``REACH`` characters of each at most, and the end of the line right above. Only those that can reach the similarity."""
    possible = lambda x: F.lower(x).rlike(rf"(?<![a-z0-9])(?:{'|'.join(_needed(similarity))})(?![a-z0-9])")
    lines = F.split("text", "\n")
    blank = lambda x: F.length(F.trim(F.translate(x, "\r\t", "  "))) == 0

    def piece(x: Column, k: Column) -> Column:
        # Lines of one character would fill REACH with half as many lines.
        rest = F.slice(F.col("lines"), k + 2, F.lit(REACH // 2))
        return _bound(rest, lambda r: _bound(F.array_position(F.transform(r, blank), F.lit(True)), lambda p: F.when(
            (F.size(r) > 0) & (p != 1) & ~blank(x),
            F.struct(
                k.alias("paragraph"),
                F.concat(F.right(x, F.lit(REACH)), F.lit("\n"), F.left(F.array_join(F.when(p > 0, F.slice(r, F.lit(1), (p - 1).cast("int"))).otherwise(r), "\n"), F.lit(REACH))).alias("body"),
                F.when(k > 0, F.right(F.element_at(F.col("lines"), F.greatest(k, F.lit(1))), F.lit(REACH))).otherwise("").alias("before"),
            ),
        )))

    pieces = F.filter(F.transform(F.col("lines"), piece), lambda x: x.isNotNull())
    rows = documents.where(possible(F.col("text"))).select("doc_id", lines.alias("lines")).select("doc_id", F.inline(pieces))
    return rows.where(possible(F.col("body")))


def _variants() -> list[tuple[str, list[str]]]:
    """Each template, and the template without every fifth, fourth or third word, by all offsets."""
    out = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = _words(text)
            out.append((family, words))
            for step in (3, 4, 5):
                out += [(family, [w for i, w in enumerate(words) if i % step != k]) for k in range(step) if len(words) > step]
    return out


def train(documents: DataFrame, fit: LicenseFit = LicenseFit()) -> LicenseModel:
    """Fits the classifier; the corpus sample is the ``none_rows`` paragraphs of least hash that are like no template."""
    spark = documents.sparkSession
    classes = (NONE, *TEMPLATES)
    features = sorted({g for texts in TEMPLATES.values() for t in texts for g in _grams(_words(t))})
    bigrams = _constant([_pairs(t) for texts in TEMPLATES.values() for t in texts], "array<array<string>>")
    words = words_of(F.col("body"))
    # The bound holds before the comparison too: the least hashes are chosen first.
    sample = paragraphs_of(documents).orderBy(F.xxhash64("doc_id", "paragraph"), "doc_id", "paragraph").limit(fit.none_rows)
    grams = grams_of(words)
    like = F.exists(bigrams, lambda t: F.size(F.array_intersect(F.col("grams"), t)) >= 0.5 * F.size(t))
    none = sample.select(grams.alias("grams"), F.pmod(F.xxhash64("doc_id", "paragraph"), F.lit(3)).alias("part")).where(~like)
    known = spark.createDataFrame([(float(classes.index(c)), _grams(w)) for c, w in _variants()], "label double, grams array<string>")
    rows = known.unionByName(none.where("part < 2").select(F.lit(0.0).alias("label"), "grams")).coalesce(1)
    counted = CountVectorizer(inputCol="grams", outputCol="features", binary=True)
    vectors = counted.fit(spark.createDataFrame([([g],) for g in features], "grams array<string>").coalesce(1))
    model = LogisticRegression(family="multinomial", regParam=fit.regularization, elasticNetParam=0.9, maxIter=60, standardization=False).fit(vectors.transform(rows).select("label", "features"))
    matrix, bias = model.coefficientMatrix.toArray().tolist(), model.interceptVector
    weights = tuple(tuple(float(matrix[c][k]) for c in range(len(classes))) for k in range(len(vectors.vocabulary)))
    names = tuple(vectors.vocabulary)
    kept = [k for k, row in enumerate(weights) if any(abs(x) > 1e-9 for x in row)]
    out = LicenseModel(classes, tuple(names[k] for k in kept), tuple(weights[k] for k in kept), tuple(float(b) for b in bias), (), fit.least_probability, fit.similarity)
    used = sorted({w for g in out.features for w in g.split(" ")})
    common = none.select(F.explode(F.array_intersect("grams", _constant(used, "array<string>"))).alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in common.collect()}
    out = replace(out, anchors=_anchors(out, sorted(used, key=lambda w: -counts.get(w, 0))))
    unseen = _scored(none.where("part = 2"), out).agg(F.max(1 - F.col("p")[0])).head()[0]
    # Above what any unseen paragraph of the sample gets.
    least = max(fit.least_probability, min(0.9, unseen or 0.0))
    return replace(out, least_probability=least)


def _anchors(model: LicenseModel, words: list[str]) -> tuple[str, ...]:
    """Words of which a paragraph must hold one to be a licence: without them, even all positive weights together miss
    the least probability. ``words``: from the commonest in ordinary text, which is left out first."""
    others = len(model.classes) - 1
    needed = [math.log(model.least_probability / (1 - model.least_probability) / others) - (model.bias[c] - model.bias[0]) for c in range(1, others + 1)]
    margins = [[max(0.0, row[c] - row[0]) for c in range(1, others + 1)] for row in model.weights]
    kept = set(words)
    for word in words:
        free = kept - {word}
        open_ = [m for g, m in zip(model.features, margins, strict=True) if not free.intersection(g.split(" "))]
        if all(sum(m[c] for m in open_) < needed[c] - 1e-6 for c in range(others)):
            kept = free
    return tuple(sorted(kept))


def _scored(rows: DataFrame, model: LicenseModel) -> DataFrame:
    """Adds p, the probability of every class, from the column grams."""
    zero, bias = _constant([0.0] * len(model.classes), "array<double>"), _constant(model.bias, "array<double>")
    table = _constant(dict(zip(model.features, model.weights, strict=True)), "map<string,array<double>>")
    known = F.array_intersect(F.col("grams"), _constant(model.features, "array<string>"))
    total = F.aggregate(known, bias, lambda acc, g: F.zip_with(acc, F.coalesce(F.try_element_at(table, g), zero), lambda a, b: a + b))
    powers = _bound(total, lambda z: _bound(F.array_max(z), lambda m: F.transform(z, lambda x: F.exp(x - m))))
    return rows.withColumn("p", _bound(powers, lambda e: _bound(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda s: F.transform(e, lambda x: x / s))))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _constant(value, kind: str) -> Column:
    """A literal of many parts; the optimizer folds it."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan(documents: DataFrame, model: LicenseModel) -> DataFrame:
    """One row per licence paragraph: doc_id, paragraph, family, probability, similarity, confirmed, body.

    family is a key of TEMPLATES; ``unknown`` where the wording is of a licence but no family is probable enough or no
    template of it compares. A notice that is confirmed only when lines are joined has a row with the number of the line
    where it begins, beside those that its lines may have by themselves. Null and empty texts have no paragraphs. Rows
    are independent: repeated rows are reported again, a null id stays null. Other columns are ignored.
    """
    kept = ("doc_id", "paragraph", "family", "probability", "similarity", "confirmed", "body")
    joined = _judged(wrapped_of(documents, model.similarity), model).where("confirmed")
    # The notice begins in this line, and no line has it alone.
    alone = F.array_max(F.transform(F.split("body", "\n"), lambda x: _similarity(x, F.col("templates"))))
    above = _similarity(F.concat_ws("\n", "before", "body"), F.col("templates"))
    below = _similarity(F.regexp_replace("body", "^[^\n]*\n", ""), F.col("templates"))
    joined = joined.where((alone < model.similarity) & (above <= F.col("similarity")) & (below < F.col("similarity")))
    return _judged(paragraphs_of(documents), model).select(*kept).unionByName(joined.select(*kept))


def _similarity(text: Column, templates: Column) -> Column:
    grams = grams_of(words_of(text))
    return _bound(grams, lambda g: F.array_max(F.transform(templates, lambda t: F.size(F.array_intersect(g, t)) / F.size(t))))


def _judged(paragraphs: DataFrame, model: LicenseModel) -> DataFrame:
    """Adds family, probability, similarity, confirmed and the templates of the family to licence paragraphs; drops others."""
    words = words_of(F.col("body"))
    anchored = paragraphs.withColumn("words", words).where(F.exists("words", lambda w: w.isin(list(model.anchors))))
    rows = _scored(anchored.withColumn("grams", grams_of(F.col("words"))), model)
    classes = _constant(model.classes, "array<string>")
    licence = F.slice("p", 2, len(model.classes) - 1)
    rows = rows.where(1 - F.col("p")[0] >= model.least_probability).withColumn("best", F.array_position("p", F.array_max(licence)).cast("int"))
    predicted = F.element_at(classes, F.col("best"))
    templates = _constant([[_pairs(t) for t in TEMPLATES.get(c, ())] for c in model.classes], "array<array<array<string>>>")
    rows = rows.withColumn("templates", F.element_at(templates, F.col("best")))
    shares = F.transform("templates", lambda t: F.size(F.array_intersect("grams", t)) / F.size(t))
    rows = rows.withColumn("predicted", predicted).withColumn("probability", F.array_max(licence)).withColumn("similarity", F.array_max(shares))
    sure = (F.col("probability") >= model.least_probability) & (F.col("similarity") >= model.similarity) & (F.col("predicted") != UNKNOWN)
    return rows.withColumn("family", F.when(sure, F.col("predicted")).otherwise(F.lit(UNKNOWN))).withColumn("confirmed", sure)


def _pairs(text: str) -> list[str]:
    return [g for g in _grams(_words(text)) if " " in g]


def scan_licenses(documents: DataFrame, fit: LicenseFit = LicenseFit()) -> DataFrame:
    """Trains on the documents' own paragraphs and scans them."""
    return scan(documents, train(documents, fit))

