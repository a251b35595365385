"""Licence scans: a trained paragraph classifier on word n-grams, confirmed by comparison with notice templates.

Training uses the DataFrame API of Spark's own logistic regression on a bounded sample. Scanning is SQL
expressions only: paragraphs, n-gram hashes, weights looked up by slot, and probabilities, all inside a row.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekeel.llm.common import let

# Notices of the licence families, as they stand in files and pages.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "This software is released under the BSD 3-Clause License.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "This article is distributed under the terms of the Creative Commons Attribution License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under the Creative Commons Attribution NonCommercial license; no commercial use is permitted.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction',
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
}
# Ordinary sentences that use words of the notices: examples of the unknown class.
ORDINARY = (
    "You need a driving license to rent a car in most countries.",
    "The license was issued in 2004 under the law of the state.",
    "The general public was not admitted to the first part of the trial.",
    "The software is distributed on a disc and may be used on any computer.",
    "Permission to enter the building is granted by the guard at the gate.",
    "All terms of the contract are subject to the law and must be agreed to in writing.",
    "A copy of the report can be found in the library.",
    "The foundation published a version of the work in English.",
    "Students of MIT released a new version of the game under a different name.",
    "The Apache people lived in the south, under the rule of their own chiefs.",
    "This work is the third part of a series on the history of the river.",
    "The following conditions are met by every person in the room.",
)
UNKNOWN = "unknown"
SAMPLE_DOCS = 200  # documents whose paragraphs are examples of the unknown class
SAMPLE_PARAGRAPHS = 2000  # of these, at most
SLOTS = 1 << 14
FALSE_SHARE = 0.002  # share of unknown paragraphs that the calibrated limit may let through
LIKENESS = 0.5  # share of n-grams that a paragraph and a template must have in common
GRAMS = (2, 3)  # words


def _words(paragraph: Column) -> Column:
    return F.filter(F.split(F.lower(paragraph), r"[^a-z0-9]+"), lambda w: w != "")


def grams(paragraph: Column) -> Column:
    """Hashes of the word n-grams of a paragraph, without repeats."""

    def runs(w: Column, n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[F.element_at(w, (i + k).cast("int")) for k in range(n)]))

    def of(w: Column) -> Column:
        return F.array_distinct(F.concat(*[runs(w, n) for n in GRAMS]))

    return let(_words(paragraph), of)


def _examples() -> list[tuple[str, str]]:
    """(family, text): notices, their sentences, and each with one word left out."""
    out = []
    for family, notices in TEMPLATES.items():
        for text in notices:
            words = text.split()
            out += [(family, text), (family, text.upper())]
            out += [(family, " ".join(words[:k] + words[k + 1:])) for k in range(len(words))]
            half = max(len(words) // 2, 4)
            out += [(family, " ".join(words[:half])), (family, " ".join(words[-half:]))]
    for text in ORDINARY:
        words = text.split()
        out += [(UNKNOWN, text)] + [(UNKNOWN, " ".join(words[:k] + words[k + 1:])) for k in range(len(words))]
    return out


@dataclass
class Model:
    """Weights per slot and family, the limit of the probability, and the n-grams of every template."""

    families: list[str]
    table: list[int]  # per slot the hash of its n-gram, 0 if it has none
    weights: list[list[float]]  # per slot and family; empty where the slot is
    bias: list[float]
    limit: float
    templates: list[tuple[str, list[int]]]

    def constant(self) -> Column:
        """All of it as one constant, of bounded size."""
        value = {"table": self.table, "weights": self.weights, "bias": self.bias,
                 "templates": [{"family": f, "grams": g} for f, g in self.templates]}
        return F.from_json(
            F.lit(json.dumps(value)), "table array<bigint>, weights array<array<double>>, bias array<double>, "
            "templates array<struct<family:string,grams:array<bigint>>>")


def fit(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, seed_share: int = 5) -> Model:
    """Train on the notices and on paragraphs of a bounded sample of documents(doc_id, text).

    The sample is the ``sample_docs`` documents with the smallest hash of their id, and of their paragraphs those
    that share no three-word run with a notice, ``SAMPLE_PARAGRAPHS`` at most, by hash. A fifth of all examples is
    held back; the limit is set on it, so that at most ``FALSE_SHARE`` of its unknown paragraphs would pass.
    """
    spark = documents.sparkSession
    ids = [r[0] for r in documents.filter("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("h"))
           .groupBy("doc_id", "h").count().orderBy("h", "doc_id").limit(sample_docs).collect()]
    notices = spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, text string")
    known = notices.select("family", grams(F.col("text")).alias("grams")).collect()
    templates = [(r["family"], list(r["grams"])) for r in known]
    owned = sorted({g for _, gs in templates for g in gs})
    table, kept = [0] * SLOTS, {}
    for g in owned:  # the few n-grams that fall on a taken slot are left out of the vocabulary
        if table[g % SLOTS] == 0:
            table[g % SLOTS] = g
            kept[g] = g % SLOTS
    prose = documents.filter(F.col("doc_id").isin(ids)).select(F.explode(F.split("text", "\n")).alias("text")).distinct()
    mine = F.array(*[F.lit(g) for g in owned])
    prose = prose.select(F.lit(UNKNOWN).alias("family"), "text", grams(F.col("text")).alias("grams")).filter(
        F.size(F.array_intersect("grams", mine)) < 3)
    prose = prose.orderBy(F.xxhash64("text"), "text").limit(SAMPLE_PARAGRAPHS).select("family", "grams")
    made = spark.createDataFrame(_examples(), "family string, text string").select("family", grams(F.col("text")).alias("grams"))
    rows = [(r["family"], sorted(kept[g] for g in r["grams"] if g in kept)) for r in made.unionByName(prose).collect()]
    families = [UNKNOWN, *sorted(TEMPLATES)]
    slots = sorted(kept.values())
    place = {s: i for i, s in enumerate(slots)}

    def frame(part: list[tuple[str, list[int]]]) -> DataFrame:
        return spark.createDataFrame([
            (float(families.index(f)), Vectors.sparse(len(slots), [(place[s], 1.0) for s in own])) for f, own in part
        ], ["label", "features"])

    held = rows[::seed_share]
    train = [r for i, r in enumerate(rows) if i % seed_share]
    fitted = LogisticRegression(
        family="multinomial", maxIter=40, regParam=1e-3, elasticNetParam=0.5, standardization=False).fit(frame(train))
    matrix, bias = fitted.coefficientMatrix.toArray(), [float(b) for b in fitted.interceptVector]
    weights: list[list[float]] = [[] for _ in range(SLOTS)]
    for s in slots:
        weights[s] = [float(x) for x in matrix[:, place[s]]]

    def probability(own: list[int]) -> float:
        z = [b + sum(weights[s][k] for s in own) for k, b in enumerate(bias)]
        top = max(z)
        e = [math.exp(v - top) for v in z]
        return 1 - e[0] / sum(e)

    unknown = sorted((probability(own) for f, own in held if f == UNKNOWN), reverse=True)
    limit = max(0.5, unknown[int(FALSE_SHARE * len(unknown))] + 1e-6 if unknown else 0.5)
    return Model(families, table, weights, bias, min(limit, 0.99), templates)


FOUND = "array<struct<paragraph:int,family:string,probability:double,likeness:double>>"


def scan(documents: DataFrame, model: Model) -> DataFrame:
    """Per row of documents(doc_id, text): doc_id, n_paragraphs, found (paragraph, family, probability, likeness).

    A paragraph is a line with a word. It is found if the probability of a licence reaches the calibrated limit and
    the best template of the likeliest family shares at least ``LIKENESS`` of its n-grams, or of the paragraph's.
    Null and empty texts have no paragraphs; repeated rows and null ids give a row each; nothing is shuffled and
    other columns are not read.
    """
    known = model.constant()
    names = F.array(*[F.lit(f) for f in model.families])

    def slot(h: Column) -> Column:
        return F.pmod(h, F.lit(SLOTS)).cast("int")

    def judged(own: Column, hits: Column, i: Column, w: Column, b: Column, ts: Column) -> Column:
        z = F.aggregate(hits, b, lambda acc, h: F.zip_with(acc, F.get(w, slot(h)), lambda x, y: x + y))

        def result(z: Column) -> Column:
            e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
            p = let(e, lambda x: 1 - F.get(x, F.lit(0)) / F.aggregate(x, F.lit(0.0), lambda a, v: a + v))
            best = let(F.slice(z, 2, len(model.families) - 1), lambda s: F.get(names, F.array_position(s, F.array_max(s)).cast("int")))
            return let(best, lambda f: F.struct(
                i.alias("paragraph"), f.alias("family"), p.alias("probability"), F.coalesce(F.array_max(F.transform(
                    F.filter(ts, lambda t: t["family"] == f), lambda t: let(
                        F.size(F.array_intersect(own, t["grams"])), lambda n: F.greatest(
                            n / F.size(t["grams"]), n / F.size(own))))), F.lit(0.0)).alias("likeness")))

        return let(z, result)

    def found(lines: Column, t: Column, w: Column, b: Column, ts: Column) -> Column:
        def one_line(line: Column, i: Column) -> Column:
            return let(grams(line), lambda own: let(
                F.filter(own, lambda h: F.get(t, slot(h)) == h),
                lambda hits: F.when(F.size(hits) > 0, judged(own, hits, i, w, b, ts))))

        return F.filter(F.transform(lines, one_line), lambda x: x.isNotNull()
                        & (x["probability"] >= model.limit) & (x["likeness"] >= LIKENESS))

    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    every = let(lines, lambda ls: let(known, lambda m: F.struct(
        F.size(F.filter(ls, lambda s: s.rlike(r"\w"))).cast("bigint").alias("n"),
        found(ls, m["table"], m["weights"], m["bias"], m["templates"]).alias("found"))))
    return documents.select("doc_id", every.alias("r")).select(
        "doc_id", F.col("r.n").alias("n_paragraphs"), F.col("r.found").alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    families = F.array_sort(F.array_distinct(F.transform("found", lambda f: f["family"])))
    listed = F.transform("found", lambda f: F.concat_ws(":", f["paragraph"], f["family"]))
    return scanned.select(
        "doc_id", "n_paragraphs", F.size("found").cast("bigint").alias("n_license"),
        F.array_join(families, ",").alias("families"), F.array_join(listed, ",").alias("paragraphs"))
