"""Operator 6: licence scan by a trained paragraph classifier, confirmed by templates. DataFrame functions only.

A paragraph is a line, with the lines that continue it: those that begin with a lower-case letter after one that does not end a
sentence. Every paragraph is judged, described by the set of its word uni- and bigrams. A multinomial logistic regression with an L1
penalty, trained on edited templates and on near misses, leaves a sparse table of weights (bounded by
the templates' n-grams), which is joined to the n-grams. The scores' temperature and the probability
below which a paragraph is unknown are fitted on variants that training did not see. The family that
wins is confirmed if enough of the paragraph's trigrams, or of a template's, are shared.

Most paragraphs need not be scored: ``gate`` derives from the weights a set of words without all of which no
family can reach the score of unknown, whatever else a paragraph holds. Told are the paragraphs of a known family, and the
unknown ones that hold a stem of the licence vocabulary (``ANCHOR``).
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, let

UNKNOWN = "unknown"
ANCHOR = r"(?i)licen[cs]|copyright|spdx|creative commons|cc[ -]by|cc0|\bgnu\b|\b[al]?gpl|warrant|redistribut|public domain|rights reserved|permission is hereby|permission to use"
#: One of these is in every text that holds a match of ANCHOR, in lower case; they are looked for first, which is faster.
STEMS = ("licen", "copyright", "spdx", "creative commons", "cc by", "cc-by", "cc0", "gnu", "gpl", "warrant", "redistribut", "public domain", "rights reserved", "permission ")
#: Share of an n-gram set that must be found in a template, or the other way round.
CONFIRM = 0.4

# Notices by family.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "You should have received a copy of the GNU General Public License along with this program."],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "You should have received a copy of the GNU Affero General Public License along with this program."],
    "BSD": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software."],
    "MPL-2.0": ["Licensed under the Mozilla Public License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 public domain dedication.", "SPDX-License-Identifier: CC0-1.0"],
    "Proprietary": ["Copyright 2020 the authors. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without written permission.", "This software is proprietary and confidential."],
}
NEAR_MISSES = [
    "His driving licence was taken away after the accident.", "The new licence plate arrived by mail in version two.", "A fishing license costs ten dollars a year.", "The warranty of the car ends after two years.",
    "The court issued a warrant for his arrest.", "The radio station lost its broadcasting license.", "The right to redistribute wealth was debated in public.", "The gnu is a large animal of the plains.",
    "They asked for permission to use the hall.", "The copyright office opened at nine.", "The poem had been in the public domain for years.", "A license to print money, he called it.", "The dealer refused to honour the warranty of the washing machine.",
    "Poetic licence lets a writer break the rules.", "The driver showed her license and the papers of the car.", "No rights reserved seats were left in the theatre.", "Creative commons and open fields lay around the village.", "The pub has a licence to serve spirits until midnight.",
    # Prose that shares single words with the notices, in other languages too.
    "Mit dem Wagen fuhren sie nach Hause.", "Sie kam mit ihrer Schwester und mit dem Hund.", "Mit und ohne Zucker.", "Wir gehen mit.", "Er war mit sich und der Welt zufrieden.", "Elle a perdu sa clef dans sa maison.", "Il aime sa ville et sa rue.", "Es la historia de sa gente.",
    "She studied at MIT and is a member of the board.", "The notice on the door said closed.", "A notice came on Monday.", "They are here and we are there.", "The files are on the desk.", "Version 1.0 was slow and 2.0 was no better.", "It rose by 1.0 and then by 2.1 and 4.0 points.", "The program of the concert begins at eight.",
    "All of this is under the table.", "The authors of the study are not known.", "The apache rode over the hill.", "A confidential letter came by mail.", "Reserved tables are by the window.", "The library is free for all.", "The work was used by a person with a clause.",
]
VARIANTS = 40


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters, digits and dots inside numbers."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?:[\p{L}\p{N}]|(?<=\d)\.(?=\d))+"), 0)


def ngrams(words: Column, n: int) -> Column:
    """Distinct runs of n words, joined by spaces."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " ")))


def training_rows(spark: SparkSession, variants: int = VARIANTS) -> DataFrame:
    """(family, words, variant): each template and near miss, whole and with words dropped or foreign words around, the same on every run."""
    rows = [(family, t) for family, ts in TEMPLATES.items() for t in ts] + [(UNKNOWN, t) for t in NEAR_MISSES]
    df = spark.createDataFrame(rows, "family string, text string").withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    drop = lambda w, i: (F.col("variant") == 0) | (F.pmod(F.xxhash64("text", "variant", i), F.lit(12)) > 0)
    extra = lambda k: F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.substring(F.translate(F.md5(F.concat_ws(" ", "text", "variant", F.lit(k), i.cast("string"))), "0123456789", "etaoinshrd"), 1, 7))
    around = F.pmod(F.xxhash64("variant", F.lit(1)), F.lit(3))
    none = F.array().cast("array<string>")
    words = F.concat(F.when(around == 1, extra(1)).otherwise(none), F.filter(words_of(F.col("text")), drop), F.when(around == 2, extra(2)).otherwise(none))
    return df.select("family", words.alias("words"), "variant")


class Classifier:
    """Sparse weights (n-gram -> weight by family), intercepts, temperature and the least probability of a known family."""

    def __init__(self, families: list[str], intercepts: list[float], weights: list[tuple[str, int, float]], scale: float, least: float):
        self.families, self.intercepts, self.weights, self.scale, self.least = families, intercepts, weights, scale, least

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.weights, "gram string, family int, weight double")


def _probabilities(scores: list[float], scale: float) -> list[float]:
    top = max(scores)
    e = [math.exp(scale * (s - top)) for s in scores]
    return [x / sum(e) for x in e]


def train(rows: DataFrame, folds: int = 4) -> Classifier:
    """Fits the classifier on rows (family, words, variant), a bounded sample; variants of one in ``folds`` calibrate it."""
    rows = rows.select("family", "variant", F.concat(ngrams(F.col("words"), 1), ngrams(F.col("words"), 2)).alias("grams")).coalesce(1)
    families = sorted(r[0] for r in rows.select("family").distinct().collect())
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    rows = rows.withColumn("label", label)
    fit, held = rows.where(F.col("variant") % folds > 0), rows.where(F.col("variant") % folds == 0)
    counts = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=8.0).fit(fit)
    model = LogisticRegression(maxIter=60, regParam=0.002, elasticNetParam=0.9, family="multinomial").fit(counts.transform(fit).select("label", "features"))
    matrix, vocabulary = model.coefficientMatrix.toArray(), counts.vocabulary
    intercepts = [float(x) for x in model.interceptVector.toArray()]
    weights = [(vocabulary[j], i, float(matrix[i, j])) for i in range(len(families)) for j in range(len(vocabulary)) if abs(matrix[i, j]) > 1e-9]

    known: dict[str, list[tuple[int, float]]] = {}
    for gram, i, w in weights:
        known.setdefault(gram, []).append((i, w))
    scored = []
    for r in held.select("label", "grams").collect():  # the templates' variants: bounded
        s = list(intercepts)
        for g in r["grams"]:
            for i, w in known.get(g, ()):
                s[i] += w
        scored.append((int(r["label"]), s))
    loss = lambda t: -sum(math.log(max(_probabilities(s, t)[y], 1e-12)) for y, s in scored)
    scale = min((0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0), key=loss)
    # Half of the least probability with which a held-out notice is recognized, within (0.2, 0.5).
    right = [p[y] for y, s in scored if families[y] != UNKNOWN and (p := _probabilities(s, scale)) and max(p) == p[y]]
    return Classifier(families, intercepts, weights, scale, min(0.5, max(0.2, min(right, default=0.4) / 2)))


def gate(classifier: Classifier) -> list[str] | None:
    """Words of which a paragraph must hold one to be of a known family; None if there is no such set.

    A family must reach the score of unknown. Without any of these words only n-grams of other words are left, and all of those
    that speak for a family, together, do not make up for what its intercept is behind that of unknown.
    """
    u = classifier.families.index(UNKNOWN)
    by_gram: dict[str, dict[int, float]] = {}
    for g, i, w in classifier.weights:
        by_gram.setdefault(g, {})[i] = w
    gaps = {i: classifier.intercepts[u] - b for i, b in enumerate(classifier.intercepts) if i != u}
    # What each n-gram speaks for each family against unknown.
    gains = [(set(g.split(" ")), {i: x for i in gaps if (x := w.get(i, 0.0) - w.get(u, 0.0)) > 0}) for g, w in by_gram.items()]
    gains = [(words, own) for words, own in gains if own]

    def enough(needed: set[str]) -> bool:
        left = dict.fromkeys(gaps, 0.0)
        for words, own in gains:
            if not words & needed:
                for i, x in own.items():
                    left[i] += x
        return all(left[i] < gap - 1e-6 for i, gap in gaps.items())

    needed = set().union(*(words for words, _ in gains))
    if not enough(needed):
        return None
    # Words of plain prose and short ones, which many paragraphs hold, are let go first.
    plain = {w for t in NEAR_MISSES for w in re.findall(r"\w+", t.lower())}
    for w in sorted(needed, key=lambda w: (w not in plain, len(w), w)):
        if enough(needed - {w}):
            needed.remove(w)
    return sorted(needed)


def _any_word(words: list[str]) -> str:
    """A regular expression for a text in lower case that holds one of the words, as words_of has them (or inside a number)."""
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[0], []).append(re.escape(w[1:]))
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in sorted(by_first.items())) + r")(?![\p{L}\p{N}])"


def anchored(text: Column) -> Column:
    """Whether a text holds a stem of the licence vocabulary."""
    return let(F.lower(text), lambda t: reduce(lambda a, b: a | b, (t.contains(x) for x in STEMS))) & text.rlike(ANCHOR)


#: Stands for a line's end inside a paragraph.
_JOINED = "\uffff"


def _paragraphs(text: Column) -> Column:
    """The paragraphs of a text, as an array; inside them line ends are _JOINED."""
    return F.split(F.regexp_replace(F.replace(text, F.lit(_JOINED), F.lit(" ")), r"(?=[ \t\r\n])(?<![.!?:;\s])([ \t]*\r?)\n(?=[ \t]*\p{Ll})", "$1" + _JOINED), "\n")


def _scores(classifier: Classifier) -> Callable[[Column], Column]:
    """Of a paragraph's text, a struct: the family (or unknown) and its probability. Each step is computed once for the next."""
    own: dict[str, list[float]] = {}
    for g, i, w in classifier.weights:
        own.setdefault(g, [0.0] * len(classifier.families))[i] += w
    # One literal, which the optimizer makes a map of once; thousands of literals take the driver seconds.
    weights = F.from_json(F.lit(json.dumps(own)), "map<string, array<double>>")
    known = F.map_keys(weights)
    names = F.array(*map(F.lit, classifier.families))

    def grams(words: Column) -> Column:
        pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda x, y: F.concat(x, F.lit(" "), y))
        return F.array_intersect(F.concat(words, pairs), known)

    def exps(v: Column) -> Column:
        return let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp((x - top) * classifier.scale)))

    def best(e: Column) -> Column:
        return let(F.array_max(e), lambda top: named(F.element_at(names, F.array_position(e, top).cast("int")), top / F.aggregate(e, F.lit(0.0), lambda a, x: a + x)))

    def named(family: Column, probability: Column) -> Column:
        return let(probability, lambda p: F.struct(F.when(p < classifier.least, F.lit(UNKNOWN)).otherwise(family).alias("family"), p.alias("probability")))

    def score(text: Column) -> Column:
        v = let(let(words_of(text), grams), lambda g: F.aggregate(g, F.lit(classifier.intercepts), lambda v, x: let(F.element_at(weights, x), lambda w: F.zip_with(v, w, lambda a, b: a + b))))
        return let(let(v, exps), best)

    return score


def license_scan(docs: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """(doc_id, paragraph, family, probability, overlap, confirmed, text): a row for each paragraph of docs that speaks of licences.

    docs has doc_id and text; other columns are ignored. paragraph is the number of the paragraph's first line, from 0.
    family is ``unknown`` where no family reaches the calibrated probability. overlap is the larger share of
    trigrams that paragraph and the family's best template have in common; confirmed: it is enough. Null and empty texts
    give no rows; rows that share a doc_id are told apart inside, and repeated rows give repeated
    rows. Runs jobs at once: training, and the paragraphs told, which are kept in spark.checkpoint.dir.
    """
    spark = docs.sparkSession
    classifier = classifier or train(training_rows(spark))
    tables = Tables(spark, "licences")
    words = gate(classifier)
    may = lambda t: F.lit(True) if words is None else F.lower(t).rlike(_any_word(words))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.length("text") > 0).where(may(F.col("text")) | anchored(F.col("text")))

    def told(parts: Column, anchor: Column) -> Column:
        """anchor: whether the whole text is anchored; if not, no paragraph is."""
        numbered = F.filter(F.transform(parts, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: may(x["t"]) | (anchor & anchored(x["t"])))
        own = F.filter(F.transform(numbered, lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t"), score(x["t"]).alias("s"))), lambda x: (x["s"]["family"] != UNKNOWN) | (anchor & anchored(x["t"])))
        before = lambda i: F.size(F.split(F.array_join(F.slice(parts, F.lit(1), i), ""), _JOINED)) - 1
        return F.transform(own, lambda x: F.struct((x["i"] + before(x["i"])).cast("int").alias("paragraph"), F.translate(x["t"], _JOINED, "\n").alias("text"), x["s"].alias("s")))

    # The weights are bounded by the templates' n-grams, so each paragraph is scored in its row. Told are picked before they become
    # rows: a filter on rows is put below the scores, with a copy of their expression for each time that it uses one.
    score = _scores(classifier)
    rows = rows.select("doc_id", F.explode(let(anchored(F.col("text")), lambda a: let(_paragraphs(F.col("text")), lambda parts: told(parts, a)))).alias("p")).select("doc_id", "p.paragraph", "p.text", words_of(F.col("p.text")).alias("words"), "p.s.family", "p.s.probability")
    scored = tables.keep(rows, "lines")

    forms = spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, t string").select("family", ngrams(words_of(F.col("t")), 3).alias("g"))
    forms = forms.groupBy("family").agg(F.collect_list("g").alias("forms"))
    own = scored.withColumn("g", ngrams(F.col("words"), 3)).join(F.broadcast(forms), "family", "left")
    shared = F.transform("forms", lambda f: F.size(F.array_intersect(f, F.col("g"))) / F.greatest(F.least(F.size(f), F.size("g")), F.lit(1)))
    own = own.withColumn("overlap", F.coalesce(F.array_max(shared), F.lit(0.0)))
    return own.select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), F.round("overlap", 6).alias("overlap"), (F.col("overlap") >= CONFIRM).alias("confirmed"), "text")
