"""Licence scan by a trained paragraph classifier, with DataFrame functions only (operator 7).

A paragraph ends at a blank line (comment signs count as blank) and where a line
ends behind a full stop, colon, semicolon, question or exclamation mark; other
line ends are wraps inside it.  Paragraphs of more than ``WINDOW`` words are read
in passages of so many words, one every ``STRIDE``.  A passage's features are its
distinct word 2- and 3-grams.  A sparse multinomial logistic regression is fitted
on a bounded sample: distinct passages with a family's key phrase, passages
far from every phrase and template, and the templates, whole, with words left out and without the
phrase.  All passages are scored by joining their n-grams with the non-zero
weights.  A family counts if its probability passes a threshold calibrated on
held-out passages and a template of the family is found in the passage; what
looks like a licence otherwise is ``unknown``.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialframe.session import durable

NONE, UNKNOWN = "none", "unknown"
#: Sentences of licence texts and notices; fixed values.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
        "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
        "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ),
    "reserved": ("All rights reserved.",),
}
#: The phrases, in words with single spaces, that label a passage; fixed values.
PHRASES = {
    "apache-2.0": r"apache license|apache 2 0",
    "bsd": r"redistribution and use in source|bsd 3 clause|bsd license",
    "cc-by": r"cc by 4 0|commons attribution 4",
    "cc-by-nc": r"cc by nc|attribution noncommercial",
    "gpl": r"gnu general public|gpl [23]",
    "mit": r"mit license|permission is hereby granted free of charge|license identifier mit",
    "reserved": r"all rights reserved",
}
#: Words of a passage, and from one passage's begin to the next one's.
WINDOW, STRIDE = 128, 64
#: Bounds of the sample: documents (about), passages of each family and without a phrase; copies of each template.
DOCUMENTS = 20_000
PER_FAMILY = 500
OTHERS = 2000
TEMPLATE_COPIES = 10
#: Every so many words one is left out of a template's odd copies.
LEFT_OUT = 11
VOCABULARY = 8192
PRECISION = 0.99
FOLDS = 5
#: Part of a template's n-grams that a passage must hold.
CONFIRMED = 0.8
#: With this part of a template's n-grams a passage is no example of other text.
EXAMPLE = 0.5
_WEIGHTS = "array<struct<gram: long, weights: array<double>>>"
_MARKS = "array<struct<gram: long, template: int>>"


def _grams(words: Column) -> Column:
    """Hashes of the distinct 2- and 3-grams of an array of words."""

    def of(w: Column, n: int) -> Column:
        starts = F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda x, k: F.xxhash64(F.lit(n), x, *[F.get(w, k + j) for j in range(1, n)]))

    # The outer array binds the words, so that they are split once and not per n-gram.
    return F.transform(F.array(words), lambda w: F.array_distinct(F.concat(of(w, 2), of(w, 3))))[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


#: Ends of paragraphs.  Each begins with a line end, so that other characters are passed quickly.
_ENDS = r"\n[\s#*/;%-]*\n|\n(?<=[.:;!?]\n|[.:;!?]\r\n)"


def passages(docs: DataFrame) -> DataFrame:
    """``row, doc_id, pos, at, words``: the passages of each paragraph; ``row`` hashes id and text."""
    split = docs.select(
        F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id"),
        F.posexplode(F.split(F.col("text").cast("string"), _ENDS)).alias("pos", "text"),
    )
    worded = split.select("row", "doc_id", "pos", _words(F.col("text")).alias("words"))
    last = F.ceil((F.size("words") - WINDOW) / STRIDE).cast("int")
    begins = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    cut = F.transform(begins, lambda k: F.slice("words", k * STRIDE + 1, WINDOW))
    return worded.select("row", "doc_id", "pos", F.posexplode(cut).alias("at", "words"))


def _sampled(docs: DataFrame) -> DataFrame:
    """About ``DOCUMENTS`` different rows, or all where there are no more; by hash, so the same in every run."""
    part = min(1.0, DOCUMENTS / max(docs.count(), 1))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if part < 1.0:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(part * (1 << 30)))
    return rows.distinct()


def sample(docs: DataFrame) -> DataFrame:
    """``(family, grams, fold)``: the bounded labelled sample, templates included."""
    spark = docs.sparkSession
    joined = F.array_join("words", " ")
    family = F.lit(None).cast("string")
    for name, phrase in PHRASES.items():
        family = F.when(joined.rlike(phrase), F.lit(name)).otherwise(family)
    labelled = passages(_sampled(docs)).where(F.size("words") > 0).select("words", family.alias("family")).distinct()
    labelled = durable(labelled.withColumn("h", F.xxhash64("words")))
    order = Window.partitionBy("family").orderBy("h", "words")
    known = labelled.where("family is not null").withColumn("at", F.row_number().over(order))
    known = known.where(F.col("at") <= PER_FAMILY).select("family", "words", "h")
    other = labelled.where("family is null").orderBy("h", "words").limit(OTHERS)
    # Licence texts without a phrase are no examples of other text.
    templates = json.dumps([r["grams"] for r in _template_rows(spark).collect()])
    bodies = F.from_json(F.lit(templates), "array<array<long>>")
    own = _grams(F.col("words"))
    near = F.exists(bodies, lambda t: F.size(F.array_intersect(own, t)) >= EXAMPLE * F.size(t))
    other = other.where(~near).select(F.lit(NONE).alias("family"), "words", "h")
    texts = json.dumps([{"family": k, "text": t, "phrase": PHRASES[k]} for k, ts in TEMPLATES.items() for t in ts])
    fixed = spark.range(1).select(
        F.inline(F.from_json(F.lit(texts), "array<struct<family: string, text: string, phrase: string>>"))
    )
    copies = F.explode(F.expr(f"sequence(1L, {TEMPLATE_COPIES}L)")).alias("h")
    fixed = fixed.select("family", "phrase", _words(F.col("text")).alias("whole"), copies)
    fewer = F.filter("whole", lambda w, k: (k + F.col("h")) % LEFT_OUT != 0)
    bare = _words(F.regexp_replace(F.array_join("whole", " "), F.col("phrase"), " "))
    long = F.size("whole") >= 2 * LEFT_OUT
    copy = F.when(long & (F.col("h") % 2 == 1), fewer).when(long & (F.col("h") % 4 == 0), bare).otherwise(F.col("whole"))
    fixed = fixed.select("family", copy.alias("words"), "h")
    empty = spark.range(4 * TEMPLATE_COPIES).select(
        F.lit(NONE).alias("family"), F.array().cast("array<string>").alias("words"), F.col("id").alias("h")
    )
    rows = known.unionByName(other).unionByName(fixed).unionByName(empty)
    return rows.select("family", _grams(F.col("words")).alias("grams"), F.pmod("h", F.lit(FOLDS)).alias("fold"))


class Classifier:
    """Weights per n-gram, intercepts and threshold, as small JSON texts."""

    def __init__(self, families: list[str], weights: str, intercepts: list[float], threshold: float) -> None:
        self.families, self.weights, self.intercepts, self.threshold = families, weights, intercepts, threshold

    def table(self, spark: SparkSession) -> DataFrame:
        """``(gram, weights)``; at most ``VOCABULARY`` rows."""
        return spark.range(1).select(F.inline(F.from_json(F.lit(self.weights), _WEIGHTS)))


def fit(docs: DataFrame) -> Classifier:
    """Fit on four fifths of the sample and calibrate the threshold on the rest."""
    families = sorted([*TEMPLATES, NONE])
    names = F.array(*[F.lit(f) for f in families])
    data = durable(
        sample(docs).select(
            (F.array_position(names, F.col("family")) - 1).cast("double").alias("label"),
            F.col("grams").cast("array<string>").alias("grams"), "fold",
        ).coalesce(2)
    )
    counts = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=VOCABULARY, minDF=2, binary=True)
    counter = counts.fit(data.where("fold <> 0"))
    vectors = counter.transform(data)
    regression = LogisticRegression(
        family="multinomial", regParam=0.001, elasticNetParam=0.5, maxIter=30, standardization=False
    )
    model = regression.fit(vectors.where("fold <> 0"))
    held = model.transform(vectors.where("fold = 0")).select("label", "prediction", vector_to_array("probability").alias("p"))
    rows = held.select("label", "prediction", F.array_max("p").alias("p")).where(
        F.col("prediction") != families.index(NONE)
    ).collect()
    least, right = 0.5, 0
    for n, r in enumerate(sorted(rows, key=lambda r: -r["p"]), 1):
        right += r["label"] == r["prediction"]
        if right < PRECISION * n:
            least = max(least, r["p"] + 1e-9)
            break
    matrix = model.coefficientMatrix.toArray()
    weights = [
        {"gram": int(term), "weights": matrix[:, k].tolist()}
        for k, term in enumerate(counter.vocabulary) if abs(matrix[:, k]).max() > 1e-9
    ]
    return Classifier(families, json.dumps(weights), model.interceptVector.toArray().tolist(), least)


def scan(docs: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """``row, doc_id, pos, family``: the families of every paragraph that reads as a licence notice.

    ``family`` is confirmed by a template, or ``unknown`` where no passage of the
    paragraph has a confirmed one.  Passages without any weighted n-gram are no
    notices.  Rows equal in doc_id and text give their paragraphs once.
    """
    spark = docs.sparkSession
    own = classifier or fit(docs)
    grams = passages(docs).select("row", "doc_id", "pos", "at", F.explode(_grams(F.col("words"))).alias("gram"))
    marks = _marks(spark)
    weighted = durable(own.table(spark).join(marks.groupBy("gram").agg(F.collect_list("template").alias("templates")), "gram", "full"))
    hits = grams.join(F.broadcast(weighted), "gram")
    n = len(own.families)
    sums = [F.sum(F.coalesce(F.col("weights")[k], F.lit(0.0))).alias(f"w{k}") for k in range(n)]
    templates = [t for ts in TEMPLATES.values() for t in ts]
    held = [F.count_if(F.array_contains("templates", k)).alias(f"t{k}") for k in range(len(templates))]
    sums = hits.groupBy("row", "doc_id", "pos", "at").agg(F.count("weights").alias("known"), *sums, *held)
    scored = durable(sums.where("known > 0"))
    # Equal rows were summed up together.
    copies = docs.groupBy(F.xxhash64("doc_id", "text").alias("row")).agg(F.count("*").alias("n")).where("n > 1")
    own_share = [(F.col(c) / F.coalesce("n", F.lit(1))).alias(c) for c in scored.columns[5:]]
    scored = scored.join(copies, "row", "left").select("row", "doc_id", "pos", "at", *own_share)
    z = [F.col(f"w{k}") + F.lit(own.intercepts[k]) for k in range(n)]
    top = F.greatest(*z)
    total = sum((F.exp(x - top) for x in z), F.lit(0.0))
    sizes, number, found = _template_sizes(spark), 0, {NONE: F.lit(False)}
    for family, texts in TEMPLATES.items():
        hits_ = [F.col(f"t{number + k}") >= F.lit(CONFIRMED * sizes[number + k]) for k in range(len(texts))]
        found[family] = reduce(Column.__or__, hits_)
        number += len(texts)
    verdict = scored.select(
        "row", "doc_id", "pos",
        F.array_position(F.array(*z), top).cast("int").alias("best"),
        (1.0 / total).alias("sure"),
        (F.exp(z[own.families.index(NONE)] - top) / total).alias("none"),
        F.array(*[found[f] for f in own.families]).alias("found"),
    )
    names, other = F.array(*[F.lit(f) for f in own.families]), own.families.index(NONE) + 1
    certain = (F.col("best") != other) & (F.col("sure") >= own.threshold) & F.element_at("found", F.col("best"))
    named = verdict.where((F.col("best") != other) | (F.col("none") < 0.5)).select(
        "row", "doc_id", "pos", F.when(certain, F.element_at(names, F.col("best"))).alias("family")
    )
    families = named.groupBy("row", "doc_id", "pos").agg(F.collect_set("family").alias("families"))
    known = F.when(F.size("families") > 0, F.col("families")).otherwise(F.array(F.lit(UNKNOWN)))
    return families.select("row", "doc_id", "pos", F.explode(known).alias("family"))


def _template_rows(spark: SparkSession) -> DataFrame:
    texts = [t for ts in TEMPLATES.values() for t in ts]
    rows = json.dumps([{"template": k, "text": t} for k, t in enumerate(texts)])
    parsed = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<template: int, text: string>>")))
    return parsed.select("template", _grams(_words(F.col("text"))).alias("grams"))


def _marks(spark: SparkSession) -> DataFrame:
    return _template_rows(spark).select(F.explode("grams").alias("gram"), "template")


def _template_sizes(spark: SparkSession) -> dict[int, int]:
    return {r["template"]: r["n"] for r in _template_rows(spark).select("template", F.size("grams").alias("n")).collect()}


def licences(docs: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_paragraphs, n_licences, n_unknown, families``.

    ``docs`` has ``doc_id`` and ``text``; other columns are not read.
    ``n_paragraphs`` counts paragraphs with a letter or digit, ``n_licences`` the
    confirmed families of each paragraph, ``n_unknown`` the paragraphs that only
    look like a notice; ``families`` joins the confirmed families by commas in
    order of name (empty for none).  A null text has no paragraphs.  Rows equal in
    doc_id and text, nulls included, get equal results.  No rows give no rows.
    """
    found = scan(docs, classifier).groupBy("row").agg(
        F.count_if(F.col("family") != UNKNOWN).alias("n_licences"),
        F.count_if(F.col("family") == UNKNOWN).alias("n_unknown"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("family") != UNKNOWN, F.col("family")))), ",").alias("families"),
    )
    parts = F.filter(F.split(F.col("text").cast("string"), _ENDS), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", F.coalesce(F.size(parts), F.lit(0)).alias("n"))
    return rows.join(found, "row", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_paragraphs"),
        F.coalesce("n_licences", F.lit(0)).alias("n_licences"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"),
        F.coalesce("families", F.lit("")).alias("families"),
    )
