"""Licence scan: a paragraph classifier over word n-grams, confirmed by comparison with templates.

A multinomial logistic regression on hashed word uni- and bigrams tells licence families from ordinary text. It is fitted
on the notices below, each in several damaged forms (words left out, ordinary words around), against the class "none": all
paragraphs of the corpus, licence wording included unless it is nearly one of the notices, and ordinary sentences that use
the same words (``ORDINARY``), damaged likewise. Paragraphs of the same features are one row that weighs as many.

The class "unknown" is calibrated on all these paragraphs and on notices of licences outside the families (``FOREIGN``): a
family counts only above the probability that all but ``false_rate`` of the paragraphs and all of the foreign notices stay
below. A paragraph that is likelier a licence than not, but of no family beyond doubt, is
unknown. A prediction is confirmed if the paragraph holds at least ``confirm`` of the word bigrams of one of the family's
notices.

Only DataFrame, SQL and spark.ml (JVM) operations are used. Defined cases: null and empty texts have no paragraphs;
paragraphs are lines; repeated rows are scanned one by one; a corpus without ordinary paragraphs is calibrated on the
built-in sentences; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logfold.llm.common import written

#: Notices by family, as authors commonly write them.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
    ),
    "epl-2.0": (
        "Licensed under the Eclipse Public License, Version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "cc0": (
        "Licensed under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "proprietary": ("All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission.", "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."),
}
#: Notices of licences that no family stands for; they only calibrate the unknown class.
FOREIGN = (
    "This software is provided as-is, without any express or implied warranty; permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "This package is free software; you may redistribute it under the terms of the Artistic License 2.0.",
    "This font software is licensed under the SIL Open Font License, Version 1.1.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this licence document, and changing it is allowed as long as the name is changed.",
    "Licensed under the Open Data Commons Open Database License.",
    "Use of this material is governed by the Academic Free License version 3.0.",
)
#: Ordinary sentences with the words of licences.
ORDINARY = (
    "The court reserved its judgment on the rights of the general public in the matter of the road.",
    "Her driving license expired before the terms of the loan were agreed.",
    "All rights of way are reserved for walkers and riders on public land.",
    "The software was distributed to every school free of charge in the spring.",
    "Permission to enter the garden is granted by the person at the gate.",
    "He obtained a copy of the file and read the notice under the conditions of the library.",
    "The work was published under a new name with the permission of the author.",
    "A public notice set out the conditions of use for the hall and the fields.",
    "They may not use the source of the river except in dry years.",
    "The company must retain a copy of each document and provide it in writing.",
    "The general terms of the agreement apply to any person who sells goods for commercial purposes.",
    "She attended MIT before she joined the Apache helicopter programme.",
    "The creative commons room is open to the international students of the college.",
    "No part of the building may be entered without prior permission from the owner.",
    "Free software courses are offered by the foundation every other week.",
    "The law requires that neither the buyer nor the seller be named in the public record.",
    "This program of concerts is free and open to the public without warranty of seats.",
    "The list of conditions for the race is included in all copies of the handbook.",
)
FAMILIES = tuple(TEMPLATES)
NONE = len(FAMILIES)
SEPARATORS, NO_SEPARATOR = r"[\x00-,./:-@\[-`{-\x7F]+", r"[^\x00-,./:-@\[-`{-\x7F]"
#: What all ordinary paragraphs weigh together in the fit, and copies of each template that are damaged.
PLAIN_WEIGHT, COPIES = 2000, 24
#: Function words, never a signal.
COMMON = frozenset("a all an and any are as at be been by can either for form from if in into is it its may more no nor not of on one or other part see shall should such that the their this to under use used via was which with without work you your".split())


def _words(text: str) -> list[str]:
    import re

    return [w for w in re.split(SEPARATORS, text.lower()) if w]


#: Words of the notices that may be signals.
VOCABULARY = tuple(sorted({w for texts in TEMPLATES.values() for text in texts for w in _words(text)} - COMMON))


class Model(NamedTuple):
    signal: tuple[str, ...]
    hashing: HashingTF
    regression: LogisticRegressionModel
    threshold: float
    confirm: float


def words_of(text: Column) -> Column:
    """Lower-cased words, parted at ASCII punctuation (but for hyphens) and white space."""
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda w: w != "")


def bigrams(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.filter(pairs, lambda g: g.isNotNull())


def _features(df: DataFrame, signal: tuple[str, ...]) -> DataFrame:
    """Adds ``grams``: the signal words, and the bigrams with one of them."""
    pairs = F.zip_with("words", F.slice("words", 2, F.size("words")), lambda a, b: F.when(b.isNotNull() & (a.isin(*signal) | b.isin(*signal)), F.concat_ws(" ", a, b)))
    return df.withColumn("grams", F.concat(F.filter("words", lambda w: w.isin(*signal)), F.filter(pairs, lambda g: g.isNotNull())))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, text): the non-blank lines of every text, numbered from 0."""
    lines = docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("paragraph", "text"))
    return lines.where(F.trim("text") != "")


def _notices(spark: SparkSession, texts: list[tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame(texts, "label int, text string").select("label", words_of(F.col("text")).alias("words"))


def _ordinary(docs: DataFrame, confirm: float) -> tuple[DataFrame, int, DataFrame]:
    """(words) of every paragraph that holds a word of ``VOCABULARY`` and is no notice; how many paragraphs are no notice, those
    without such a word included; and (around, k): ``COPIES`` beginnings of the latter, which only damage the built-in texts."""
    lines = paragraphs(docs).where(F.col("text").rlike(NO_SEPARATOR))
    told = lines.withColumn("told", F.size(F.array_intersect(F.split(F.lower("text"), SEPARATORS), F.array(*map(F.lit, VOCABULARY)))) > 0)
    notices = tuple(x for f in FAMILIES for x in TEMPLATES[f])
    every = list(dict.fromkeys(" ".join(p) for w in map(_words, notices) for p in zip(w, w[1:])))
    held = told.where("told").select(words_of(F.col("text")).alias("words")).withColumn("held", F.array_intersect(bigrams(F.col("words")), F.array(*map(F.lit, every))))
    some = written(held.select("words", F.when(F.size("held") == 0, 0.0).otherwise(_share(F.col("held"), notices)).alias("share")))
    total = lines.count() - some.where(F.col("share") >= confirm / 2).count()
    first = told.where("NOT told").orderBy(F.xxhash64("text"), "text").limit(COPIES).select("text")
    around = first.select(F.slice(words_of(F.col("text")), 1, 12).alias("around"), F.row_number().over(Window.orderBy(F.xxhash64("text"), "text")).alias("k"))
    return some.where(F.col("share") < confirm / 2).select("words"), total, around


def _damaged(notices: DataFrame, around: DataFrame, copies: int, seed: int) -> DataFrame:
    """Every notice in ``copies`` forms: one in three whole, the others without an eighth of their words; half with other words behind."""
    each = notices.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(copies)))).join(F.broadcast(around), "k", "left")
    kept = F.filter("words", lambda w, i: (F.pmod(F.xxhash64(w, i, F.col("k"), F.lit(seed)), F.lit(8)) > 0) | (F.col("k") % 3 == 0))
    return each.select("label", F.when(F.col("k") % 2 == 0, F.concat(kept, F.coalesce("around", F.array().cast("array<string>")))).otherwise(kept).alias("words")).where(F.size("words") > 1)


def train(docs: DataFrame, sample_rows: int = PLAIN_WEIGHT, false_rate: float = 0.001, confirm: float = 0.6) -> Model:
    """All paragraphs that are no notice are fitted and calibrated on; in the fit they weigh as much together as ``sample_rows`` texts."""
    spark: SparkSession = docs.sparkSession
    known = _notices(spark, [(k, text) for k, family in enumerate(FAMILIES) for text in TEMPLATES[family]])
    ordinary, foreign = _notices(spark, [(NONE, text) for text in ORDINARY]), _notices(spark, [(NONE, text) for text in FOREIGN])
    some, total, around = _ordinary(docs, confirm)
    around = written(around)
    seen = some.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, VOCABULARY)))).alias("w")).groupBy("w").count()
    usual = {r.w for r in seen.where(F.col("count") > max(2, total // 100)).collect()}  # at most the vocabulary
    signal = tuple(w for w in VOCABULARY if w not in usual and not w.isdigit())
    plain = written(_features(some.where(F.exists("words", lambda w: w.isin(*signal))), signal).groupBy("grams").agg(F.count(F.lit(1)).alias("n")))
    quiet = total - plain.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # paragraphs without a signal word are alike to the classifier
    plain = plain.unionByName(spark.createDataFrame([([], quiet)], "grams array<string>, n long"))
    made = _features(_damaged(known, around, COPIES, 0).unionByName(_damaged(ordinary, around, COPIES, 0)), signal).select("label", "grams", F.lit(1.0).alias("weight"))
    rows = made.unionByName(plain.where("n > 0").select(F.lit(NONE).alias("label"), "grams", (F.col("n") * (sample_rows / max(1, total))).alias("weight")))
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=1 << 14, binary=True)
    fit_rows = written(rows.repartition("grams").sortWithinPartitions("grams", "label", "weight"))
    ready = hashing.transform(fit_rows).select("label", "features", "weight").cache()
    regression = LogisticRegression(family="multinomial", weightCol="weight", maxIter=40, regParam=0.001, elasticNetParam=0.0).fit(ready)
    ready.unpersist()
    model = Model(signal, hashing, regression, 0.5, confirm)
    ordinary_top = predict(_damaged(ordinary, around, COPIES, 1).select("words"), model).agg(F.percentile_approx("probability", F.lit(1 - false_rate), 10_000)).first()[0]
    strange = predict(foreign.select("words"), model).agg(F.max("probability")).first()[0]
    return model._replace(threshold=min(0.95, max(0.5, _exceeded(plain, model, false_rate * total), ordinary_top or 0.0, strange or 0.0)))


def _exceeded(plain: DataFrame, model: Model, most: float) -> float:
    """The least probability, in steps of 1/10,000, that at most ``most`` of all counted paragraphs exceed."""
    cell = F.ceil(F.col("probability") * 10_000)
    cells = _scored(plain, model).groupBy(cell.alias("cell")).agg(F.sum("n").alias("n")).orderBy(F.desc("cell")).collect()  # 10,001 at most
    above = 0
    for r in cells:
        above += r.n
        if above > most:
            return r.cell / 10_000
    return 0.0


def template_share(words: Column, notices: tuple[str, ...]) -> Column:
    """The largest share of a notice's word bigrams that the paragraph holds."""
    return _share(bigrams(words), notices)


def _share(grams: Column, notices: tuple[str, ...]) -> Column:
    literal = [F.array(*(F.lit(" ".join(p)) for p in dict.fromkeys(zip(w, w[1:])))) for w in map(_words, notices)]
    return F.greatest(*(F.size(F.array_intersect(grams, x)) / F.size(x) for x in literal))


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """Adds to rows with ``words``: the likeliest family, its probability, and ``licence``, the probability of any family."""
    return _scored(_features(rows, model.signal), model)


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    scored = model.regression.setProbabilityCol("p").setPredictionCol("best").setRawPredictionCol("raw").transform(model.hashing.transform(rows))
    all_p = vector_to_array("p")
    top = scored.withColumn("licence", 1 - F.element_at(all_p, NONE + 1)).withColumn("p", F.slice(all_p, 1, NONE)).withColumn("probability", F.array_max("p"))
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position("p", F.col("probability")).cast("int"))
    return top.withColumn("family", family).drop("p", "best", "raw", "features", "grams")


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, paragraph, family, probability, template_share, confirmed, text) of paragraphs that read like a licence.

    ``family`` is unknown where the likeliest family stays below the calibrated threshold; probability is then that of
    any licence.
    """
    rows = paragraphs(docs).withColumn("words", words_of(F.col("text"))).where(F.exists("words", lambda w: w.isin(*model.signal)))
    hits = predict(rows, model).where(F.col("licence") >= 0.5)
    share = F.lit(0.0)
    for f in FAMILIES:
        share = F.when(F.col("family") == f, template_share(F.col("words"), TEMPLATES[f])).otherwise(share)
    found = hits.withColumn("template_share", share)
    sure = F.col("probability") >= model.threshold
    return found.select(
        "doc_id", "paragraph", F.when(sure, F.col("family")).otherwise("unknown").alias("family"), F.when(sure, F.col("probability")).otherwise(F.col("licence")).alias("probability"), "template_share",
        (sure & (F.col("template_share") >= model.confirm)).alias("confirmed"), "text",
    )
