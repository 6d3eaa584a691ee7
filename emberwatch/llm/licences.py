"""Licence scans: a trained paragraph classifier with an unknown class, confirmed by templates.

A paragraph is a non-empty line. Its words and word pairs are sparse features of a multinomial logistic
regression with an elastic-net penalty. It learns licence families from notices and damaged copies of
them, and the unknown class from at most BACKGROUND paragraphs of the corpus, chosen by hash,
and sentences that only sound like a licence. On held-out copies the lowest probability is found at
which at least RIGHT of the accepted are right; below it a paragraph is unknown. A prediction is
confirmed when the paragraph holds at least OVERLAP of the five-word shingles of a notice of the
family; shorter notices count whole. Only DataFrame operations and Spark's own library are used.

Null or empty text has no paragraph. Repeated rows are scanned each by itself. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.common import stored

BACKGROUND = 4000
VOCABULARY = 4000
RIGHT = 0.99
SHINGLE = 5
OVERLAP = 0.8
UNKNOWN = "unknown"
COPIES = 12

# Common notices of each family, as their licences word them.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License.",
        "This project is available under the terms of the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GNU GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright by the authors. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without permission.",
    ],
}
LOOKALIKES = [
    "She renewed her driver license at the public office.",
    "The license plate was issued by the state in version two.",
    "A licensed therapist works under the supervision of the clinic.",
    "The committee released the report under the general agreement.",
    "Use of the source was permitted without restriction in the public park.",
    "He granted permission to copy the notes free of charge.",
    "The software was redistributed in binary form last year.",
    "Creative work is the common attribution of the general public.",
    "The new version was released to the public.",
    "All rights are equal before the law.",
]
FAMILIES = [*NOTICES, UNKNOWN]


def words_of(text: Column) -> Column:
    """Lower-case words; letters, digits and inner points, dashes."""
    clean = F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " ")
    return F.filter(F.split(clean, " "), lambda w: w != "")


def grams(words: Column) -> Column:
    """Words and pairs of neighbours."""
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))),
                       lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))


def _examples(spark: SparkSession) -> DataFrame:
    """Notices, and copies of them that lack words or stand among others; half is held out."""
    rows = [(family, n) for family, notices in NOTICES.items() for n in notices]
    rows += [(UNKNOWN, n) for n in LOOKALIKES]
    whole = spark.createDataFrame(rows, "family string, notice string").select(
        "family", words_of(F.col("notice")).alias("words"),
        F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy"),
    )
    missing = F.filter(
        "words", lambda w, i: (F.col("copy") == 0) | (F.size("words") < 6)
        | (F.pmod(F.xxhash64(w, i, F.col("copy")), F.lit(9)) != 0)
    )
    return whole.select(
        "family", missing.alias("words"), F.pmod("copy", F.lit(2)).alias("half"),
        (F.col("copy") > 0).alias("damaged"),
    )


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    return docs.select(F.col(key).alias(key), F.posexplode(lines).alias("paragraph", "line"))


class Scanner:
    """A fitted vocabulary and regression, and the probability from which they are believed."""

    def __init__(self, vectors: CountVectorizerModel, model: LogisticRegressionModel,
                 threshold: float):
        self.vectors, self.model, self.threshold = vectors, model, threshold

    def score(self, rows: DataFrame) -> DataFrame:
        """``family`` and ``probability`` for the ``words`` of each row."""
        seen = self.vectors.transform(rows.withColumn("_grams", grams(F.col("words"))))
        scored = self.model.transform(seen).withColumn("_odds", vector_to_array("_probability"))
        names = F.array(*map(F.lit, FAMILIES))
        return scored.select(
            *rows.columns, F.get(names, F.col("_class").cast("int")).alias("family"),
            F.array_max("_odds").alias("probability"),
            F.monotonically_increasing_id().alias("_place"),
        )


def train(docs: DataFrame, text: str = "text") -> Scanner:
    spark = docs.sparkSession
    lines = paragraphs(docs.select(F.lit(0).alias("_k"), F.col(text).alias("_t")), "_k", "_t")
    # The share is set by a count, so that what is learned from stays bounded.
    total = lines.count()
    draw = F.pmod(F.xxhash64("line"), F.lit(1_000_000))
    known = [" ".join(n.lower().split()) for notices in NOTICES.values() for n in notices]
    plain = F.trim(F.regexp_replace(F.lower("line"), "\\s+", " "))
    background = lines.filter(draw < F.lit(1e6 * BACKGROUND / max(1, total))).filter(
        ~plain.isin(known)
    ).select(F.lit(UNKNOWN).alias("family"), words_of(F.substr("line", F.lit(1), F.lit(2000)))
             .alias("words"), F.pmod(F.xxhash64("line", F.lit(1)), F.lit(2)).cast("int")
             .alias("half"), F.lit(False).alias("damaged"))
    # The same line counts once: copies of a text teach nothing new.
    background = background.distinct().filter(F.size("words") > 0)
    rows = stored(_examples(spark).select("family", "words", F.col("half").cast("int").alias(
        "half"), "damaged").unionByName(background), "licence-examples")
    label = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")) - 1
    rows = rows.withColumn("label", label.cast("double")).withColumn("_grams", grams(F.col("words")))
    vectors = CountVectorizer(
        inputCol="_grams", outputCol="_features", vocabSize=VOCABULARY, minDF=2.0, binary=True
    ).fit(rows.filter((F.col("half") == 0) & (F.col("family") != UNKNOWN)))
    training = vectors.transform(rows.filter("half = 0"))
    model = LogisticRegression(
        featuresCol="_features", labelCol="label", predictionCol="_class",
        probabilityCol="_probability", rawPredictionCol="_raw", maxIter=60, regParam=0.002,
        elasticNetParam=0.3, family="multinomial",
    ).fit(training)
    scanner = Scanner(vectors, model, 1.0)
    tested = scanner.score(rows.filter("half = 1").select("words", F.col("family").alias("truth")))
    steps = [x / 100 for x in range(30, 100, 5)]
    counts = tested.filter(F.col("family") != UNKNOWN).agg(*[
        x for i, t in enumerate(steps) for x in (
            F.count_if(F.col("probability") >= t).alias(f"n{i}"),
            F.count_if((F.col("probability") >= t) & (F.col("family") == F.col("truth")))
            .alias(f"k{i}"),
        )
    ]).first()
    fine = [t for i, t in enumerate(steps) if counts[f"n{i}"] and
            counts[f"k{i}"] >= RIGHT * counts[f"n{i}"]]
    scanner.threshold = fine[0] if fine else steps[-1]
    return scanner


def _shingles(words: Column) -> Column:
    size = F.size(words)
    return F.when(size <= SHINGLE, F.array(F.array_join(words, " "))).otherwise(F.transform(
        F.sequence(F.lit(1), size - SHINGLE + 1),
        lambda i: F.array_join(F.slice(words, i, F.lit(SHINGLE)), " "),
    ))


def _notice_words(notice: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in notice.lower()).split()


def similarity(words: Column, family: Column) -> Column:
    """Largest share of a notice's shingles that the paragraph holds, over the family's notices."""
    held = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    best = F.lit(0.0)
    for name, notices in NOTICES.items():
        shares = []
        for notice in notices:
            said = _notice_words(notice)
            parts = [" ".join(said[i : i + SHINGLE])
                     for i in range(max(1, len(said) - SHINGLE + 1))]
            hits = sum((F.contains(held, F.lit(f" {p} ")).cast("int") for p in parts), F.lit(0))
            shares.append(hits / F.lit(float(len(parts))))
        best = F.when(family == name, F.greatest(*shares)).otherwise(best)
    return best


def scan(docs: DataFrame, scanner: Scanner | None = None, key: str = "doc_id") -> DataFrame:
    """Paragraphs taken as licence notices: place, family, probability and template similarity."""
    scanner = scanner or train(docs)
    lines = paragraphs(docs, key)
    rows = lines.withColumn("words", words_of(F.col("line"))).filter(F.col("line") != "")
    believed = (F.col("family") != UNKNOWN) & (F.col("probability") >= scanner.threshold)
    found = scanner.score(rows).filter(believed & (F.col("_place") >= 0))
    share = similarity(F.col("words"), F.col("family"))
    return found.select(
        key, "paragraph", "family", "probability", share.alias("similarity"),
        (share >= OVERLAP).alias("confirmed"), F.col("line").alias("notice"),
    )
