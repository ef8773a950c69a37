"""License scans: a paragraph classifier confirmed by templates.

A paragraph is what stands between lines without letters or digits, its lines
joined; signs that mark comments are no words. Each of its lines is one as well.
Longer ones are read in overlapping windows of words.
Its word n-grams are hashed into a sparse vector, from which a multinomial
logistic regression tells the licence family or "unknown". It learns from parts
of the templates (families) and from paragraphs of the corpus (unknown). Its
softmax is tempered, and the least score of a family set, on paragraphs kept
back from learning. A prediction counts once the template of its family agrees,
and the words agree that tell the family from its kin.

Only text that can agree is scored: a paragraph that holds the asked share of a
template's pairs holds one of a few long words of that template (``required_words``).
Documents without any are done after one look at their text, with the same result.

Everything is a row of its own until a document's few hits are gathered, so a
hot source needs no care.

- Null texts are empty ones and have no paragraphs; an empty table has no rows.
- Ids may be null or repeated: every row has a result, by a number that is given once.
- Of families of equal score the first by name is told.
- Very long lines are windows; very long texts are split in one go by the row.
- Equal texts are one in the sample that is learnt from, however often they occur.
- Other columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import texts, written

UNKNOWN = "unknown"
LINE_END = "[\\r\\n\u2028\u2029]+"
#: A line end, signs alone, and the next line end.
BETWEEN = "(?>\\r\\n|[\\r\\n\u2028\u2029])[^\\p{L}\\p{N}]*(?>\\r\\n|[\\r\\n\u2028\u2029])"

# Notices by which texts are put under a licence, by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-NC-SA": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "CC0": [
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "proprietary": [
        "All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ],
}


# Words that a paragraph of a family has (one of them), or has not.
NEEDED = {
    "AGPL": ["affero"],
    "LGPL": ["lesser"],
    "CC-BY-NC-SA": ["by-nc-sa", "attribution-noncommercial-sharealike"],
    "CC-BY-NC": ["by-nc", "attribution-noncommercial"],
    "CC-BY-SA": ["by-sa", "attribution-sharealike"],
    "CC-BY": ["by", "attribution"],
}
# Words that are common in any prose; they only decide which words are looked for first.
EVERYDAY = {
    "a", "above", "all", "an", "and", "any", "appear", "are", "be", "by", "can", "charge", "conditions",
    "copy", "extent", "following", "for", "free", "from", "general", "has", "in", "included", "international",
    "is", "it", "its", "law", "may", "met", "name", "no", "nor", "not", "of", "on", "or", "part", "possible",
    "prior", "products", "program", "provided", "public", "purpose", "related", "required", "shall", "source",
    "subject", "terms", "that", "the", "this", "to", "under", "use", "used", "v", "version", "with",
    "without", "work", "writing", "written", "you",
}
EXCLUDED = {"GPL": ["affero", "lesser", "library"]}


@dataclass(frozen=True)
class Settings:
    """``documents``: about so many distinct texts of the corpus are looked at,
    ``paragraphs``: about so many distinct paragraphs of theirs are learnt from.
    ``false_share``: unknown paragraphs that may score as a family.
    ``agreement``: least share of a template's n-grams that a paragraph holds."""

    bits: int = 12
    window: int = 200
    overlap: int = 40
    documents: int = 20_000
    paragraphs: int = 10_000
    false_share: float = 0.001
    agreement: float = 0.6
    penalty: float = 1e-3
    iterations: int = 25


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    regression: LogisticRegressionModel
    temperature: float
    least_score: float
    settings: Settings


def words_of(text: Column) -> Column:
    """Words in lower case: runs of letters and digits, and + - . within."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.+\-][\p{L}\p{N}]+)*+"), 0)


def ngrams(words: Column) -> Column:
    """Words, pairs and triples of a column of words."""

    def runs(n: int) -> Column:
        return F.when(
            F.size(words) >= n,
            F.transform(
                F.sequence(F.lit(0), F.size(words) - n),
                lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(n)]),
            ),
        ).otherwise(F.array().cast("array<string>"))

    return F.concat(words, runs(2), runs(3))


def numbered(docs: DataFrame, id_col: str, text_col: str, settings: Settings) -> DataFrame:
    """(doc_id, row, text) of every row; a text that can hold no notice is null.

    Written, so that the numbers are given once and the texts looked at once.
    """
    text = F.when(may_agree(F.col("text"), settings), F.col("text"))
    rows = texts(docs, id_col, text_col).select("doc_id", F.monotonically_increasing_id().alias("row"), text.alias("text"))
    return written(rows, "license-rows")


def required_words(share: float) -> list[str]:
    """Words of which every paragraph has one that holds the share of a template's pairs.

    Of a template's n pairs at least share * n are held, so at most the others are
    not; words that occur in more pairs than that cannot all be missing. Long words
    that are not of every day are taken first.
    """
    chosen = set()
    for notices in TEMPLATES.values():
        for words in map(template_words, notices):
            pairs = set(zip(words, words[1:]))
            missing, covered = len(pairs) - math.ceil(share * len(pairs)), set()
            for word in sorted(set(words), key=lambda w: (w in EVERYDAY, -len(w), w)):
                if len(covered) > missing:
                    break
                chosen.add(word)
                covered |= {p for p in pairs if word in p}
    return sorted(chosen)


def may_agree(text: Column, settings: Settings) -> Column:
    """Whether the text has one of the required words (or begins a word with one)."""
    words = "|".join(re.escape(w) for w in required_words(settings.agreement))
    return F.lower(text).rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{words})")


def paragraphs(rows: DataFrame, settings: Settings, prune: bool = False) -> DataFrame:
    """(doc_id, row, block, whole, words) of every block of lines and every line,
    or window of one, of rows (doc_id, row, text). ``whole`` tells blocks of several
    lines. With ``prune`` those that can agree with no template are left out."""
    step = settings.window - settings.overlap
    blocks = (
        rows.filter(F.col("text").isNotNull())
        .select("doc_id", "row", F.posexplode(F.split("text", BETWEEN)).alias("block", "lines"))
        .withColumn("of", F.filter(F.split("lines", LINE_END), lambda x: x.rlike(r"[\p{L}\p{N}]")))
    )
    several = F.transform("of", lambda x: F.struct(F.lit(False).alias("whole"), x.alias("line")))
    joined = F.array(F.struct(F.lit(True).alias("whole"), F.array_join("of", " ").alias("line")))
    lines = (
        blocks.select(
            "doc_id",
            "row",
            "block",
            F.explode(F.when(F.size("of") > 1, F.concat(joined, several)).otherwise(several)).alias("l"),
        )
        .filter(may_agree(F.col("l.line"), settings) if prune else F.lit(True))
        .select("doc_id", "row", "block", "l.whole", words_of(F.col("l.line")).alias("words"))
        .filter(F.size("words") > 0)
    )
    starts = F.sequence(
        F.lit(0), F.greatest(F.lit(0), F.size("words") - settings.overlap - 1), F.lit(step)
    )
    windows = F.transform(starts, lambda i: F.slice("words", i + 1, F.lit(settings.window)))
    return lines.select(
        "doc_id",
        "row",
        "block",
        "whole",
        F.explode(
            F.when(F.size("words") <= settings.window, F.array("words")).otherwise(windows)
        ).alias("words"),
    )


def with_features(rows: DataFrame, settings: Settings) -> DataFrame:
    """Adds the hashed n-grams, one for each present, whatever its count."""
    hashed = HashingTF(
        inputCol="grams", outputCol="features", numFeatures=1 << settings.bits, binary=True
    )
    return hashed.transform(rows.withColumn("grams", ngrams(F.col("words")))).drop("grams")


def template_words(notice: str) -> list[str]:
    """``words_of`` for a template, which is ASCII."""
    return re.findall(r"[a-z0-9]+(?:[.+\-][a-z0-9]+)*", notice.lower())


def template_parts() -> list[tuple[str, list[str]]]:
    """Every template, and two thirds of it from every second word on."""
    parts = []
    for family, notices in TEMPLATES.items():
        for words in map(template_words, notices):
            parts.append((family, words))
            size = max(6, 2 * len(words) // 3)
            parts += [(family, words[i : i + size]) for i in range(0, len(words) - 5, 2) if len(words) > 8]
    return parts


def with_pairs(rows: DataFrame) -> DataFrame:
    """Adds the distinct pairs of neighbouring words."""
    n = F.size("words")
    pairs = F.transform(
        F.sequence(F.lit(0), n - 2),
        lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1)),
    )
    return rows.withColumn("pairs", F.when(n >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>")))


def agreement(pairs: Column, family: str) -> Column:
    """Largest share of a template of the family that the pairs hold."""
    shares = []
    for words in map(template_words, TEMPLATES[family]):
        own = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
        held = F.size(F.array_intersect(pairs, F.array(*[F.lit(x) for x in own])))
        shares.append(held / len(own))
    return F.greatest(F.lit(0.0), *shares)


def fits(words: Column, family: str) -> Column:
    """Whether the words are those that tell the family from its kin."""
    needed, excluded = NEEDED.get(family, []), EXCLUDED.get(family, [])
    test = F.lit(True)
    if needed:
        test = test & F.arrays_overlap(words, F.array(*[F.lit(w) for w in needed]))
    if excluded:
        test = test & ~F.arrays_overlap(words, F.array(*[F.lit(w) for w in excluded]))
    return test


def surprise(raw: Column, of: Column, temperature: float) -> Column:
    """Minus the logarithm of the tempered softmax of one raw score."""
    powers = F.aggregate(raw, F.lit(0.0), lambda total, x: total + F.exp((x - of) / temperature))
    return F.log(powers)


def with_best(rows: DataFrame, n_families: int) -> DataFrame:
    """Adds ``raw``, the raw scores, and ``best``, the highest of a family."""
    raw = rows.withColumn("raw", vector_to_array("rawPrediction"))
    return raw.withColumn("best", F.array_max(F.slice("raw", 1, n_families)))


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()
) -> Model:
    """Learns families from the templates, the unknown class from about
    ``paragraphs`` paragraphs that hold no third of any template."""
    families = tuple(sorted(TEMPLATES)) + (UNKNOWN,)
    index = F.create_map(*[x for i, f in enumerate(families) for x in (F.lit(f), F.lit(float(i)))])
    spark = docs.sparkSession

    def sampled(rows: DataFrame, value: str, most: int) -> DataFrame:
        """About ``most`` of the distinct values, whatever the number of their copies."""
        hashed = rows.withColumn("_hash", F.xxhash64(value))
        n = hashed.agg(F.approx_count_distinct("_hash")).first()[0]
        part = hashed.filter(F.pmod("_hash", F.lit(1 << 30)) < int(min(1.0, most / max(n, 1)) * (1 << 30)))
        return part.groupBy("_hash").agg(F.first(value).alias(value)).drop("_hash")

    chosen = sampled(texts(docs, id_col, text_col).select("text"), "text", settings.documents)
    nothing = F.lit(None)
    chosen = chosen.select(nothing.cast("string").alias("doc_id"), nothing.cast("long").alias("row"), "text")
    chosen = written(chosen, "license-sample")
    sample = sampled(paragraphs(chosen, settings).select("words"), "words", settings.paragraphs)
    held = F.greatest(F.lit(0.0), *[agreement(F.col("pairs"), f) for f in families[:-1]])
    unknown = with_pairs(sample).filter(held < 1 / 3).select(F.lit(UNKNOWN).alias("family"), "words")
    # words alone, so that an unknown class exists in a corpus without paragraphs
    given = template_parts() + [(UNKNOWN, [w]) for w in ("the", "license", "version")]
    learnt = written(unknown, "paragraphs").unionByName(
        spark.createDataFrame(given, "family string, words array<string>")
    )
    unknown_label = len(families) - 1
    back = F.pmod(F.xxhash64(F.concat_ws(" ", "words")), F.lit(5)) == 0
    labelled = with_features(learnt, settings).select(
        "features",
        index[F.col("family")].alias("label"),
        (back & (F.col("family") == UNKNOWN)).alias("back"),
        # as much weight for all families together as for the unknown class
        F.when(F.col("family") == UNKNOWN, 1.0).otherwise(20.0).alias("weight"),
    )
    # a bounded sample, passed over once for each step of the optimiser
    labelled = labelled.coalesce(4).persist()
    regression = LogisticRegression(
        family="multinomial", weightCol="weight", regParam=settings.penalty, maxIter=settings.iterations
    ).fit(labelled.filter(f"NOT back OR label <> {unknown_label}"))
    kept_back = regression.transform(labelled.filter(f"back OR label <> {unknown_label}"))
    raw = with_best(kept_back, unknown_label).withColumn(
        "own", F.get("raw", F.col("label").cast("int"))
    )
    grid = [2.0 ** (i / 2) for i in range(-4, 9)]
    losses = raw.agg(
        *[F.avg(surprise(F.col("raw"), F.col("own"), t)).alias(f"t{i}") for i, t in enumerate(grid)]
    ).first()
    temperature = grid[min(range(len(grid)), key=lambda i: losses[i])]
    score = F.exp(-surprise(F.col("raw"), F.col("best"), temperature))
    least = raw.filter(F.col("label") == unknown_label).agg(
        F.percentile_approx(score, 1 - settings.false_share, 100_000).alias("s")
    ).first()["s"]
    labelled.unpersist()
    return Model(families, regression, temperature, max(0.5, least or 0.0), settings)


def scan_paragraphs(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every paragraph that may agree with a template, with its family, score and
    agreement; ``confirmed`` where the template agrees with a family that scores enough."""
    return _scored(numbered(docs, id_col, text_col, model.settings), model)


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    rows = with_features(paragraphs(rows, model.settings, prune=True), model.settings)
    n = len(model.families) - 1
    names = F.array(*[F.lit(f) for f in model.families])
    told = F.struct(
        F.exp(-surprise(F.col("raw"), F.col("best"), model.temperature)).alias("score"),
        F.get(names, F.array_position("raw", F.col("best")).cast("int") - 1).alias("family"),
    )
    # a generator, because filters on the score would be moved below a mere
    # projection, and the model be evaluated again for every mention of it
    scored = (
        with_best(model.regression.transform(rows), n)
        .select("doc_id", "row", "block", "whole", "words", F.explode(F.array(told)).alias("told"))
        .select("doc_id", "row", "block", "whole", "words", "told.score", "told.family")
    )
    scored = scored.withColumn(
        "family", F.when(F.col("score") >= model.least_score, F.col("family")).otherwise(UNKNOWN)
    )
    agreed = F.lit(0.0)
    for name in model.families[:-1]:
        own = F.when(fits(F.col("words"), name), agreement(F.col("pairs"), name)).otherwise(0.0)
        agreed = F.when(F.col("family") == name, own).otherwise(agreed)
    hits = with_pairs(scored).withColumn("agreement", agreed).drop("pairs")
    return hits.withColumn("confirmed", F.col("agreement") >= model.settings.agreement)


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: number of confirmed paragraphs, families, and
    the highest score and agreement of those. A block counts for a family if none
    of its lines does."""
    rows = numbered(docs, id_col, text_col, model.settings)
    lines, wholes = F.count_if(~F.col("whole")), F.count_if("whole")
    hits = (
        _scored(rows, model)
        .filter("confirmed")
        .groupBy("row", "block", "family")
        .agg(
            F.when(lines > 0, lines).otherwise(wholes).alias("n"),
            F.max("score").alias("score"),
            F.max("agreement").alias("agreement"),
        )
        .groupBy("row")
        .agg(
            F.sum("n").alias("n_license"),
            F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"),
            F.max("score").alias("score"),
            F.max("agreement").alias("agreement"),
        )
    )
    return rows.select("doc_id", "row").join(hits, "row", "left").select(
        "doc_id",
        F.coalesce("n_license", F.lit(0)).alias("n_license"),
        F.coalesce("families", F.lit("")).alias("families"),
        "score",
        "agreement",
    )
