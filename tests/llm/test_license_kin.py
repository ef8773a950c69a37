"""Licences of one kin are told apart; what cannot agree is left out without loss."""

import random

import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import licenses

NOTICES = {
    "AGPL": "This program is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU Affero General Public License as published by the Free Software Foundation, either version 3",
    "GPL": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL": "This library is licensed under the GNU Lesser General Public License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY": "Licensed under CC BY 4.0.",
    "CC-BY-SA": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA": "Licensed under CC BY-NC-SA 4.0.",
    "proprietary": "All rights reserved.",
}


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_families_of_one_kin(spark, model):
    docs = spark.createDataFrame(list(NOTICES.items()), "doc_id string, text string")
    assert {r.doc_id: r.families for r in licenses.scan(docs, model).collect()} == {f: f for f in NOTICES}


def test_pruning_loses_no_agreement(spark, model):
    """Parts of templates, words left out: what agrees enough has a required word."""
    rng = random.Random(4)
    texts = []
    for notices in licenses.TEMPLATES.values():
        for words in map(licenses.template_words, notices):
            for _ in range(30):
                texts.append(" ".join(w for w in words if rng.random() < rng.choice([0.6, 0.8, 0.95])))
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id int, row int, text string")
    settings = model.settings
    held = F.greatest(*[licenses.agreement(F.col("pairs"), f) for f in licenses.TEMPLATES])
    whole = licenses.with_pairs(licenses.paragraphs(rows, settings)).filter(held >= settings.agreement)
    pruned = licenses.with_pairs(licenses.paragraphs(rows, settings, prune=True)).filter(held >= settings.agreement)
    assert whole.count() == pruned.count() > 100


def test_hits_stay_with_their_rows(spark, model):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: tuple(r) for r in licenses.scan(documents, model).collect()}
    twice = documents.unionByName(documents).repartition("doc_id")
    got = licenses.scan(twice, model).collect()
    assert len(got) == 2 * len(want) and all(tuple(r) == want[r.doc_id] for r in got)


def test_copies_do_not_fill_the_sample(spark):
    copies = spark.range(20_000).select("id", F.lit("one line of a text that occurs again").alias("text"))
    others = spark.range(50).select(F.col("id") + 20_000, F.concat(F.lit("other line "), "id", F.lit(" here")).alias("text"))
    docs = copies.unionByName(others.toDF("id", "text"))
    learnt = licenses.train(docs, "id", "text", licenses.Settings(documents=40, paragraphs=40, iterations=3))
    assert learnt.families[-1] == licenses.UNKNOWN
    found = licenses.scan(docs, learnt, "id", "text")
    assert found.filter("n_license > 0").count() == 0 and found.count() == 20_050
