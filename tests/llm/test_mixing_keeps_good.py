"""Mixing for the pipeline loses no good document."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tallyhouse.llm import mixing


def test_mostly_good_corpus(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(600):
        kind = "good" if i % 100 < 97 else "poor" if i % 100 < 99 else "toxic"
        words = [f"{kind}{j}" for j in rng.integers(0, 30, 50)]
        rows.append((i, " ".join(words), "en", "s", 100))
        labels.append((i, int(kind == "good"), int(kind == "toxic")))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    kept = {r.doc_id for r in corpus_pipeline.mixing_stage(spark, docs, str(tmp_path)).collect()}
    assert {i for i, quality, _ in labels if quality} <= kept


def test_soft_chances(spark):
    rows = [(i, 100, [0.6, 0.4, 0.0] if i % 10 == 0 else [1.0, 0.0, 0.0] if i % 10 < 8 else [0.1, 0.8, 0.1]) for i in range(200)]
    chances = spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>")
    got = mixing.fit_rates(chances, mixing.TARGETS, whole="good").rows.collect()
    assert all(r.rate >= 1 for r in got if r.p[0] >= 0.6)
    assert any(r.rate < 0.5 for r in got if r.p[0] < 0.5)
