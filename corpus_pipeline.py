"""From raw documents to tokens: five stages, each on all that the one before kept.

``documents`` has doc_id, text, lang, source and n_chars. All stages but the last
return those columns; ``n_chars`` follows the text where a stage rewrites it.
Null texts and texts without a letter go at the first stage, because no language
can be told. An empty table passes as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import bpe, langid, mixing, neardup, secrets
from tallyhouse.llm.common import table, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model learns from labelled rows
    that are not held out."""
    model = langid.train(docs, ~langid.held_out())
    return langid.accepted(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return neardup.without_near_duplicates(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    masked = secrets.masked_rows(docs, secrets.train(docs))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates ask; those most likely good once at least,
    and more than once where good ones are to get more weight than they have."""
    mix = mixing.mix(
        docs,
        table(spark, sf_dir, "labels"),
        mixing.label_domain(F.col("quality"), F.col("toxic")),
        mixing.TARGETS,
        carry=True,
        whole="good",
    )
    return mixing.mixed_rows(mix)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests of a decoding round trip."""
    return bpe.round_trip(docs, bpe.Vocabulary.public(), with_ids=True)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", token_stage),
]

#: Learnt models, hashes and merges are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
