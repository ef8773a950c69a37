"""The registered queries of this subpackage: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import bpe, fingerprint, langid, licenses, merkle, merkle_sql, mixing, neardup, pii
from tallyhouse.llm import quality, secrets, substrings, warc, whitening
from tallyhouse.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op1_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.Vocabulary.public())


@query("op2_fingerprints")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))
    text = {c: F.concat_ws(",", F.col(c).cast("array<string>")) for c in ("sketch", "edited_sketch")}
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text["sketch"].alias("fingerprint"),
        text["edited_sketch"].alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "kept_share",
        "n_shingles",
    )


@query("op3_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.train(documents, ~langid.held_out())
    return langid.predict(documents, model).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score"
    )


@query("op6_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_quality(table(spark, sf_dir, "documents"))


@query("op9_warc")
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op10_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[f"n_{k}" for k in pii.KINDS],
        F.sha2("base_spans", 256).alias("base_sha256"),
        "spans",
        "n_added",
    )


@query("op5_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = secrets.scan(documents, secrets.train(documents))
    hits = F.filter("findings", lambda f: f["secret"])
    spans = F.transform(hits, lambda f: F.concat_ws(":", f["start"], f["end"]))
    return found.select(
        "doc_id",
        F.size("findings").cast("long").alias("n_candidates"),
        F.size(hits).cast("long").alias("n_secrets"),
        F.array_join(spans, ",").alias("secrets"),
        F.array_max(F.transform("findings", lambda f: f["score"])).alias("highest_score"),
        F.sha2("masked", 256).alias("masked_sha256"),
    )


@query("op7_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return licenses.scan(documents, licenses.train(documents))


@query("op4_mixing")
def mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(
        table(spark, sf_dir, "documents"),
        table(spark, sf_dir, "labels"),
        mixing.label_domain(F.col("quality"), F.col("toxic")),
        mixing.TARGETS,
    )
    names = F.array(*[F.lit(d) for d in mixing.DOMAINS])
    return mix.rows.select(
        "doc_id",
        "n_tokens",
        F.get(names, F.array_position("p", F.array_max("p")).cast("int") - 1).alias("domain"),
        *[F.get("p", i).alias(f"p_{d}") for i, d in enumerate(mixing.DOMAINS)],
        "rate",
        F.lit(mix.steps).alias("steps"),
        *[F.lit(float(mix.residuals[d])).alias(f"residual_{d}") for d in mixing.DOMAINS],
    )


@query("op8_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op11_whitening")
def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_embeddings(table(spark, sf_dir, "embeddings"))


@query("op12_merkle_manifest", merkle_sql.MANIFEST)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(
        table(spark, sf_dir, "documents"),
        changed=merkle.tampered(),
        changes={"n_chars": F.col("n_chars") + 1},
    )


@query(
    "op13_substring_dedup",
    r"""WITH words AS (SELECT row_number() OVER () AS r, doc_id,
          coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        windows AS (SELECT r, doc_id, p, array_to_string(w[p:p + 49], ' ') AS passage
          FROM words, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS p)),
        firsts AS (SELECT passage, min(doc_id) AS first FROM windows GROUP BY passage),
        hits AS (SELECT r, p FROM windows JOIN firsts USING (passage) WHERE doc_id > first),
        gone AS (SELECT r, list(DISTINCT p + i) AS cut
          FROM hits, LATERAL (SELECT unnest(range(50)) AS i) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(cut), 0)::BIGINT AS n_removed,
          sha256(CASE WHEN cut IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(
            list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(cut, i)),
              lambda i: w[i]), ' ') END) AS kept_sha256
        FROM words LEFT JOIN gone USING (r)""",
)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"))
