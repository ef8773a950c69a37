"""Ids that are texts of any kind: fingerprints' next documents, names of WARC records."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import fingerprint, warc

IDS = ["a", "a\r\nb", "a\r\n\r\nb", "", " x ", "<y>", "ü/ß:%41", "7"]


def test_record_names(spark):
    rows = [(i, f"https://x.org/{n}", f"page {n}", "clash") for n, i in enumerate(IDS)] + [
        (None, "u", "no id", "c"), ("\u00e9", "u", "page 0", "c")
    ]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string, refers string")
    got = {(r.page_id, r.payload_digest): r for r in warc.archive_round_trip(pages).collect()}
    assert set(got) == {(r[0], warc.digest(r[2].encode())) for r in rows}
    # "page 0" is held twice: by "a", and by a larger id
    assert [r.refers_to for r in got.values() if r.record_type == "revisit"] == ["\u00e9"]


def brute(rows):
    """Digest of each text's edit, by the next document in descending order."""
    ordered = sorted(rows, key=lambda r: r[0].encode(), reverse=True)
    edited = {}
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        third = len(text) // 3
        edited[i] = hashlib.sha256((text[: len(text) - third] + after[:third]).encode()).hexdigest()
    return edited


@pytest.mark.parametrize("name", [str, lambda i: f"b{i % 7}-{i}", lambda i: "ö" * (i % 5) + str(i)])
def test_next_document(spark, name):
    rows = [(name(i), f"{i} " * (1 + i % 9)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(7)
    got = {r.doc_id: r.edited_sha256 for r in fingerprint.edited_fingerprints(docs).collect()}
    assert got == brute(rows)


def test_next_document_of_dates_and_nothing(spark):
    days = spark.range(1500).select(
        F.expr("date_add(DATE'2020-01-01', CAST(id AS INT))").alias("doc_id"), F.col("id").cast("string").alias("text")
    )
    assert fingerprint.edited_fingerprints(days).select("doc_id").distinct().count() == 1500
    assert fingerprint.edited_fingerprints(days.limit(0)).count() == 0
