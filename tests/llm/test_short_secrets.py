"""Secrets that are short, of letters only, or of other signs."""

import pytest

from tallyhouse.llm import secrets

SECRETS = [
    ('password = "Xk!9?vT#2m"', "Xk!9?vT#2m"),
    ("db_password: hunter2x, user: bob", "hunter2x"),
    ("secret = 'correcthorsebattery'", "correcthorsebattery"),
    ('{"api_key": "abcDEFghi"}', "abcDEFghi"),
    ("accessToken=q.w$e%r!z&page=2", "q.w$e%r!z"),
    ("clone https://bob:s3c!t@example.org/repo", "s3c!t"),
    ("token = 0123456789abcdef0123456789abcdef01234567", "0123456789abcdef0123456789abcdef01234567"),
]
OTHERS = ["Author: Shakespeare wrote it", "secretary: Johanna", "see https://example.org:8080/a@b", "no secrets"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate([t for t, _ in SECRETS] + OTHERS))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_all_findings_real(spark, docs):
    """All labelled findings are secrets: so is every finding, and is masked."""
    forest = secrets.train(docs)
    rows = secrets.scan(docs, forest).orderBy("doc_id").collect()
    for row, (text, value) in zip(rows, SECRETS):
        assert [(f.value, f.secret) for f in row.findings] == [(value, True)], text
        assert row.masked == text.replace(value, secrets.MASK)
    for row, text in zip(rows[len(SECRETS) :], OTHERS):
        assert row.findings == [] and row.masked == text
