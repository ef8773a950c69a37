"""Disguised identifiers that go on after a plain one, of any length, in texts of any length."""

import re
import time

import pytest

from tallyhouse.llm import pii

GOES_ON = [
    ("write to jane@mail.acme dot com now", "email", "jane@mail.acme dot com", 1),
    ("call +1 487 555 72 zero nine ok", "phone", "+1 487 555 72 zero nine", 1),
    ("to jane dot doe@acme.org, please", "email", "jane dot doe@acme.org", 1),
]
LONG = [
    "a at b dot c dot d dot e dot f dot g dot com",
    "x" * 70 + " at foo dot com",
    "jane     at    mail    dot   com",
    "jane     [at]    mail    (dot)   com",
    "a dot b dot c dot d dot e dot f@acme.org",
    "jane at " + "h" * 63 + " dot com",
]


@pytest.mark.parametrize("text, kind, span, n_plain", GOES_ON)
def test_plain_stays_and_longer_is_added(text, kind, span, n_plain):
    plain, added = pii.find(text)
    assert len(plain[kind]) == n_plain
    assert [text[s:e] for s, e in added[kind]] == [span]


@pytest.mark.parametrize("text", LONG)
def test_any_length(text):
    assert [(s - 3, e - 3) for s, e in pii.find(f"to {text}, ok")[1]["email"]] == [(0, len(text))]


def test_part_of_a_plain_span_is_not_added():
    assert pii.find("bob@acme.org at the dot com")[1]["email"] == []


@pytest.mark.parametrize(
    "part", [" ", "a dot ", "x at y dot ", "@ ", "a at b ", "(", " . ", "one two ", "a@b. ", "at dot ", "1 dot "]
)
def test_linear(part):
    def seconds(n: int) -> float:
        start = time.perf_counter()
        pii.find((part * (n // len(part))) + " a [at] b.org x@y.z")
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(2_000_000) < 30


def test_base_is_the_four_expressions(spark):
    """Plain spans of the given texts are those of the plain expressions."""
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def digits(text):
        return re.sub("[^0-9]", "", text)

    def brute(text):
        found = [f"email:{m.start()}:{m.end()}" for m in email.finditer(text)]
        found += [
            f"ip:{m.start()}:{m.end()}" for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))
        ]
        found += [
            f"card:{m.start()}:{m.end()}"
            for m in card.finditer(text)
            if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))
        ]
        found += [f"phone:{m.start()}:{m.end()}" for m in phone.finditer(text) if 9 <= len(digits(m[0])) <= 15]
        return ",".join(found)

    got = {r.doc_id: r.base_spans for r in pii.find_personal_data(documents).collect()}
    for row in documents.collect():
        assert got[row.doc_id] == brute(row.text or "")
