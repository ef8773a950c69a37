"""Secrets in many forms, held out from those learnt from; very long texts."""

import random
import string

import pytest

from tallyhouse.llm import secrets

ALNUM = string.ascii_letters + string.digits
NAMES = ["password", "db_password", "API_KEY", "accessToken", "AWS_SECRET_ACCESS_KEY_FOR_PRODUCTION_EU", "client-secret"]


def value(rng: random.Random, n: int) -> str:
    return rng.choice(string.ascii_letters) + "".join(rng.choices(ALNUM, k=n - 2)) + rng.choice(string.digits)


def pem(rng: random.Random) -> str:
    lines = ["".join(rng.choices(ALNUM + "+/", k=64)) for _ in range(5)]
    return "\n".join(["-----BEGIN RSA PRIVATE KEY-----", *lines, "-----END RSA PRIVATE KEY-----"])


def secret(rng: random.Random) -> tuple[str, str]:
    """A text and the secret in it."""
    name, v = rng.choice(NAMES), value(rng, rng.randint(8, 40))
    form = rng.randrange(9)
    if form == 0:
        return f'{name} = "{v}"', v
    if form == 1:
        return f"{name}{' ' * rng.randint(5, 20)}: {v}", v
    if form == 2:
        return f"{name}:\n    {v}\nnext line", v
    if form == 3:
        return f"<{name}>{v}</{name}>", v
    if form == 4:
        v = "ghp_" + "".join(rng.choices(ALNUM, k=36))
        return f"we pushed with {v} last night", v
    if form == 5:
        v = pem(rng)
        return f"here is the file\n{v}\nbye", v
    if form == 6:
        return f"https://bob:{v}@example.org/repo", v
    if form == 7:
        return f"{name} => '{v}',", v
    user = value(rng, 20)
    return f"git clone https://{user}:{v}@example.org/repo", f"{user}:{v}"


def other(rng: random.Random) -> str:
    """A text without a secret, most of them with a candidate."""
    hexes = "".join(rng.choices("0123456789abcdef", k=32))
    return [
        f"see https://example.org/files/{value(rng, 24)}/page",
        f"order 2024-{rng.randint(10**11, 10**12)}-0001 was sent",
        f"id {hexes[:8]}-{hexes[8:12]}-{hexes[12:16]}-{hexes[16:20]}-{hexes[20:]} here",
        "password: required",
        "the internationalization2 standardisation-committee2024 met",
        f"path /usr/lib/python3/{value(rng, 18)}/site",
        "Password: the secretary of the tokenizer: Johanna",
    ][rng.randrange(7)]


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(1)
    rows = [t for t, _ in (secret(rng) for _ in range(300))] + [other(rng) for _ in range(300)]
    return secrets.train(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))


def test_held_out_findings(spark, forest):
    rng = random.Random(2)
    planted = [secret(rng) for _ in range(200)]
    plain = [other(rng) for _ in range(200)]
    rows = [t for t, _ in planted] + plain
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    masked = [r.masked for r in secrets.scan(docs, forest).orderBy("doc_id").collect()]
    lost = [t for (t, v), m in zip(planted, masked) if m != t.replace(v, secrets.MASK)]
    wrong = [t for t, m in zip(plain, masked[len(planted) :]) if m != t]
    assert len(lost) <= 0.05 * len(planted), lost[:5]
    assert len(wrong) <= 0.05 * len(plain), wrong[:5]


def test_every_form_is_one_candidate(spark):
    rng = random.Random(3)
    planted = [secret(rng) for _ in range(100)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(planted)], "doc_id long, text string")
    found = secrets.with_candidates(docs, "doc_id", "text").orderBy("doc_id").collect()
    for row, (text, v) in zip(found, planted):
        assert [c.value for c in row.candidates] == [v], text
        assert "".join(a + b for a, b in zip(row.gaps, [c.value for c in row.candidates] + [""])) == text


def test_very_long_texts(spark, forest):
    """No text makes the search recurse or take the square of its length."""
    n = 5_000_000
    long = [
        "token=" + "a1" * (n // 2),
        "token" * (n // 5),
        "token=" + ",;&" * (n // 3),
        "<token " * (n // 7),
        "-----BEGIN PRIVATE KEY-----" + "\nabc- " * (n // 6),
        "-----BEGIN PRIVATE KEY-----" * (n // 27),
        "://a:" * (n // 5),
        "password:" + " " * n + "x1y2z3",
    ]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string").repartition(8)
    rows = secrets.scan(docs, forest).orderBy("doc_id").collect()
    assert [len(r.findings) > 0 for r in rows][0] and rows[7].masked.endswith(secrets.MASK)
    assert rows[0].masked == "token=" + secrets.MASK


def test_copies_of_one_finding(spark):
    """A finding with most rows is one example; the others are still learnt from."""
    rng = random.Random(4)
    rows = ["password = 'always1same2'"] * 3000 + [secret(rng)[0] for _ in range(60)] + [other(rng) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    forest = secrets.train(docs, settings=secrets.Settings(findings=200))
    found = secrets.scan(docs, forest).filter("doc_id < 3000")
    assert found.filter(f"masked = \"password = '{secrets.MASK}'\"").count() == 3000
