"""Operators on texts against brute force, on small tables with odd rows."""

import base64
import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import bpe, fingerprint, langid, licenses, mixing, neardup, pii, quality, secrets, warc

SCHEMA = "doc_id long, text string, ids string, sketch int, score int"
ODD = [
    (1, None, "x", 1, 1),
    (2, "", "x", 1, 1),
    (3, " \n\t ", None, None, None),
    (4, "one two", "x", 1, 1),
    (4, "one two", "x", 1, 1),
    (None, "no id here at all, really", "x", 1, 1),
    (5, "éè ß 漢字 \U0001f600 " * 40, "x", 1, 1),
    (6, "word " * 3000, "x", 1, 1),
    (7, "a" * 5000, "x", 1, 1),
    (8, "\n\n  \n" * 500 + "end", "x", 1, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_bpe_by_chunks(spark, odd, none, documents):
    vocabulary = bpe.Vocabulary.public()
    codec = bpe.Codec(vocabulary)
    docs = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = sorted(
        ((r.doc_id, codec.encode(r.text or "").tolist()) for r in docs.collect()), key=repr
    )
    encoded = bpe.encode(docs, vocabulary, chunk=256, overlap=64)
    got = sorted(((r.doc_id, list(r.ids)) for r in encoded.collect()), key=repr)
    assert got == want
    back = bpe.decode(encoded, vocabulary).select("doc_id", F.col("decoded").cast("string")).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(
        ((r.doc_id, r.text or "") for r in docs.collect()), key=repr
    )
    assert bpe.round_trip(none, vocabulary).count() == 0


def plain_shingles(text):
    words = [w for w in re.split(r"[\x09-\x0D\x20]+", text) if w]
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def resemblance(a, b):
    a, b = plain_shingles(a), plain_shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, documents, odd, none):
    rows = sorted(documents.collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(documents).collect()}
    for row, after in zip(rows, rows[1:] + rows[:1]):
        third = len(row.text) // 3
        edited = row.text[: len(row.text) - third] + after.text[:third]
        found = got[row.doc_id]
        assert found.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert found.n_chars == len(row.text)
        assert abs(found.near_edited - resemblance(row.text, edited)) < 0.12
        assert abs(found.near_next - resemblance(row.text, after.text)) < 0.12
    assert fingerprint.edited_fingerprints(odd).count() == len(ODD)
    assert fingerprint.edited_fingerprints(none).count() == 0


def test_ranges_of_clustered_ids(spark):
    ids = [*range(0, 40), *range(10**12, 10**12 + 40)]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    rows, order = fingerprint.with_next(docs, rows_per_range=8)
    got = rows.withColumn("n", F.lead("text").over(order)).filter("NOT guest").collect()
    down = sorted(ids, reverse=True)
    assert {r.doc_id: r.n for r in got} == {a: f"t{b}" for a, b in zip(down, down[1:] + down[:1])}


def test_sketches_merge(spark):
    text = " ".join(f"w{i}" for i in range(900))
    whole = spark.createDataFrame([("k", text)], "k string, text string")
    halves = [" ".join(f"w{i}" for i in r) for r in (range(0, 500), range(496, 900))]
    parts = spark.createDataFrame([("k", h) for h in halves] + [(None, "")], "k string, text string")
    one = fingerprint.with_sketch(whole, "text", "sketch", 64).first().sketch
    merged = fingerprint.merge_parts(fingerprint.with_sketch(parts, "text", "sketch", 64), ["k"], "sketch", 64)
    got = {r.k: r.sketch for r in merged.collect()}
    assert got["k"] == one and got[None] == []
    n = whole.select(fingerprint.distinct_shingles(F.array(*[F.lit(x) for x in one]), 64)).first()[0]
    assert 0.6 < n / 896 < 1.6


def test_language_id(spark, documents, odd, none):
    model = langid.train(documents, ~langid.held_out())
    known = {r.doc_id: r.lang for r in documents.collect()}
    rows = langid.predict(documents, model).join(
        documents.select("doc_id", langid.held_out().alias("out")), "doc_id"
    )
    out = [r for r in rows.collect() if r.out]
    assert sum(known[r.doc_id] == r.lang_pred for r in out) >= 0.9 * len(out)
    assert all(0 <= r.score <= 1 for r in out)
    strange = {r.doc_id: r.lang_pred for r in langid.predict(odd, model).collect()}
    assert strange[1] == strange[2] == strange[3] == "und"
    empty = langid.train(none.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}
    assert langid.accepted(odd, model).columns == odd.columns


def brute_repeats(text, n=8):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    inside = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + n)}
    return len(words), len(inside)


def test_repetition(spark, documents, odd, none):
    got = {r.doc_id: r for r in quality.repetition_quality(documents).collect()}
    for row in documents.limit(60).collect():
        found = got[row.doc_id]
        assert (found.n_words, found.n_repeat_words) == brute_repeats(row.text)
        lines = row.text.split("\n")
        again = [x for i, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r") and x in lines[:i]]
        assert found.n_dup_lines == len(again)
        assert found.n_symbols == len(re.findall(r"[#*$%&|<>]", row.text))
    strange = quality.repetition_quality(odd).collect()
    assert len(strange) == len(ODD) and not any(r.kept for r in strange if r.doc_id in (1, 2, 3, 6))
    assert quality.repetition_quality(none).count() == 0


PLAIN = [
    ("a b@c.d, x", "email:2:7"),
    ("1.2.3.4 999.1.1.1", "ip:0:7"),
    ("4539 1488 0343 6467", "card:0:19"),
    ("+1 (487) 555-7209", "phone:0:17"),
    ("@x.y a@b a@@b.c", ""),
    ("7" * 3000, ""),
]
DISGUISED = [
    ("john dot smith [at] example [dot] com", "email"),
    ("jane AT mail DOT example DOT org", "email"),
    ("jоhn@еxample.com", "email"),
    ("192 dot 168 dot 10 dot 7", "ip"),
    ("10․0․0․1", "ip"),
    ("４５３９ 1488 0343 6467", "card"),
    ("plus one four eight seven five five five seven two zero nine", "phone"),
]


def test_personal_data(spark, odd, none):
    docs = spark.createDataFrame(
        [(i, t) for i, (t, _) in enumerate(PLAIN + DISGUISED)], "doc_id long, text string"
    )
    rows = pii.find_personal_data(docs).orderBy("doc_id").collect()
    for row, (_, spans) in zip(rows, PLAIN):
        assert row.spans == row.base_spans == spans
    for row, (text, kind) in zip(rows[len(PLAIN) :], DISGUISED):
        assert row.base_spans == "" and row.spans == f"{kind}:0:{len(text)}"
    for text in ("we met at home and at the dot of noon", "a@ b he was at home. In the"):
        assert pii.find(text)[1] == {k: [] for k in pii.KINDS}
    assert pii.find_personal_data(odd).count() == len(ODD)
    assert pii.find_personal_data(none).count() == 0


def test_secrets(spark, documents, odd, none):
    forest = secrets.train(documents)
    got = {r.doc_id: r for r in secrets.scan(documents, forest).collect()}
    for row in documents.collect():
        found = got[row.doc_id]
        hits = [f for f in found.findings if f.secret]
        for f in found.findings:
            assert row.text[f.start : f.end] == f.value
        planted = re.findall(r'(?i)token = "([0-9a-f]{40})"', row.text)
        assert [f.value for f in hits] == planted
        masked = row.text
        for f in reversed(hits):
            masked = masked[: f.start] + secrets.MASK + masked[f.end :]
        assert found.masked == masked
    assert secrets.scan(odd, secrets.train(odd)).count() == len(ODD)
    assert secrets.masked_rows(odd, forest).columns == odd.columns
    assert secrets.scan(none, secrets.train(none)).count() == 0


def test_licenses(spark, documents, odd, none):
    model = licenses.train(documents)
    got = {r.doc_id: r for r in licenses.scan(documents, model).collect()}
    notices = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Released under the MIT License.": "MIT",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    }
    for row in documents.collect():
        for notice, family in notices.items():
            if notice in row.text.split("\n"):
                assert family in got[row.doc_id].families.split(",")
        if not re.search("licen|rights reserved", row.text, re.I):
            assert got[row.doc_id].n_license == 0
    assert licenses.scan(odd, model).count() == len(ODD)
    assert licenses.scan(none, licenses.train(none)).count() == 0


def test_mixing(spark, documents, odd, none):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    domain = mixing.label_domain(F.col("quality"), F.col("toxic"))
    mix = mixing.mix(documents, labels, domain, mixing.TARGETS)
    rows = mix.rows.collect()
    total = sum(r.n_tokens for r in rows)
    assert all(r.rate >= 0 and abs(sum(r.p) - 1) < 1e-6 for r in rows)
    for i, name in enumerate(mixing.DOMAINS):
        share = sum(r.rate * r.n_tokens * r.p[i] for r in rows) / total
        assert abs(share - mixing.TARGETS[name]) < 1e-4
    strange = mixing.mix(odd, labels.limit(0), domain, mixing.TARGETS, carry=True)
    assert strange.rows.count() == len(ODD)
    assert mixing.mixed_rows(strange).columns == odd.columns
    assert mixing.mix(none, labels, domain, mixing.TARGETS).rows.count() == 0


def test_mixing_looks_at_capitals_digits_and_tables(spark):
    texts = ["plain words here", "PLAIN WORDS HERE", "plain 12345 here", "plain | words | here", "plain # words"]
    docs = mixing.with_words(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = mixing.with_features(docs, [["plain"]]).orderBy("doc_id").collect()
    assert [(r.upper > 0, r.digits > 0, r.bars > 0, r.marks > 0) for r in rows] == [
        (False,) * 4, (True, False, False, False), (False, True, False, False),
        (False, False, True, False), (False, False, False, True),
    ]
    assert rows[1].upper == 14 / 16 and rows[2].digits == 5 / 16


def test_mixing_tells_what_is_missed(spark):
    rows = [(i, 100, [0.5, 0.3, 0.2] if i % 2 else [0.9, 0.1, 0.0]) for i in range(40)]
    chances = spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>")
    for steps in (2, 40):
        mix = mixing.fit_rates(chances, mixing.TARGETS, settings=mixing.Settings(steps=steps))
        got = mix.rows.collect()
        for i, name in enumerate(mixing.DOMAINS):
            share = sum(r.rate * r.n_tokens * r.p[i] for r in got) / 4000
            assert abs(share - mixing.TARGETS[name] - mix.residuals[name]) < 1e-9
    assert mixing.Settings().tolerance <= 1e-4


def test_dart_signatures():
    """Shared values follow the weighted similarity, and need no other text."""
    rng = np.random.default_rng(5)
    for _ in range(4):
        keys = rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = rng.integers(1, 4, 300).astype(float), rng.integers(1, 4, 300).astype(float)
        left, right = keys[:300], keys[60:360]
        x, y = dict(zip(left, a)), dict(zip(right, b))
        lower = sum(min(x.get(k, 0), y.get(k, 0)) for k in {*x, *y})
        upper = sum(max(x.get(k, 0), y.get(k, 0)) for k in {*x, *y})
        same = neardup.signature(left, a, 512) == neardup.signature(right, b, 512)
        assert abs(same.mean() - lower / upper) < 0.09


def test_near_duplicates(spark, documents, odd, none):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 500, 150)]
    texts = [" ".join(base)] * 3
    for _ in range(60):
        copy = list(base)
        copy[rng.integers(0, 150)] = f"new{rng.integers(0, 10**6)}"
        texts.append(" ".join(copy))
    rows = [(10**6 + i, t) for i, t in enumerate(texts)]
    docs = documents.select("doc_id", "text").unionByName(
        spark.createDataFrame(rows, "doc_id long, text string")
    )
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    sets = {r.doc_id: plain_shingles(r.text) for r in docs.collect()}
    top = {d: d for d in sets}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= 0.8 * len(x | y):
            low, high = sorted((root(a), root(b)))
            top[high] = low
    assert {d: r.class_id for d, r in got.items()} == {d: root(d) for d in sets}
    strange = neardup.near_duplicates(odd).collect()
    assert {r.doc_id: r.class_id for r in strange} == {
        1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, None: None,
    }
    stay = neardup.without_near_duplicates(odd)
    assert stay.columns == odd.columns and stay.count() == 8
    assert neardup.near_duplicates(none).count() == 0


def test_near_pair_among_unlike_texts_of_one_bucket(spark):
    """Forty texts that share two thirds, of which two are near."""
    rng = np.random.default_rng(11)
    passage = [f"p{i}" for i in rng.integers(0, 10**6, 300)]
    texts = [" ".join(passage + [f"t{i}x{j}" for j in range(70)]) for i in range(40)]
    texts[31] = texts[17].rsplit(" ", 30)[0] + " " + " ".join(f"u{j}" for j in range(30))
    sets = [plain_shingles(t) for t in texts]
    near = [
        (i, j)
        for i, j in itertools.combinations(range(40), 2)
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    ]
    assert near == [(17, 31)]
    # a single band of one value: most of the unlike texts are in one bucket
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = neardup.near_duplicates(docs, settings=neardup.Settings(bands=1, rows=1)).collect()
    assert {r.doc_id: r.class_id for r in found} == {i: 17 if i == 31 else i for i in range(40)}


def test_near_by_distinct_shingles_alone(spark):
    """Copies that differ in how often a passage repeats share no weighted band."""
    rows, want = [], {}
    for i in range(0, 20, 2):
        words = [f"g{i}w{j}" for j in range(200)]
        rows += [(i, " ".join(words)), (i + 1, " ".join(words + words[70:130] * 6))]
        want |= {i: i, i + 1: i}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()} == want


PAGES = [(1, "u", "<p>"), (2, "u", "<p>"), (3, None, None), (4, "v", ""), (9, "u", "<p>"), (9, "u", "<p>"),
         (None, "w", "<p>"), (5, "x\r\ny", "é" * 9000)]


def test_warc(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = sorted((tuple(r) for r in warc.archive_round_trip(pages).select(
        "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to").collect()), key=repr)
    want = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        later = page is not None and page < max(same)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((page, "revisit" if later else "response", len(data), digest, max(same) if later else None))
    assert got == sorted(want, key=repr)
    large = warc.archive_round_trip(pages, min_bytes=4)
    assert {r.record_type for r in large.collect()} == {"response"}
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_warc_reader_refuses_damage():
    whole = warc.member("response", "1", "u", b"payload", None)
    assert next(warc.read_records(whole + whole)).http[1] == b"payload"
    with pytest.raises(warc.WarcError):
        list(warc.read_records(whole[:-9]))
    import zlib

    data = zlib.decompress(whole, 31).replace(b"payload\r\n", b"paYload\r\n")
    with pytest.raises(warc.WarcError):
        warc.parse(data)


def test_pipeline(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == docs.columns, name
        assert 0 < after.count()
        before = corpus_pipeline.written(after, name)
    assert "token = \"" not in " ".join(r.text for r in before.collect()) or secrets.MASK in " ".join(
        r.text for r in before.collect()
    )
    tokens = corpus_pipeline.token_stage(spark, before, sf_dir)
    assert tokens.count() == before.count()
    want = {hashlib.sha256(r.text.encode()).hexdigest() for r in before.collect()}
    assert {r.decoded_sha256 for r in tokens.collect()} == want
