"""Removal of repeated passages against a set of all windows."""

import random
import re
from hashlib import sha256

import pytest

from tallyhouse.llm import substrings

SCHEMA = "doc_id long, text string, digest string, anchor int, shard int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=50):
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    firsts = {}
    for i, words in docs:
        if i is not None:
            for p in range(len(words) - window + 1):
                key = tuple(words[p : p + window])
                firsts[key] = min(i, firsts.get(key, i))
    out = []
    for i, words in docs:
        gone = set()
        for p in range(len(words) - window + 1):
            if i is not None and firsts[tuple(words[p : p + window])] < i:
                gone |= set(range(p, p + window))
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((i, len(words), len(gone), sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(docs, settings=substrings.Settings()):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, substrings.without_repeats(docs, settings=settings).collect()), key=repr)
    assert got == brute(rows, settings.window)
    return got


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    got = check(docs)
    assert sum(r[2] for r in got) > 1000
    small = substrings.Settings(window=12, gram=4, shard_words=300, block_pieces=10)
    check(docs, small)


def test_odd_rows(spark):
    shared = " ".join(f"s{i}" for i in range(70))
    exact = " ".join(f"e{i}" for i in range(50))
    rows = [
        (1, None),
        (2, ""),
        (3, " \n\t\r\x0b\x0c "),
        (4, exact + " tail"),
        (5, "head " + exact),
        (6, exact[:-1]),
        (7, f"a {shared} b"),
        (7, f"c {shared} d"),
        (8, f"{shared} glued {shared}"),
        (9, f"{shared}\n\n{shared}\x85 x"),
        (None, shared),
        (None, shared),
        (-1, f"only here {shared[:-20]}"),
        (10, f"{shared} {exact} {shared}"),
        (10, f"{shared} {exact} {shared}"),
        (11, "one " * 300),
        (12, "one " * 60),
        (13, " ".join(f"q{i}" for i in range(400)) + " " + " ".join(f"q{i}" for i in range(400))),
        (14, "é漢 \U0001f600 " * 60),
        (15, "x é漢 \U0001f600 " * 60),
        (16, "x" * 2_000_000),
    ]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(4)
    check(docs)
    spans = {
        r["doc_id"]: r["spans"]
        for r in substrings.without_repeats(docs.filter("doc_id in (4, 5)"), texts=True).collect()
    }
    assert spans == {4: [], 5: [[1, 51]]}
    assert substrings.without_repeats(docs.limit(0)).count() == 0


def test_text_ids_and_very_long_text(spark):
    random.seed(3)
    same = "same " * 400_000
    got = substrings.without_repeats(spark.createDataFrame([(1, same), (2, same[5:])], "doc_id int, text string"))
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == {1: 0, 2: 399_999}
    long = " ".join(random.choice("abcdefgh") * 2 for _ in range(300_000))
    docs = spark.createDataFrame([("b", long), ("a", long[300_000:600_000]), ("c", "new words")], "doc_id string, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substrings.without_repeats(docs).collect()}
    assert got == {"a": 0, "b": 100_000, "c": 0}


def test_a_passage_with_many_surroundings(spark):
    random.seed(5)
    passage = " ".join(f"common{i}" for i in range(65))
    rows = []
    for i in range(300):
        words = [f"w{random.randrange(10_000)}" for _ in range(120)]
        at = random.randrange(120)
        rows.append((i, " ".join([*words[:at], passage, *words[at:]])))
    rows += [(300 + i, rows[i % 3][1]) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = check(docs, substrings.Settings(shard_words=200, block_pieces=20))
    assert sum(r[2] >= 65 for r in got) == 399


@pytest.mark.parametrize("seed", range(4))
def test_automata(seed):
    random.seed(seed)
    documents = [[random.randrange(3) for _ in range(random.randrange(60))] for _ in range(8)]
    automaton = substrings.Automaton()
    for i, words in enumerate(documents):
        automaton.add([b"%d" % w for w in words], 10 - i)
    text = [random.randrange(4) for _ in range(500)]
    for window in (1, 3, 6):
        matcher = substrings.Matcher(automaton, window)
        want = []
        for p in range(len(text) - window + 1):
            part = text[p : p + window]
            ids = [
                10 - i
                for i, d in enumerate(documents)
                if any(d[q : q + window] == part for q in range(len(d) - window + 1))
            ]
            want.append(min(ids, default=None))
        assert matcher.smallest([b"%d" % w for w in text]) == want
