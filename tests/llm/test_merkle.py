"""Merkle manifests against hashing the whole tree in one place."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, node string"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def hashed(row):
    text = [row[f] for f in merkle.FIELDS]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in text])


def tree(leaves):
    """The root, and for each leaf its siblings as (is left, digest or None)."""
    level, paths, places = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for path, p in zip(paths, places):
            other = p ^ 1
            path.append((other < p, level[other] if other < len(level) else None))
        places = [p // 2 for p in places]
        level = [digest(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def brute(rows):
    rows = [r.asDict() if hasattr(r, "asDict") else dict(r) for r in rows]
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    found, subroots = [], []
    for lang in langs:
        own = [r for r in rows if r["lang"] == lang]
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"], hashed(r)))
        subroot, paths = tree([hashed(r) for r in own])
        subroots.append(subroot)
        found.append((own, subroot, paths))
    root, tops = tree(subroots)
    out = []
    for (own, subroot, paths), top in zip(found, tops):
        for row, path in zip(own, paths):
            changed = dict(row)
            if row["doc_id"] is not None and row["n_chars"] is not None:
                changed["n_chars"] += zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            node = hashed(changed)
            for left, other in path + top:
                node = digest(node) if other is None else digest(other, node) if left else digest(node, other)
            proof = digest(*[other for _, other in path + top if other is not None])
            out.append((row["doc_id"], hashed(row), subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def run(docs, **options):
    return merkle.manifest(
        docs, changed=merkle.tampered(), changes={"n_chars": F.col("n_chars") + 1}, **options
    )


@pytest.mark.parametrize("height", [1, 3, 10])
def test_given_documents(spark, height):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = run(docs.repartition(5), height=height)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs.collect())
    assert got.filter("verified").count() not in (0, got.count())


def test_odd_rows(spark):
    rows = [
        (1, None, None, None, None, "t", "n"),
        (2, "", "", "", 0, None, None),
        (2, "", "", "", 0, None, None),
        (2, "other", "", "", 5, None, None),
        (None, "no id", "de", "s", 5, None, None),
        (None, "no id", "de", "s", 5, None, None),
        (3, "x" * 5_000_000, "de", "s", None, None, None),
        (4, "é漢\U0001f600", "é", "s", 3, None, None),
        (5, "one", "z", "s", 3, None, None),
        (-6, "two", "de", "s", 3, None, None),
    ] + [(n, "same", "en", "s", 4, None, None) for n in range(7, 40) for _ in range(n % 3 + 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for height in (2, 10):
        got = run(docs.repartition(4), height=height)
        assert sorted(map(tuple, got.collect()), key=repr) == brute(docs.collect())


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(5, "a", "en", "s", 1, None, None)], SCHEMA)
    assert [tuple(r) for r in run(one).collect()] == brute(one.collect())
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_versions_share_nodes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = run(docs, height=3, proofs=True).collect()
    for row in rows:
        if row["version"] is None:
            assert row["folded_root"] == row["root"]
        else:
            assert len(row["version"]) == len(row["proof"]) + 1
            assert row["version"][-1] == row["folded_root"] != row["root"]
            assert row["version"][0] != row["leaf"]
