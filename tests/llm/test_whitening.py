"""Whitened embeddings against dense linear algebra on the whole table."""

import numpy as np
import pytest

from tallyhouse.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, v string"


def brute(rows, components=8):
    """n, exact deviations, covariance eigenpairs of rows of equal length."""
    x = np.floor(1024 * np.array(rows, dtype=np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum(int(v) ** 2 for v in row) for row in (n * x - sums).tolist()]
    y = (n * x - sums) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return n, deviation, y, values[::-1][:components], vectors[:, ::-1][:, :components]


def test_given_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = sorted(table.select("vec_id", "embedding").collect())
    n, deviation, y, values, vectors = brute([r[1] for r in rows])
    whitened = y @ vectors / np.sqrt(values)
    got = whitening.whitened_embeddings(table.repartition(5)).orderBy("vec_id", "component").collect()
    assert len(got) == 8 * n
    found = np.array([r["whitened"] for r in got]).reshape(n, 8)
    sign = np.sign((found * whitened).sum(axis=0))
    assert np.abs(found - sign * whitened).max() < 1e-8
    assert [r["deviation"] for r in got[::8]] == deviation
    total = np.trace(y.T @ y / n)
    assert np.allclose([r["explained"] for r in got[:8]], values / total, rtol=1e-9)
    assert {r["n"] for r in got} == {n} and {r["identity_error"] for r in got} == {got[0]["identity_error"]}
    assert got[0]["identity_error"] < 1e-9
    assert [r["component"] for r in got[:8]] == list(range(1, 9))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (1, [0.5, 1.0, 0.0]),
        (1, [0.5, 1.0, 0.0]),
        (2, None),
        (3, []),
        (4, [0.5, None, 1.0]),
        (5, [nan, 0.0, 1.0]),
        (6, [inf, 0.0, 1.0]),
        (7, [1.0, 2.0]),
        (8, [-0.25, 3.0, -7.0]),
        (None, [2.0, 2.0, 2.0]),
        (9, [1e30, 0.0, 0.0]),
    ]
    table = spark.createDataFrame([(*v, "x", None) for v in vectors], SCHEMA).repartition(4)
    got = whitening.whitened_embeddings(table).orderBy("vec_id", "component").collect()
    good = [v for i, v in vectors if i in (1, 8, None) and v and len(v) == 3]
    n, deviation, y, values, vectors = brute(good, 3)
    assert [r["vec_id"] for r in got[::3]] == [None, 1, 1, 8]
    assert sorted(r["deviation"] for r in got[::3]) == sorted(deviation)
    assert np.allclose([r["explained"] for r in got[:3]], values / values.sum(), rtol=1e-9)
    assert got[0]["identity_error"] < 1e-9


def test_no_variance_and_large_numbers(spark):
    schema = "vec_id string, embedding array<double>"
    one = whitening.whitened_embeddings(spark.createDataFrame([("a", [1.0, 2.0])], schema)).collect()
    assert [(r["whitened"], r["explained"], r["deviation"]) for r in one] == [(None, None, 0)] * 2
    big = spark.createDataFrame([("a", [1e14, 0.0]), ("b", [0.0, 1.0]), ("c", [0.0, 0.5])], schema)
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened_embeddings(big).collect()}
    assert got == {"a": None, "b": None, "c": None}
    line = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 1.0])], schema)
    got = whitening.whitened_embeddings(line).orderBy("vec_id", "component").collect()
    assert abs(abs(got[0]["whitened"]) - 1) < 1e-9 and got[1]["whitened"] is None
    empty = whitening.whitened_embeddings(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and "identity_error" in empty.columns


@pytest.mark.parametrize("size", [1, 2, 3, 9, 70])
def test_eigenpairs(size):
    random = np.random.default_rng(size)
    rows = random.standard_normal((2 * size + 3, size))
    matrices = [np.eye(size), np.zeros((size, size)), np.ones((size, size)), rows.T @ rows]
    repeated = np.linalg.qr(random.standard_normal((size, size)))[0]
    matrices.append(repeated @ np.diag(np.arange(size) // 3 + 1.0) @ repeated.T)
    for matrix in matrices:
        values, vectors = whitening.leading_eigenpairs(matrix, 8)
        scale = np.abs(matrix).max() + 1
        assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:8], atol=1e-12 * scale * size)
        assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * scale * size
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12 * size
