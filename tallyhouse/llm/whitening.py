"""Whitening of embeddings: their leading principal components at unit variance.

``fit`` takes two passes over the vectors: exact sums, then the covariance of
centred entries, added up task by task and cell by cell. The covariance, whose
size depends on the dimension alone, is solved on the driver: Householder
reflections make it tridiagonal, bisection with Sturm counts finds the leading
eigenvalues, inverse iteration their vectors, which are made orthogonal within
clusters of close eigenvalues. ``whiten`` hands the components to all tasks and
projects; ``identity_error`` measures the whitened covariance in a pass of its own.

Entries are whole numbers, floor(scale * c) + offset. What belongs to the fit:

- A vector that is null or empty, or holds a null, a non-finite entry or one whose
  whole number does not fit in a long, is left out, also from the result.
- Vectors need one dimension: that of most vectors (of the larger, if two tie).
  Vectors of other lengths are left out too.
- Repeated rows count as often as they occur; ids are only passed on, null or not.
- Equal eigenvalues have no order of their own: any orthonormal vectors serve.
- Components without variance (eigenvalue 0 up to rounding) have a null
  ``whitened``; without any variance ``explained`` is null as well.
- ``deviation`` is null where it does not fit in a long.
- An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.common import column

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
LONG = 2**63 - 1


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` learns; its size depends on the dimension alone."""

    n: int
    sums: tuple[int, ...]
    trace: float
    eigenvalues: np.ndarray
    components: np.ndarray  # one per column
    scale: int = SCALE
    offset: int = OFFSET

    @property
    def dimension(self) -> int:
        return len(self.sums)

    @property
    def varying(self) -> np.ndarray:
        """Components with a variance above rounding errors."""
        return self.eigenvalues > self.trace * self.dimension * np.finfo(float).eps


def whole_numbers(vectors: pa.Array, scale: int, offset: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per length, the places of the usable vectors in the batch and their entries."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    found = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        values = np.floor(scale * entries[starts[rows, None] + np.arange(size)])
        with np.errstate(invalid="ignore"):
            usable = (np.abs(values) < 2.0**62).all(axis=1)  # not so for NaN
        if usable.any():
            found[size] = rows[usable], values[usable].astype(np.int64) + offset
    return found


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S without rounding, in unlimited integers where a long may not hold it."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) > LONG:
        return x.astype(object) * n - np.array(sums, dtype=object)
    return x * n - np.array(sums, dtype=np.int64)


def _sums(scale: int, offset: int):
    def add(batches):
        totals: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for size, (_, x) in whole_numbers(batch.column(0), scale, offset).items():
                n, sums = totals.get(size, (0, [0] * size))
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                new = [s + (int(h) << 32) + int(w) for s, h, w in zip(sums, high, low)]
                totals[size] = n + len(x), new
        for size, (n, sums) in totals.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([size] * size, pa.int32()),
                    pa.array(range(size), pa.int32()),
                    pa.array([n] * size, pa.int64()),
                    pa.array([str(s) for s in sums]),
                ],
                names=["size", "place", "n", "total"],
            )

    return add


def _products(shared):
    """Per task, the upper triangle of the products of centred entries."""

    def add(batches):
        n, sums, scale, offset = shared.value
        total = np.zeros((len(sums), len(sums)))
        for batch in batches:
            for size, (_, x) in whole_numbers(batch.column(0), scale, offset).items():
                if size == len(sums):
                    y = (centred(x, n, sums) / n).astype(np.float64)
                    total += y.T @ y
        i, j = np.triu_indices(len(sums))
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])],
            names=["i", "j", "product"],
        )

    return add


def _matrix(products: DataFrame, size: int, n: int) -> np.ndarray:
    matrix = np.zeros((size, size))
    for i, j, value in products.groupBy("i", "j").agg(F.sum("product")).collect():
        matrix[i, j] = matrix[j, i] = value / n
    return matrix


def fit(
    vectors: DataFrame,
    vector_col: str = "embedding",
    components: int = COMPONENTS,
    scale: int = SCALE,
    offset: int = OFFSET,
) -> Whitening | None:
    """Sums, covariance and its leading components; None if no vector is usable."""
    context = vectors.sparkSession.sparkContext
    entries = vectors.select(column(vector_col).cast("array<double>").alias("v"))
    partial = entries.mapInArrow(_sums(scale, offset), "size int, place int, n long, total string")
    totals = partial.groupBy("size", "place").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    )
    by_size = totals.groupBy("size").agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "total"))).alias("totals")
    )
    best = by_size.orderBy(F.desc("n"), F.desc("size")).first()
    if best is None:
        return None
    n, sums = best["n"], tuple(int(t["total"]) for t in best["totals"])
    shared = context.broadcast((n, sums, scale, offset))
    products = entries.mapInArrow(_products(shared), "i int, j int, product double")
    covariance = _matrix(products, len(sums), n)
    values, leading = leading_eigenpairs(covariance, components)
    return Whitening(n, sums, float(np.trace(covariance)), values, leading, scale, offset)


def _projected(y: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened rows of n * x - S; NaN for components without variance."""
    out = (y / model.n).astype(np.float64) @ model.components
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(model.varying, out / np.sqrt(model.eigenvalues), np.nan)


def identity_error(vectors: DataFrame, model: Whitening, vector_col: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity.

    Rows are centred before they are projected, so the whitened ones are too.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    kept = np.flatnonzero(model.varying)
    if len(kept) == 0:
        return 0.0

    def add(batches):
        model = shared.value
        kept = np.flatnonzero(model.varying)
        total = np.zeros((len(kept), len(kept)))
        for batch in batches:
            for size, (_, x) in whole_numbers(batch.column(0), model.scale, model.offset).items():
                if size == model.dimension:
                    w = _projected(centred(x, model.n, model.sums), model)[:, kept]
                    total += w.T @ w
        i, j = np.triu_indices(len(kept))
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])],
            names=["i", "j", "product"],
        )

    entries = vectors.select(column(vector_col).cast("array<double>").alias("v"))
    products = entries.mapInArrow(add, "i int, j int, product double")
    return float(np.abs(_matrix(products, len(kept), model.n) - np.eye(len(kept))).max())


def _deviations(y: np.ndarray) -> pa.Array:
    if int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] <= LONG:
        return pa.array((y * y).sum(axis=1).astype(np.int64))
    exact = [sum(int(v) ** 2 for v in row) for row in y]
    return pa.array([v if v <= LONG else None for v in exact], pa.int64())


def whiten(
    vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """A row for each usable vector and component: id, ``component`` (from 1),
    ``n``, ``deviation``, ``whitened``, ``explained``."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def project(batches):
        model = shared.value
        n_components = len(model.eigenvalues)
        share = model.eigenvalues / model.trace if model.trace > 0 else np.full(n_components, np.nan)
        for batch in batches:
            found = whole_numbers(batch.column(1), model.scale, model.offset).get(model.dimension)
            if found is None:
                continue
            rows, x = found
            y = centred(x, model.n, model.sums)
            repeated = pa.array(np.repeat(np.arange(len(rows)), n_components))
            number = np.tile(np.arange(1, n_components + 1, dtype=np.int32), len(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)).take(repeated),
                    pa.array(number),
                    pa.array(np.full(len(number), model.n)),
                    _deviations(y).take(repeated),
                    pa.array(_projected(y, model).ravel(), from_pandas=True),
                    pa.array(np.tile(share, len(rows)), from_pandas=True),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained"],
            )

    rows = vectors.select(column(id_col).alias("id"), column(vector_col).cast("array<double>").alias("v"))
    schema = result_type(rows.schema["id"].dataType)
    return rows.mapInArrow(project, schema).withColumnRenamed("id", id_col)


def result_type(id_type: T.DataType) -> T.StructType:
    return (
        T.StructType()
        .add("id", id_type)
        .add("component", "integer")
        .add("n", "long")
        .add("deviation", "long")
        .add("whitened", "double")
        .add("explained", "double")
    )


def whitened_embeddings(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """All usable vectors whitened by their own covariance, with its ``identity_error``."""
    model = fit(vectors, vector_col, components)
    if model is None:
        kind = result_type(vectors.select(column(id_col)).schema[0].dataType)
        nothing = vectors.sparkSession.createDataFrame([], kind.add("identity_error", "double"))
        return nothing.withColumnRenamed("id", id_col)
    error = identity_error(vectors, model, vector_col)
    return whiten(vectors, model, id_col, vector_col).withColumn("identity_error", F.lit(error))


# Leading eigenvectors of a symmetric matrix


def leading_eigenpairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as columns. Of the
    two signs a vector has that which makes its largest entry positive."""
    count = min(count, len(matrix))
    scale = float(np.abs(matrix).max(initial=0.0)) or 1.0
    diagonal, beside, reflectors = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diagonal, beside, count)
    vectors = inverse_iteration(diagonal, beside, values)
    for k in reversed(range(len(reflectors))):
        v = reflectors[k]
        vectors[k + 1 :] -= 2.0 * np.outer(v, v @ vectors[k + 1 :])
    vectors /= np.linalg.norm(vectors, axis=0)
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(count)])
    return values * scale, vectors


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of Q' A Q, Q a product of Householder reflections."""
    a = np.array(matrix, dtype=np.float64)
    reflectors = []
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        v /= np.abs(v).max() or 1.0  # squares of tiny entries would vanish
        length = np.linalg.norm(v)
        v[0] += length if v[0] >= 0 else -length
        size = np.linalg.norm(v)
        v = v / size if size > 0 else v
        # (I - 2vv') A (I - 2vv') is A less a product of rank two
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2.0 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        column_k = a[k + 1 :, k] - 2.0 * v * (v @ a[k + 1 :, k])
        a[k + 1 :, k] = a[k, k + 1 :] = column_k
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def below(diagonal: np.ndarray, beside: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues are less than each point."""
    tiny = np.finfo(float).tiny
    counts = np.zeros(len(points), dtype=np.int64)
    pivot = np.ones(len(points))
    squares = np.append(0.0, beside**2)
    for d, b in zip(diagonal, squares):
        pivot = d - points - b / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        counts += pivot < 0
    return counts


def leading_eigenvalues(diagonal: np.ndarray, beside: np.ndarray, count: int) -> np.ndarray:
    """The largest eigenvalues, by bisection until an interval cannot be halved."""
    size = len(diagonal)
    reach = np.append(np.abs(beside), 0.0) + np.append(0.0, np.abs(beside))
    least, most = (diagonal - reach).min(), (diagonal + reach).max()
    margin = (abs(least) + abs(most)) * 1e-12 + np.finfo(float).tiny
    low, high = np.full(count, least - margin), np.full(count, most + margin)
    wanted = size - 1 - np.arange(count)  # how many eigenvalues are smaller
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        left = below(diagonal, beside, middle) > wanted
        high = np.where(left, middle, high)
        low = np.where(left, low, middle)


def solve_tridiagonal(diagonal: np.ndarray, beside: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Solution by elimination with row exchanges; pivots below ``least`` are raised to it."""
    n = len(diagonal)
    first, second, third = diagonal.copy(), np.append(beside, 0.0), np.zeros(n)
    x = right.copy()
    for i in range(n - 1):
        low_first, low_second = beside[i], first[i + 1]
        low_third = second[i + 1]
        if abs(low_first) > abs(first[i]):
            first[i], low_first = low_first, first[i]
            second[i], low_second = low_second, second[i]
            third[i], low_third = low_third, third[i]
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(first[i]) < least:
            first[i] = least
        factor = low_first / first[i]
        first[i + 1] = low_second - factor * second[i]
        second[i + 1] = low_third - factor * third[i]
        x[i + 1] -= factor * x[i]
    if abs(first[-1]) < least:
        first[-1] = least
    for i in reversed(range(n)):
        if i + 1 < n:
            x[i] -= second[i] * x[i + 1]
        if i + 2 < n:
            x[i] -= third[i] * x[i + 2]
        x[i] /= first[i]
    return x


def inverse_iteration(
    diagonal: np.ndarray, beside: np.ndarray, values: np.ndarray, steps: int = 4
) -> np.ndarray:
    """Unit eigenvectors of a tridiagonal matrix, given its falling eigenvalues.

    Eigenvalues closer than a thousandth of the norm form a cluster; a vector is
    made orthogonal to those before it in its cluster at every step.
    """
    size = len(diagonal)
    norm = float(np.abs(diagonal).max() + 2 * np.abs(beside).max(initial=0.0)) or 1.0
    least = norm * np.finfo(float).eps
    random = np.random.default_rng(7)
    vectors = np.zeros((size, len(values)))
    start, shift = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            start = k
        # equal eigenvalues are told apart by a last digit
        shift = min(value, shift - 2 * least) if k > start else value
        z = random.standard_normal(size)
        for _ in range(steps):
            z = solve_tridiagonal(diagonal - shift, beside, z / np.linalg.norm(z), least)
            kept = 0.0
            while kept < 0.7:  # what little is left of a vector needs another round
                z = z / np.linalg.norm(z)
                z -= vectors[:, start:k] @ (vectors[:, start:k].T @ z)
                kept = np.linalg.norm(z)
        vectors[:, k] = z / np.linalg.norm(z)
    return vectors
