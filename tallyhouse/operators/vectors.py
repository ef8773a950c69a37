"""Vector operators: embedding, upsert, delete and cosine search.

Vectors are tables with an id of any type and an array column. Scores are rounded to nine
places, so that ties do not depend on the order of a floating-point sum; equal
scores are ordered by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# A slice of contexts is held by every task at once.
MAX_SLICE = 1024
DIMENSIONS = 384


# Texts are embedded in pieces of about this many bytes.
PIECE_BYTES = 1 << 21


def hash_embedding(dimensions: int = DIMENSIONS):
    """A deterministic embedding of texts, as a vectorised function.

    Component i starts from the hash h = h * 31 + byte + i + j over the bytes j
    in 64-bit arithmetic. The hash is linear in i, so two sums over each text
    give all components; the sums of a batch run over its bytes at once.
    """

    def piece(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Components of texts without gaps between them; every size is above 0."""
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        powers = np.full(sizes.max(), 31, dtype=np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        weights = powers[np.repeat(sizes, sizes) - 1 - place]
        terms = weights * (data.astype(np.uint64) + place.astype(np.uint64))
        base, step = np.add.reduceat(terms, starts), np.add.reduceat(weights, starts)
        index = np.arange(dimensions, dtype=np.uint64)
        hashes = (base[:, None] + index[None, :] * step[:, None]).view(np.int64)
        values = (np.fmod(hashes, 2000) - 1000) / 1000.0
        return values * (1.0 / ((values * values).sum(axis=1, keepdims=True) + 1e-8))

    @F.arrow_udf("array<double>")
    def embed(texts: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        filled = np.flatnonzero(sizes)
        components = np.empty((len(filled), dimensions))
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes[filled]) // PIECE_BYTES)) + 1
        for part in np.split(np.arange(len(filled)), cuts):
            if len(part):
                rows = filled[part]
                joined = b"".join(t.as_buffer() for t in texts.take(pa.array(rows)))
                components[part] = piece(np.frombuffer(joined, dtype=np.uint8), sizes[rows])
        lengths = np.where(sizes > 0, dimensions, 0)
        offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
        return pa.ListArray.from_arrays(
            pa.array(offsets), pa.array(components.ravel()), mask=pa.array(sizes == 0)
        )

    return embed


#: Loads a model: from then on, a list of texts gives a matrix with a row for each.
EmbeddingLoader = Callable[[], Callable[[list[str]], np.ndarray]]

EMPTY_TEXT = "text cannot be empty"


def model_embedding(load: EmbeddingLoader):
    """Embedding by a user's own model, as a vectorised function to ``embedding`` and
    ``error``.

    ``load`` is called once in each worker that has texts. Texts go to the model by
    batches; if a batch fails, its texts are tried one by one, and the message of a
    text's own failure becomes its error. An empty or null text is an error.
    """

    @F.pandas_udf("embedding array<double>, error string")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = None
        for texts in batches:
            vectors: list = [None] * len(texts)
            errors: list = [EMPTY_TEXT] * len(texts)
            filled = [i for i, t in enumerate(texts) if t]
            if filled and model is None:
                model = load()

            def put(rows: list[int]) -> None:
                found = np.asarray(model([texts.iat[i] for i in rows]), dtype=np.float64)
                if found.ndim != 2 or len(found) != len(rows):
                    raise ValueError(f"{len(rows)} texts gave embeddings of shape {found.shape}")
                for i, v in zip(rows, found):
                    vectors[i], errors[i] = v, None

            try:
                if filled:
                    put(filled)
            except Exception:
                for i in filled:
                    try:
                        put([i])
                    except Exception as error:  # of this text alone
                        vectors[i], errors[i] = None, str(error) or type(error).__name__
            yield pd.DataFrame(
                {"embedding": pd.Series(vectors, dtype=object), "error": pd.Series(errors, dtype=object)}
            )

    return embed


def embed_texts(
    df: DataFrame,
    text: str,
    dimensions: int = DIMENSIONS,
    column: str = "embedding",
    embedding: EmbeddingLoader | None = None,
    error: str | None = None,
) -> DataFrame:
    """Add the embedding of a text column; an empty text has none.

    Without ``embedding``, the loader of a model, texts are embedded by their hash.
    ``error`` names a column that says why a row has no embedding.
    """
    if embedding is None:
        out = df.withColumn(column, hash_embedding(dimensions)(F.col(text)))
        return out.withColumn(error, F.when(F.col(column).isNull(), EMPTY_TEXT)) if error else out
    both = df.withColumn("_embedded", model_embedding(embedding)(F.col(text)))
    made = {column: F.col("_embedded.embedding")}
    if error:
        made[error] = F.col("_embedded.error")
    return both.withColumns(made).drop("_embedded")


def upsert(stored: DataFrame, new: DataFrame, id: str, version: str) -> DataFrame:
    """Stored and new vectors, of which the latest version of each id remains,
    in each collection if the vectors have one.

    Ranking keeps one row per id in each task before the shuffle.
    """
    latest = Window.partitionBy(id, *_collection(stored, new)).orderBy(F.desc(version))
    both = stored.unionByName(new, allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(latest)).filter("_n <= 1").drop("_n")


def delete(stored: DataFrame, ids: DataFrame, id: str) -> DataFrame:
    """Stored vectors whose id is not listed, in its collection if both name one."""
    by = [id, *_collection(stored, ids)]
    return stored.join(ids.select(*by), by, "left_anti")


def _collection(*tables: DataFrame) -> list[str]:
    return ["collection"] if all("collection" in t.columns for t in tables) else []


def drop_collection(stored: DataFrame, name: str) -> DataFrame:
    return stored.filter(~F.col("collection").eqNullSafe(name))


def list_collections(stored: DataFrame, prefix: str = "") -> DataFrame:
    """Names of the collections, with their number of vectors."""
    named = stored.filter(F.col("collection").startswith(prefix))
    return named.groupBy("collection").agg(F.count("*").alias("vectors"))


def list_vectors(stored: DataFrame, collection: str, id: str, limit: int = 50) -> DataFrame:
    """The first vectors of a collection by id, without scores."""
    return stored.filter(F.col("collection") == collection).orderBy(id).limit(limit)


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per label, aggregated position by position on the map side."""
    cells = df.select(label, F.posexplode(vector).alias("_pos", "_x"))
    means = cells.groupBy(label, "_pos").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    ordered = means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("_pos", "_x"))).alias("_cells"))
    return ordered.select(label, F.col("_cells._x").alias(vector))


def _slices(df: DataFrame, id: str, vector: str) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and unit vectors of a table in slices of bounded size, by id."""
    ids, rows = [], []
    for row in df.filter(F.col(vector).isNotNull()).select(id, vector).orderBy(id).toLocalIterator():
        ids.append(row[0])
        rows.append(row[1])
        if len(ids) == MAX_SLICE:
            yield ids, _unit(np.array(rows, dtype=np.float64))
            ids, rows = [], []
    if ids:
        yield ids, _unit(np.array(rows, dtype=np.float64))


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


# Query vectors a task holds at once, in number and bytes, and scores it computes at once.
CELL_QUERIES = 8192
CELL_BYTES = 1 << 25
CELL_SCORES = 1 << 20
# Up to so many queries are sent to every task.
BROADCAST_QUERIES = 2048


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    id: str,
    vector: str,
    query_id: str,
    query_vector: str,
    collection: str | None = None,
    payload: Sequence[str] = (),
    broadcast_queries: int = BROADCAST_QUERIES,
) -> DataFrame:
    """The ``k`` most similar vectors for each query vector: query_id, id, score and
    rank; the ``collection`` if one is named, and ``payload``, the named columns of the
    vector that was found.

    With ``collection``, a column of both tables, queries search the vectors of their
    own collection. Ids are of any type that has an order. Vectors and queries without
    id, components or collection, and those with a component that is no finite number,
    are left out; a vector of zeros has the score 0. Queries of one id (and collection)
    share their ``k``.

    Few queries go to every task that scans vectors, which are then not shuffled. More
    queries are laid out in a grid: rows of vectors by columns of queries, each cell a
    group of at most about ``CELL_QUERIES`` queries and a share of the vectors. The grid
    has a cell for each shuffle partition, in the shape that sends the fewest rows; only
    where its groups of queries would be too large it has more columns. Both ways multiply in blocks and keep the best ``k`` of a query per task, so tasks x
    queries x k rows are ranked, never pairs. Either way it is one job, however many
    queries there are.
    """
    spark = vectors.sparkSession
    place = F.col(_name(collection)).cast("string") if collection else F.lit("")
    extra = F.struct(*[F.col(_name(c)) for c in payload]) if payload else F.lit(None).cast("string")
    table = _usable(
        vectors.select(
            place.alias("collection"),
            F.col(_name(id)).alias("id"),
            _components(vectors, vector).alias("v"),
            extra.alias("payload"),
        ),
        "id",
    )
    asked = _usable(
        queries.select(
            place.alias("collection"),
            F.col(_name(query_id)).alias("query_id"),
            _components(queries, query_vector).alias("v"),
        ),
        "query_id",
    )
    schema = T.StructType(
        [
            T.StructField("collection", T.StringType()),
            asked.schema["query_id"],
            table.schema["id"],
            T.StructField("score", T.DoubleType()),
            table.schema["payload"],
        ]
    )
    few = asked.limit(broadcast_queries + 1).collect()
    if len(few) <= broadcast_queries:
        shared = spark.sparkContext.broadcast(_by_collection(few))
        found = table.mapInArrow(_search_shared(shared, k, schema), schema)
    else:
        rows, columns = _grid(
            table.count(),
            asked.count(),
            int(spark.conf.get("spark.sql.shuffle.partitions")),
            max(len(r["v"]) for r in few),
        )
        found = _cells(table, asked, rows, columns).mapInArrow(_search_cells(k, schema), schema)
    best = Window.partitionBy("collection", "query_id").orderBy(F.desc("score"), F.asc("id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    unused = [c for c, used in (("collection", collection), ("payload", payload)) if not used]
    return ranked.drop(*unused)


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _usable(df: DataFrame, id: str) -> DataFrame:
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return df.filter(F.col(id).isNotNull() & F.col("collection").isNotNull() & finite & (F.size("v") > 0))


def _components(df: DataFrame, vector: str) -> Column:
    """Components as they are stored, if as floats: half the bytes of doubles in a shuffle."""
    kind = df.select(F.col(_name(vector))).schema[0].dataType.simpleString()
    return F.col(_name(vector)).cast("array<float>" if kind == "array<float>" else "array<double>")


def _grid(vectors: int, queries: int, cells: int, dimensions: int) -> tuple[int, int]:
    """Rows and columns of the grid. All queries are sent once for each row and all vectors
    once for each column, which is least where both are sent as often as the other."""
    most = max(1, min(CELL_QUERIES, CELL_BYTES // (8 * dimensions)))
    balanced = min(cells, max(1, round((cells * queries / max(vectors, 1)) ** 0.5)))
    columns = max(balanced, -(-queries // most))
    return max(1, cells // columns), columns


def _cells(table: DataFrame, asked: DataFrame, rows: int, columns: int) -> DataFrame:
    """Queries and vectors of every cell of the grid, queries first."""

    def share(name: str, n: int) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    nothing = F.lit(None)
    of_queries = asked.select(
        "collection",
        every(rows).alias("row"),
        share("query_id", columns).alias("column"),
        "query_id",
        nothing.cast(table.schema["id"].dataType).alias("id"),
        "v",
        nothing.cast(table.schema["payload"].dataType).alias("payload"),
    )
    of_vectors = table.select(
        "collection",
        share("id", rows).alias("row"),
        every(columns).alias("column"),
        nothing.cast(asked.schema["query_id"].dataType).alias("query_id"),
        "id",
        "v",
        "payload",
    )
    keys = ["collection", "row", "column"]
    dealt = of_queries.unionByName(of_vectors).repartition(*keys)
    return dealt.sortWithinPartitions(*keys, F.col("query_id").isNull())


def _by_collection(rows: list) -> dict[str, tuple[list, np.ndarray]]:
    grouped: dict[str, tuple[list, list]] = {}
    for name, query, v in rows:
        ids, of_ids = grouped.setdefault(name, ([], []))
        ids.append(query)
        of_ids.append(v)
    return {name: (ids, _unit(np.array(v, dtype=np.float64))) for name, (ids, v) in grouped.items()}


class _Best:
    """The best ``k`` vectors so far for each query of a cell."""

    def __init__(self, queries: list, matrix: np.ndarray, k: int) -> None:
        self.queries, self.matrix, self.k = queries, matrix, k
        self.query, self.score = np.empty(0, dtype=np.int64), np.empty(0)
        self.ids = self.payload = None
        self.least = np.full(len(queries), -np.inf)

    def add(self, ids: pa.Array, vectors: pa.Array, payload: pa.Array) -> None:
        dimensions = self.matrix.shape[1]
        if (vectors.value_lengths().to_numpy(zero_copy_only=False) != dimensions).any():
            raise ValueError(f"vectors need {dimensions} components")
        data = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        data = _unit(data.reshape(-1, dimensions))
        step = max(1, CELL_SCORES // len(self.queries))
        for start in range(0, len(data), step):
            scores = np.round(self.matrix @ data[start : start + step].T, 9)
            if scores.shape[1] > self.k:
                limit = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            else:
                limit = np.full(len(scores), -np.inf)
            query, row = np.nonzero(scores >= np.maximum(limit, self.least)[:, None])
            at = pa.array(start + row)
            self._merge(query, scores[query, row], ids.take(at), payload.take(at))

    def _merge(self, query: np.ndarray, score: np.ndarray, ids: pa.Array, payload: pa.Array) -> None:
        query, score = np.append(self.query, query), np.append(self.score, score)
        if self.ids is not None:
            ids, payload = pa.concat_arrays([self.ids, ids]), pa.concat_arrays([self.payload, payload])
        order = np.lexsort((pc.rank(ids, tiebreaker="dense").to_numpy(), -score, query))
        sorted_query = query[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_query, sorted_query)
        order = order[place < self.k]
        self.query, self.score = query[order], score[order]
        self.ids, self.payload = ids.take(pa.array(order)), payload.take(pa.array(order))
        last = np.append(self.query[1:] != self.query[:-1], True)[: len(order)]
        full = last & (place[place < self.k] == self.k - 1)
        self.least[self.query[full]] = self.score[full]

    def rows(self, collection: str, query_type: pa.DataType) -> pa.RecordBatch | None:
        if self.ids is None or not len(self.ids):
            return None
        queries = pa.array(self.queries, query_type).take(pa.array(self.query))
        names = pa.array([collection] * len(self.query), pa.string())
        return pa.RecordBatch.from_arrays(
            [names, queries, self.ids, pa.array(self.score), self.payload],
            names=["collection", "query_id", "id", "score", "payload"],
        )


def _search_shared(shared, k: int, schema: T.StructType):
    query_type = to_arrow_type(schema["query_id"].dataType)

    def search(batches):
        bests = {name: _Best(*asked, k) for name, asked in shared.value.items()}
        for batch in batches:
            names = batch.column(0)
            for name in names.unique().to_pylist():
                if name in bests:
                    of_name = batch.filter(pc.equal(names, name))
                    bests[name].add(of_name.column(1), of_name.column(2), of_name.column(3))
        for name, best in bests.items():
            if (rows := best.rows(name, query_type)) is not None:
                yield rows

    return search


def _search_cells(k: int, schema: T.StructType):
    query_type = to_arrow_type(schema["query_id"].dataType)

    def search(batches):
        cell, asked, best = None, [], None
        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(3)]))
            is_query = batch.column(3).is_valid().to_pylist()
            start = 0
            while start < len(keys):
                end = start + 1
                while end < len(keys) and keys[end] == keys[start] and is_query[end] == is_query[start]:
                    end += 1
                if keys[start] != cell:
                    if best is not None and (rows := best.rows(cell[0], query_type)) is not None:
                        yield rows
                    cell, asked, best = keys[start], [], None
                part = batch.slice(start, end - start)
                if is_query[start]:
                    asked += zip(part.column(3).to_pylist(), part.column(5).to_pylist())
                elif asked:
                    if best is None:
                        ids, v = zip(*asked)
                        best = _Best(list(ids), _unit(np.array(v, dtype=np.float64)), k)
                    best.add(part.column(4), part.column(5), part.column(6))
                start = end
        if best is not None and (rows := best.rows(cell[0], query_type)) is not None:
            yield rows

    return search


def nearest_contexts(
    df: DataFrame, vector: str, contexts: DataFrame, context_id: str, context_vector: str, k: int = 3
) -> DataFrame:
    """Add ``hits``: the ``k`` contexts most similar to each row's vector.

    Contexts are few (one per domain). They are broadcast in slices of bounded
    size; of each slice a row gets its best ``k`` alone, so rows are never shuffled
    and other scores never leave the worker. Rows without a vector have no hits.
    """
    spark_context = df.sparkSession.sparkContext
    kind = f"array<struct<score:double,{context_id}:string>>"
    ranked = df.withColumn("hits", F.array().cast(kind))

    def best_of(shared):
        @F.arrow_udf("array<struct<score:double,name:string>>")
        def best(vectors: pa.Array) -> pa.Array:
            names, matrix = shared.value
            known = vectors.is_valid().to_numpy(zero_copy_only=False)
            rows = vectors.drop_null()
            data = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            scores = np.round(_unit(data.reshape(len(rows), matrix.shape[1])) @ matrix.T, 9)
            # names ascend, so equal scores stay in their order
            first = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            offsets = np.append(0, np.cumsum(np.where(known, first.shape[1], 0))).astype(np.int32)
            pairs = pa.StructArray.from_arrays(
                [
                    pa.array(np.take_along_axis(scores, first, axis=1).ravel()),
                    pa.array(names).take(pa.array(first.ravel())),
                ],
                names=["score", "name"],
            )
            return pa.ListArray.from_arrays(pa.array(offsets), pairs, mask=pa.array(~known))

        return best

    for ids, matrix in _slices(contexts, context_id, context_vector):
        names = np.array([str(i) for i in ids], dtype=object)
        order = np.argsort(names, kind="stable")
        shared = spark_context.broadcast((names[order].tolist(), matrix[order]))
        found = F.coalesce(best_of(shared)(F.col(vector)), F.array()).cast(kind)
        # hits of one score stay in the order of the context names
        both = F.array_sort(
            F.concat("hits", found),
            lambda a, b: F.when(a["score"] > b["score"], -1)
            .when(a["score"] < b["score"], 1)
            .when(a[context_id] < b[context_id], -1)
            .when(a[context_id] > b[context_id], 1)
            .otherwise(0),
        )
        ranked = ranked.withColumn("hits", F.slice(both, 1, k))
    return ranked


def classify_by_hits(df: DataFrame, domain: str, descriptions: dict[str, str] | None = None) -> DataFrame:
    """Domain and confidence of the best hit, a reason, and whether to ask the BI source.

    With ``descriptions`` the texts of the two best contexts are added. Rows
    without a hit keep the domain that keywords give, if there is one.
    """
    best = F.get("hits", F.lit(0))
    has_keywords = {"domain", "domain_confidence"} <= set(df.columns)
    other = F.col("domain") if has_keywords else F.lit(None).cast("string")
    other_confidence = F.col("domain_confidence") if has_keywords else F.lit(None).cast("double")
    out = df.withColumns(
        {
            "_domain": F.coalesce(best[domain], other),
            "_confidence": F.coalesce(best["score"], other_confidence),
        }
    )
    reason = F.when(
        best.isNotNull(),
        F.format_string(
            "Matched domain '%s' with confidence %.2f based on vector similarity", "_domain", "_confidence"
        ),
    ).otherwise(
        F.concat(F.lit("Keyword-based classification (fallback) - matched '"), F.col("_domain"), F.lit("'"))
    )
    columns = {
        "reasoning": reason,
        "use_bi": (F.col("_confidence") >= 0.6) & (F.col("_domain") != "general"),
    }
    if descriptions:
        texts = F.create_map(*[F.lit(x) for pair in descriptions.items() for x in pair])
        columns["context"] = F.transform(F.slice("hits", 1, 2), lambda h: texts[h[domain]])
    out = out.withColumns(columns).drop("domain", "domain_confidence", "hits")
    return out.withColumnsRenamed({"_domain": "domain", "_confidence": "confidence"})
