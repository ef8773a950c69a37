import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import contexts, vectors


def slow_embedding(text, dimensions=384):
    values = []
    for i in range(dimensions):
        h = 0
        for j, b in enumerate(text.encode("utf-8")):
            h = (h * 31 + b + i + j) % 2**64
        if h >= 2**63:
            h -= 2**64
        remainder = h % 2000 if h >= 0 else -((-h) % 2000)
        values.append((remainder - 1000) / 1000.0)
    scale = 1.0 / (sum(v * v for v in values) + 1e-8)
    return [v * scale for v in values]


TEXTS = ["a", "Show me total sales", "é ü 漢字 mixed", "x" * 300, "Why did revenue drop? " * 40]


def test_hash_embedding(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    rows = vectors.embed_texts(df, "text").orderBy("id").collect()
    for row, text in zip(rows, TEXTS):
        assert np.allclose(row.embedding, slow_embedding(text), rtol=1e-12, atol=1e-15)


def test_empty_text_has_no_embedding(spark):
    df = spark.createDataFrame([("",), (None,), ("a",)], "text string")
    rows = vectors.embed_texts(df, "text", 8).collect()
    assert [r.embedding is None for r in rows] == [True, True, False]


def random_vectors(seed, n, d=8):
    rng = np.random.default_rng(seed)
    return rng.integers(-3, 4, size=(n, d)).astype(float)


def brute(data, queries, k):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit(data) @ unit(queries).T, 9)
    return {
        q: [int(i) for i in np.lexsort((np.arange(len(data)), -scores[:, q]))[:k]]
        for q in range(len(queries))
    }


@pytest.mark.parametrize("few", [0, 1024])
@pytest.mark.parametrize("cell", [(2, 16), (1024, 1 << 20)])
def test_top_k_with_ties_and_cells(spark, monkeypatch, few, cell):
    monkeypatch.setattr(vectors, "CELL_QUERIES", cell[0])
    monkeypatch.setattr(vectors, "CELL_SCORES", cell[1])
    data, asked = random_vectors(1, 200), random_vectors(2, 5)
    data[10:40] = data[9]  # copies
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, v array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "q long, v array<double>")
    found = vectors.top_k(
        table.repartition(5), queries, 7, "id", "v", "q", "v", broadcast_queries=few
    ).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.id)
    assert got == brute(data, asked, 7)


@pytest.mark.parametrize("few", [0, 1024])
def test_top_k_in_collections_with_text_ids_and_payload(spark, few):
    data, asked = random_vectors(5, 90), random_vectors(6, 8)
    names = ["a", "b", "c"]
    rows = [(f"v{i:02}", names[i % 3], v.tolist(), f"text {i}") for i, v in enumerate(data)]
    rows += [
        ("bad1", "a", None, "x"),
        ("bad2", "a", [], "x"),
        ("bad3", "a", [1.0, None], "x"),
        ("bad4", "a", [float("nan")] * 8, "x"),
        (None, "a", [1.0] * 8, "x"),
        ("bad5", None, [1.0] * 8, "x"),
    ]
    table = spark.createDataFrame(rows, "id string, place string, v array<double>, query_id string")
    wanted = [(f"q{i}", names[i % 2], v.tolist()) for i, v in enumerate(asked)]
    wanted += [("lost", "nowhere", asked[0].tolist()), ("none", "a", None)]
    queries = spark.createDataFrame(wanted, "q string, place string, v array<double>")
    found = vectors.top_k(
        table.repartition(4),
        queries.repartition(3),
        4,
        "id",
        "v",
        "q",
        "v",
        collection="place",
        payload=["query_id", "place"],
        broadcast_queries=few,
    ).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        assert r.payload.query_id == f"text {int(r.id[1:])}" and r.payload.place == r.collection
        got.setdefault(r.query_id, []).append(r.id)
    for i in range(8):
        own = [j for j in range(90) if j % 3 == i % 2]
        best = brute(data[own], asked[i : i + 1], 4)[0]
        assert got.pop(f"q{i}") == [f"v{own[j]:02}" for j in best]
    assert got == {}


def test_top_k_without_queries_or_vectors(spark):
    table = spark.createDataFrame([(1, [1.0])], "id long, v array<double>")
    nothing = table.limit(0)
    assert vectors.top_k(table, nothing, 3, "id", "v", "id", "v").count() == 0
    assert vectors.top_k(nothing, table, 3, "id", "v", "id", "v", broadcast_queries=0).count() == 0


def test_many_queries_shuffle_no_pairs(spark):
    """Rows that leave the search are at most rows of the grid x queries x k."""
    table = spark.range(4000).select("id", F.array(F.sin("id"), F.cos("id")).alias("v")).repartition(7)
    found = vectors.top_k(table, table, 2, "id", "v", "id", "v")
    assert found.count() == 8000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_many_queries_send_few_copies(spark):
    """Queries and vectors are sent to as many cells as needed, floats as floats."""
    kind = "array<float>"
    table = spark.range(9000).select("id", F.array(F.sin("id"), F.cos("id")).cast(kind).alias("v"))
    found = vectors.top_k(table, table, 1, "id", "v", "id", "v")
    assert {(r.query_id, r.id) for r in found.collect()} >= {(i, i) for i in range(0, 9000, 7)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "as array<double>" not in plan
    rows, columns = vectors._grid(9000, 9000, 8, 2)
    assert (rows + columns) * 9000 <= 6 * 9000 and rows * columns >= 6
    assert vectors._grid(720_000, 720_000, 200, 64) == (2, 88)
    assert vectors._grid(0, 5, 8, 2) == (1, 6) and vectors._grid(10**6, 3000, 200, 64) == (200, 1)


def test_own_embedding(spark):
    def loaded_lengths():
        """A model of one's own: counts of letters, and no embedding of the word bad."""

        def model(texts):
            if "bad" in texts:
                raise ValueError("bad text")
            return np.array([[len(t), t.count("a")] for t in texts], dtype=float)

        return model

    texts = ["a", "banana", "", None, "bad", "x" * 9]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(1)
    embedded = vectors.embed_texts(df, "text", embedding=loaded_lengths, error="problem").orderBy("id")
    assert [(r.embedding, r.problem) for r in embedded.collect()] == [
        ([1.0, 1.0], None),
        ([6.0, 3.0], None),
        (None, vectors.EMPTY_TEXT),
        (None, vectors.EMPTY_TEXT),
        (None, "bad text"),
        ([9.0, 0.0], None),
    ]
    hashed = vectors.embed_texts(df, "text", 4, error="problem").orderBy("id").collect()
    assert [r.problem is None for r in hashed] == [True, True, False, False, True, True]


@pytest.mark.parametrize("slice_size", [2, 1024])
def test_nearest_contexts(spark, monkeypatch, slice_size):
    monkeypatch.setattr(vectors, "MAX_SLICE", slice_size)
    data, context = random_vectors(3, 50), random_vectors(4, 7)
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(50, None)]
    table = spark.createDataFrame(rows, "id long, v array<double>")
    known = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(context)], "c string, w array<double>")
    near = vectors.nearest_contexts(table, "v", known, "c", "w").orderBy("id").collect()
    want = brute(context, data, 3)
    for row in near[:50]:
        assert [int(h.c) for h in row.hits] == want[row.id]
    assert near[50].hits == []


def test_classify_questions_by_predefined_contexts(spark):
    asked = [(0, "Show me total sales by region"), (1, "covid vaccine today"), (2, "")]
    df = spark.createDataFrame(asked, "id int, text string")
    rows = contexts.classify_questions(df, "text").orderBy("id").collect()
    known = contexts.predefined_texts()
    matrix = np.array([slow_embedding(t) for _, t in known])
    for row, (_, text) in zip(rows[:2], asked):
        v = np.array(slow_embedding(text))
        scores = matrix @ v / np.linalg.norm(matrix, axis=1) / np.linalg.norm(v)
        assert row.domain == known[int(np.argmax(scores))][0]
        assert abs(row.confidence - scores.max()) < 1e-8
        assert row.use_bi == (scores.max() >= 0.6)
        assert len(row.context) == 2
    assert (rows[2].domain, rows[2].confidence) == ("sales", 0.5)
    assert rows[2].reasoning.startswith("Keyword-based")
    assert rows[0].semantic_intent == "analytics" and rows[0].keywords == ["sales"]


def test_predefined_contexts_keep_their_members(spark):
    rows = {r.domain: r for r in contexts.predefined_contexts(spark).collect()}
    assert rows["gaming"].keywords[1:3] == ["video games", "game sales"]
    assert rows["marketing"].glossary[0].synonyms == ["acquisition cost", "customer cost"]
    assert rows["slack"].glossary == [] and rows["slack"].patterns[0].pattern == "slack analytics"
    assert rows["covid"].metrics[0] == "vaccinated" and rows["finance"].dimensions[0] == "account"
    assert {d: r.search_text for d, r in rows.items()} == dict(contexts.predefined_texts())


def test_upsert_delete_and_collections(spark):
    old = spark.createDataFrame([(1, "x", 1), (2, "x", 1)], "id long, collection string, version int")
    new = spark.createDataFrame([(2, "y", 2), (3, "y", 2)], "id long, collection string, version int")
    merged = vectors.upsert(old, new, "id", "version")
    # an id is one vector in each collection
    assert {(r.id, r.collection) for r in merged.collect()} == {(1, "x"), (2, "x"), (2, "y"), (3, "y")}
    assert {r.id for r in vectors.delete(merged, new, "id").collect()} == {1, 2}
    assert vectors.drop_collection(merged, "y").count() == 2
    assert vectors.list_collections(merged, "y").collect() == [("y", 2)]
    assert vectors.list_vectors(merged, "y", "id", 1).first().id == 2


def test_centroids(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [0.0, 1.0])], "l string, v array<double>")
    got = {r.l: r.v for r in vectors.centroids(df, "l", "v").collect()}
    assert got == {"a": [2.0, 3.0], "b": [0.0, 1.0]}
