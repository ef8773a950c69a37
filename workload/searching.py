"""Vector queries over the embeddings and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse.operators import semantic, vectors
from tallyhouse.operators.contexts import (
    DESCRIPTIONS,
    ContextStore,
    classify_questions,
    context_vectors,
    contexts_from_vectors,
    predefined_texts,
)
from tallyhouse.operators.questions import BUSINESS_KEYWORDS, SEMANTIC_INTENTS
from tallyhouse.session import run_folder
from workload.base import plain, query
from workload.modelling import CATALOG_SQL, CONFIDENCE_SQL, CONTEXT_SQL, RICH_SQL, catalog
from workload.understanding import QUESTION_SQL, question_log, rules_sql


def stored_vectors(wh):
    return wh.table("embeddings").select(
        "vec_id", "embedding", F.concat(F.lit("domain_"), F.col("label")).alias("domain"), "label"
    )


def domain_vectors(wh):
    return vectors.centroids(wh.table("embeddings"), "label", "embedding")


CENTROIDS_SQL = """cells AS (SELECT label, unnest(embedding)::DOUBLE AS x,
      generate_subscripts(embedding, 1) AS pos FROM embeddings),
    centers AS (SELECT label, list(m ORDER BY pos) AS c FROM
      (SELECT label, pos, avg(x) AS m FROM cells GROUP BY 1, 2) GROUP BY 1),
    scored AS (SELECT vec_id, e.label AS own, c.label,
      round(list_cosine_similarity(embedding::DOUBLE[], c), 9) AS score FROM embeddings e, centers c)"""


@query(
    "vector_topk",
    f"""WITH {CENTROIDS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank
          FROM scored)
        SELECT CAST(label AS BIGINT) AS query_id, vec_id AS id, round(score, 6) AS score, rank FROM r WHERE rank <= 50""",
)
def vector_topk(wh):
    found = vectors.top_k(
        wh.table("embeddings"), domain_vectors(wh), 50, "vec_id", "embedding", "label", "embedding"
    )
    return plain(found.withColumn("score", F.round("score", 6)))


@query(
    "vector_search",
    """WITH t AS (SELECT 'v' || vec_id AS id, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS collection,
            'domain_' || label AS domain, embedding::DOUBLE[] AS e FROM embeddings),
       s AS (SELECT collection, q.id AS query_id, v.id, v.domain, round(list_cosine_similarity(q.e, v.e), 9) AS score
             FROM t q JOIN t v USING (collection)),
       r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
       SELECT collection, query_id, id, domain, round(score, 6) AS score, rank FROM r WHERE rank <= 3""",
)
def vector_search(wh):
    """The three nearest of every vector in its collection, itself among them."""
    stored = wh.table("embeddings").select(
        F.concat(F.lit("v"), "vec_id").alias("id"),
        F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("collection"),
        F.concat(F.lit("domain_"), "label").alias("domain"),
        "embedding",
    )
    found = vectors.top_k(
        stored, stored, 3, "id", "embedding", "id", "embedding", collection="collection", payload=["domain"]
    )
    return plain(
        found.select("collection", "query_id", "id", "payload.domain", F.round("score", 6).alias("score"), "rank")
    )


@query(
    "domain_vector",
    f"""WITH {CENTROIDS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label::VARCHAR) AS n
          FROM scored)
        SELECT vec_id, label::VARCHAR AS domain, round(score, 6) AS confidence, score >= 0.6 AS use_bi,
          format('Matched domain ''{{}}'' with confidence {{:.2f}} based on vector similarity', label, score) AS reasoning
        FROM r WHERE n = 1""",
)
def domain_vector(wh):
    contexts = domain_vectors(wh).withColumnRenamed("label", "domain")
    near = vectors.nearest_contexts(
        wh.table("embeddings").drop("label"), "embedding", contexts, "domain", "embedding"
    )
    classified = vectors.classify_by_hits(near, "domain")
    return classified.select(
        "vec_id", "domain", F.round("confidence", 6).alias("confidence"), "use_bi", "reasoning"
    )


@query(
    "domain_vector_hits",
    f"""WITH {CENTROIDS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label::VARCHAR) AS n
          FROM scored)
        SELECT vec_id, string_agg(label::VARCHAR, '|' ORDER BY n) AS domains FROM r WHERE n <= 3 GROUP BY 1""",
)
def domain_vector_hits(wh):
    contexts = domain_vectors(wh).withColumnRenamed("label", "domain")
    near = vectors.nearest_contexts(
        wh.table("embeddings").drop("label"), "embedding", contexts, "domain", "embedding"
    )
    return plain(near.select("vec_id", F.col("hits.domain").alias("domains")))


@query(
    "vector_upsert",
    """WITH n AS (SELECT vec_id * 2 AS vec_id, embedding, label + 100 AS label FROM embeddings)
       SELECT vec_id, CAST(label AS BIGINT) AS label, embedding[1]::DOUBLE AS first FROM n
       UNION ALL SELECT vec_id, label, embedding[1] FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM n)""",
)
def vector_upsert(wh):
    old = wh.table("embeddings").withColumn("version", F.lit(1))
    new = wh.table("embeddings").select(
        (F.col("vec_id") * 2).alias("vec_id"),
        "embedding",
        (F.col("label") + 100).alias("label"),
        F.lit(2).alias("version"),
    )
    merged = vectors.upsert(old, new, "vec_id", "version")
    return plain(
        merged.select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("first"))
    )


@query(
    "vector_delete",
    """SELECT vec_id, CAST(label AS BIGINT) AS label FROM embeddings
       WHERE embedding[1] <= 0.1::FLOAT""",
)
def vector_delete(wh):
    stored = wh.table("embeddings")
    gone = stored.filter(F.get("embedding", F.lit(0)) > F.lit(0.1).cast("float"))
    return plain(vectors.delete(stored, gone, "vec_id").select("vec_id", "label"))


def collections(wh):
    kind = F.when(F.col("label") < 5, "domains_").otherwise("queries_")
    return wh.table("embeddings").withColumn("collection", F.concat(kind, F.col("label")))


@query(
    "vector_collections",
    """SELECT 'domains_' || label AS collection, count(*) AS vectors FROM embeddings WHERE label < 5 GROUP BY 1""",
)
def vector_collections(wh):
    return vectors.list_collections(collections(wh), "domains_")


@query(
    "vector_list",
    "SELECT vec_id, CAST(label AS BIGINT) AS label FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 50",
)
def vector_list(wh):
    return plain(vectors.list_vectors(collections(wh), "domains_3", "vec_id").select("vec_id", "label"))


WRAP = "18446744073709551616::HUGEINT"


@query(
    "hash_embed",
    f"""WITH b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'),
            lambda x: CAST('0x' || x AS INTEGER)::HUGEINT) AS bytes FROM documents),
       p AS (SELECT doc_id, list_reduce(list_transform(bytes, lambda x, j: x + j - 1), lambda h, x: (h * 31 + x) % {WRAP}) % {WRAP} AS base,
            list_reduce(list_transform(bytes, lambda x: 1::HUGEINT), lambda h, x: (h * 31 + x) % {WRAP}) % {WRAP} AS step FROM b),
       h AS (SELECT doc_id, i, (base + i * step) % {WRAP} AS h FROM p, range(384) AS r(i)),
       v AS (SELECT doc_id, i, ((CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - {WRAP} ELSE h END) % 2000 - 1000)::DOUBLE / 1000.0 AS v FROM h),
       s AS (SELECT doc_id, CAST(sum(CAST(v * 1000 AS BIGINT) * CAST(v * 1000 AS BIGINT)) AS DOUBLE) / 1000000 AS sq,
               max(v) FILTER (i = 0) AS v0, max(v) FILTER (i = 200) AS v200, max(v) FILTER (i = 383) AS v383 FROM v GROUP BY 1)
       SELECT doc_id, 384::BIGINT AS dims, round(v0 / (sq + 1e-8::DOUBLE), 10) AS v0, round(v200 / (sq + 1e-8::DOUBLE), 10) AS v200,
         round(v383 / (sq + 1e-8::DOUBLE), 10) AS v383 FROM s""",
)
def hash_embed(wh):
    embedded = vectors.embed_texts(wh.table("documents").select("doc_id", "text"), "text")

    def at(i):
        return F.round(F.get("embedding", F.lit(i)), 10)

    return embedded.select(
        "doc_id",
        F.size("embedding").cast("long").alias("dims"),
        at(0).alias("v0"),
        at(200).alias("v200"),
        at(383).alias("v383"),
    )


def embedded_sql(texts: str) -> str:
    """Unit vectors of a table texts(kind, id, text), one row per component."""
    return f"""b AS (SELECT kind, id, list_transform(regexp_extract_all(hex(encode(text)), '..'),
            lambda x: CAST('0x' || x AS INTEGER)::HUGEINT) AS bytes FROM {texts} WHERE text <> ''),
       p AS (SELECT kind, id, list_reduce(list_transform(bytes, lambda x, j: x + j - 1), lambda h, x: (h * 31 + x) % {WRAP}) % {WRAP} AS base,
            list_reduce(list_transform(bytes, lambda x: 1::HUGEINT), lambda h, x: (h * 31 + x) % {WRAP}) % {WRAP} AS step FROM b),
       h AS (SELECT kind, id, i, (base + i * step) % {WRAP} AS h FROM p, range(384) AS r(i)),
       v AS (SELECT kind, id, i, ((CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - {WRAP} ELSE h END) % 2000 - 1000)::DOUBLE AS v FROM h),
       u AS (SELECT kind, id, list(v ORDER BY i) AS vec FROM v GROUP BY 1, 2)"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CONTEXT_ROWS = ", ".join(f"({quoted(d)}, {quoted(t)})" for d, t in predefined_texts())
DESCRIBED = " ".join(f"WHEN '{d}' THEN {quoted(t)}" for d, t in DESCRIPTIONS.items())


@query(
    "classify_questions",
    f"""WITH {QUESTION_SQL}, texts AS (SELECT 'q' AS kind, id, text FROM questions
            UNION ALL SELECT 'c', * FROM (VALUES {CONTEXT_ROWS})),
       {embedded_sql("texts")},
       s AS (SELECT q.id, c.id AS domain, round(list_cosine_similarity(q.vec, c.vec), 9) AS score
             FROM u q JOIN u c ON q.kind = 'q' AND c.kind = 'c'),
       r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, domain) AS n FROM s),
       t AS (SELECT id, string_agg(CASE domain {DESCRIBED} END, '|' ORDER BY n) AS context FROM r WHERE n <= 2 GROUP BY 1),
       l AS (SELECT id, lower(text) AS q FROM questions)
       SELECT id, domain, round(score, 6) AS confidence, score >= 0.6 AS use_bi, context,
         {rules_sql([(f"'{n}'", w) for n, w in SEMANTIC_INTENTS], "'analytics'")} AS semantic_intent,
         array_to_string(list_filter([{", ".join(f"'{w}'" for w in BUSINESS_KEYWORDS)}], lambda w: contains(q, w)), '|') AS keywords,
         format('Matched domain ''{{}}'' with confidence {{:.2f}} based on vector similarity', domain, score) AS reasoning
       FROM r JOIN t USING (id) JOIN l USING (id) WHERE n = 1""",
)
def classify_all_questions(wh):
    classified = classify_questions(question_log(wh), "text").drop("text")
    return plain(classified.withColumn("confidence", F.round("confidence", 6)))


@query(
    "context_vectors",
    f"""WITH {CATALOG_SQL}, {RICH_SQL}, {CONTEXT_SQL}
      SELECT 'domain_' || domain || '_warehouse' AS id, domain, description, {CONFIDENCE_SQL} AS confidence,
        array_to_string(string_split(keywords, '|')[1:10], '|') AS keywords, true AS auto_generated FROM sized""",
)
def domain_context_vectors(wh):
    """Domain contexts of all tables, stored as vectors and read back."""
    stored = context_vectors(semantic.domain_contexts(catalog(wh)), "warehouse")
    common = stored.filter((F.col("collection") == "domain_contexts") & (F.size("embedding") == 384))
    back = contexts_from_vectors(common)
    return plain(back.select("id", "domain", "description", "confidence", "keywords", "auto_generated"))


@query(
    "context_store",
    f"""WITH {CATALOG_SQL}, {RICH_SQL}, {CONTEXT_SQL},
      listed AS (SELECT domain, string_agg(table_name, '|' ORDER BY table_idx) AS table_names FROM tables GROUP BY 1),
      made AS (SELECT CAST(max(o_orderdate) AS VARCHAR) AS updated_at FROM orders)
      SELECT 'domain_' || domain || '_' || source AS id, source, v AS version, domain, description, keywords,
        metrics, dimensions, table_names, updated_at,
        CASE domain {" ".join(f"WHEN '{d}' THEN '{'|'.join(t for t, _, _ in g)}'" for d, g in semantic.GLOSSARY.items())} ELSE '' END AS terms,
        concat_ws('|', CASE domain {" ".join(f"WHEN '{d}' THEN '{p[0]}'" for d, p in semantic.QUERY_PATTERNS.items())} END,
          CASE WHEN nm > 0 THEN domain || ' trend analysis' END) AS patterns
      FROM sized JOIN listed USING (domain), made, (VALUES ('sales', 1), ('stock', 2)) s(source, v)""",
)
def context_store(wh):
    """Contexts of two sources, one of them replaced once, read back from the store."""
    made = semantic.domain_contexts(catalog(wh))
    # the catalog is small, the tables it was made of are not: they are scanned once
    made = made.sparkSession.createDataFrame(made.collect(), made.schema)
    when = wh.table("orders").agg(F.max("o_orderdate")).first()[0]
    store = ContextStore(wh.spark, run_folder(wh.spark, "contexts"))
    vectors_of = {s: context_vectors(made, s, F.lit(str(when))) for s in ("sales", "stock")}
    store.replace(vectors_of["stock"].limit(1), ["stock"])
    store.replace(vectors_of["sales"].unionByName(vectors_of["stock"]), ["sales", "stock"])
    numbers = store.versions().select("source", "version")
    own = store.vectors().filter(F.col("collection") != "domain_contexts")
    back = contexts_from_vectors(own)
    return plain(
        back.withColumn("source", F.regexp_extract("id", "_([a-z]+)$", 1))
        .join(numbers, "source")
        .select(
            "id",
            "source",
            "version",
            "domain",
            "description",
            "keywords",
            "metrics",
            "dimensions",
            "table_names",
            F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
            F.col("glossary.term").alias("terms"),
            F.col("patterns.pattern").alias("patterns"),
        )
    )
