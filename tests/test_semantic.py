import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import contexts, profile, semantic

# table, column, type, roles (i = id, m = metric, d = dimension, t = datetime)
COLUMNS = [
    ("orders", "order_id", "i"),
    ("orders", "customer_id", "i"),
    ("orders", "order_date", "t"),
    ("orders", "total_amount", "m"),
    ("orders", "status", "d"),
    ("customers", "customer_id", "i"),
    ("customers", "email", ""),
    ("customers", "registration_date", "t"),
    ("customers", "customer_segment", "d"),
    ("customers", "lifetime_value", "m"),
    ("products", "product_id", "i"),
    ("products", "product_name", ""),
    ("products", "category", "d"),
    ("products", "price", "m"),
    ("products", "stock_quantity", "m"),
]
TAGS = [
    ("orders", ["sales", "orders", "revenue", "transactions"]),
    ("customers", ["customers", "crm", "segmentation", "ltv"]),
    ("products", ["products", "inventory", "catalog", "pricing"]),
]


@pytest.fixture
def catalog(spark):
    names = [t for t, _ in TAGS]
    rows = [
        (names.index(t), t, i, c, "i" in r, "m" in r, "d" in r) for i, (t, c, r) in enumerate(COLUMNS, start=1)
    ]
    return spark.createDataFrame(
        rows,
        "table_idx int, table_name string, position int, column_name string, "
        "is_id boolean, is_metric boolean, is_dimension boolean",
    )


@pytest.fixture
def tags(spark):
    return spark.createDataFrame(TAGS, "table_name string, tags array<string>")


def test_metrics(catalog):
    rows = semantic.business_metrics(catalog).orderBy("table_idx", "position").collect()
    assert [(r.name, r.type) for r in rows] == [
        ("Order Total Amount", "sum"),
        ("Customer Lifetime Value", "sum"),
        ("Product Price", "sum"),
        ("Product Stock Quantity", "count"),
    ]
    assert rows[0].description == "Total total amount from orders"
    assert rows[0].keywords == [
        "total_amount", "total amount", "orders", "order", "money", "sales", "income", "revenue",
    ]
    assert rows[0].dimensions == ["status"] and rows[3].domain == "product"


def test_relationships(catalog):
    rows = profile.table_relationships(catalog).collect()
    assert [(r.from_table, r.from_column, r.to_table, r.to_column) for r in rows] == [
        ("orders", "customer_id", "customers", "customer_id")
    ]


def test_relationship_by_table_name(spark):
    rows = [(0, "users", "id", True), (1, "visits", "user_id", True), (1, "visits", "page", False)]
    catalog = spark.createDataFrame(rows, "table_idx int, table_name string, column_name string, is_id boolean")
    found = profile.table_relationships(catalog).collect()
    assert [(r.from_column, r.to_column, r.relation_type) for r in found] == [("id", "user_id", "one_to_many")]


def test_primary_domain(catalog, tags):
    row = semantic.primary_domain(catalog, tags).first()
    assert row.domain == "product" and abs(row.confidence - 3 / 7) < 1e-12


def test_contexts(catalog, tags):
    rows = {r.domain: r for r in semantic.domain_contexts(catalog, tags).collect()}
    assert {d: round(r.confidence, 3) for d, r in rows.items()} == {
        "sales": 0.575,
        "customer": 0.425,
        "product": 0.75,
    }
    sales = rows["sales"]
    assert sales.keywords == ["orders", "revenue", "sales", "status", "total_amount", "transactions"]
    assert [g.term for g in sales.glossary] == ["Revenue", "Conversion Rate"]
    assert [p.pattern for p in sales.patterns] == ["sales performance analysis", "sales trend analysis"]
    assert sales.patterns[1].keywords == ["orders", "revenue", "sales", "trend", "over time"]
    texts = {r.domain: r.search_text for r in semantic.search_text(semantic.domain_contexts(catalog, tags)).collect()}
    assert texts["product"].startswith("product Product catalog, inventory management")
    assert "products products inventory catalog pricing product_id category price stock_quantity" in texts["product"]


def test_domain_by_tags_then_columns(spark):
    catalog = spark.createDataFrame(
        [(0, "t1", 1, "budget", False, True, False), (1, "t2", 1, "email", False, False, True), (2, "t3", 1, "x", False, False, False)],
        "table_idx int, table_name string, position int, column_name string, "
        "is_id boolean, is_metric boolean, is_dimension boolean",
    )
    tags = spark.createDataFrame([("t1", ["misc", "staff"])], "table_name string, tags array<string>")
    rows = semantic.table_domains(catalog, tags).orderBy("table_idx").collect()
    assert [r.domain for r in rows] == ["hr", "marketing", "general"]
    alone = semantic.primary_domain(catalog.filter("table_name = 't3'")).first()
    assert (alone.domain, alone.confidence) == ("general", 1.0)


def test_sample_questions(catalog):
    asked = [r.question for r in semantic.sample_questions(semantic.business_metrics(catalog)).collect()]
    assert len(asked) == 6 and asked[0] == "Show me total sales revenue"


def test_profile(spark):
    df = spark.range(200).select(
        F.col("id").alias("item_id"),
        F.concat(F.lit("n"), F.col("id") % 3).alias("kind"),
        F.concat(F.lit("long text number "), F.col("id")).alias("note"),
        (F.col("id") % 7 - 3).cast("double").alias("price"),
        F.when(F.col("id") > 5, F.col("id")).alias("other_key"),
        F.lit("it's `odd`").alias("odd`name"),
    )
    rows = {r.column_name: r for r in profile.profile_columns(spark, {"it's": df}).collect()}
    assert rows["item_id"].is_id and rows["item_id"].is_unique and rows["item_id"].samples == ["0", "1", "2"]
    assert rows["kind"].is_dimension and rows["kind"].samples == ["n0", "n1", "n2"]
    assert not rows["note"].is_dimension and rows["note"].is_unique and rows["note"].samples == []
    assert rows["price"].is_metric and rows["price"].is_currency and rows["price"].samples == ["-3.0", "-2.0", "-1.0"]
    assert rows["other_key"].nullable and rows["other_key"].is_unique and rows["other_key"].n_nonnull == 194
    assert rows["odd`name"].samples == ["it's `odd`"] and not rows["odd`name"].is_unique


def test_containment(spark):
    parent = spark.range(5).withColumnRenamed("id", "a_key")
    child = spark.createDataFrame([(1,), (1,), (4,), (9,), (None,)], "b_key long")
    pairs = spark.createDataFrame([("p", "a_key", "c", "b_key")], "from_table string, from_column string, to_table string, to_column string")
    row = profile.containment(pairs, {"p": parent, "c": child}).first()
    assert (row.child_keys, row.found_keys) == (3, 2) and abs(row.containment - 2 / 3) < 1e-12


def test_context_vectors_round_trip(spark, catalog, tags, tmp_path):
    made = contexts.context_vectors(semantic.domain_contexts(catalog, tags), "shop")
    assert {r.collection for r in made.select("collection").collect()} == {"domains_shop", "domain_contexts"}
    path = str(tmp_path / "contexts")
    contexts.refresh_contexts(made, path)
    contexts.refresh_contexts(contexts.context_vectors(semantic.domain_contexts(catalog), "other"), path)
    contexts.refresh_contexts(made.filter("collection = 'domain_contexts'"), path)
    stored = spark.read.parquet(path)
    assert {(r.connector_id, r["count"]) for r in stored.groupBy("connector_id").count().collect()} == {
        ("shop", 3),
        ("other", 6),
    }
    back = contexts.contexts_from_vectors(stored.filter("connector_id = 'shop'"))
    row = back.filter("domain = 'sales'").first()
    assert row.id == "domain_sales_shop" and round(row.confidence, 3) == 0.575 and row.auto_generated
    slim = stored.select("id", F.struct("metadata.domain").alias("metadata"))
    assert contexts.contexts_from_vectors(slim).first().keywords == []
    nameless = stored.select("id", F.struct(F.lit(None).cast("string").alias("domain")).alias("metadata"))
    assert contexts.contexts_from_vectors(nameless).count() == 0


def test_ingest_sources(spark):
    registry = spark.createDataFrame(
        [("a", "connected"), ("b", "disconnected"), ("c", "connected")], "id string, status string"
    )
    orders = spark.range(10).select(F.col("id").alias("order_id"), F.col("id").cast("double").alias("price"))

    def open_tables(source):
        if source == "c":
            raise OSError("unreachable")
        return {"orders": orders}

    made, failed = contexts.ingest_sources(registry, open_tables)
    assert failed == {"c": "unreachable"}
    assert {r.id for r in made.collect()} == {"domain_sales_a"}


def brute_inclusions(tables):
    values = {k: {v for v in vs if v is not None} for k, vs in tables.items()}
    return {
        (a, b): (len(values[a]), len(values[b]), len(values[a] & values[b]))
        for a in values
        for b in values
        if a != b and values[a] & values[b]
    }


def test_inclusions(spark):
    parents = [(i, f"p{i}" * 20, float(i)) for i in range(40)]
    children = [(i % 30 if i % 7 else None, f"p{i % 50}" * 20, i / 2) for i in range(200)]
    tables = {
        "p": spark.createDataFrame(parents, "id long, name string, x double").repartition(3),
        "c": spark.createDataFrame(children, "pid int, name string, y float").repartition(3),
        "empty": spark.createDataFrame([], "id long"),
    }
    columns = {"p": ["id", "name", "x"], "c": ["pid", "name", "y"], "empty": ["id"]}
    found = profile.inclusions(tables, columns)
    got = {
        ((r.from_table, r.from_column), (r.to_table, r.to_column)): (r.from_keys, r.to_keys, r.found_keys)
        for r in found.collect()
    }
    want = {
        ("p", "id"): [r[0] for r in parents],
        ("p", "name"): [r[1] for r in parents],
        ("p", "x"): [r[2] for r in parents],
        ("c", "pid"): [r[0] for r in children],
        ("c", "name"): [r[1] for r in children],
        ("c", "y"): [r[2] for r in children],
    }
    assert got == brute_inclusions(want)
    assert all(r.containment == r.found_keys / r.to_keys for r in found.collect())


def test_inclusions_scan_each_table_once(spark, tmp_path):
    tables = {}
    for name in "abc":
        spark.range(50).select("id", (F.col("id") * 2).alias("key"), F.lit(1).alias("x")).write.parquet(f"{tmp_path}/{name}")
        tables[name] = spark.read.parquet(f"{tmp_path}/{name}")
    counts = profile.shared_values(tables, {t: ["id", "key", "x"] for t in tables})
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3
    # one shuffle of values, one of the counted pairs; combined before both
    assert plan.count("Exchange hashpartitioning(value") == 1 and plan.count("Exchange") == 2
    assert {(r.a, r.b): r.shared for r in counts.collect()}[0, 1] == 25


def test_containment_of_relationships(spark):
    tables = {
        "a": spark.createDataFrame([(1,), (2,), (2,), (None,)], "id long"),
        "b": spark.createDataFrame([(2,), (3,), (None,)], "a_id int"),
        "none": spark.createDataFrame([], "a_id int"),
    }
    rows = [("a", "id", "b", "a_id"), ("a", "id", "none", "a_id"), ("b", "a_id", "a", "id"), ("a", "id", "b", "a_id")]
    schema = "from_table string, from_column string, to_table string, to_column string"
    wanted = spark.createDataFrame(rows, schema)
    got = {(r.from_table, r.to_table): tuple(r)[4:] for r in profile.containment(wanted, tables).collect()}
    assert got == {("a", "b"): (2, 1, 0.5), ("a", "none"): (0, 0, None), ("b", "a"): (2, 1, 0.5)}
    assert profile.containment(wanted.limit(0), tables).count() == 0


def test_described_tables_and_columns(spark, catalog, tags):
    rows = [
        ("orders", None, "Customer order transactions"),
        ("orders", "total_amount", "What was paid"),
        ("orders", "status", ""),
        ("products", "price", "List price"),
        ("gone", "x", "nothing"),
    ]
    described = spark.createDataFrame(rows, "table_name string, column_name string, description string")
    made = semantic.domain_contexts(catalog, tags, described)
    texts = {r.domain: r.search_text for r in semantic.search_text(made).collect()}
    assert "orders Customer order transactions sales orders revenue transactions order_id" in texts["sales"]
    assert "total_amount What was paid status" in texts["sales"] and "price List price" in texts["product"]
    short = {r.domain: r.search_text for r in semantic.search_text(made, with_columns=False).collect()}
    assert "Customer order transactions" in short["sales"] and "What was paid" not in short["sales"]


def test_contexts_survive_the_store(spark, catalog, tags, tmp_path):
    made = semantic.domain_contexts(catalog, tags)
    want = {r.domain: r for r in made.collect()}
    store = contexts.ContextStore(spark, str(tmp_path / "store"))
    assert store.vectors() is None
    for source in ("shop", "other"):
        store.replace(contexts.context_vectors(made, source, F.lit("2024-05-01 10:00:00")), [source])
    back = {r.domain: r for r in store.contexts("domains_shop").collect()}
    assert set(back) == set(want)
    for domain, row in back.items():
        for member in ("description", "keywords", "metrics", "dimensions", "tables", "glossary", "patterns", "confidence"):
            assert row[member] == want[domain][member]
        assert row.table_names == [t.table_name for t in want[domain].tables]
        assert row.business_tags == [g for t in want[domain].tables for g in t.tags]
        assert str(row.updated_at) == "2024-05-01 10:00:00" and row.auto_generated


def test_sources_are_replaced_whole(spark, catalog, tags, tmp_path):
    made = semantic.domain_contexts(catalog, tags)
    store = contexts.ContextStore(spark, str(tmp_path / "store"))
    both = contexts.context_vectors(made, "a").unionByName(contexts.context_vectors(made, "b"))
    store.replace(both, ["a", "b"])
    assert store.vectors().count() == 12
    # a keeps one context, b loses all; c is not named and stays out
    less = contexts.context_vectors(made.filter("domain = 'sales'"), "a")
    store.replace(less.unionByName(contexts.context_vectors(made, "c")), ["a", "b"])
    assert {(r.source, r.id) for r in store.vectors().select("source", "id").collect()} == {("a", "domain_sales_a")}
    assert {(r.source, r.version, r.contexts) for r in store.versions().collect()} == {("a", 2, 2), ("b", 2, 0)}
    # a replacement that broke off before its number was noted is not seen
    both.withColumns({"source": F.lit("a"), "written": F.lit("lost")}).write.mode("append").partitionBy(
        "source", "written"
    ).parquet(str(tmp_path / "store" / "vectors"))
    assert store.vectors().count() == 2
    store.replace(both, ["a"])
    assert store.vectors().count() == 6
