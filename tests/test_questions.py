import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import text as tx
from tallyhouse.operators import policy, questions, routing


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string")


SALES = "Show me total sales by region for last month"


def test_legacy_intent(spark):
    df = texts(spark, SALES, "Find all orders above $1000", "Why compare?", "top game", "show chart", "fetch")
    rows = questions.legacy_intent(df, "text").orderBy("id").collect()
    assert [(r.intent, r.confidence, r.use_bi) for r in rows] == [
        ("analytics", 0.8, True),
        ("other", 0.3, False),
        ("causal_analysis", 0.9, True),
        ("other", 0.3, True),
        ("visualization", 0.8, True),
        ("data_retrieval", 0.7, True),
    ]


def test_planner_intent(spark):
    df = texts(spark, SALES, "xyz", "monthly trend by quarter", "what sales performance", "dashboard chart plot")
    rows = questions.planner_intent(df, "text").orderBy("id").collect()
    assert [(r.intent, r.confidence, r.main_action) for r in rows] == [
        ("aggregation", 0.8, "general_query"),
        ("unknown", 0.3, "unknown"),
        ("trend", 0.8, "analyze_trends"),
        ("analytics", 0.8, "performance_analysis"),
        ("visualization", 0.9, "create_visualization"),
    ]
    assert rows[2].dimensions == ["time"] and rows[3].metrics == ["revenue"]
    assert [r.output_format for r in rows] == ["table", "table", "table", "table", "dashboard"]


def test_semantic_and_domain(spark):
    df = texts(spark, SALES, "Find all orders above $1000", "name it", "a plain sentence")
    rows = questions.keyword_domain(questions.semantic_intent(df, "text"), "text").orderBy("id").collect()
    assert rows[0].semantic_intent == "analytics"
    assert [(r.domain, r.domain_confidence) for r in rows] == [
        ("sales", 0.7),
        ("sales", 0.7),
        ("birth_names", 0.8),
        ("sales", 0.5),
    ]


def test_keywords(spark):
    df = texts(spark, "Give me unique insight on World Bank's Data", " 'Über'! ab  the\tTHE cats. ")
    rows = questions.extract_keywords(df, "text").orderBy("id").collect()
    assert rows[0].keywords == ["unique", "insight", "world", "bank's"]
    assert rows[1].keywords == ["über", "cats"]


def test_entities(spark):
    df = texts(spark, "sales and Price last  week, today, 2024-01-31: count rate")
    both = questions.extract_entities(df, "text").first()
    assert both.time_expressions == ["last  week", "2024-01-31", "today"]
    assert both.metric_expressions == ["sales", "Price", "count", "rate"]
    last = questions.extract_entities(df, "text", last_pattern=True).first()
    assert (last.time_expressions, last.metric_expressions) == (["today"], ["rate"])


def dataset_catalog(spark, *rows):
    return spark.createDataFrame(list(rows), "place int, id string, dashboard_title string, title string")


def slow_match(text, catalog):
    """Score of every dataset, keyword by keyword, in the catalog's order."""
    stop = set(questions.STOP_WORDS)
    said = [w.strip(".,!?;:'\"") for w in text.lower().split()]
    said = [w for w in said if w not in stop and len(w.encode()) > 2]
    best, most = (None, None), 0
    for _, id, first, second in sorted(catalog):
        title = (first if first is not None else second) or ""
        low = title.lower()
        score = sum(2 * (k in low) + sum(k in w or w in k for w in low.split()) for k in said)
        if score > most:
            best, most = (id, title), score
    return (*best, most)


def test_match_datasets(spark):
    rows = [
        (3, "a", "Slack Dashboard", None),
        (1, "b", None, "World Bank's Data"),
        (2, "c", "Video Game Sales", "ignored data"),
        (4, "d", "Sales", "x"),
        (5, "e", None, None),
        (6, "f", "", "sales sales"),
        (0, "g", "sales sales", None),
        (7, "h", "A de salesforce é日本語", None),
    ]
    asked = [
        "Give me unique insight on World Bank's Data",
        "sales of games",
        "sales sales of presales",
        "zzz",
        "the",
        "",
        "Déjà 日本 salesforce",
        "dashboards dashboards slack",
        "sales of games",
    ]
    df = texts(spark, *asked).repartition(3)
    found = routing.match_datasets(df, "text", dataset_catalog(spark, *rows).repartition(2), order="place")
    got = {r.id: (r.dataset_id, r.title, r.score) for r in found.collect()}
    assert got == {i: slow_match(t, rows) for i, t in enumerate(asked)}
    assert got[0] == ("b", "World Bank's Data", 6) and got[3] == (None, None, 0)
    empty = routing.match_datasets(df, "text", dataset_catalog(spark), order="place")
    assert {(r.dataset_id, r.score) for r in empty.collect()} == {(None, 0)}


def test_match_datasets_keeps_titles_out_of_the_plan(spark):
    rows = [(i, f"d{i}", f"title number{i} of area{i % 50}", None) for i in range(3000)]
    catalog = dataset_catalog(spark, *rows)
    asked = ["area7 number77", "area49", "number2999 area1"]
    found = routing.match_datasets(texts(spark, *asked), "text", catalog, order="place")
    assert {r.id: r.dataset_id for r in found.collect()} == {
        i: slow_match(t, rows)[0] for i, t in enumerate(asked)
    }
    assert "number77" not in found._jdf.queryExecution().optimizedPlan().toString()


def shuffled_rows(df):
    """Rows that each shuffle of a table's plan has written."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name == "Exchange":
            yield node.metrics().apply("shuffleRecordsWritten").value()
        below = node.children()
        parts = [below.apply(i) for i in range(below.size())]
        if name == "AdaptiveSparkPlan":
            parts = [node.executedPlan()]
        elif name.endswith("QueryStage"):
            parts = [node.plan()]
        for part in parts:
            yield from walk(part)

    return list(walk(df._jdf.queryExecution().executedPlan()))


def test_match_datasets_shuffles_questions_and_not_their_titles(spark):
    rows = [(i, f"d{i}", f"red area number{i}", None) for i in range(60)]
    asked = [f"reddish{i} area{i} zz{i}" for i in range(400)] + ["number5 area", "number5 number5 red", "zz1"]
    found = routing.match_datasets(texts(spark, *asked), "text", dataset_catalog(spark, *rows), order="place")
    assert 0 < max(shuffled_rows(found)) < 2 * len(asked)
    got = {r.id: (r.dataset_id, r.title, r.score) for r in found.collect()}
    assert got == {i: slow_match(t, rows) for i, t in enumerate(asked)}


def test_dataset_rows(spark):
    catalog = dataset_catalog(spark, (2, "a", "second", None), (1, "a", "first", "x"), (3, "b", None, "y"))
    wanted = spark.createDataFrame([(1, "a"), (2, "b"), (3, "gone"), (4, None)], "n int, want string")
    got = {r.n: r.dataset for r in routing.dataset_rows(wanted, "want", catalog, order="place").collect()}
    assert got[1].dashboard_title == "first" and got[2].title == "y"
    assert got[3] is None and got[4] is None


def sources(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, type string, status string")


def test_requests_are_split_row_by_row(spark):
    """Rows that share a key, or have none, and a registry of more than 1000 sources."""
    known = sources(spark, *[(f"s{i}", "postgres", "connected") for i in range(1200)])
    rows = [(1, "x", ["s7"]), (1, "x", ["gone"]), (None, "x", ["s8", "s8"])]
    df = spark.createDataFrame(rows, "id int, text string, want array<string>")
    got = [(r.id, r.source_id) for r in routing.route_queries(df, "id", "text", known, "want").collect()]
    assert got.count((1, "s7")) == 2 and (None, "s8") in got
    assert len(got) == 1 + 1200 + 1


def test_routing(spark):
    known = sources(
        spark,
        ("bi", "superset", "connected"),
        ("db", "postgres", "connected"),
        ("old", "postgres", "disconnected"),
    )
    df = texts(spark, "show dashboard", "list orders", "hello", "orders please").withColumn(
        "want", F.when(F.col("id") == 3, F.array(F.lit("bi"), F.lit("old"))).otherwise(F.array(F.lit("old")))
    )
    rows = routing.route_queries(df, "id", "text", known, "want").collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, set()).add(r.source_id)
    assert got == {0: {"bi"}, 1: {"db"}, 2: {"bi", "db"}, 3: {"bi"}}
    planned = questions.planner_intent(texts(spark, "plot chart", "select from x", "zzz"), "text")
    rows = routing.route_by_intent(planned, "id", "intent", "main_action", known).collect()
    assert {(r.id, r.source_id, r.priority) for r in rows} == {
        (0, "bi", 0),
        (0, "db", 1),
        (1, "db", 0),
        (2, "bi", 0),
        (2, "db", 0),
    }
    nothing = sources(spark, ("old", "postgres", "disconnected"))
    assert routing.route_queries(df, "id", "text", nothing).isEmpty()


REPLIES = [
    ('so {"type": "trend", "confidence": 0.9} ok', True, "trend", 0.9),
    ('{"type": 5, "confidence": "0.9"}', True, "", 0.0),
    ('{"type": "sql"} {"confidence": 1}', False, "unknown", 0.3),
    ('{"a": 1}, {"b": 2}', False, "unknown", 0.3),
    ('{"type": "sql"}], [{"b": 2}', False, "unknown", 0.3),
    ('{"type": "sql"}}, {"b": 2}', False, "unknown", 0.3),
    ("no json } {", False, "unknown", 0.3),
    ("", False, "unknown", 0.3),
]


def test_parse_intent_json(spark):
    df = spark.createDataFrame([(i, r[0], "xyz") for i, r in enumerate(REPLIES)], "id int, reply string, q string")
    rows = questions.parse_intent_json(df, "reply", "q").orderBy("id").collect()
    assert [(r.from_reply, r.intent, r.confidence) for r in rows] == [r[1:] for r in REPLIES]


def test_mine_chart_rows(spark):
    replies = ['[{"a": 1}]', "[1, 2]", "[]", '[{"a": 1}] and more', '{"a": 1}', ' \n[{"a": "x"}, {"a": 2.5}]\n']
    df = spark.createDataFrame(list(enumerate(replies)), "id int, reply string")
    got = {}
    for r in questions.mine_chart_rows(df, "reply").orderBy("id", "row_no").collect():
        got.setdefault(r.id, []).append(r.row)
    fallback = [{"category": f"Insight {i}", "value": v} for i, v in ((1, "100"), (2, "75"), (3, "50"))]
    assert got == {
        0: [{"a": "1"}],
        1: fallback,
        3: fallback,
        4: fallback,
        5: [{"a": "x"}, {"a": "2.5"}],
    }


def test_mine_questions(spark):
    df = spark.createDataFrame([(1, "short?\n  what is the total\nplain long line\nshow all of it")], "id int, reply string")
    rows = questions.mine_questions(df, "reply").orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in rows] == [(1, "what is the total"), (3, "show all of it")]


def test_text_functions(spark):
    df = spark.createDataFrame([("\x00 a\tb\nc\x7f\u0085 ", "total_sales")], "t string, n string")
    row = df.select(
        tx.sanitise(F.col("t")).alias("clean"),
        tx.fingerprint("sql", F.col("n")).alias("key"),
        tx.title_case(F.replace(F.col("n"), F.lit("_"), F.lit(" "))).alias("title"),
        tx.singular(F.col("n")).alias("one"),
    ).first()
    assert row.clean == "abc"
    assert row.title == "Total Sales" and row.one == "total_sale"
    import hashlib

    assert row.key == "sql:" + hashlib.sha256(b"sqltotal_sales").hexdigest()[:16]


# Statements with the verdicts that the policy has to give.
POLICY_CASES = [
    ("SELECT * FROM users", "ok"),
    ("SELECT id, name FROM users WHERE active = true", "ok"),
    ("SELECT u.id, u.name FROM users u JOIN orders o ON u.id = o.user_id", "ok"),
    ("SELECT 1 as test_connection", "ok"),
    ("SELECT * FROM users; DROP TABLE users;--", "dangerous"),
    ("SELECT * FROM users WHERE id = 1 UNION SELECT * FROM passwords", "ok"),
    ("SELECT * FROM users WHERE id = 1-- AND active = true", "dangerous"),
    ("DELETE FROM users WHERE id = 1", "dangerous"),
    ("INSERT INTO users (name) VALUES ('hacker')", "dangerous"),
    ("UPDATE users SET role = 'admin' WHERE id = 1", "dangerous"),
    ("DROP TABLE users", "dangerous"),
    ("ALTER TABLE users ADD COLUMN hacked boolean", "dangerous"),
    ("CREATE TABLE backdoor (id int)", "dangerous"),
    ("EXEC sp_executesql N'SELECT * FROM users'", "dangerous"),
    ("SELECT pg_sleep(10)", "dangerous"),
    ("COPY users TO '/tmp/users.csv'", "dangerous"),
    ("SELECT * FROM information_schema.tables", "dangerous"),
    ("", "invalid"),
    ("SELECT " + "\x00" * 10001, "too_long"),
    ("SELECT * FROM users; SELECT * FROM orders", "dangerous"),
    ("SELECT * FROM users /* WHERE id = 1 */ WHERE id = 2", "dangerous"),
    ("SELECT * FROM users;", "ok"),
    ("SELECT a,\n b\nFROM t", "invalid"),
    ("SELECT created_at FROM t", "dangerous"),
    ("SELECT 1\n", "ok"),
    ("SELECT now()", "invalid"),
    ("   ", "invalid"),
    ("WITH x AS (SELECT 1) SELECT * FROM x", "dangerous"),
]


def test_policy(spark):
    df = texts(spark, *[c[0] for c in POLICY_CASES])
    rows = policy.audit(df, "text").orderBy("id").collect()
    assert [(r.text[:60], r.verdict) for r in rows] == [(t[:60], v) for t, v in POLICY_CASES]


def test_request_checks(spark):
    df = texts(spark, "", "select 1", " SELECT shutdown", "x" * 1001, "a -- b", "update x", "y" * 2001)
    both = policy.check_requests(df, "text").withColumnRenamed("verdict", "sql")
    rows = policy.check_questions(both, "text").orderBy("id").select("sql", "verdict")
    assert [tuple(r) for r in rows.collect()] == [
        ("invalid", "invalid"),
        ("ok", "ok"),
        ("suspicious", "ok"),
        ("bad_format", "too_long"),
        ("bad_format", "suspicious"),
        ("bad_format", "ok"),
        ("too_long", "too_long"),
    ]


def test_guarded_sql(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert policy.guarded_sql(spark, "SELECT id FROM three;").count() == 3
    with pytest.raises(PermissionError):
        policy.guarded_sql(spark, "DROP VIEW three")


def test_name_and_id(spark):
    df = texts(spark, "", "My source-1_b", "bad#", "n" * 101, "a\n")
    rows = df.orderBy("id").select(policy.name_verdict(F.col("text"))).collect()
    assert [r[0] for r in rows] == ["invalid", "ok", "bad_format", "too_long", "ok"]
    uuid = "123e4567-e89b-42d3-a456-426614174000"
    df = texts(spark, uuid, uuid.upper(), uuid + "\n")
    rows = df.orderBy("id").select(policy.id_verdict(F.col("text"))).collect()
    assert [r[0] for r in rows] == ["ok", "bad_format", "bad_format"]


def test_guarded_sql_reads_listed_views_only(spark, tmp_path):
    path = str(tmp_path / "files")
    spark.range(5).write.parquet(path)
    spark.range(7).createOrReplaceTempView("hidden")
    views = {"Shown": spark.read.parquet(path).withColumnRenamed("id", "n"), "more": spark.range(3)}
    run = lambda sql: policy.guarded_sql(spark, sql, views).collect()
    assert len(run("SELECT n FROM shown WHERE n > (SELECT max(id) FROM more) ")) == 2
    assert len(run("SELECT s.n FROM shown s JOIN more m ON s.n = m.id;")) == 3
    assert run("SELECT 1 + 1 as two")[0].two == 2
    refused = [
        "SELECT * FROM hidden",
        "SELECT * FROM shown JOIN hidden ON id = n",
        "SELECT * FROM shown WHERE n IN (SELECT id FROM hidden)",
        "SELECT (SELECT max(id) FROM hidden) FROM shown",
        f"SELECT * FROM parquet.`{path}` JOIN shown",
        "SELECT * FROM range(10)",
        "SELECT * FROM shown WHERE EXISTS (SELECT 1 FROM hidden WHERE hidden.id = shown.n)",
    ]
    for sql in refused:
        with pytest.raises(PermissionError):
            run(sql)


def test_requested_sources_come_before_the_intent(spark):
    known = sources(spark, ("bi", "superset", "connected"), ("db", "postgres", "connected"), ("old", "postgres", "error"))
    planned = questions.planner_intent(texts(spark, "plot chart", "select from x", "select from x"), "text")
    wanted = planned.withColumn(
        "want", F.when(F.col("id") == 1, F.array(F.lit("bi"))).when(F.col("id") == 2, F.array(F.lit("old")))
    )
    rows = routing.route_by_intent(wanted, "id", "intent", "main_action", known, "want").collect()
    assert {(r.id, r.source_id, r.priority) for r in rows} == {(0, "bi", 0), (0, "db", 1), (1, "bi", 0), (2, "db", 0)}


def test_source_by_id(spark):
    from tallyhouse.sources.registry import source_by_id

    known = sources(spark, ("bi", "superset", "connected"), ("db", "postgres", "error"))
    wanted = spark.createDataFrame([(1, "db"), (2, "gone"), (3, None)], "n int, want string")
    got = {r.n: r.source for r in source_by_id(known, wanted, "want").collect()}
    assert got[1].type == "postgres" and got[2] is None and got[3] is None


def test_hidden_and_broken_tables(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from tallyhouse.sources.tables import Warehouse, column_listing

    (tmp_path / "broken.parquet").mkdir()
    assert Warehouse(spark, str(tmp_path)).find("gone") is None
    with pytest.raises(AnalysisException):
        Warehouse(spark, str(tmp_path)).find("broken")
    failing = spark.range(3).select(F.raise_error(F.lit("read")).alias("x"))
    listed = column_listing({"pg_x": failing, "shop": spark.range(2), "sql_a": failing})
    assert [(r.table_name, r.n_nonnull) for r in listed.collect()] == [("shop", 2)]
