"""Question, policy, routing and history queries.

The questions are one per order, worded after the order's priority and status,
together with every conversation turn. Statements, replies and the query log
are laid out from orders and events in the same way.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse.functions import text as tx
from tallyhouse.operators import analysis, history, policy, questions, routing
from tallyhouse.sources.tables import union_sources
from workload.base import plain, query

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]
QUESTIONS = [
    "Why did revenue drop for customer {c} last month?",
    "Compare sales of customer {c} versus last quarter, between regions",
    "Show me total sales by region for last month",
    "Find all orders above ${k}",
    "Give me unique insight on World Bank's Data",
    "What are the top selling games on each platform since {d}?",
    "Show Slack channel messages, growth over time, monthly",
    "Create a dashboard chart of weekly orders: price and quantity",
    "SELECT name FROM customers WHERE id = {c}",
    "How many covid vaccine doses today and yesterday, percentage per state",
    "List active users this week",
    "budget vs expense trend, quarterly, {d}",
    "Is the finance performance kpi better? explain the ratio",
    "birth names population, 'demographics' summary!",
    "display supplier inventory; only include amount greater than {k}",
]
STATEMENTS = [
    "SELECT * FROM orders WHERE id = {k}",
    "SELECT id, name FROM users WHERE active = true;",
    "SELECT {k} as test_connection",
    "SELECT * FROM users; DROP TABLE users;--",
    "SELECT * FROM users WHERE id = {c} UNION SELECT * FROM passwords",
    "DELETE FROM users WHERE id = {c}",
    "SELECT id,\n name\nFROM users",
    "  select u.id from users u join orders o on u.id = o.user_id  ",
    "SELECT created_at FROM users WHERE id = {c}",
    "SELECT pg_sleep({c})",
    "SELECT * FROM users; SELECT * FROM orders",
    "SELECT * FROM information_schema.tables",
    "WITH t AS (SELECT 1) SELECT * FROM t",
    "SELECT nothing",
    "SELECT * FROM users /* WHERE id = {k} */ WHERE id = 2",
]
REPLIES = {
    "view": 'Here it is: {"type": "trend", "confidence": 0.9, "props": {p}} as asked.',
    "signup": "No json at all.\n  Would you like to show user {u}?\nshort?\nwhat about event {e}, then",
    "error": '{"type": 5, "confidence": "high"}',
    "click": '[{"age_group": "30-49", "percentage": {u}}, {"age_group": "16-29", "percentage": 20}]',
    "purchase": 'Two parts {"type": "sql"} and {"confidence": 1}',
}

CASES = [(p, s) for p in PRIORITIES for s in STATUSES]


def worded(templates: list[str]):
    text = None
    for (priority, status), template in zip(CASES, templates):
        test = (F.col("o_orderpriority") == priority) & (F.col("o_orderstatus") == status)
        text = F.when(test, template) if text is None else text.when(test, template)
    for mark, value in (
        ("{c}", F.col("o_custkey").cast("string")),
        ("{k}", F.col("o_orderkey").cast("string")),
        ("{d}", F.col("o_orderdate").cast("date").cast("string")),
    ):
        text = F.replace(text, F.lit(mark), value)
    return text


def worded_sql(templates: list[str]) -> str:
    def quote(text):
        return text.replace("'", "''")

    cases = " ".join(
        f"WHEN o_orderpriority = '{p}' AND o_orderstatus = '{s}' THEN '{quote(t)}'"
        for (p, s), t in zip(CASES, templates)
    )
    return (
        f"replace(replace(replace(CASE {cases} END, '{{c}}', o_custkey::VARCHAR), "
        "'{k}', o_orderkey::VARCHAR), '{d}', CAST(CAST(o_orderdate AS DATE) AS VARCHAR))"
    )


def question_log(wh):
    asked = wh.table("orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey")).alias("id"), worded(QUESTIONS).alias("text")
    )
    turns = wh.table("conversations").select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("id"), "text"
    )
    return asked.unionByName(turns)


QUESTION_SQL = f"""questions AS (SELECT 'o' || o_orderkey AS id, {worded_sql(QUESTIONS)} AS text FROM orders
    UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations)"""


def statement_log(wh):
    sent = wh.table("orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey")).alias("id"), worded(STATEMENTS).alias("text")
    )
    texts = wh.table("documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text")
    return sent.unionByName(texts)


STATEMENT_SQL = f"""statements AS (SELECT 'o' || o_orderkey AS id, {worded_sql(STATEMENTS)} AS text FROM orders
    UNION ALL SELECT 'd' || doc_id, text FROM documents)"""


def reply_log(wh):
    text = None
    for kind, template in REPLIES.items():
        test = F.col("event_type") == kind
        text = F.when(test, template) if text is None else text.when(test, template)
    for mark, column in (("{p}", "props"), ("{u}", "user_id"), ("{e}", "event_id")):
        text = F.replace(text, F.lit(mark), F.col(column).cast("string"))
    asked = F.concat(F.lit("monthly growth of "), F.col("event_type"))
    return wh.table("events").select("event_id", text.alias("reply"), asked.alias("question"))


REPLY_SQL = (
    "replies AS (SELECT event_id, 'monthly growth of ' || event_type AS question, "
    "replace(replace(replace(CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in REPLIES.items())
    + " END, '{p}', props), '{u}', user_id::VARCHAR), '{e}', event_id::VARCHAR) AS reply FROM events)"
)


def any_sql(words, column="q"):
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def rules_sql(rules, default, column="q"):
    cases = " ".join(f"WHEN {any_sql(words, column)} THEN {value}" for value, words in rules)
    return f"CASE {cases} ELSE {default} END"


LOWERED_SQL = f"WITH {QUESTION_SQL}, l AS (SELECT id, lower(text) AS q FROM questions) "
LEGACY_SQL = rules_sql([(f"'{n}'", w) for n, _, w in questions.LEGACY_INTENTS], "'other'")


@query(
    "intent_legacy",
    LOWERED_SQL
    + f"""SELECT id, {LEGACY_SQL} AS intent,
        {rules_sql([(f"{c}::DOUBLE", w) for _, c, w in questions.LEGACY_INTENTS], "0.3::DOUBLE")} AS confidence,
        {LEGACY_SQL} <> 'other' OR {any_sql(questions.GAME_WORDS)} AS use_bi FROM l""",
)
def intent_legacy(wh):
    return questions.legacy_intent(question_log(wh), "text").drop("text")


@query(
    "intent_semantic",
    LOWERED_SQL
    + f"""SELECT id, {rules_sql([(f"'{n}'", w) for n, w in questions.SEMANTIC_INTENTS], "'analytics'")}
        AS semantic_intent FROM l""",
)
def intent_semantic(wh):
    return questions.semantic_intent(question_log(wh), "text").drop("text")


def planner_sql(source: str, key: str, text: str) -> str:
    """Planner intents of a table, over one row per (question, intent)."""
    counts = ", ".join(
        f"({', '.join([str(i), chr(39) + n + chr(39)])}, {' + '.join(f'contains(q, {chr(39)}{w}{chr(39)})::INT' for w in words)})"
        for i, (n, words) in enumerate(questions.PLANNER_INTENTS.items())
    )
    return f"""scored AS (
        SELECT s.{key}, s.q, arg_max(c.name, c.n * 10 - c.i) AS top, max(c.n) AS best
        FROM (SELECT {key}, lower({text}) AS q FROM {source}) s,
             LATERAL (SELECT * FROM (VALUES {counts}) AS v(i, name, n)) c
        GROUP BY s.{key}, s.q),
      kinds AS (SELECT {key}, q, best, CASE WHEN best = 0 THEN 'unknown' ELSE top END AS intent FROM scored),
      planned AS (SELECT {key}, intent,
        CASE best WHEN 0 THEN 0.3::DOUBLE WHEN 1 THEN 0.7::DOUBLE WHEN 2 THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END AS confidence,
        CASE intent WHEN 'visualization' THEN 'create_visualization'
          WHEN 'comparison' THEN CASE WHEN {any_sql(["between", "vs", "versus"])} THEN 'comparative_analysis' ELSE 'compare_data' END
          WHEN 'trend' THEN 'analyze_trends' WHEN 'sql' THEN 'execute_sql'
          WHEN 'analytics' THEN CASE WHEN {any_sql(["performance", "kpi"])} THEN 'performance_analysis' ELSE 'analyze_data' END
          WHEN 'unknown' THEN 'unknown' ELSE 'general_query' END AS main_action,
        CASE WHEN intent = 'visualization' THEN CASE WHEN contains(q, 'dashboard') THEN 'dashboard' ELSE 'chart' END
             ELSE 'table' END AS output_format,
        CASE WHEN intent = 'trend' AND {any_sql(["quarter", "monthly", "weekly"])} THEN 'time' ELSE '' END AS dimensions,
        CASE WHEN intent = 'analytics' AND {any_sql(["sales", "revenue"])} THEN 'revenue' ELSE '' END AS metrics
      FROM kinds)"""


@query(
    "intent_planner",
    f"WITH {QUESTION_SQL}, {planner_sql('questions', 'id', 'text')} SELECT * FROM planned",
)
def intent_planner(wh):
    return plain(questions.planner_intent(question_log(wh), "text").drop("text"))


@query(
    "domain_keyword",
    LOWERED_SQL
    + f"""SELECT id, {rules_sql([(f"'{n}'", w) for n, _, w in questions.KEYWORD_DOMAINS], "'sales'")} AS domain,
        {rules_sql([(f"{c}::DOUBLE", w) for _, c, w in questions.KEYWORD_DOMAINS], "0.5::DOUBLE")}
        AS domain_confidence FROM l""",
)
def domain_keyword(wh):
    return questions.keyword_domain(question_log(wh), "text").drop("text")


KEYWORDS_SQL = f"""list_filter(list_transform(list_filter(
      string_split_regex(lower(text), '[\\s\\x0B\\x{{85}}\\p{{Z}}]+'), lambda w: w <> ''),
      lambda w: trim(w, '.,!?;:''"')),
      lambda w: w NOT IN ({", ".join(f"'{w}'" for w in questions.STOP_WORDS)}) AND strlen(w) > 2)"""


@query(
    "business_keywords",
    LOWERED_SQL
    + "SELECT id, array_to_string(list_filter(["
    + ", ".join(f"'{w}'" for w in questions.BUSINESS_KEYWORDS)
    + "], lambda w: contains(q, w)), '|') AS keywords FROM l",
)
def business_keywords(wh):
    return plain(questions.business_keywords(question_log(wh), "text").drop("text"))


@query(
    "extract_keywords",
    f"""WITH {QUESTION_SQL}, d AS (SELECT id, text FROM questions
          UNION ALL SELECT 'd' || doc_id, text FROM documents)
        SELECT id, array_to_string({KEYWORDS_SQL}, '|') AS keywords FROM d""",
)
def extract_keywords(wh):
    texts = question_log(wh).unionByName(
        wh.table("documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text")
    )
    return plain(questions.extract_keywords(texts, "text").drop("text"))


DASHBOARDS = [
    "World Bank's Data",
    "Video Game Sales",
    "Sales by Region",
    "Orders and Customers",
    "Slack Dashboard",
    "COVID Vaccine Dashboard",
    "USA Births Names",
    "Weekly Revenue Trend",
    "Supplier Inventory",
    "Finance Budget",
]


DASHBOARD_ROWS = ", ".join(
    "(%d, 'board%d', %s, %s)" % ((i, i) + ((f"'{q}'", "NULL") if i % 2 else ("NULL", f"'{q}'")))
    for i, q in enumerate(t.replace("'", "''") for t in DASHBOARDS)
)
DASHBOARD_SQL = f"""boards AS (SELECT * FROM (VALUES {DASHBOARD_ROWS}) v(place, id, dashboard_title, title)
    UNION ALL SELECT 100 + n_nationkey, 'nation' || n_nationkey, 'Orders of ' || n_name, NULL FROM nation
    UNION ALL SELECT 1000 + p_partkey, 'part' || p_partkey, NULL, p_type || ' ' || p_name FROM part)"""


def dashboards(wh):
    """Titled boards, one per nation and part; every second fixed one has its title in another column."""
    fixed = [(i, f"board{i}", t if i % 2 else None, None if i % 2 else t) for i, t in enumerate(DASHBOARDS)]
    schema = "place long, id string, dashboard_title string, title string"
    place, text = F.col("n_nationkey"), F.lit(None).cast("string")
    of_nations = wh.table("nation").select(
        (place + 100).cast("long").alias("place"),
        F.concat(F.lit("nation"), place).alias("id"),
        F.concat(F.lit("Orders of "), "n_name").alias("dashboard_title"),
        text.alias("title"),
    )
    of_parts = wh.table("part").select(
        (F.col("p_partkey") + 1000).cast("long").alias("place"),
        F.concat(F.lit("part"), "p_partkey").alias("id"),
        text.alias("dashboard_title"),
        F.concat_ws(" ", "p_type", "p_name").alias("title"),
    )
    return wh.spark.createDataFrame(fixed, schema).unionByName(of_nations).unionByName(of_parts)


@query(
    "match_datasets",
    f"""WITH {QUESTION_SQL}, {DASHBOARD_SQL}, k AS (SELECT id, unnest({KEYWORDS_SQL}) AS k FROM questions),
       t AS (SELECT id AS dataset_id, place AS n, coalesce(dashboard_title, title) AS title FROM boards),
       c AS (SELECT k, n, dataset_id, title, lower(title) AS low, string_split(lower(title), ' ') AS ws
             FROM (SELECT DISTINCT k FROM k), t),
       p AS (SELECT k, n, dataset_id, title, 2 * contains(low, k)::INT
               + len(list_filter(ws, lambda w: contains(w, k) OR contains(k, w))) AS p FROM c),
       s AS (SELECT id, n, dataset_id, title, sum(p) AS score FROM k JOIN p USING (k) WHERE p > 0 GROUP BY 1, 2, 3, 4),
       b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, n) AS r FROM s)
       SELECT q.id, b.dataset_id, b.title, CAST(coalesce(b.score, 0) AS BIGINT) AS score
       FROM questions q LEFT JOIN b ON b.id = q.id AND b.r = 1""",
)
def match_datasets(wh):
    return plain(routing.match_datasets(question_log(wh), "text", dashboards(wh), order="place").drop("text"))


@query(
    "dataset_by_id",
    f"""WITH {DASHBOARD_SQL} SELECT o_orderkey, b.id IS NOT NULL AS found, b.id AS dataset_id,
         coalesce(b.dashboard_title, b.title) AS title
       FROM orders LEFT JOIN boards b ON b.id = 'part' || (o_custkey * 3)""",
)
def dataset_by_id(wh):
    """The board that each order's customer asks for by id, if there is one."""
    asked = wh.table("orders").select("o_orderkey", F.concat(F.lit("part"), F.col("o_custkey") * 3).alias("want"))
    found = routing.dataset_rows(asked, "want", dashboards(wh), order="place")
    return found.select(
        "o_orderkey",
        F.col("dataset").isNotNull().alias("found"),
        F.col("dataset.id").alias("dataset_id"),
        F.coalesce("dataset.dashboard_title", "dataset.title").alias("title"),
    )


def entity_sql(patterns):
    return "array_to_string(flatten([" + ", ".join(
        f"regexp_extract_all(text, '(?i){p}')" for p, _ in patterns
    ) + "]), '|')"


def last_sql(patterns):
    parts = [f"nullif(array_to_string(regexp_extract_all(text, '(?i){p}'), '|'), '')" for p, _ in reversed(patterns)]
    return f"coalesce({', '.join(parts)}, '')"


@query(
    "extract_entities",
    f"""WITH {QUESTION_SQL} SELECT id, {entity_sql(questions.TIME_PATTERNS)} AS time_expressions,
        {entity_sql(questions.METRIC_PATTERNS)} AS metric_expressions FROM questions""",
)
def extract_entities(wh):
    return plain(questions.extract_entities(question_log(wh), "text").drop("text"))


@query(
    "extract_entities_last",
    f"""SELECT doc_id, {last_sql(questions.TIME_PATTERNS)} AS time_expressions,
        {last_sql(questions.METRIC_PATTERNS)} AS metric_expressions FROM documents""",
)
def extract_entities_last(wh):
    texts = wh.table("documents").select("doc_id", "text")
    return plain(questions.extract_entities(texts, "text", last_pattern=True).drop("text"))


TEMPLATE_SQL = rules_sql([(f"'{n}'", w) for n, w in questions.TEMPLATES], "'catalog_columns'")
BOARD_SQL = rules_sql(
    [(f"'{n}'", w) for n, w in questions.DASHBOARD_TEMPLATES], "'catalog_columns'", "text"
)


@query(
    "select_template",
    f"""WITH {QUESTION_SQL}, l AS (SELECT id, text, lower(text) AS q FROM questions)
        SELECT id, {TEMPLATE_SQL} AS template, {BOARD_SQL} AS dashboard_template FROM l""",
)
def select_template(wh):
    chosen = questions.select_template(question_log(wh), "text").withColumnRenamed("template", "t")
    return questions.select_dashboard_template(chosen, "text").select(
        "id", F.col("t").alias("template"), F.col("template").alias("dashboard_template")
    )


JSON_SQL = "regexp_extract(reply, '(?s)\\{.*\\}')"


@query(
    "parse_intent_json",
    f"""WITH {REPLY_SQL}, {planner_sql('replies', 'event_id', 'question')},
       j AS (SELECT event_id, CASE WHEN json_valid({JSON_SQL}) AND {JSON_SQL} <> '' THEN {JSON_SQL} END AS j FROM replies)
       SELECT event_id, j IS NOT NULL AS from_reply,
         CASE WHEN j IS NULL THEN intent WHEN json_type(j, '$.type') = 'VARCHAR' THEN j->>'$.type' ELSE '' END AS intent,
         CASE WHEN j IS NULL THEN confidence WHEN json_type(j, '$.confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT')
              THEN CAST(j->>'$.confidence' AS DOUBLE) ELSE 0 END AS confidence,
         CASE WHEN j IS NULL THEN main_action ELSE 'llm_classified' END AS main_action
       FROM j JOIN planned USING (event_id)""",
)
def parse_intent_json(wh):
    return questions.parse_intent_json(reply_log(wh), "reply", "question").drop("reply", "question")


@query(
    "mine_questions",
    f"""WITH {REPLY_SQL}, t AS (SELECT 'r' || event_id AS id, reply AS text FROM replies
            UNION ALL SELECT 'd' || doc_id, text FROM documents),
       l AS (SELECT id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM t),
       s AS (SELECT id, line_no, trim(line, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)) AS line FROM l)
       SELECT id, CAST(line_no AS BIGINT) AS line_no, line FROM s WHERE strlen(line) > 10
         AND (contains(line, '?') OR contains(line, 'show') OR contains(line, 'what'))""",
)
def mine_questions(wh):
    replies = reply_log(wh).select(
        F.concat(F.lit("r"), F.col("event_id")).alias("id"), F.col("reply").alias("text")
    )
    documents = wh.table("documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text")
    return plain(questions.mine_questions(replies.unionByName(documents), "text"))


@query(
    "mine_chart_rows",
    f"""WITH {REPLY_SQL}
       SELECT event_id, CAST(0 AS BIGINT) AS row_no, '30-49' AS label, user_id::VARCHAR AS amount
         FROM events WHERE event_type = 'click'
       UNION ALL SELECT event_id, 1, '16-29', '20' FROM events WHERE event_type = 'click'
       UNION ALL SELECT event_id, i, 'Insight ' || (i + 1), (100 - 25 * i)::VARCHAR
         FROM events, range(3) AS r(i) WHERE event_type <> 'click'""",
)
def mine_chart_rows(wh):
    rows = questions.mine_chart_rows(reply_log(wh).drop("question"), "reply")
    return plain(
        rows.select(
            "event_id",
            "row_no",
            F.coalesce(F.col("row")["age_group"], F.col("row")["category"]).alias("label"),
            F.coalesce(F.col("row")["percentage"], F.col("row")["value"]).alias("amount"),
        )
    )


CONTROL_SQL = "[\\x00-\\x1f\\x7f-\\x{9f}]"


@query(
    "sanitize_text",
    f"""WITH t AS (SELECT 'd' || doc_id AS id, text FROM documents
            UNION ALL SELECT 'p' || page_id, html FROM pages)
       SELECT id, trim(regexp_replace(text, '{CONTROL_SQL}', '', 'g'), ' ' || chr(160) || chr(12288)) AS clean FROM t""",
)
def sanitize_text(wh):
    documents = wh.table("documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text")
    pages = wh.table("pages").select(F.concat(F.lit("p"), F.col("page_id")).alias("id"), F.col("html").alias("text"))
    return documents.unionByName(pages).select("id", tx.sanitise(F.col("text")).alias("clean"))


@query(
    "query_fingerprint",
    "SELECT doc_id, 'query:' || substr(sha256('query' || lang || text), 1, 16) AS cache_key FROM documents",
)
def query_fingerprint(wh):
    key = tx.fingerprint("query", F.col("lang"), F.col("text"))
    return wh.table("documents").select("doc_id", key.alias("cache_key"))


# --- policy --------------------------------------------------------------


def like_any(words, column):
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


SHAPE_SQL = policy.FROM_SHAPE
CONSTANT_SQL = policy.CONSTANT_SHAPE


@query(
    "sql_policy_audit",
    f"""WITH {STATEMENT_SQL}, s AS (SELECT id, text,
           trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)) AS body FROM statements),
       u AS (SELECT *, upper(body) AS up,
               CASE WHEN ends_with(body, ';') THEN left(body, length(body) - 1) ELSE body END AS inside FROM s)
       SELECT id, CASE WHEN strlen(text) > 10000 THEN 'too_long' WHEN body = '' THEN 'invalid'
           WHEN NOT starts_with(up, 'SELECT') THEN 'dangerous'
           WHEN {like_any(policy.DANGEROUS_PARTS, 'up')} THEN 'dangerous'
           WHEN contains(inside, ';') THEN 'dangerous'
           WHEN NOT (regexp_matches(body, '{SHAPE_SQL}') OR regexp_matches(body, '{CONSTANT_SQL}')) THEN 'invalid'
           ELSE 'ok' END AS verdict,
         array_to_string(list_filter([{", ".join(f"'{w}'" for w in policy.DANGEROUS_PARTS)}],
           lambda w: contains(upper(text), w)), '|') AS refused_parts
       FROM u""",
)
def sql_policy_audit(wh):
    return plain(policy.audit(statement_log(wh), "text").drop("text"))


@query(
    "guarded_sql",
    """SELECT o_orderpriority AS priority, count(*) AS n, CAST(sum(o_totalprice::DECIMAL(18,2)) AS DOUBLE) AS total
       FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN
         (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 1""",
)
def guarded_sql(wh):
    """A statement over three listed views, through the gate."""
    statement = """SELECT o_orderpriority AS priority, count(*) AS n,
            CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN
          (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY o_orderpriority"""
    views = {t: wh.table(t) for t in ("orders", "customer", "nation")}
    return policy.guarded_sql(wh.spark, " ".join(statement.split()), views)


@query(
    "sql_request_check",
    f"""WITH {STATEMENT_SQL} SELECT id, CASE WHEN text = '' THEN 'invalid'
         WHEN strlen(text) > 2000 THEN 'too_long'
         WHEN NOT starts_with(upper(trim(text, ' ' || chr(9) || chr(10) || chr(13))), 'SELECT') THEN 'bad_format'
         WHEN {like_any(policy.REQUEST_PARTS, 'upper(text)')} THEN 'suspicious' ELSE 'ok' END AS verdict
       FROM statements""",
)
def sql_request_check(wh):
    return policy.check_requests(statement_log(wh), "text").drop("text")


@query(
    "text_request_check",
    f"""WITH t AS (SELECT 'd' || doc_id AS id, text FROM documents
            UNION ALL SELECT 'p' || page_id, html FROM pages
            UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations)
       SELECT id, CASE WHEN text = '' THEN 'invalid' WHEN strlen(text) > 1000 THEN 'too_long'
         WHEN {like_any(policy.SUSPICIOUS_PARTS, 'lower(text)')} THEN 'suspicious' ELSE 'ok' END AS verdict FROM t""",
)
def text_request_check(wh):
    documents = wh.table("documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text")
    pages = wh.table("pages").select(F.concat(F.lit("p"), F.col("page_id")).alias("id"), F.col("html").alias("text"))
    turns = wh.table("conversations").select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("id"), "text"
    )
    texts = documents.unionByName(pages).unionByName(turns)
    return policy.check_questions(texts, "text").drop("text")


UUID_SQL = """substr(md5(c_custkey::VARCHAR), 1, 8) || '-' || substr(md5(c_custkey::VARCHAR), 9, 4) || '-4' ||
  substr(md5(c_custkey::VARCHAR), 14, 3) || '-' || substr(md5(c_custkey::VARCHAR), 17, 4) || '-' ||
  substr(md5(c_custkey::VARCHAR), 21, 12)"""


@query(
    "id_format_check",
    f"""SELECT c_custkey, {UUID_SQL} AS uuid,
         CASE WHEN regexp_matches({UUID_SQL}, '^.{{13}}-4...-[89ab]') THEN 'ok' ELSE 'bad_format' END AS id_verdict,
         CASE WHEN contains(c_name, '#') THEN 'bad_format' ELSE 'ok' END AS name_verdict,
         'ok' AS segment_verdict FROM customer""",
)
def id_format_check(wh):
    digest = F.md5(F.col("c_custkey").cast("string"))
    uuid = F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("4"), F.substring(digest, 14, 3)),
        F.substring(digest, 17, 4),
        F.substring(digest, 21, 12),
    )
    return (
        wh.table("customer")
        .withColumn("uuid", uuid)
        .select(
            "c_custkey",
            "uuid",
            policy.id_verdict(F.col("uuid")).alias("id_verdict"),
            policy.name_verdict(F.col("c_name")).alias("name_verdict"),
            policy.name_verdict(F.col("c_mktsegment")).alias("segment_verdict"),
        )
    )


# --- routing -------------------------------------------------------------

SOURCE_TYPES = {0: "superset", 1: "postgres", 2: "api", 3: "postgres", 4: "superset"}


def source_registry(wh):
    kind = F.get(F.array(*[F.lit(t) for t in SOURCE_TYPES.values()]), F.col("r_regionkey"))
    status = F.when(F.col("r_name") == "MIDDLE EAST", "disconnected").otherwise("connected")
    return wh.table("region").select(
        F.col("r_name").alias("id"), kind.alias("type"), status.alias("status")
    )


SOURCE_SQL = f"""sources AS (SELECT r_name AS id,
    ['superset', 'postgres', 'api', 'postgres', 'superset'][r_regionkey + 1] AS type,
    CASE WHEN r_name = 'MIDDLE EAST' THEN 'disconnected' ELSE 'connected' END AS status FROM region),
  active AS (SELECT id AS source_id, type FROM sources WHERE status = 'connected')"""


@query(
    "route_queries",
    f"""WITH {QUESTION_SQL}, {SOURCE_SQL}, l AS (SELECT id, lower(text) AS q FROM questions),
       asked AS (SELECT id, CASE WHEN contains(q, 'region') THEN ['ASIA', 'MIDDLE EAST']
                                 WHEN contains(q, 'covid') THEN ['MIDDLE EAST'] ELSE [] END AS want FROM l),
       direct AS (SELECT id, source_id, type, 0 AS priority FROM asked, active WHERE list_contains(want, source_id)),
       rest AS (SELECT * FROM l WHERE id NOT IN (SELECT id FROM direct)),
       hit AS (SELECT id, source_id, type, 0 AS priority FROM rest, active WHERE
                 (type = 'superset' AND {any_sql(routing.TYPE_WORDS["superset"])})
                 OR (type = 'postgres' AND {any_sql(routing.TYPE_WORDS["postgres"])})
                 OR type NOT IN ('superset', 'postgres')),
       fallback AS (SELECT id, source_id, type, 0 AS priority FROM rest, active
                    WHERE id NOT IN (SELECT id FROM hit))
       SELECT id, source_id, type, CAST(priority AS BIGINT) AS priority FROM
         (SELECT * FROM direct UNION ALL SELECT * FROM hit UNION ALL SELECT * FROM fallback)""",
)
def route_queries(wh):
    low = F.lower("text")
    want = (
        F.when(low.contains("region"), F.array(F.lit("ASIA"), F.lit("MIDDLE EAST")))
        .when(low.contains("covid"), F.array(F.lit("MIDDLE EAST")))
        .otherwise(F.array().cast("array<string>"))
    )
    asked = question_log(wh).withColumn("want", want)
    return plain(routing.route_queries(asked, "id", "text", source_registry(wh), "want"))


@query(
    "route_by_intent",
    f"""WITH {QUESTION_SQL}, {SOURCE_SQL}, {planner_sql('questions', 'id', 'text')},
       hit AS (SELECT id, source_id, type,
             CASE WHEN intent = 'visualization' AND type <> 'superset' THEN 1 ELSE 0 END AS priority
           FROM planned, active WHERE CASE intent WHEN 'sql' THEN type = 'postgres'
             WHEN 'analytics' THEN type = 'postgres' ELSE true END)
       SELECT id, source_id, type, CAST(priority AS BIGINT) AS priority FROM hit
       UNION ALL SELECT id, source_id, type, 0 FROM planned, active WHERE id NOT IN (SELECT id FROM hit)""",
)
def route_by_intent(wh):
    planned = questions.planner_intent(question_log(wh), "text")
    return plain(routing.route_by_intent(planned, "id", "intent", "main_action", source_registry(wh)))


@query(
    "analysis_context",
    f"""WITH {QUESTION_SQL}, {planner_sql('questions', 'id', 'text')},
       c AS (SELECT 'orders' AS source, o_orderpriority AS kind, o_orderkey AS amount FROM orders
             UNION ALL SELECT 'customers', c_mktsegment, c_custkey FROM customer),
       s AS (SELECT '[' || string_agg(j, ',' ORDER BY amount DESC, kind) || ']' AS sample FROM (
               SELECT to_json({{'kind': kind, 'amount': amount}})::VARCHAR AS j, kind, amount FROM c
               ORDER BY amount DESC, kind LIMIT 3))
       SELECT p.id, 'Enhanced Data Analysis Context:' || chr(10) || 'User Query: ' || q.text || chr(10) ||
         'Detected Intent: ' || intent || format(' (Confidence: {{:.2f}})', confidence) || chr(10) || 'Main Action: ' || main_action
         || chr(10) || 'Total Records: ' || (SELECT count(*) FROM c) || chr(10)
         || CASE WHEN metrics <> '' THEN 'Identified Metrics: ' || metrics || chr(10) ELSE '' END
         || CASE WHEN dimensions <> '' THEN 'Identified Dimensions: ' || dimensions || chr(10) ELSE '' END
         || 'Data Sources:' || chr(10) || '- customers: ' || (SELECT count(*) FROM customer) || ' records' || chr(10)
         || '- orders: ' || (SELECT count(*) FROM orders) || ' records' || chr(10) || chr(10)
         || 'Sample Data Structure:' || chr(10) || '- kind' || chr(10) || '- amount' || chr(10) AS context, s.sample
       FROM planned p JOIN questions q ON q.id = p.id, s""",
)
def analysis_context(wh):
    combined = union_sources(
        {
            "orders": wh.table("orders").select(
                F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("amount")
            ),
            "customers": wh.table("customer").select(
                F.col("c_mktsegment").alias("kind"), F.col("c_custkey").alias("amount")
            ),
        }
    )
    summary = analysis.data_summary(combined, "source", [F.desc("amount"), "kind"])
    planned = questions.planner_intent(question_log(wh), "text")
    return analysis.analysis_context(planned, "text", summary).select("id", "context", "sample")


# --- query history -------------------------------------------------------


def history_log(wh):
    return as_history(wh.table("events"))


def as_history(events):
    return events.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.col("event_type").alias("query_type"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.col("value").alias("execution_time_ms"),
        F.get_json_object("props", "$.k").cast("long").alias("row_count"),
        F.col("props").alias("result_preview"),
        F.col("ts").alias("created_at"),
    )


HISTORY_SQL = """log AS (SELECT event_id AS id, user_id, event_type AS query_type,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, value AS execution_time_ms,
    CAST(props->>'k' AS BIGINT) AS row_count, props AS result_preview, ts AS created_at FROM events)"""


@query(
    "history_page",
    f"""WITH {HISTORY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS n
          FROM log) SELECT user_id, id, query_type, status, row_count FROM r WHERE n > 10 AND n <= 30""",
)
def history_page(wh):
    return history.history_pages(history_log(wh), 20, 10).select(
        "user_id", "id", "query_type", "status", "row_count"
    )


@query(
    "history_entry",
    f"WITH {HISTORY_SQL} SELECT id, user_id, status, CAST(result_preview->>'k' AS BIGINT) AS k FROM log",
)
def history_entry(wh):
    return history.with_preview(history_log(wh), "struct<k: bigint>").select(
        "id", "user_id", "status", F.col("result_preview.k").alias("k")
    )


@query(
    "history_stats",
    f"""WITH {HISTORY_SQL} SELECT user_id, count(*) AS total_queries,
         count(*) FILTER (status = 'success') AS successful_queries,
         count(*) FILTER (status = 'error') AS failed_queries,
         CAST(sum(execution_time_ms::DECIMAL(18,2)) AS DOUBLE) / count(execution_time_ms) AS avg_execution_time_ms,
         CAST(sum(row_count) AS BIGINT) AS total_rows_returned FROM log GROUP BY 1""",
)
def history_stats(wh):
    return history.user_stats(history_log(wh))


@query(
    "history_retention",
    f"""WITH {HISTORY_SQL} SELECT id, user_id, CAST(created_at AS VARCHAR) AS created_at FROM log
        WHERE created_at >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS""",
)
def history_retention(wh):
    as_of = wh.table("events").agg(F.max("ts")).scalar()
    return plain(history.retain(history_log(wh), as_of, 7).select("id", "user_id", "created_at"))


@query(
    "history_retention_count",
    """SELECT count(*) AS removed FROM events
       WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAYS""",
)
def history_retention_count(wh):
    as_of = wh.table("events").agg(F.max("ts")).scalar()
    return history.count_expired(history_log(wh), as_of, 7)


@query(
    "history_delete",
    f"WITH {HISTORY_SQL} SELECT id, user_id, query_type FROM log WHERE NOT (status = 'error' AND row_count > 50)",
)
def history_delete(wh):
    log = history_log(wh)
    bad = log.filter((F.col("status") == "error") & (F.col("row_count") > 50))
    return history.delete_entries(log, bad).select("id", "user_id", "query_type")
