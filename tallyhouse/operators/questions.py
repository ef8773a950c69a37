"""Understanding of questions: intents, domains, keywords and entities.

Every operator adds columns to a table of texts, row by row: there is no
shuffle and no Python in the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import text as tx

# Three separate intent vocabularies, keyword lists and patterns.
LEGACY_INTENTS = [
    ("causal_analysis", 0.9, ["why", "reason", "cause", "because", "decline", "drop", "increase"]),
    ("comparison", 0.9, ["compare", "vs", "versus", "difference", "better", "worse"]),
    ("visualization", 0.8, ["dashboard", "chart", "visualization", "graph", "report"]),
    (
        "analytics",
        0.8,
        ["sales", "revenue", "profit", "performance", "metrics", "kpi", "trend", "analytics"],
    ),
    ("data_retrieval", 0.7, ["show", "get", "fetch", "data", "list", "display"]),
]
LEGACY_OTHER = ("other", 0.3)
GAME_WORDS = ["game", "gaming", "entertainment"]

SEMANTIC_INTENTS = [
    ("analytics", ["insight", "analysis", "analytics", "show me"]),
    ("comparison", ["compare", "vs", "difference", "between"]),
    ("trend", ["trend", "over time", "growth", "change"]),
    ("visualization", ["chart", "graph", "visualize", "dashboard"]),
    ("summary", ["summary", "overview", "total", "aggregate"]),
]
SEMANTIC_OTHER = "analytics"

PLANNER_INTENTS = {
    "analytics": [
        "analyze", "analysis", "insights", "understand", "explain", "what", "how", "why",
        "performance", "metrics", "kpi", "report", "summary",
    ],
    "sql": [
        "select", "from", "where", "join", "group by", "order by", "having", "sql", "query",
        "execute", "run",
    ],
    "visualization": [
        "chart", "graph", "plot", "dashboard", "visualize", "show", "display", "bar chart",
        "line chart", "pie chart", "scatter plot",
    ],
    "comparison": [
        "compare", "comparison", "versus", "vs", "difference", "between", "against",
        "relative to", "compared to",
    ],
    "trend": [
        "trend", "over time", "time series", "growth", "decline", "pattern", "monthly", "weekly",
        "daily", "quarterly", "yearly",
    ],
    "filter": [
        "filter", "where", "only", "exclude", "include", "containing", "matching", "equal to",
        "greater than", "less than",
    ],
    "aggregation": [
        "sum", "count", "average", "max", "min", "total", "aggregate", "group", "by", "per", "each",
    ],
}

KEYWORD_DOMAINS = [
    ("finance", 0.8, ["finance", "financial", "accounting", "budget"]),
    ("gaming", 0.8, ["game", "gaming", "video"]),
    ("slack", 0.9, ["slack"]),
    ("covid", 0.8, ["covid", "vaccine"]),
    ("birth_names", 0.8, ["birth", "name"]),
    ("sales", 0.7, ["sales", "revenue", "orders"]),
]
KEYWORD_DOMAIN_DEFAULT = ("sales", 0.5)

BUSINESS_KEYWORDS = [
    "sales", "revenue", "profit", "orders", "customers", "marketing", "campaign", "leads",
    "conversion", "finance", "cost", "budget", "expense", "accounting", "operations", "process",
    "efficiency", "productivity", "hr", "employee", "staff", "personnel", "product", "inventory",
    "catalog", "pricing", "game", "gaming", "video game", "entertainment", "slack", "channel",
    "messages", "communication", "covid", "vaccine", "vaccination", "pandemic", "birth", "names",
    "population", "demographics",
]

STOP_WORDS = [
    "give", "me", "the", "a", "an", "from", "on", "in", "of", "to", "show", "get", "find", "what",
    "how", "is", "are", "was", "were", "be", "have", "has", "had", "do", "does", "did", "will",
    "would", "should", "could", "data", "s",
]
PUNCTUATION = ".,!?;:'\""

# each pattern with words of which a match must contain one
TIME_PATTERNS = [
    (r"(last|past|previous)\s+(week|month|quarter|year|day|hour)", ["last", "past", "previous"]),
    (r"(this|current)\s+(week|month|quarter|year|day)", ["this", "current"]),
    (r"\d{4}-\d{2}-\d{2}", ["-"]),
    (r"(yesterday|today|tomorrow)", ["yesterday", "today", "tomorrow"]),
]
METRIC_PATTERNS = [
    (
        r"(sales|revenue|profit|cost|price|amount|value)",
        ["sales", "revenue", "profit", "cost", "price", "amount", "value"],
    ),
    (r"(count|number|quantity|volume|total)", ["count", "number", "quantity", "volume", "total"]),
    (r"(rate|percentage|ratio|proportion)", ["rate", "percentage", "ratio", "proportion"]),
]


def with_lower(df: DataFrame, text: str) -> DataFrame:
    """The lower-case text as a column of its own, so that it is computed once."""
    return df.withColumn("_lower", F.lower(F.col(text)))


def legacy_intent(df: DataFrame, text: str) -> DataFrame:
    """Columns ``intent``, ``confidence`` and ``use_bi``; the first matching rule wins."""
    names, confidences, rules = zip(*LEGACY_INTENTS)
    low = F.col("_lower")
    ruled = with_lower(df, text).withColumn("_rule", tx.first_rule(low, list(rules)))
    other = F.col("_rule") == len(rules)
    return ruled.withColumns(
        {
            "intent": tx.pick(F.col("_rule"), [*names, LEGACY_OTHER[0]]),
            "confidence": tx.pick(F.col("_rule"), [*confidences, LEGACY_OTHER[1]]),
            "use_bi": ~other | tx.contains_any(low, GAME_WORDS),
        }
    ).drop("_lower", "_rule")


def semantic_intent(df: DataFrame, text: str) -> DataFrame:
    names, rules = zip(*SEMANTIC_INTENTS)
    rule = tx.first_rule(F.col("_lower"), list(rules))
    return (
        with_lower(df, text)
        .withColumn("semantic_intent", tx.pick(rule, [*names, SEMANTIC_OTHER]))
        .drop("_lower")
    )


def planner_intent(df: DataFrame, text: str) -> DataFrame:
    """Intent with the most hits, its confidence and the enriched parse.

    Equal counts go to the intent listed first.
    """
    names = list(PLANNER_INTENTS)
    low = F.col("_lower")
    scored = with_lower(df, text).withColumns(
        {f"_{n}": tx.count_hits(low, words) for n, words in PLANNER_INTENTS.items()}
    )
    best = scored.withColumn("_best", F.greatest(*[F.col(f"_{n}") for n in names]))
    intent = F.when(F.col("_best") == 0, "unknown")
    for n in names:
        intent = intent.when(F.col(f"_{n}") == F.col("_best"), n)
    confidence = (
        F.when(F.col("_best") == 0, 0.3)
        .when(F.col("_best") == 1, 0.7)
        .when(F.col("_best") == 2, 0.8)
        .otherwise(0.9)
    )
    chosen = best.withColumns({"intent": intent, "confidence": confidence})
    kind = F.col("intent")
    main_action = (
        F.when(kind == "visualization", "create_visualization")
        .when(
            kind == "comparison",
            F.when(
                tx.contains_any(low, ["between", "vs", "versus"]), "comparative_analysis"
            ).otherwise("compare_data"),
        )
        .when(kind == "trend", "analyze_trends")
        .when(kind == "sql", "execute_sql")
        .when(
            kind == "analytics",
            F.when(tx.contains_any(low, ["performance", "kpi"]), "performance_analysis").otherwise(
                "analyze_data"
            ),
        )
        .when(kind == "unknown", "unknown")
        .otherwise("general_query")
    )
    output_format = F.when(
        kind == "visualization",
        F.when(low.contains("dashboard"), "dashboard").otherwise("chart"),
    ).otherwise("table")
    none = F.array().cast("array<string>")
    timed = (kind == "trend") & tx.contains_any(low, ["quarter", "monthly", "weekly"])
    money = (kind == "analytics") & tx.contains_any(low, ["sales", "revenue"])
    return chosen.withColumns(
        {
            "main_action": main_action,
            "output_format": output_format,
            "dimensions": F.when(timed, F.array(F.lit("time"))).otherwise(none),
            "metrics": F.when(money, F.array(F.lit("revenue"))).otherwise(none),
        }
    ).drop("_lower", "_best", *[f"_{n}" for n in names])


def keyword_domain(df: DataFrame, text: str) -> DataFrame:
    """Columns ``domain`` and ``domain_confidence`` from keywords alone."""
    names, confidences, rules = zip(*KEYWORD_DOMAINS)
    return (
        with_lower(df, text)
        .withColumn("_rule", tx.first_rule(F.col("_lower"), list(rules)))
        .withColumns(
            {
                "domain": tx.pick(F.col("_rule"), [*names, KEYWORD_DOMAIN_DEFAULT[0]]),
                "domain_confidence": tx.pick(
                    F.col("_rule"), [*confidences, KEYWORD_DOMAIN_DEFAULT[1]]
                ),
            }
        )
        .drop("_lower", "_rule")
    )


def business_keywords(df: DataFrame, text: str) -> DataFrame:
    return (
        with_lower(df, text)
        .withColumn("keywords", tx.hits(F.col("_lower"), BUSINESS_KEYWORDS))
        .drop("_lower")
    )


def extract_keywords(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("keywords", tx.keywords(F.col(text), STOP_WORDS, PUNCTUATION, 3))


def extract_entities(df: DataFrame, text: str, last_pattern: bool = False) -> DataFrame:
    """Time and metric expressions: matches of all patterns, or of the last that matches.

    A pattern runs only on texts that contain one of its words.
    """
    none = F.array().cast("array<string>")
    found = {}
    for kind, patterns in (("time", TIME_PATTERNS), ("metric", METRIC_PATTERNS)):
        for i, (pattern, needed) in enumerate(patterns):
            possible = tx.contains_any(F.col("_folded"), needed)
            found[f"_{kind}{i}"] = F.when(possible, tx.find_all(F.col(text), pattern)).otherwise(none)
    matched = df.withColumn("_folded", tx.folded(F.col(text))).withColumns(found)

    def combined(kind: str) -> Column:
        columns = [F.col(c) for c in found if c.startswith(f"_{kind}")]
        if not last_pattern:
            return F.concat(*columns)
        return F.coalesce(*[F.when(F.size(c) > 0, c) for c in reversed(columns)], none)

    return matched.withColumns(
        {"time_expressions": combined("time"), "metric_expressions": combined("metric")}
    ).drop("_folded", *found)


# Canned statement per keyword rule, first match wins.
TEMPLATES = [
    ("connection_test", GAME_WORDS),
    ("unified_sales", ["sales", "revenue"]),
    ("user_activity", ["user", "active"]),
]
DASHBOARD_TEMPLATES = [
    ("indicator_panel", ["world", "health"]),
    ("sales_projection", ["bike", "vehicle", "sales"]),
]
DISCOVERY = "catalog_columns"


def select_template(df: DataFrame, text: str) -> DataFrame:
    """Which canned report answers a question."""
    names, rules = zip(*TEMPLATES)
    rule = tx.first_rule(F.col("_lower"), list(rules))
    return with_lower(df, text).withColumn("template", tx.pick(rule, [*names, DISCOVERY])).drop("_lower")


def select_dashboard_template(df: DataFrame, title: str) -> DataFrame:
    """Which canned report stands for a dashboard title (letter case counts)."""
    names, rules = zip(*DASHBOARD_TEMPLATES)
    rule = tx.first_rule(F.col(title), list(rules))
    return df.withColumn("template", tx.pick(rule, [*names, DISCOVERY]))


# --- replies of a text model ----------------------------------------------


def one_json(text: Column) -> Column:
    """The text as a variant if it is exactly one JSON document, else NULL.

    The parser stops after the first document. Only when nothing follows it
    can the text be both the sole member of an array and that of an object.
    """
    array = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>"
    )
    member = F.try_parse_json(F.concat(F.lit('{"value":'), text, F.lit("}")))
    return F.when((F.size(array) == 1) & member.isNotNull(), F.get(array, F.lit(0)))


def parse_intent_json(df: DataFrame, reply: str, question: str) -> DataFrame:
    """Intent from the JSON part of a reply, else from the question's patterns.

    The reply's parse comes with the fixed action ``llm_classified``. Missing
    or wrongly typed members leave the type empty and the confidence 0.
    """
    patterns = planner_intent(df, question).withColumn("_json", one_json(tx.outer_braces(F.col(reply))))
    ok = F.col("_json").isNotNull()

    def member(name: str, kinds: list[str], type: str) -> Column:
        value = F.variant_get("_json", f"$.{name}", "variant")
        fits = F.schema_of_variant(value).rlike("^(" + "|".join(kinds) + ")")
        return F.when(fits, F.try_variant_get("_json", f"$.{name}", type))

    kind = F.coalesce(member("type", ["STRING"], "string"), F.lit(""))
    number = F.coalesce(member("confidence", ["BIGINT", "DECIMAL", "DOUBLE"], "double"), F.lit(0.0))
    return patterns.select(
        *df.columns,
        ok.alias("from_reply"),
        F.when(ok, kind).otherwise(F.col("intent")).alias("intent"),
        F.when(ok, number).otherwise(F.col("confidence")).alias("confidence"),
        F.when(ok, "llm_classified").otherwise(F.col("main_action")).alias("main_action"),
    )


def mine_questions(df: DataFrame, reply: str) -> DataFrame:
    """Lines of a reply that look like questions, with their line numbers."""
    line = F.col("line")
    wanted = (F.octet_length(line) > 10) & tx.contains_any(line, ["?", "show", "what"])
    keep = [c for c in df.columns if c != reply]
    return (
        df.select(*keep, F.posexplode(F.split(F.col(reply), "\n")).alias("line_no", "_line"))
        .select(*keep, "line_no", tx.strip(F.col("_line")).alias("line"))
        .filter(wanted)
    )


def mine_chart_rows(df: DataFrame, reply: str) -> DataFrame:
    """Chart rows of a reply that is a JSON array, else three fixed rows.

    Each row keeps its members as a map of strings.
    """
    rows = F.from_json(F.col(reply), "array<map<string,string>>")
    text = tx.strip(F.col(reply))
    whole = F.when(text.startswith("["), F.schema_of_variant(one_json(text)))
    is_array = F.coalesce(whole.rlike("^ARRAY<(OBJECT|VOID)"), F.lit(False))
    fallback = F.array(
        *[
            F.create_map(F.lit("category"), F.lit(f"Insight {i}"), F.lit("value"), F.lit(str(v)))
            for i, v in enumerate((100, 75, 50), start=1)
        ]
    )
    keep = [c for c in df.columns if c != reply]
    return df.select(
        *keep, F.posexplode(F.when(is_array & rows.isNotNull(), rows).otherwise(fallback)).alias("row_no", "row")
    )
