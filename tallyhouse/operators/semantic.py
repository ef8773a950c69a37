"""The semantic layer: metrics, domains and domain contexts of a catalog.

The input is the catalog of ``profile_columns``: one row per column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import text as tx

# Name patterns, descriptions, terms and questions per domain.
SIMPLE_DOMAINS = [
    ("sales", ["order", "sale", "transaction"]),
    ("marketing", ["campaign", "lead", "marketing"]),
    ("customer", ["customer", "user", "client"]),
    ("product", ["product", "inventory", "catalog"]),
    ("hr", ["employee", "hr", "staff"]),
    ("finance", ["finance", "payment", "invoice"]),
]
DOMAIN_PATTERNS = [
    (
        "sales",
        ["order", "sale", "transaction", "purchase", "invoice", "receipt", "payment", "billing", "checkout"],
    ),
    (
        "marketing",
        [
            "campaign", "lead", "prospect", "marketing", "advertisement", "email", "newsletter",
            "promotion", "coupon", "affiliate",
        ],
    ),
    ("customer", ["customer", "user", "client", "account", "profile", "contact", "member", "subscriber"]),
    (
        "product",
        ["product", "item", "catalog", "inventory", "stock", "sku", "variant", "category", "brand"],
    ),
    (
        "finance",
        [
            "finance", "accounting", "revenue", "expense", "budget", "cost", "profit", "tax", "payroll",
            "investment",
        ],
    ),
    (
        "operations",
        ["operation", "process", "workflow", "task", "job", "schedule", "resource", "asset", "facility"],
    ),
    (
        "hr",
        ["employee", "staff", "personnel", "hr", "human", "department", "position", "salary", "benefit"],
    ),
]
DOMAIN_DESCRIPTIONS = {
    "sales": "Sales and revenue analytics, order management, customer transactions",
    "marketing": "Marketing campaign performance, lead generation, customer acquisition",
    "customer": "Customer relationship management, user profiles, engagement metrics",
    "product": "Product catalog, inventory management, pricing and categorization",
    "finance": "Financial reporting, accounting, revenue and expense tracking",
    "operations": "Operational efficiency, process management, resource utilization",
    "hr": "Human resources, employee management, organizational analytics",
    "general": "General business data and analytics",
}
OTHER_DESCRIPTION = "Business data and analytics"
EXPECTED_KEYWORDS = {
    "sales": ["sales", "order", "revenue", "customer"],
    "marketing": ["campaign", "lead", "marketing", "conversion"],
    "customer": ["customer", "user", "profile", "engagement"],
    "product": ["product", "inventory", "catalog", "price"],
    "finance": ["finance", "payment", "invoice", "revenue"],
}
GLOSSARY = {
    "sales": [
        ("Revenue", "Total income generated from sales transactions", ["income", "sales", "earnings"]),
        ("Conversion Rate", "Percentage of prospects that become customers", ["conversion", "close rate"]),
    ],
    "marketing": [
        (
            "CAC",
            "Customer Acquisition Cost - cost to acquire one customer",
            ["acquisition cost", "customer cost"],
        ),
        (
            "ROAS",
            "Return on Ad Spend - revenue per dollar spent on advertising",
            ["ad return", "advertising roi"],
        ),
    ],
    "customer": [
        (
            "LTV",
            "Customer Lifetime Value - total revenue from customer relationship",
            ["lifetime value", "customer value"],
        ),
        ("Churn Rate", "Percentage of customers who stop using service", ["churn", "attrition rate"]),
    ],
}
QUERY_PATTERNS = {
    "sales": (
        "sales performance analysis",
        "Analysis of sales metrics and performance trends",
        ["sales", "performance", "revenue", "orders"],
        ["show me sales data", "sales performance", "revenue analysis"],
    ),
    "marketing": (
        "marketing campaign analysis",
        "Analysis of marketing campaign effectiveness",
        ["marketing", "campaign", "leads", "conversion"],
        ["campaign performance", "lead generation", "marketing roi"],
    ),
    "customer": (
        "customer behavior analysis",
        "Analysis of customer behavior and engagement patterns",
        ["customer", "behavior", "engagement", "retention"],
        ["customer insights", "user engagement", "customer segmentation"],
    ),
}
SAMPLE_QUESTIONS = {
    "sales": [
        "Show me total sales revenue",
        "What are our top selling products?",
        "How many orders did we have this month?",
    ],
    "marketing": [
        "Show me campaign performance",
        "What's our lead conversion rate?",
        "Which marketing channels are most effective?",
    ],
    "customer": [
        "Show me customer segmentation",
        "What's our customer lifetime value?",
        "How many new customers this quarter?",
    ],
}
METRIC_TYPES = [
    ("sum", ["amount", "total", "revenue", "price"]),
    ("count", ["count", "quantity", "num"]),
    ("avg", ["rate", "percentage"]),
    ("ratio", ["ratio"]),
]


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def by_domain(domain: Column, values: dict[str, Column], otherwise: Column) -> Column:
    chain = None
    for name, value in values.items():
        chain = F.when(domain == name, value) if chain is None else chain.when(domain == name, value)
    return chain.otherwise(otherwise)


def named_by(text: Column, rules: list[tuple[str, list[str]]], default: str | None) -> Column:
    """The first domain one of whose patterns occurs in a lower-case name."""
    names, patterns = zip(*rules)
    return tx.pick(tx.first_rule(text, list(patterns)), [*names, default])


def simple_domain(table: Column) -> Column:
    return named_by(F.lower(table), SIMPLE_DOMAINS, "general")


def table_domains(catalog: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Domain of each table: by its name, else its tags, else its columns.

    Tags and columns count in their order; ``tags`` has table_name and tags.
    """
    of_column = named_by(F.lower("column_name"), DOMAIN_PATTERNS, None)
    tables = (
        catalog.withColumn("_domain", of_column)
        .groupBy("table_idx", "table_name")
        .agg(
            F.min_by("_domain", F.when(F.col("_domain").isNotNull(), F.col("position"))).alias("_by_column"),
            F.count_if("is_metric").alias("n_metrics"),
        )
        .withColumn("simple_domain", simple_domain(F.col("table_name")))
    )
    if tags is not None:
        tables = tables.join(tags, "table_name", "left")
    else:
        tables = tables.withColumn("tags", strings([]))
    tables = tables.withColumn("tags", F.coalesce("tags", strings([])))
    tagged = F.filter(
        F.transform("tags", lambda t: named_by(F.lower(t), DOMAIN_PATTERNS, None)), lambda d: d.isNotNull()
    )
    by_name = named_by(F.lower("table_name"), DOMAIN_PATTERNS, None)
    return tables.withColumn(
        "domain", F.coalesce(by_name, F.get(tagged, F.lit(0)), "_by_column", F.lit("general"))
    ).drop("_by_column")


def business_metrics(catalog: DataFrame) -> DataFrame:
    """Name, description, type, dimensions, domain and keywords of each metric column."""
    dimensions = (
        catalog.filter("is_dimension")
        .groupBy("table_name")
        .agg(F.array_sort(F.collect_list(F.struct("position", "column_name"))).alias("d"))
        .select("table_name", F.col("d.column_name").alias("dimensions"))
    )
    column, table = F.col("column_name"), F.col("table_name")
    low, low_table = F.lower(column), F.lower(table)
    spaced = F.replace(column, F.lit("_"), F.lit(" "))
    title = tx.title_case(spaced)
    name = F.when(F.lower(title).contains(low_table), title).otherwise(
        F.concat(tx.title_case(tx.singular(table)), F.lit(" "), title)
    )
    description = (
        F.when(tx.contains_any(low, ["total", "amount"]), F.concat(F.lit("Total "), spaced, F.lit(" from "), low_table))
        .when(low.contains("count"), F.concat(F.lit("Number of records in "), low_table))
        .when(low.contains("revenue"), F.concat(F.lit("Revenue generated from "), low_table))
        .when(low.contains("price"), F.concat(F.lit("Price information from "), low_table))
        .otherwise(F.concat(title, F.lit(" metric from "), low_table, F.lit(" table")))
    )
    base = F.array(low, F.lower(spaced), low_table, F.lower(tx.singular(table)))
    extra = (
        F.when(tx.contains_any(low, ["amount", "revenue"]), strings(["money", "sales", "income", "revenue"]))
        .when(tx.contains_any(low, ["count", "quantity"]), strings(["number", "total", "count"]))
        .when(low.contains("rate"), strings(["percentage", "ratio", "rate"]))
        .otherwise(strings([]))
    )
    return (
        catalog.filter("is_metric")
        .join(dimensions, "table_name", "left")
        .select(
            "table_idx",
            "position",
            name.alias("name"),
            description.alias("description"),
            named_by(low, METRIC_TYPES, "sum").alias("type"),
            "table_name",
            "column_name",
            F.coalesce("dimensions", strings([])).alias("dimensions"),
            simple_domain(table).alias("domain"),
            F.concat(base, extra).alias("keywords"),
        )
    )


def primary_domain(catalog: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """The domain with most votes and its share of all votes.

    A table votes with 1 and half a point per metric column for its domain;
    each metric votes with half a point for its simple domain. Equal votes go
    to the domain first in the alphabet.
    """
    tables = table_domains(catalog, tags)
    votes = tables.select("domain", (1 + F.col("n_metrics") * 0.5).alias("vote")).unionByName(
        tables.select(F.col("simple_domain").alias("domain"), (F.col("n_metrics") * 0.5).alias("vote"))
    )
    scores = votes.groupBy("domain").agg(F.sum("vote").alias("score"))
    winner = scores.agg(
        F.min(F.struct((-F.col("score")).alias("s"), "domain"))["domain"].alias("domain"),
        F.max("score").alias("top"),
        F.sum("score").alias("total"),
    )
    share = F.coalesce(F.try_divide(F.col("top"), F.col("total")), F.lit(0.5))
    return winner.select(
        "domain",
        F.when((F.col("domain") == "general") & (share < 0.7), 0.5).otherwise(share).alias("confidence"),
    )


def sample_questions(metrics: DataFrame) -> DataFrame:
    """Suggested questions for the metrics' domains, each once, in metric order."""
    first = metrics.groupBy("domain").agg(F.min(F.struct("table_idx", "position")).alias("at"))
    lists = by_domain(
        F.col("domain"), {d: strings(q) for d, q in SAMPLE_QUESTIONS.items()}, strings([])
    )
    return first.select("at", F.posexplode(lists).alias("n", "question")).orderBy("at", "n").select("question")


def _glossary(domain: Column) -> Column:
    kind = "array<struct<term:string,definition:string,synonyms:array<string>>>"
    terms = {
        d: F.array(
            *[
                F.struct(F.lit(t).alias("term"), F.lit(x).alias("definition"), strings(s).alias("synonyms"))
                for t, x, s in entries
            ]
        ).cast(kind)
        for d, entries in GLOSSARY.items()
    }
    return by_domain(domain, terms, F.array().cast(kind))


def _pattern(pattern, intent: str, description, keywords, examples) -> Column:
    return F.struct(
        pattern.alias("pattern"),
        F.lit(intent).alias("intent"),
        description.alias("description"),
        keywords.alias("keywords"),
        examples.alias("examples"),
    )


def _patterns(domain: Column, keywords: Column, metrics: Column) -> Column:
    kind = (
        "array<struct<pattern:string,intent:string,description:string,"
        "keywords:array<string>,examples:array<string>>>"
    )
    own = {
        d: F.array(_pattern(F.lit(p), "analytics", F.lit(x), strings(k), strings(e))).cast(kind)
        for d, (p, x, k, e) in QUERY_PATTERNS.items()
    }
    trend = F.array(
        _pattern(
            F.concat(domain, F.lit(" trend analysis")),
            "trend",
            F.concat(F.lit("Time-based trend analysis for "), domain, F.lit(" metrics")),
            F.concat(F.slice(keywords, 1, 3), strings(["trend", "over time"])),
            F.array(F.concat(domain, F.lit(" trends")), F.lit("trends over time")),
        )
    ).cast(kind)
    none = F.array().cast(kind)
    return F.concat(by_domain(domain, own, none), F.when(F.size(metrics) > 0, trend).otherwise(none))


def domain_confidence(domain: Column, n_tables: Column, keywords: Column, metrics: Column, dimensions: Column) -> Column:
    matched = {}
    for d, words in EXPECTED_KEYWORDS.items():
        found = F.size(F.filter(strings(words), lambda w: F.exists(keywords, lambda k: k.contains(w))))
        matched[d] = found.cast("double") / len(words) * 0.3
    score = (
        n_tables * F.lit(0.2)
        + F.size(metrics) * F.lit(0.1)
        + F.size(dimensions) * F.lit(0.05)
        + by_domain(domain, matched, F.lit(0.0))
    )
    return F.greatest(F.lit(0.3), F.least(F.lit(1.0), score))


def domain_contexts(
    catalog: DataFrame, tags: DataFrame | None = None, descriptions: DataFrame | None = None
) -> DataFrame:
    """One context per domain: its tables, vocabulary, glossary, patterns and confidence.

    ``descriptions`` (table_name, column_name, description) describes columns, and
    tables where the column name is NULL; they become part of the search text.
    """
    if descriptions is None:
        descriptions = catalog.sparkSession.createDataFrame(
            [], "table_name string, column_name string, description string"
        )
    of_tables = (
        descriptions.filter("column_name IS NULL").groupBy("table_name").agg(F.min("description").alias("description"))
    )
    of_columns = (
        descriptions.filter("column_name IS NOT NULL")
        .groupBy("table_name", "column_name")
        .agg(F.min(F.nullif("description", F.lit(""))).alias("_description"))
    )
    tables = table_domains(catalog, tags).select("table_idx", "table_name", "tags", "domain")
    columns = catalog.join(tables.select("table_name", "domain"), "table_name").join(
        of_columns, ["table_name", "column_name"], "left"
    )
    used = columns.filter("is_metric OR is_dimension")
    words = (
        tables.select("domain", F.lower("table_name").alias("w"))
        .unionByName(tables.select("domain", F.explode(F.transform("tags", F.lower)).alias("w")))
        .unionByName(used.select("domain", F.lower("column_name").alias("w")))
        .groupBy("domain")
        .agg(F.array_sort(F.collect_set("w")).alias("keywords"))
    )
    roles = columns.groupBy("domain").agg(
        F.array_sort(F.collect_set(F.when(F.col("is_metric"), F.col("column_name")))).alias("metrics"),
        F.array_sort(F.collect_set(F.when(F.col("is_dimension"), F.col("column_name")))).alias("dimensions"),
    )
    text = F.concat_ws(" ", "column_name", "_description").alias("text")
    useful = F.when(
        F.col("is_metric") | F.col("is_dimension") | F.col("is_id"), F.struct("position", "column_name", text)
    )
    listed = (
        columns.groupBy("domain", "table_idx", "table_name")
        .agg(F.array_sort(F.collect_list(useful)).alias("_useful"))
        .withColumns({"columns": F.col("_useful.column_name"), "column_texts": F.col("_useful.text")})
    )
    table = F.struct("table_idx", "table_name", "description", "tags", "columns", "column_texts")
    grouped = (
        listed.join(tables.select("table_name", "tags"), "table_name")
        .join(of_tables, "table_name", "left")
        .groupBy("domain")
        .agg(F.array_sort(F.collect_list(table)).alias("tables"))
        .withColumn("n_tables", F.size("tables"))
    )
    domain = F.col("domain")
    described = by_domain(domain, {d: F.lit(t) for d, t in DOMAIN_DESCRIPTIONS.items()}, F.lit(OTHER_DESCRIPTION))
    richness = F.when(
        F.col("n_tables") > 1,
        F.concat(F.lit(" with "), F.col("n_tables").cast("string"), F.lit(" related data sources")),
    ).otherwise("")
    k, m, d = F.col("keywords"), F.col("metrics"), F.col("dimensions")
    return (
        grouped.join(words, "domain")
        .join(roles, "domain")
        .withColumns(
            {
                "description": F.concat(described, richness),
                "glossary": _glossary(domain),
                "patterns": _patterns(domain, k, m),
                "confidence": domain_confidence(domain, F.col("n_tables"), k, m, d),
            }
        )
        .orderBy(F.desc("n_tables"), "domain")
    )


def search_text(contexts: DataFrame, with_columns: bool = True) -> DataFrame:
    """The contexts with one text each, as input for an embedding.

    Without ``with_columns`` metrics, dimensions and column names are left out.
    """

    def per(array: str, parts) -> Column:
        return F.concat_ws(" ", F.transform(array, parts))

    if with_columns:
        names = [F.concat_ws(" ", "metrics"), F.concat_ws(" ", "dimensions")]
        table = lambda t: F.concat_ws(
            " ", t["table_name"], F.nullif(t["description"], F.lit("")), t["tags"], t["column_texts"]
        )
    else:
        names = []
        table = lambda t: F.concat_ws(
            " ", t["table_name"], F.nullif(t["description"], F.lit("")), t["tags"]
        )
    parts = [
        F.col("domain"),
        F.col("description"),
        F.concat_ws(" ", "keywords"),
        *names,
        per("tables", table),
        per("glossary", lambda g: F.concat_ws(" ", g["term"], g["definition"], g["synonyms"])),
        per("patterns", lambda p: F.concat_ws(" ", p["description"], p["keywords"], p["examples"])),
    ]
    filled = F.filter(F.array(*parts), lambda p: p != "")
    return contexts.withColumn("search_text", F.concat_ws(" ", filled))
