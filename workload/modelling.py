"""Profile and semantic layer queries over all given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse.operators import profile, semantic
from workload.base import TABLES, plain, query
from workload.reporting import COLUMN_TYPES, schema_columns


def all_tables(wh):
    return {t: wh.table(t) for t in TABLES}


def catalog(wh):
    return profile.profile_columns(wh.spark, all_tables(wh), samples=0, check_unique=False)


INTEGERS = ("int", "bigint")


def role_sql(with_details: bool) -> str:
    """Roles of every column, from exact distinct counts."""
    parts = []
    for idx, t in enumerate(COLUMN_TYPES):
        for i, (c, kind) in enumerate(schema_columns(t), start=1):
            is_id = kind in INTEGERS and c.endswith(("id", "key"))
            metric = kind in (*INTEGERS, "double") and not is_id
            currency = metric and any(
                w in c for w in ["amount", "price", "revenue", "value", "cost", "bal", "spend", "budget"]
            )
            dimension = (
                f"(SELECT count(DISTINCT {c}) <= greatest(50, 0.01 * count(*)) FROM {t})"
                if kind == "string"
                else "false"
            )
            details = ""
            if with_details:
                nested = kind.startswith("array") or kind == "double"
                unique = "false" if nested else f"(SELECT count(DISTINCT {c}) = count({c}) FROM {t})"
                sample = (
                    f"(SELECT array_to_string(list(v ORDER BY {c}), '|') FROM (SELECT {c}, {c}::VARCHAR AS v "
                    f"FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY {c} LIMIT 3))"
                )
                if kind == "string":
                    sample = f"CASE WHEN {dimension} THEN {sample} ELSE '' END"
                if kind.startswith("array"):
                    sample = "''"
                details = (
                    f", (SELECT count(*) FROM {t}) AS n_rows, (SELECT count({c}) FROM {t}) AS n_nonnull"
                    f", (SELECT count({c}) < count(*) FROM {t}) AS nullable, {unique} AS is_unique, {sample} AS samples"
                )
            parts.append(
                f"SELECT {idx} AS table_idx, '{t}' AS table_name, {i} AS position, '{c}' AS column_name, "
                f"'{kind}' AS data_type, {str(is_id).lower()} AS is_id, {str(metric).lower()} AS is_metric, "
                f"{dimension} AS is_dimension, {str(kind == 'timestamp_ntz').lower()} AS is_datetime, "
                f"{str(currency).lower()} AS is_currency{details}"
            )
    return "catalog AS (" + " UNION ALL ".join(parts) + ")"


CATALOG_SQL = role_sql(False)


@query(
    "profile_columns",
    f"""WITH {role_sql(True)} SELECT * REPLACE (CAST(table_idx AS BIGINT) AS table_idx,
          CAST(position AS BIGINT) AS position) FROM catalog""",
)
def profile_columns(wh):
    return plain(profile.profile_columns(wh.spark, all_tables(wh)))


BARE = "regexp_replace({}, '^[a-z]{{1,2}}_', '')"
PAIRS_SQL = f"""ids AS (SELECT *, {BARE.format('column_name')} AS k,
       regexp_replace(table_name, 's$', '') AS part FROM catalog WHERE is_id),
     pairs AS (SELECT a.table_name AS from_table, b.table_name AS to_table, a.column_name AS from_column,
         b.column_name AS to_column, a.k = b.k AS same FROM ids a JOIN ids b ON a.table_idx < b.table_idx
         AND (a.k = b.k OR contains(a.k, b.part) OR contains(b.k, a.part)))"""


@query(
    "table_relationships",
    f"""WITH {CATALOG_SQL}, {PAIRS_SQL} SELECT from_table, to_table, from_column, to_column,
          'one_to_many' AS relation_type, 0.8::DOUBLE AS confidence FROM pairs""",
)
def table_relationships(wh):
    return profile.table_relationships(catalog(wh), profile.bare_name(F.col("column_name")))


KEY_PAIRS = [
    ("region", "r_regionkey", "nation", "n_regionkey"),
    ("nation", "n_nationkey", "customer", "c_nationkey"),
    ("nation", "n_nationkey", "supplier", "s_nationkey"),
    ("customer", "c_nationkey", "supplier", "s_nationkey"),
    ("customer", "c_custkey", "orders", "o_custkey"),
    ("supplier", "s_suppkey", "lineitem", "l_suppkey"),
    ("part", "p_partkey", "lineitem", "l_partkey"),
    ("orders", "o_orderkey", "lineitem", "l_orderkey"),
    ("documents", "doc_id", "labels", "doc_id"),
]


@query(
    "fk_containment",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS from_table, '{b}' AS from_column, '{c}' AS to_table, '{d}' AS to_column,
            count(*) AS child_keys, count(*) FILTER (found) AS found_keys,
            count(*) FILTER (found) / count(*)::DOUBLE AS containment
            FROM (SELECT k, k IN (SELECT {b} FROM {a}) AS found FROM (SELECT DISTINCT {d} AS k FROM {c}))"""
        for a, b, c, d in KEY_PAIRS
    ),
)
def fk_containment(wh):
    tables = all_tables(wh)
    key = profile.bare_name(F.col("column_name"))
    same = profile.bare_name(F.col("from_column")) == profile.bare_name(F.col("to_column"))
    return profile.containment(profile.table_relationships(profile.schema_ids(tables), key).filter(same), tables)


ID_COLUMNS = {
    t: [c for c, kind in schema_columns(t) if kind in INTEGERS and c.endswith(("id", "key"))] for t in TABLES
}


@query(
    "key_inclusions",
    f"""WITH v AS ({" UNION ALL ".join(
        f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, {c}::BIGINT AS v FROM {t} WHERE {c} IS NOT NULL"
        for t, cs in ID_COLUMNS.items() for c in cs)}),
      n AS (SELECT t, c, count(*) AS keys FROM v GROUP BY 1, 2),
      p AS (SELECT a.t AS at, a.c AS ac, b.t AS bt, b.c AS bc, count(*) AS found
            FROM v a JOIN v b ON a.v = b.v AND (a.t, a.c) <> (b.t, b.c) GROUP BY 1, 2, 3, 4)
      SELECT p.at AS from_table, ac AS from_column, bt AS to_table, bc AS to_column, f.keys AS from_keys,
        n.keys AS to_keys, found AS found_keys, found / n.keys::DOUBLE AS containment
      FROM p JOIN n f ON f.t = p.at AND f.c = ac JOIN n ON n.t = bt AND n.c = bc""",
)
def key_inclusions(wh):
    """All pairs of id columns that share keys, from one scan of each table."""
    tables = all_tables(wh)
    return profile.inclusions(
        tables, {t: [f.name for f in df.schema if profile._is_id(f)] for t, df in tables.items()}
    )


def rule_sql(rules, column, default):
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains({column}, '{w}')" for w in words) + f" THEN '{name}'"
        for name, words in rules
    )
    return f"CASE {cases} ELSE {default} END"


RICH_SQL = f"""tables AS (SELECT table_idx, table_name, count(*) FILTER (is_metric) AS n_metrics,
      coalesce({rule_sql(semantic.DOMAIN_PATTERNS, 'table_name', 'NULL')},
        (SELECT arg_min(d, position) FROM (SELECT position, {rule_sql(semantic.DOMAIN_PATTERNS, 'c.column_name', 'NULL')} AS d
           FROM catalog c WHERE c.table_name = o.table_name) WHERE d IS NOT NULL), 'general') AS domain,
      {rule_sql(semantic.SIMPLE_DOMAINS, 'table_name', "'general'")} AS simple_domain
    FROM catalog o GROUP BY table_idx, table_name)"""


@query(
    "table_domain",
    f"WITH {CATALOG_SQL}, {RICH_SQL} SELECT table_name, domain, n_metrics FROM tables",
)
def table_domain(wh):
    return semantic.table_domains(catalog(wh)).select("table_name", "domain", "n_metrics")


@query("table_domain_simple", f"WITH {CATALOG_SQL}, {RICH_SQL} SELECT table_name, simple_domain FROM tables")
def table_domain_simple(wh):
    return semantic.table_domains(catalog(wh)).select("table_name", "simple_domain")


@query(
    "primary_domain",
    f"""WITH {CATALOG_SQL}, {RICH_SQL}, v AS (SELECT domain, 1 + n_metrics * 0.5::DOUBLE AS vote FROM tables
          UNION ALL SELECT simple_domain, n_metrics * 0.5::DOUBLE FROM tables),
        s AS (SELECT domain, sum(vote) AS score FROM v GROUP BY 1),
        b AS (SELECT domain, score / (SELECT sum(score) FROM s) AS share FROM s ORDER BY score DESC, domain LIMIT 1)
        SELECT domain, CASE WHEN domain = 'general' AND share < 0.7 THEN 0.5::DOUBLE ELSE share END AS confidence FROM b""",
)
def primary_domain(wh):
    return semantic.primary_domain(catalog(wh))


TITLE = "array_to_string(list_transform(string_split({}, ' '), lambda w: upper(w[1]) || substr(w, 2)), ' ')"
METRICS_SQL = f"""metrics AS (SELECT table_idx, position, table_name, column_name, replace(column_name, '_', ' ') AS spaced,
      {TITLE.format("replace(column_name, '_', ' ')")} AS title,
      {rule_sql(semantic.METRIC_TYPES, 'column_name', "'sum'")} AS type,
      {rule_sql(semantic.SIMPLE_DOMAINS, 'table_name', "'general'")} AS domain,
      coalesce((SELECT string_agg(d.column_name, '|' ORDER BY d.position) FROM catalog d
         WHERE d.table_name = m.table_name AND d.is_dimension), '') AS dimensions
    FROM catalog m WHERE is_metric)"""


@query(
    "business_metrics",
    f"""WITH {CATALOG_SQL}, {METRICS_SQL}
      SELECT table_name, column_name, type, domain, dimensions,
        CASE WHEN contains(lower(title), table_name) THEN title
             ELSE {TITLE.format("regexp_replace(table_name, 's$', '')")} || ' ' || title END AS name,
        CASE WHEN contains(column_name, 'total') OR contains(column_name, 'amount')
               THEN 'Total ' || spaced || ' from ' || table_name
             WHEN contains(column_name, 'count') THEN 'Number of records in ' || table_name
             WHEN contains(column_name, 'revenue') THEN 'Revenue generated from ' || table_name
             WHEN contains(column_name, 'price') THEN 'Price information from ' || table_name
             ELSE title || ' metric from ' || table_name || ' table' END AS description,
        column_name || '|' || spaced || '|' || table_name || '|' || regexp_replace(table_name, 's$', '') ||
        CASE WHEN contains(column_name, 'amount') OR contains(column_name, 'revenue') THEN '|money|sales|income|revenue'
             WHEN contains(column_name, 'count') OR contains(column_name, 'quantity') THEN '|number|total|count'
             WHEN contains(column_name, 'rate') THEN '|percentage|ratio|rate' ELSE '' END AS keywords
      FROM metrics""",
)
def business_metrics(wh):
    return plain(semantic.business_metrics(catalog(wh)).drop("table_idx", "position"))


@query(
    "sample_queries",
    f"""WITH {CATALOG_SQL}, {METRICS_SQL}, q(domain, question) AS (VALUES
        {", ".join("('%s', '%s')" % (d, q.replace("'", "''")) for d, qs in semantic.SAMPLE_QUESTIONS.items() for q in qs)})
        SELECT DISTINCT question FROM metrics JOIN q USING (domain)""",
)
def sample_queries(wh):
    return semantic.sample_questions(semantic.business_metrics(catalog(wh)))


CONTEXT_SQL = f"""cols AS (SELECT c.*, t.domain FROM catalog c JOIN tables t USING (table_name)),
    words AS (SELECT domain, table_name AS w FROM tables
              UNION SELECT domain, column_name FROM cols WHERE is_metric OR is_dimension),
    ctx AS (SELECT domain, count(*) AS n_tables,
        (SELECT string_agg(w, '|' ORDER BY w) FROM words w WHERE w.domain = t.domain) AS keywords,
        coalesce((SELECT string_agg(DISTINCT column_name, '|' ORDER BY column_name) FROM cols c WHERE c.domain = t.domain AND is_metric), '') AS metrics,
        coalesce((SELECT string_agg(DISTINCT column_name, '|' ORDER BY column_name) FROM cols c WHERE c.domain = t.domain AND is_dimension), '') AS dimensions,
        CASE domain {" ".join(f"WHEN '{d}' THEN '{x}'" for d, x in semantic.DOMAIN_DESCRIPTIONS.items())} END
          || CASE WHEN count(*) > 1 THEN ' with ' || count(*) || ' related data sources' ELSE '' END AS description,
        CASE domain {" ".join(f"WHEN '{d}' THEN [{', '.join(repr(w) for w in ws)}]" for d, ws in semantic.EXPECTED_KEYWORDS.items())}
          ELSE [] END AS expected
      FROM tables t GROUP BY domain),
    sized AS (SELECT *, CASE WHEN metrics = '' THEN 0 ELSE len(string_split(metrics, '|')) END AS nm,
        CASE WHEN dimensions = '' THEN 0 ELSE len(string_split(dimensions, '|')) END AS nd,
        len(list_filter(expected, lambda e: contains(keywords, e))) AS hit FROM ctx)"""


CONFIDENCE_SQL = """greatest(0.3::DOUBLE, least(1.0::DOUBLE, n_tables * 0.2::DOUBLE + nm * 0.1::DOUBLE
    + nd * 0.05::DOUBLE + CASE WHEN len(expected) = 0 THEN 0::DOUBLE ELSE hit::DOUBLE / len(expected) * 0.3::DOUBLE END))"""


@query(
    "domain_contexts",
    f"""WITH {CATALOG_SQL}, {RICH_SQL}, {CONTEXT_SQL}
      SELECT domain, n_tables, keywords, metrics, dimensions, description,
        {CONFIDENCE_SQL} AS confidence,
        CASE domain {" ".join(f"WHEN '{d}' THEN '{'|'.join(t for t, _, _ in g)}'" for d, g in semantic.GLOSSARY.items())} ELSE '' END AS terms,
        concat_ws('|', CASE domain {" ".join(f"WHEN '{d}' THEN '{p[0]}'" for d, p in semantic.QUERY_PATTERNS.items())} END,
          CASE WHEN nm > 0 THEN domain || ' trend analysis' END) AS patterns
      FROM sized""",
)
def domain_contexts(wh):
    return plain(
        semantic.domain_contexts(catalog(wh)).select(
            "domain",
            "n_tables",
            "keywords",
            "metrics",
            "dimensions",
            "description",
            "confidence",
            F.col("glossary.term").alias("terms"),
            F.col("patterns.pattern").alias("patterns"),
        )
    )


GLOSSARY_TEXT = {
    d: " ".join(f"{t} {x} {' '.join(s)}" for t, x, s in g) for d, g in semantic.GLOSSARY.items()
}
PATTERN_TEXT = {
    d: f"{x} {' '.join(k)} {' '.join(e)}" for d, (_, x, k, e) in semantic.QUERY_PATTERNS.items()
}


@query(
    "domain_search_text",
    f"""WITH {CATALOG_SQL}, {RICH_SQL}, {CONTEXT_SQL}
      SELECT domain, concat_ws(' ', domain, description, replace(keywords, '|', ' '),
        nullif(replace(metrics, '|', ' '), ''), nullif(replace(dimensions, '|', ' '), ''),
        (SELECT string_agg(txt, ' ' ORDER BY table_idx) FROM (
           SELECT table_idx, table_name || coalesce(' ' || string_agg(column_name, ' ' ORDER BY position)
             FILTER (is_metric OR is_dimension OR is_id), '') AS txt
           FROM cols c WHERE c.domain = s.domain GROUP BY table_idx, table_name)),
        CASE domain {" ".join(f"WHEN '{d}' THEN '{x}'" for d, x in GLOSSARY_TEXT.items())} END,
        CASE domain {" ".join(f"WHEN '{d}' THEN '{x}'" for d, x in PATTERN_TEXT.items())} END,
        CASE WHEN nm > 0 THEN 'Time-based trend analysis for ' || domain || ' metrics ' ||
          array_to_string(string_split(keywords, '|')[1:3], ' ') || ' trend over time ' || domain ||
          ' trends trends over time' END) AS search_text
      FROM sized s""",
)
def domain_search_text(wh):
    texts = semantic.search_text(semantic.domain_contexts(catalog(wh)))
    return texts.select("domain", "search_text")
