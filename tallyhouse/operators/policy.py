"""Read-only policy for SQL text and hygiene checks for requests.

Each check adds a verdict to a table of texts. ``guarded_sql`` applies the
same rules to one statement before Spark runs it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import text as tx

# Refused parts of statements, patterns of allowed shapes, limits.
DANGEROUS_PARTS = [
    "DROP", "DELETE", "INSERT", "UPDATE", "ALTER", "CREATE", "TRUNCATE", "REPLACE", "EXEC",
    "EXECUTE", "GRANT", "REVOKE", "MERGE", "CALL", ";DROP", "; DROP", "--", "/*", "*/", "XP_",
    "SP_", "INFORMATION_SCHEMA", "PG_SLEEP", "WAITFOR", "BENCHMARK", "INTO OUTFILE",
    "INTO DUMPFILE", "LOAD_FILE", "COPY ", "\\COPY",
]
REQUEST_PARTS = [
    "DROP", "DELETE", "INSERT", "UPDATE", "ALTER", "CREATE", "EXEC", "EXECUTE", "XP_", "SP_",
    "SHUTDOWN", "GRANT", "REVOKE",
]
SUSPICIOUS_PARTS = [
    "<script", "javascript:", "vbscript:", "onload=", "onerror=", "eval(", "exec(", "system(",
    "drop table", "delete from", "insert into", "update set", "union select", "--", ";--", "/*",
    "*/", "xp_", "sp_",
]
# White space is spelled out, because \s means more in some engines than in others.
SPACE = r"[\t\n\f\r ]"
FROM_SHAPE = rf"(?i)^{SPACE}*SELECT{SPACE}+[^\n]+{SPACE}+FROM{SPACE}+[\w.]+"
CONSTANT_SHAPE = rf"(?i)^{SPACE}*SELECT{SPACE}+[\d\t\n\f\r +\-*/]+({SPACE}+as{SPACE}+\w+)?{SPACE}*\z"
MAX_STATEMENT = 10000
MAX_REQUEST = 2000
MAX_QUESTION = 1000
MAX_NAME = 100
NAME_SHAPE = r"^[a-zA-Z0-9\t\n\f\r \-_]+\z"
UUID_SHAPE = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"


def audit(df: DataFrame, sql: str) -> DataFrame:
    """Verdict on every statement, and the refused parts found in it.

    The verdict is ok, too_long, invalid or dangerous; the first rule that
    applies decides. Parts are searched for once, in a column of their own.
    """
    body, upper = F.col("_body"), F.col("_upper")
    inner = F.when(body.endswith(";"), F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    shaped = body.rlike(FROM_SHAPE) | body.rlike(CONSTANT_SHAPE)
    verdict = (
        F.when(F.octet_length(F.col(sql)) > MAX_STATEMENT, "too_long")
        .when(body == "", "invalid")
        .when(~upper.startswith("SELECT"), "dangerous")
        .when(F.size("refused_parts") > 0, "dangerous")
        .when(inner.contains(";"), "dangerous")
        .when(~shaped, "invalid")
        .otherwise("ok")
    )
    return (
        df.withColumn("_body", tx.strip(F.col(sql)))
        .withColumn("_upper", F.upper("_body"))
        .withColumn("refused_parts", tx.hits(upper, DANGEROUS_PARTS))
        .withColumn("verdict", verdict)
        .drop("_body", "_upper")
    )


def check_requests(df: DataFrame, sql: str) -> DataFrame:
    """Verdict of the stricter check of statements in requests."""
    upper = F.col("_upper")
    verdict = (
        F.when(F.col(sql) == "", "invalid")
        .when(F.octet_length(F.col(sql)) > MAX_REQUEST, "too_long")
        .when(~tx.strip(upper).startswith("SELECT"), "bad_format")
        .when(tx.contains_any(upper, REQUEST_PARTS), "suspicious")
        .otherwise("ok")
    )
    return df.withColumn("_upper", F.upper(F.col(sql))).withColumn("verdict", verdict).drop("_upper")


def check_questions(df: DataFrame, question: str) -> DataFrame:
    """Verdict on texts that are sent as questions."""
    verdict = (
        F.when(F.col(question) == "", "invalid")
        .when(F.octet_length(F.col(question)) > MAX_QUESTION, "too_long")
        .when(tx.contains_any(F.col("_lower"), SUSPICIOUS_PARTS), "suspicious")
        .otherwise("ok")
    )
    return df.withColumn("_lower", F.lower(F.col(question))).withColumn("verdict", verdict).drop("_lower")


def name_verdict(name: Column) -> Column:
    return (
        F.when(name == "", "invalid")
        .when(F.octet_length(name) > MAX_NAME, "too_long")
        .when(~name.rlike(NAME_SHAPE), "bad_format")
        .otherwise("ok")
    )


def id_verdict(id: Column) -> Column:
    return F.when(id == "", "invalid").when(~id.rlike(UUID_SHAPE), "bad_format").otherwise("ok")


def tables_read(df: DataFrame) -> set[str]:
    """Names of the views, tables and files that an analysed query reads, wherever it
    does: in joins, in subqueries and in expressions."""
    analysed = df._jdf.queryExecution().analyzed()
    found, waiting = set(), [analysed]
    while waiting:
        plan = waiting.pop()
        kind = plan.nodeName()
        if kind == "View":
            # what a view is made of is the business of whoever registered it
            found.add(plan.desc().identifier().table())
        else:
            if plan.children().isEmpty() and kind not in ("OneRowRelation", "LocalRelation"):
                found.add(plan.toString().strip())
            for inner in (plan.children(), plan.subqueries()):
                waiting += [inner.apply(i) for i in range(inner.size())]
    return found


def guarded_sql(spark: SparkSession, sql: str, views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Run one statement if the policy allows it.

    With ``views`` the statement may read these tables and nothing else. They are
    registered under their names; what it reads is taken from its analysed plan, so
    that neither a file path, a catalog table nor a subquery gets around the list.
    """
    verdict = audit(spark.range(1).select(F.lit(sql).alias("sql")), "sql").first().verdict
    if verdict != "ok":
        raise PermissionError(f"statement refused: {verdict}")
    for name, table in (views or {}).items():
        table.createOrReplaceTempView(name)
    df = spark.sql(sql.strip().removesuffix(";"))
    if views is not None:
        others = tables_read(df) - {name.lower() for name in views} - set(views)
        if others:
            raise PermissionError(f"statement refused: reads {', '.join(sorted(others))}")
    return df
