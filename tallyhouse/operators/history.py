"""Analytics over the log of past queries.

Log columns: id, user_id, query_type, status, execution_time_ms, row_count,
result_preview (JSON text), created_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append_history(rows: DataFrame, path: str) -> None:
    """Append rows, with a nested preview stored as JSON text."""
    kind = rows.schema["result_preview"].dataType.typeName()
    if kind in ("struct", "array", "map"):
        rows = rows.withColumn("result_preview", F.to_json("result_preview"))
    rows.write.mode("append").parquet(path)


def clamp_page(limit: int, offset: int) -> tuple[int, int]:
    """A page size outside 1 to 100 becomes 50, a negative offset 0."""
    return (limit if 1 <= limit <= 100 else 50), max(offset, 0)


def user_page(log: DataFrame, user: object, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a user's queries, newest first."""
    limit, offset = clamp_page(limit, offset)
    mine = log.filter(F.col("user_id") == user)
    return mine.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def history_pages(log: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """The same page for all users at once.

    Spark keeps at most offset + limit rows of a user in each task before the
    shuffle, so a very active user stays small.
    """
    limit, offset = clamp_page(limit, offset)
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.asc("id"))
    return (
        log.withColumn("_n", F.row_number().over(newest))
        .filter(F.col("_n") <= offset + limit)
        .filter(F.col("_n") > offset)
        .drop("_n")
    )


def with_preview(log: DataFrame, preview_type: str) -> DataFrame:
    """Entries with their preview parsed."""
    return log.withColumn("result_preview", F.from_json("result_preview", preview_type))


def entry(log: DataFrame, id: object, user: object, preview_type: str) -> DataFrame:
    """One entry of a user."""
    mine = (F.col("id") == id) & (F.col("user_id") == user)
    return with_preview(log.filter(mine), preview_type)


def user_stats(log: DataFrame, by: list | None = None) -> DataFrame:
    """Totals per user, combined on the map side. Missing values count as 0."""
    time = F.col("execution_time_ms").cast("decimal(18,2)")
    return (
        log.groupBy(*(by or ["user_id"]))
        .agg(
            F.count("*").alias("total_queries"),
            F.count_if(F.col("status") == "success").alias("successful_queries"),
            F.count_if(F.col("status") == "error").alias("failed_queries"),
            F.sum(time).alias("_time"),
            F.count(time).alias("_timed"),
            F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows_returned"),
        )
        .withColumn(
            "avg_execution_time_ms",
            F.coalesce(F.try_divide(F.col("_time").cast("double"), F.col("_timed")), F.lit(0.0)),
        )
        .drop("_time", "_timed")
    )


def expired(as_of: Column, days: int) -> Column:
    """Whether a row is older than ``days`` days; rows without a time are kept."""
    old = F.col("created_at") < as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    return F.coalesce(old, F.lit(False))


def retain(log: DataFrame, as_of: Column, days: int) -> DataFrame:
    """The log without rows older than ``days`` days."""
    return log.filter(~expired(as_of, days))


def count_expired(log: DataFrame, as_of: Column, days: int) -> DataFrame:
    """How many rows the retention removes."""
    return log.filter(expired(as_of, days)).agg(F.count("*").alias("removed"))


def delete_entries(log: DataFrame, entries: DataFrame) -> DataFrame:
    """The log without the given (id, user_id) pairs."""
    return log.join(entries.select("id", "user_id"), ["id", "user_id"], "left_anti")
