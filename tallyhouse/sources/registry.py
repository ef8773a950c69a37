"""The registry of configured data sources, kept as an ordinary table.

Columns: id, name, type, status, config (map of strings), created_at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_sources(
    registry: DataFrame, type: str | None = None, status: str | None = None
) -> DataFrame:
    """Sources of a type or status, newest first."""
    if type is not None:
        registry = registry.filter(F.col("type") == type)
    if status is not None:
        registry = registry.filter(F.col("status") == status)
    return registry.orderBy(F.col("created_at").desc(), "id")


def source_by_id(registry: DataFrame, wanted: DataFrame, id: str) -> DataFrame:
    """``wanted`` with ``source``, the registry's row of the id in column ``id``, as a
    struct; NULL where there is no such source."""
    rows = registry.groupBy(F.col("id").alias("_id")).agg(F.first(F.struct(*registry.columns)).alias("source"))
    return wanted.join(rows, F.col(id) == F.col("_id"), "left").drop("_id")


def validate_sources(registry: DataFrame) -> DataFrame:
    """Add ``valid`` and ``problem`` according to the rules of each source type."""

    def filled(key: str):
        return F.coalesce(F.col("config")[key], F.lit("")) != ""

    url = F.coalesce(F.col("config")["url"], F.lit(""))
    bi = F.col("type") == "superset"
    database = F.col("type") == "postgres"
    web = url.startswith("http://") | url.startswith("https://")
    credentials = (filled("username") & filled("password")) | filled("bearer_token")
    problem = (
        F.when(~(bi | database), "unsupported type")
        .when(url == "", "url is required")
        .when(bi & ~web, "url must be a web address")
        .when(bi & ~credentials, "credentials are required")
    )
    return registry.withColumn("problem", problem).withColumn("valid", F.col("problem").isNull())
