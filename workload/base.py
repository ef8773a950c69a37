"""Registration of the queries that run on the given tables.

Each query is a function of a Warehouse. ``sql`` is the equivalent for the
independent check engine; both sides lay results out plainly (no nested
columns, decimals as doubles, dates as text) so that values can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.sources.tables import Warehouse

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)

QUERIES: dict[str, Callable[[Warehouse], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def plain(df: DataFrame) -> DataFrame:
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.IntegerType):
            c = c.cast("long")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.concat_ws("|", c)
        columns.append(c.alias(f.name))
    return df.select(*columns)


def money(name: str):
    """A price column as an exact number, so that sums do not depend on order."""
    return F.col(name).cast("decimal(18,2)")


def net_price():
    return money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))


NET_SQL = "(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2)))"


def ratio_sql(a: str, b: str) -> str:
    """Half-up quotient to two places, by whole-number arithmetic on 1/10000."""
    n = f"CAST(({a}) * 10000 AS HUGEINT)"
    d = f"CAST(({b}) * 10000 AS HUGEINT)"
    return (
        f"(CASE WHEN {d} = 0 THEN NULL ELSE "
        f"CAST(sign({n}) * sign({d}) * ((abs({n}) * 200 + abs({d})) // (2 * abs({d}))) AS DOUBLE) / 100 END)"
    )
