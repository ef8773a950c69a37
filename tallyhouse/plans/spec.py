"""A declarative query spec, applied as DataFrame calls.

Several data sources are appended by column name. The order of application is join, time range, filter, group and aggregate,
sort, limit. Catalyst pushes filters below the joins and prunes columns.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: Any
    condition: str = "AND"


@dataclass(frozen=True)
class Aggregation:
    function: str
    field: str
    alias: str | None = None


@dataclass(frozen=True)
class Sort:
    field: str
    direction: str = "ASC"


@dataclass(frozen=True)
class Join:
    type: str
    table: str
    on_condition: str


@dataclass(frozen=True)
class TimeRange:
    """Absolute bounds, or a named range counted from the day ``as_of``."""

    field: str
    start: dt.datetime | None = None
    end: dt.datetime | None = None
    period: str | None = None
    relative: str | None = None
    as_of: dt.date | None = None


@dataclass(frozen=True)
class QuerySpec:
    data_sources: list[str]
    joins: list[Join] = field(default_factory=list)
    time_range: TimeRange | None = None
    filters: list[Filter] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    aggregations: list[Aggregation] = field(default_factory=list)
    sort_by: list[Sort] = field(default_factory=list)
    limit: int | None = None
    #: ``table`` (rows as they are) or ``json``, ``csv``: one column ``row`` of text.
    output_format: str = "table"


OPERATORS = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "IN": lambda c, v: c.isin(list(v)),
    "LIKE": lambda c, v: c.like(v),
}
AGGREGATES = {"SUM": F.sum, "COUNT": F.count, "AVG": F.avg, "MAX": F.max, "MIN": F.min}
JOIN_TYPES = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full"}


def _constant(df: DataFrame, field: str, value: Any) -> Any:
    """A date or time as a constant of the column's own type.

    Otherwise the column would be converted, and the filter not reach the scan.
    """
    if not isinstance(value, dt.date):
        return value
    kind = df.select(F.col(field)).schema[0].dataType.simpleString()
    text = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value.isoformat()
    return F.lit(text).cast(kind)


def predicate(df: DataFrame, filters: list[Filter]) -> Column:
    """The filters joined from left to right by their AND / OR conditions."""

    def add(left: Column | None, f: Filter) -> Column:
        test = OPERATORS[f.operator.upper()](F.col(f.field), _constant(df, f.field, f.value))
        if left is None:
            return test
        return left | test if f.condition.upper() == "OR" else left & test

    return reduce(add, filters, None)


def _day(date: dt.date) -> dt.datetime:
    return dt.datetime(date.year, date.month, date.day)


def time_bounds(span: TimeRange) -> tuple[dt.datetime | None, dt.datetime | None]:
    """Half-open bounds; named ranges are whole calendar units before ``as_of``.

    ``last_7_days`` are the seven full days before the day ``as_of``.
    """
    name = span.relative or span.period
    if not name:
        return span.start, span.end
    if span.as_of is None:
        raise ValueError(f"the range {name} needs as_of")
    today = _day(span.as_of)
    day = dt.timedelta(days=1)
    if name == "today":
        return today, today + day
    if name == "yesterday":
        return today - day, today
    if name == "last_7_days":
        return today - 7 * day, today
    if name == "last_week":
        monday = today - today.weekday() * day
        return monday - 7 * day, monday
    if name == "last_month":
        first = today.replace(day=1)
        return (first - day).replace(day=1), first
    if name == "last_quarter":
        first = today.replace(month=(today.month - 1) // 3 * 3 + 1, day=1)
        before = first - day
        return before.replace(month=before.month - 2, day=1), first
    if name == "last_year":
        first = today.replace(month=1, day=1)
        return first.replace(year=first.year - 1), first
    raise ValueError(f"unknown time range {name}")


def in_time_range(df: DataFrame, span: TimeRange) -> DataFrame:
    """Rows of the range. Bounds are constants of the column's own type, so
    that the comparison reaches the scan."""
    start, end = time_bounds(span)
    column = F.col(span.field)
    if start is not None:
        df = df.filter(column >= _constant(df, span.field, start))
    if end is not None:
        df = df.filter(column < _constant(df, span.field, end))
    return df


def aggregate_columns(aggregations: list[Aggregation]) -> list[Column]:
    columns = []
    for a in aggregations:
        function = a.function.upper()
        target = F.lit(1) if a.field == "*" else F.col(a.field)
        alias = a.alias or f"{function.lower()}_{'all' if a.field == '*' else a.field}"
        columns.append(AGGREGATES[function](target).alias(alias))
    return columns


def run_spec(tables: Mapping[str, DataFrame], spec: QuerySpec) -> DataFrame:
    if not spec.data_sources:
        raise ValueError("a spec needs a data source")
    base, *others = spec.data_sources
    df = tables[base]
    for name in others:
        df = df.unionByName(tables[name], allowMissingColumns=True)
    df = df.alias(base)
    for join in spec.joins:
        other = tables[join.table].alias(join.table)
        df = df.join(other, F.expr(join.on_condition), JOIN_TYPES[join.type.upper()])
    if spec.time_range is not None:
        df = in_time_range(df, spec.time_range)
    if spec.filters:
        df = df.filter(predicate(df, spec.filters))
    if spec.aggregations:
        df = df.groupBy(*spec.group_by).agg(*aggregate_columns(spec.aggregations))
    elif spec.group_by:
        df = df.select(*spec.group_by).distinct()
    if spec.sort_by:
        df = df.orderBy(
            *[
                F.desc_nulls_last(s.field)
                if s.direction.upper() == "DESC"
                else F.asc_nulls_last(s.field)
                for s in spec.sort_by
            ]
        )
    if spec.limit is not None:
        df = df.limit(spec.limit)
    return laid_out(df, spec.output_format)


def laid_out(df: DataFrame, output_format: str) -> DataFrame:
    """The rows in an output format; a format that is not known is an error."""
    row = F.struct("*")
    if output_format in ("", "table"):
        return df
    if output_format == "json":
        return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("row"))
    if output_format == "csv":
        return df.select(F.to_csv(row).alias("row"))
    raise ValueError(f"unknown output format {output_format}")
