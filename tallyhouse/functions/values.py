"""Lenient value handling for rows that come from JSON or CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions.text import strip


NUMBER_SHAPE = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|Infinity)\z"
BASED_SHAPE = r"^0([xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)\z"


def number_from_text(value: Column) -> Column:
    """The number a text stands for, as a double; NULL when it stands for none."""
    text = strip(value.cast("string"))
    lower = F.lower(text)
    base = F.when(lower.startswith("0x"), 16.0).when(lower.startswith("0o"), 8.0).otherwise(2.0)
    digits = F.split(F.substring(lower, F.lit(3), F.length(lower)), "")
    based = F.aggregate(
        F.array_remove(digits, ""),
        F.lit(0.0),
        lambda n, d: n * base + F.instr(F.lit("0123456789abcdef"), d) - 1,
    )
    return F.when(text.rlike(NUMBER_SHAPE), text.try_cast("double")).when(
        text.rlike(BASED_SHAPE), based
    )


def lenient_number(value: Column) -> Column:
    """A number as a double; anything that is not a number counts as 0."""
    return F.coalesce(number_from_text(value), F.lit(0.0))


def first_truthy(df: DataFrame, names: list[str]) -> Column:
    """First of the columns that holds more than NULL, '' or 0, as a string.

    Names the table does not have are passed over.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for name in names:
        if name not in have:
            continue
        if isinstance(have[name], T.NumericType):
            # NaN is falsy too, and equals itself in SQL
            value = F.col(name)
            keep = (value != 0) & ~F.isnan(value.cast("double"))
            parts.append(F.when(keep, value.cast("string")))
        else:
            value = F.col(name).cast("string")
            parts.append(F.when(value != "", value))
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")


def coalesce_aliases(df: DataFrame, names: list[str], type: str | None = None) -> Column:
    """First non-NULL of the columns that exist; NULL when none exists."""
    have = [F.col(n) for n in names if n in df.columns]
    value = F.coalesce(*have) if have else F.lit(None).cast(type or "string")
    return value.cast(type) if type else value


def humanise(name: str) -> str:
    """``total_sales`` becomes ``Total Sales``."""
    return " ".join(w[:1].upper() + w[1:] for w in name.replace("_", " ").split(" "))


def grouped_digits(value: Column) -> Column:
    """Rounded to a whole number, with thousands separators."""
    return F.format_number(F.round(value), 0)


def in_millions(value: Column) -> Column:
    return value / F.lit(1000000.0)
