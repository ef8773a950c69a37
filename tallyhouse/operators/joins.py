"""Outer joins whose optional side may have hot keys.

Adaptive execution splits a hot key of either side of an inner join, but never of the
optional side of an outer one. So an outer join is put together here: the inner join,
and the rows without a partner, found against the distinct keys of the other side,
which Spark combines before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("left", "right", "full")


def outer_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str) -> DataFrame:
    """The columns of both sides, joined where all pairs of columns in ``on`` are equal.

    ``how`` is left, right or full. NULL keys have no partner. Both sides need names
    of their own.
    """
    if how.lower() not in KINDS:
        raise ValueError(f"an outer join is one of {', '.join(KINDS)}, not {how}")
    twice = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if twice:
        raise ValueError(f"both sides have columns {', '.join(sorted(twice))}")
    of_left, of_right = [a for a, _ in on], [b for _, b in on]
    parts = [left.join(right, _equal(of_left, of_right))]
    if how.lower() in ("left", "full"):
        parts.append(_alone(left, of_left, right, of_right))
    if how.lower() in ("right", "full"):
        parts.append(_alone(right, of_right, left, of_left))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _equal(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [_column(x) == _column(y) for x, y in zip(left, right)])


def _alone(rows: DataFrame, keys: Sequence[str], others: DataFrame, other_keys: Sequence[str]) -> DataFrame:
    """Rows whose keys do not occur among the others'."""
    known = others.select(*[_column(k) for k in other_keys]).distinct()
    return rows.join(known, _equal(keys, other_keys), "left_anti")
