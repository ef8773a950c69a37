"""Outer joins with hot keys are the ordinary outer joins."""

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators.joins import outer_join


def as_text(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def sides(spark):
    left = [(i % 7 if i % 5 else None, "x" if i % 2 else "y", i) for i in range(60)]
    right = [(3, "x", i) for i in range(300)] + [(i, "y", i) for i in range(4, 12)] + [(None, "x", 0), (3, None, 1)]
    return (
        spark.createDataFrame(left, "a int, kind string, n int").repartition(3),
        spark.createDataFrame(right, "b long, sort string, m int").repartition(4),
    )


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_same_as_plain_join(sides, how):
    left, right = sides
    one = left.join(right, F.col("a") == F.col("b"), how)
    assert as_text(outer_join(left, right, [("a", "b")], how)) == as_text(one)
    both = (F.col("a") == F.col("b")) & (F.col("kind") == F.col("sort"))
    two = left.join(right, both, how)
    assert as_text(outer_join(left, right, [("a", "b"), ("kind", "sort")], how)) == as_text(two)
    assert as_text(outer_join(left, right.limit(0), [("a", "b")], how)) == as_text(
        left.join(right.limit(0), F.col("a") == F.col("b"), how)
    )


def test_only_the_inner_join_meets_all_rows(sides):
    """Outer parts see distinct keys: no plan node is an outer join."""
    left, right = sides
    plan = outer_join(left, right, [("a", "b")], "full")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and plan.count("Join LeftAnti") == 2
    assert "Outer" not in plan and plan.count("Aggregate") == 2


def test_names_and_kinds(sides):
    left, right = sides
    with pytest.raises(ValueError):
        outer_join(left, right.withColumnRenamed("m", "N"), [("a", "b")], "full")
    with pytest.raises(ValueError):
        outer_join(left, right, [("a", "b")], "inner")
