"""What a round of near-dedup makes of firsts that many buckets share."""

from pyspark.sql import functions as F

from tallyhouse.llm import neardup


def rows_made(plan, of: str) -> int:
    """Rows that the nodes of that name have put out, by Spark's own counters."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return rows_made(plan.executedPlan(), of)
    if "QueryStage" in plan.nodeName():
        return rows_made(plan.plan(), of)
    below = plan.children()
    own = plan.metrics().apply("numOutputRows").value() if plan.nodeName() == of else 0
    return own + sum(rows_made(below.apply(i), of) for i in range(below.size()))


def test_a_first_of_many_buckets_is_one_row(spark):
    """Sixty nodes that meet in each of thirty buckets, where the firsts are the same."""
    rows = spark.range(60).select(
        F.col("id").alias("node"),
        F.explode(F.sequence(F.lit(0), F.lit(29))).alias("bucket"),
        F.col("id").alias("class"),
    )
    # a table, so that the only rows made are those of the round
    rows = neardup.written(rows, "rows")
    for salts, limit in ((range(1), 4), (range(1, 5), None)):
        pairs = neardup.drawn_pairs(rows, salts, limit)
        found = pairs.collect()
        assert len({(r.node, r.other) for r in found}) == len(found)
        assert {r.node for r in found} | {r.other for r in found} == set(range(60))
        assert all(r["class"] == r.node != r.other == r.other_class for r in found)
        made = rows_made(pairs._jdf.queryExecution().executedPlan(), "Generate")
        assert made == len(found) <= 60 * len(salts), (made, len(found))


def test_hashes_of_words_take_little_memory():
    """A worker keeps its words while it waits, beside all that run in its executor."""
    for i in range(200):
        neardup.shingles(" ".join(f"w{i}x{j}" for j in range(1000)), 5)
    assert len(neardup._WORDS) <= 60_000
