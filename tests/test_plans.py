"""What the physical plans must and must not contain."""

import datetime as dt

import pytest

import __spark_entry__ as contract
from tallyhouse.plans.spec import Filter, QuerySpec, Sort, run_spec
from tallyhouse.sources.tables import Warehouse

SF_DIR = "/root/testdata/sf0.001"
QUERIES = contract.queries()


def plan(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize(
    "name",
    [
        "product_line_revenue",
        "segment_analysis",
        "spec_join_full",
        "match_datasets",
        "route_queries",
        "analysis_context",
        "table_relationships",
        "vector_topk",
        "history_delete",
    ],
)
def test_no_cross_join_and_no_row_functions(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert word not in text


@pytest.mark.parametrize(
    "name", ["intent_planner", "extract_keywords", "sql_policy_audit", "mine_questions", "hash_embed"]
)
def test_no_shuffle(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, SF_DIR))


@pytest.mark.parametrize("name", ["history_page", "vector_topk", "vector_upsert"])
def test_ranking_is_cut_before_the_shuffle(spark, name):
    assert plan(QUERIES[name](spark, SF_DIR)).count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("name", ["scan_table", "time_range_filter"])
def test_filters_reach_the_scan(spark, name):
    assert "GreaterThanOrEqual(o_orderdate" in plan(QUERIES[name](spark, SF_DIR))


def test_spec_dates_reach_the_scan(spark):
    orders = Warehouse(spark, SF_DIR).table("orders")
    for value in (dt.date(1998, 1, 1), dt.datetime(1998, 1, 1)):
        spec = QuerySpec(["orders"], filters=[Filter("o_orderdate", "<", value)])
        df = run_spec({"orders": orders}, spec).select("o_orderkey")
        assert "LessThan(o_orderdate" in plan(df)
        assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan(df)


def test_output_formats(spark):
    rows = spark.createDataFrame([(1, "a,b"), (2, None)], "n int, t string")
    spec = lambda form: QuerySpec(["rows"], sort_by=[Sort("n")], output_format=form)
    texts = {f: [r[0] for r in run_spec({"rows": rows}, spec(f)).collect()] for f in ("table", "json", "csv")}
    assert texts["table"] == [1, 2]
    assert texts["json"] == ['{"n":1,"t":"a,b"}', '{"n":2,"t":null}']
    assert texts["csv"] == ['1,"a,b"', "2,"]
    with pytest.raises(ValueError):
        run_spec({"rows": rows}, spec("chart"))


def test_first_join_is_on_aggregated_keys(spark):
    text = plan(QUERIES["product_line_revenue"](spark, SF_DIR))
    tree = text[: text.index("(1) Scan")]
    join = min(i for i in (tree.find("BroadcastHashJoin"), tree.find("SortMergeJoin")) if i >= 0)
    assert "HashAggregate" in tree[join:]


@pytest.mark.parametrize("name,scans", [("chart_set", 2), ("chart_set_channels", 1), ("chart_set_generic", 1)])
def test_charts_share_their_scan(spark, name, scans):
    """The growth chart, which has every row, is the second scan of chart_set."""
    text = plan(QUERIES[name](spark, SF_DIR))
    assert text[: text.index("(1) Scan")].count("Scan parquet") == scans
