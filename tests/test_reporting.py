import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import values
from tallyhouse.operators import charts, reports
from tallyhouse.plans import spec as sp
from tallyhouse.sources import registry, tables

D = Decimal


@pytest.fixture
def sales(spark):
    rows = [
        ("Q1 2024", "Road", D("100.50"), 2, None),
        ("Q2 2024", "Road", D("50.00"), 1, "N"),
        ("Q1 2024", "Urban", D("10.25"), 5, "S"),
        ("Q2 2024", None, D("1.00"), 7, "S"),
    ]
    return spark.createDataFrame(
        rows, "quarter string, bike_category string, total_revenue decimal(12,2), quantity int, region string"
    )


def as_dict(df, key="label", value="value"):
    return {r[key]: float(r[value]) for r in df.collect()}


def test_group_sums(sales):
    assert as_dict(charts.category_breakdown(sales)) == {"Road": 150.5, "Urban": 10.25, None: 1.0}
    assert as_dict(charts.time_series(sales, charts.REVENUE_ALIASES)) == {"Q1 2024": 110.75, "Q2 2024": 51.0}
    assert as_dict(charts.time_series(sales, charts.ORDER_ALIASES)) == {"Q1 2024": 7, "Q2 2024": 8}


def test_numbers_as_text(spark):
    df = spark.createDataFrame(
        [("a", "43999.80"), ("a", " 1e2 "), ("b", "x"), ("b", None), ("b", "NaN")], "category string, revenue string"
    )
    assert as_dict(charts.category_breakdown(df)) == {"a": 44099.8, "b": 0.0}


def test_kpi_cards(sales):
    rows = charts.kpi_cards(sales).orderBy("position").collect()
    assert [(r.title, r.text) for r in rows] == [
        ("Total Revenue", "$162"),
        ("Average Revenue", "$40"),
        ("Peak Performance", "$101"),
    ]
    assert charts.kpi_cards(sales, 4).filter("position = 4").first().text == "15"
    assert charts.kpi_cards(sales.limit(0)).isEmpty()


def test_kpi_falls_back_to_other_value_columns(spark):
    df = spark.createDataFrame([(1200.4, 10.0), (0.0, 5.0)], "sales double, users double")
    rows = charts.kpi_cards(df, 4).orderBy("position").collect()
    assert [r.text for r in rows] == ["M1,200", "M600", "M1,200", "15"]


def test_top_categories_and_grouped(sales):
    top = charts.top_categories(sales, "bike_category", F.col("total_revenue"))
    assert [r.label for r in top.collect()] == ["Road", "Urban", "Unknown"]
    grouped = charts.grouped_metrics(sales, "bike_category", ["total_revenue", "quantity"])
    assert [(r.label, float(r.total_revenue), r.quantity) for r in grouped.collect()] == [
        ("Road", 150.5, 3),
        ("Urban", 10.25, 5),
        ("Unknown", 0.0, 0),
    ]


def test_first_rows(sales):
    bars = charts.record_bars(sales, "quantity", ["quantity"], 2).collect()
    assert [(r.label, r.value) for r in bars] == [("Record 1", 1.0), ("Record 2", 2.0)]
    assert charts.preview(sales, ["quantity"], 1).columns[2] == "total revenue"
    series = charts.growth_series(sales, ["quantity"]).collect()
    assert [float(r.revenue) for r in series] == [100.5, 10.25, 50.0, 1.0]


def test_classify_columns(spark):
    df = spark.createDataFrame([("1", "x", None, True), (" ", "2", "", False)], "a string, b string, c string, d boolean")
    assert {r.column_name: r.kind for r in charts.classify_columns(df).collect()} == {
        "a": "numeric",
        "b": "string",
        "c": "numeric",
        "d": "numeric",
    }


def test_segments_and_campaigns(spark):
    segments = spark.createDataFrame(
        [("A", "2024-01", 9.99, 200.0, 8.0), ("B", "2024-02", 10.0, 100.0, 0.0), ("C", "2024-02", 20.0, 300.0, 7.0)],
        "segment_name string, month_year string, churn_rate double, customer_lifetime_value double, acquisition_cost double",
    )
    rows = reports.segment_analysis(segments).collect()
    assert [(r.segment_name, r.ltv_cac_ratio, r.churn_risk_level) for r in rows] == [
        ("C", 42.86, "High Risk"),
        ("B", None, "Medium Risk"),
        ("A", 25.0, "Low Risk"),
    ]
    campaigns = spark.createDataFrame(
        [("x", 100.0, 350.0, 4), ("y", 100.0, 50.0, 3), ("z", 1.0, 1.0, 0)],
        "campaign_name string, spend double, revenue_generated double, conversions int",
    )
    rows = reports.campaign_roi(campaigns).collect()
    assert [(r.campaign_name, r.roi_percentage, r.roas_ratio, r.cost_per_conversion) for r in rows] == [
        ("x", 250.0, 3.5, 25.0),
        ("y", -50.0, 0.5, 33.33),
    ]


def test_weekly_trends(spark):
    weeks = spark.createDataFrame(
        [("2024-01-07", D("100.00"), 3, 1), ("2024-01-14", D("150.00"), 1, 3), ("2024-01-21", D("75.00"), 0, 0)],
        "week_ending string, total_revenue decimal(12,2), new_customers int, returning_customers int",
    )
    rows = reports.weekly_trends(weeks).collect()
    assert [(r.retention_rate, r.revenue_growth_pct) for r in rows] == [(None, -50.0), (75.0, 50.0), (25.0, None)]


def test_age_bands(spark):
    df = spark.createDataFrame([(a,) for a in (24, 25, 34, 44, 54, 55)], "age int")
    assert [r[0] for r in df.select(reports.age_band(F.col("age"))).collect()] == [
        "18-24", "25-34", "25-34", "35-44", "45-54", "55+",
    ]


def test_time_bounds():
    def bounds(**named):
        start, end = sp.time_bounds(sp.TimeRange("d", as_of=dt.date(2024, 1, 31), **named))
        return start.date().isoformat(), end.date().isoformat()

    assert bounds(relative="today") == ("2024-01-31", "2024-02-01")
    assert bounds(relative="yesterday") == ("2024-01-30", "2024-01-31")
    assert bounds(relative="last_7_days") == ("2024-01-24", "2024-01-31")
    assert bounds(period="last_week") == ("2024-01-22", "2024-01-29")
    assert bounds(period="last_month") == ("2023-12-01", "2024-01-01")
    assert bounds(period="last_quarter") == ("2023-10-01", "2024-01-01")
    assert bounds(period="last_year") == ("2023-01-01", "2024-01-01")
    with pytest.raises(ValueError):
        bounds(period="last_decade")


def test_spec_joins_and_order(spark):
    left = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "a int, x int")
    right = spark.createDataFrame([(1, 5), (4, 6)], "b int, y int")
    known = {"l": left, "r": right}

    def run(kind):
        spec = sp.QuerySpec(["l"], joins=[sp.Join(kind, "r", "l.a = r.b")], sort_by=[sp.Sort("a"), sp.Sort("b")])
        return [(r.a, r.b) for r in sp.run_spec(known, spec).collect()]

    assert run("INNER") == [(1, 1)]
    assert run("LEFT") == [(1, 1), (2, None), (3, None)]
    assert run("RIGHT") == [(1, 1), (None, 4)]
    assert run("FULL") == [(1, 1), (2, None), (3, None), (None, 4)]
    spec = sp.QuerySpec(["l"], sort_by=[sp.Sort("x", "DESC")], limit=2)
    assert [r.x for r in sp.run_spec(known, spec).collect()] == [20, 10]


def test_spec_appends_sources(spark):
    known = {"a": spark.createDataFrame([(1, 2)], "k int, x int"), "b": spark.createDataFrame([(3,)], "k int")}
    spec = sp.QuerySpec(["a", "b"], filters=[sp.Filter("k", ">", 0), sp.Filter("x", "=", 2, "OR")])
    assert sorted((r.k, r.x) for r in sp.run_spec(known, spec).collect()) == [(1, 2), (3, None)]


def test_sources(spark, tmp_path, sales):
    path = str(tmp_path / "out")
    for kind in ("csv", "json", "parquet"):
        tables.write_table(sales, kind, f"{path}-{kind}")
        schema = None if kind == "parquet" else sales.schema
        back = tables.read_table(spark, kind, f"{path}-{kind}", schema)
        assert back.exceptAll(sales).isEmpty() and back.count() == 4
    with pytest.raises(ValueError):
        tables.read_table(spark, "csv", path)
    sales.createOrReplaceTempView("sales")
    found = tables.parameter_query(spark, "SELECT * FROM sales WHERE quantity > $1 AND region = $2", [2, "S"])
    assert found.count() == 2
    with pytest.raises(ValueError):
        tables.parameter_query(spark, "SELECT $1", [1, 2])
    with pytest.raises(ValueError):
        tables.union_sources({"x": None})


def test_validate_sources(spark):
    rows = [
        ("superset", {"url": "https://x", "username": "u", "password": "p"}),
        ("superset", {"url": "ftp://x", "bearer_token": "t"}),
        ("superset", {"url": "http://x", "username": "u", "password": ""}),
        ("postgres", {"url": "postgres://x"}),
        ("postgres", {}),
        ("mysql", {"url": "x"}),
    ]
    df = spark.createDataFrame(rows, "type string, config map<string,string>")
    assert [r.problem for r in registry.validate_sources(df).collect()] == [
        None,
        "url must be a web address",
        "credentials are required",
        None,
        "url is required",
        "unsupported type",
    ]


def test_first_truthy(spark):
    df = spark.createDataFrame([("", 0, "c"), ("a", 1, "c"), (None, 2, "c")], "a string, b int, c string")
    got = df.select(values.first_truthy(df, ["missing", "a", "b", "c"]).alias("v")).collect()
    assert [r.v for r in got] == ["c", "a", "2"]
    assert values.humanise("total_sales") == "Total Sales"


def test_error_payloads(spark):
    df = spark.createDataFrame(
        [(1, "boom", None), (2, None, "hm"), (3, None, None), (4, "x", None), (4, None, None)],
        "id int, error string, message string",
    )
    rows = charts.flag_error_payloads(df, ["id"]).orderBy("id").collect()
    assert [r.problem for r in rows] == ["Unable to retrieve data: boom", "Data retrieval issue: hm", None, None]
    assert [r.has_real_data for r in rows] == [False, False, True, True]


def test_chart_choice(spark, sales):
    def made(rows, schema):
        return charts.prepare_charts(spark.createDataFrame(rows, schema), ["rank"])

    births = made([("Emma", 10, "F", 1), ("Liam", 9, "M", 2), ("Ava", 5, "F", 3)], "name string, births int, gender string, rank int")
    assert as_dict(births["genderBreakdown"]) == {"F": 15, "M": 9}
    assert [r.label for r in births["topNames"].collect()] == ["Emma", "Liam", "Ava"]
    games = made([("g%d" % i, "P", 1.5, i) for i in range(9)], "game string, platform string, sales double, rank int")
    assert set(games) == {"platformBreakdown", "topGames"} and games["topGames"].count() == 8
    states = made([("CA", 2500000, 61.5, 1)], "state string, vaccinated long, percentage double, rank int")
    assert as_dict(states["topStates"]) == {"CA": 2.5}
    assert as_dict(states["vaccinationPercentage"]) == {"CA": 61.5}
    assert set(charts.prepare_charts(sales, ["quantity"])) == {"timeSeries", "categoryBreakdown", "categoryBar", "growth"}
    numbers = made([(5, 1), (6, 2)], "amount int, rank int")
    assert [(r.label, r.value) for r in numbers["genericBar"].collect()] == [("Record 1", 5.0), ("Record 2", 6.0)]
    single = made([("x", 1)], "kind string, rank int")
    assert single["genericBar"].count() == 1 and single["genericPie"].isEmpty()


def test_chart_rows_are_the_prepared_charts(spark, sales):
    tables = [
        (sales, ["quantity"]),
        ([("Emma", 10, "F", 1), ("Liam", 9, "M", 2), ("Ava", None, None, 3)], "name string, births int, gender string, rank int"),
        ([("g%d" % i, "PQ"[i % 2], 1.5, i) for i in range(9)], "game string, platform string, sales double, rank int"),
        ([("CA", 2500000, 61.5, 1), ("NY", 5, None, 2)], "state string, vaccinated long, percentage double, rank int"),
        ([(5, 1), (6, 2)], "amount int, rank int"),
        ([("x", 1)], "kind string, rank int"),
        ([("k%d" % (i % 12) if i % 5 else None, i, i % 7, 2 * i) for i in range(60)], "kind string, rank int, a int, b int"),
        ([], "kind string, rank int, a int"),
    ]
    for rows, schema in tables:
        df, order = (rows, schema) if isinstance(schema, list) else (spark.createDataFrame(rows, schema), ["rank"])
        prepared = charts.charts_as_rows(charts.prepare_charts(df, order))
        at_once = charts.chart_rows(df, order)
        columns = [c for c in ("chart", "label", "series", "value") if c in prepared.columns]
        got = sorted(map(str, at_once.select(*columns).collect()))
        assert got == sorted(map(str, prepared.select(*columns).collect()))


def test_lenient_number(spark):
    texts = [" 12 ", "1e3", ".5", "5.", "1d", "0x1F", "Infinity", "inf", "", None, "1,000", "-2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in df.orderBy("i").select(values.lenient_number(F.col("t")).alias("v")).collect()]
    assert got == [12.0, 1000.0, 0.5, 5.0, 0.0, 31.0, float("inf"), 0.0, 0.0, 0.0, 0.0, -2.0]


def test_based_numbers_of_any_length(spark):
    texts = ["0x1fffffffffffffff", "0b11", "0o17", "0b2", "0x" + "0" * 40 + "a", "0x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.v for r in df.orderBy("i").select(values.lenient_number(F.col("t")).alias("v")).collect()]
    assert got == [float(2**61), 3.0, 15.0, 0.0, 10.0, 0.0]
