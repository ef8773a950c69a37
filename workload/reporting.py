"""Reports, scans, specs and charts over the order tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyhouse.operators import charts, reports
from tallyhouse.operators.joins import outer_join
from tallyhouse.plans.spec import (
    Aggregation,
    Filter,
    Join,
    QuerySpec,
    Sort,
    TimeRange,
    run_spec,
)
from tallyhouse.sources import registry, tables
from workload.base import NET_SQL, TABLES, money, net_price, plain, query, ratio_sql

# --- scans ---------------------------------------------------------------


@query(
    "scan_table",
    """SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders
       WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus = 'F'""",
)
def scan_table(wh):
    path = f"{wh.root}/orders.parquet"
    since = F.lit("1998-01-01").cast("timestamp_ntz")
    return (
        tables.read_table(wh.spark, "parquet", path)
        .filter((F.col("o_orderdate") >= since) & (F.col("o_orderstatus") == "F"))
        .select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    )


@query(
    "param_query",
    """SELECT o_orderpriority, count(*) AS n FROM orders
       WHERE o_totalprice >= 250000.0 AND o_orderstatus = 'O' GROUP BY 1""",
)
def param_query(wh):
    wh.register(["orders"])
    return tables.parameter_query(
        wh.spark,
        "SELECT o_orderpriority, count(*) AS n FROM orders "
        "WHERE o_totalprice >= $1 AND o_orderstatus = $2 GROUP BY o_orderpriority",
        [250000.0, "O"],
    )


@query(
    "dashboard_union",
    """SELECT 'order_status' AS source, o_orderstatus AS label, count(*) AS orders,
              CAST(sum(o_totalprice::DECIMAL(18,2)) AS DOUBLE) AS revenue,
              CAST(NULL AS BIGINT) AS customers FROM orders GROUP BY 2
       UNION ALL SELECT 'market_segment', c_mktsegment, NULL, NULL, count(*)
              FROM customer GROUP BY 2""",
)
def dashboard_union(wh):
    orders, customer = wh.table("orders"), wh.table("customer")
    missing = wh.find("refunds")
    return plain(
        tables.union_sources(
            {
                "order_status": orders.groupBy(F.col("o_orderstatus").alias("label")).agg(
                    F.count("*").alias("orders"), F.sum(money("o_totalprice")).alias("revenue")
                ),
                "refunds": missing,
                "market_segment": customer.groupBy(F.col("c_mktsegment").alias("label")).agg(
                    F.count("*").alias("customers")
                ),
            }
        )
    )


@query(
    "chart_scan",
    """SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events
       UNION ALL SELECT event_id, CAST(event_id AS BIGINT) FROM events""",
)
def chart_scan(wh):
    payload = F.concat(
        F.lit('{"result":[{"data":['),
        F.col("props"),
        F.lit(',{"k":'),
        F.col("event_id").cast("string"),
        F.lit('}]},{"data":[{"k":-1}]}]}'),
    )
    payloads = wh.table("events").select("event_id", payload.alias("payload"))
    return tables.explode_chart_payload(payloads, "payload", "struct<k: bigint>")


COLUMN_TYPES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def schema_columns(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ")) for c in COLUMN_TYPES[table].split(", ")]


@query(
    "catalog_columns",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({i} AS BIGINT) AS ordinal_position, "
        f"'{kind}' AS data_type, count({c}) AS n_nonnull FROM {t}"
        for t in COLUMN_TYPES
        for i, (c, kind) in enumerate(schema_columns(t), start=1)
    ),
)
def catalog_columns(wh):
    return tables.column_listing({t: wh.table(t) for t in TABLES})


@query(
    "first_nonempty_sample",
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""",
)
def first_nonempty_sample(wh):
    orders = wh.table("orders").select("o_orderkey", "o_totalprice")
    candidates = [wh.find("payments"), orders.filter("o_totalprice < 0"), orders]
    found = tables.first_nonempty(candidates)
    return found.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query(
    "json_rows",
    """SELECT to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_mktsegment': c_mktsegment})::VARCHAR
       AS row_json FROM customer""",
)
def json_rows(wh):
    return tables.as_json_rows(wh.table("customer").select("c_custkey", "c_name", "c_mktsegment"))


def page_registry(wh):
    """Every page as a configured source: its url decides type and credentials."""
    url = F.col("url")
    kind = (
        F.when(url.contains("?"), "superset").when(url.endswith("/"), "mysql").otherwise("postgres")
    )
    token = F.when(url.contains("utm_"), F.lit("t"))
    address = F.when(url.contains("ref="), F.regexp_replace(url, "^https?://", "")).otherwise(url)
    return wh.table("pages").select(
        F.col("page_id").alias("id"),
        kind.alias("type"),
        F.when(url.startswith("https"), "connected").otherwise("disconnected").alias("status"),
        F.create_map(
            F.lit("url"), address, F.lit("bearer_token"), token
        ).alias("config"),
        F.col("page_id").alias("created_at"),
    )


PAGE_TYPE_SQL = """CASE WHEN contains(url, '?') THEN 'superset'
                        WHEN ends_with(url, '/') THEN 'mysql' ELSE 'postgres' END"""


@query(
    "validate_sources",
    f"""SELECT id, type, problem, problem IS NULL AS valid FROM (
         SELECT page_id AS id, {PAGE_TYPE_SQL} AS type,
           CASE WHEN {PAGE_TYPE_SQL} = 'mysql' THEN 'unsupported type'
                WHEN {PAGE_TYPE_SQL} = 'postgres' THEN NULL
                WHEN contains(url, 'ref=') THEN 'url must be a web address'
                WHEN NOT contains(url, 'utm_') THEN 'credentials are required' END AS problem
         FROM pages)""",
)
def validate_sources(wh):
    return registry.validate_sources(page_registry(wh)).select("id", "type", "problem", "valid")


@query(
    "active_sources",
    f"""SELECT page_id AS id, {PAGE_TYPE_SQL} AS type, url FROM pages
        WHERE starts_with(url, 'https') AND {PAGE_TYPE_SQL} = 'postgres'""",
)
def active_sources(wh):
    return registry.list_sources(page_registry(wh), type="postgres", status="connected").select(
        "id", "type", F.col("config")["url"].alias("url")
    )


# --- reports -------------------------------------------------------------


@query(
    "product_line_revenue",
    f"""SELECT p_type AS category, count(*) AS orders, CAST(sum({NET_SQL}) AS DOUBLE) AS revenue,
              CAST(sum({NET_SQL}) AS DOUBLE) / count(*) AS avg_order_value
       FROM lineitem JOIN part ON l_partkey = p_partkey
       GROUP BY p_type ORDER BY revenue DESC, category LIMIT 20""",
)
def product_line_revenue(wh):
    return plain(
        reports.product_line_revenue(
            wh.table("lineitem"), wh.table("part"), ("l_partkey", "p_partkey"), "p_type", net_price()
        )
    )


@query(
    "monthly_orders_revenue",
    f"""SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month,
              count(*) AS orders, CAST(sum({NET_SQL}) AS DOUBLE) AS revenue
       FROM orders JOIN lineitem ON l_orderkey = o_orderkey
       GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 24""",
)
def monthly_orders_revenue(wh):
    return plain(
        reports.monthly_orders_revenue(
            wh.table("orders"),
            wh.table("lineitem"),
            ("o_orderkey", "l_orderkey"),
            "o_orderdate",
            net_price(),
        )
    )


def period():
    return F.concat(
        F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), F.year("o_orderdate").cast("string")
    )


PERIOD_SQL = "'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate)"


def quarterly_sales(wh):
    """Lines of every order under the column names of a sales table."""
    return wh.table("orders").select(
        "o_orderkey",
        period().alias("quarter"),
        F.col("o_orderpriority").alias("category"),
        money("o_totalprice").alias("total_revenue"),
        F.col("o_custkey").alias("quantity"),
    )


@query(
    "sales_projection",
    f"""SELECT {PERIOD_SQL} AS quarter, o_orderpriority AS category,
              CAST(o_totalprice::DECIMAL(18,2) AS DOUBLE) AS total_revenue, o_custkey AS total_sold
       FROM orders""",
)
def sales_projection(wh):
    return plain(reports.sales_projection(quarterly_sales(wh)))


@query(
    "active_users",
    """SELECT strftime(ts, '%Y-%m') AS month_year, event_type AS platform,
              count(DISTINCT user_id) AS active_users FROM events GROUP BY 1, 2""",
)
def active_users(wh):
    return reports.active_users(wh.table("events"), "ts", "user_id", "event_type")


@query(
    "indicator_panel",
    """SELECT n_name AS country_name, year, population, life_expectancy FROM (
         SELECT n_name, CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS population,
                CAST(sum(o_totalprice::DECIMAL(18,2)) AS DOUBLE) AS life_expectancy
         FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey
         GROUP BY 1, 2) WHERE year >= 1998 ORDER BY year DESC, n_name LIMIT 100""",
)
def indicator_panel(wh):
    per_customer = (
        wh.table("orders")
        .groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("year"))
        .agg(F.count("*").alias("n"), F.sum(money("o_totalprice")).alias("price"))
    )
    nations = wh.table("customer").join(
        wh.table("nation"), F.col("n_nationkey") == F.col("c_nationkey")
    )
    wide = (
        per_customer.join(nations, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("n_name").alias("country_name"), "year")
        .agg(F.sum("n").alias("sp_pop_totl"), F.sum("price").alias("sp_dyn_le00_in"))
    )
    names = {"sp_pop_totl": "population", "sp_dyn_le00_in": "life_expectancy"}
    return plain(reports.indicator_panel(wide, names, "year", "country_name", 1998))


@query(
    "segment_analysis",
    f"""WITH s AS (
         SELECT c_mktsegment AS segment_name, strftime(o_orderdate, '%Y-%m') AS month_year,
           count(DISTINCT o_custkey) AS total_customers, count(*) AS n,
           sum(o_totalprice::DECIMAL(18,2)) AS spent,
           count(*) FILTER (o_orderstatus = 'P') AS pending,
           sum(c_acctbal::DECIMAL(18,2)) AS acquisition_cost
         FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
       SELECT segment_name, month_year, total_customers,
         {ratio_sql("spent", "n")} AS avg_order_value,
         CAST(spent AS DOUBLE) AS customer_lifetime_value,
         {ratio_sql("pending * 30", "n")} AS churn_rate,
         CAST(acquisition_cost AS DOUBLE) AS acquisition_cost,
         {ratio_sql("spent", "acquisition_cost")} AS ltv_cac_ratio,
         CASE WHEN {ratio_sql("pending * 30", "n")} < 10 THEN 'Low Risk'
              WHEN {ratio_sql("pending * 30", "n")} < 20 THEN 'Medium Risk'
              ELSE 'High Risk' END AS churn_risk_level
       FROM s""",
)
def segment_analysis(wh):
    per_customer = (
        wh.table("orders")
        .groupBy("o_custkey", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"))
        .agg(
            F.count("*").alias("n"),
            F.sum(money("o_totalprice")).alias("spent"),
            F.count_if(F.col("o_orderstatus") == "P").alias("pending"),
        )
    )
    customers = wh.table("customer").select(
        "c_custkey", F.col("c_mktsegment").alias("segment_name"), money("c_acctbal").alias("balance")
    )
    segments = (
        per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("segment_name", "month")
        .agg(
            F.count("*").alias("total_customers"),
            F.sum("n").alias("n"),
            F.sum("spent").alias("customer_lifetime_value"),
            F.sum("pending").alias("pending"),
            F.sum(F.col("balance") * F.col("n")).alias("acquisition_cost"),
        )
        .withColumns(
            {
                "month_year": F.date_format("month", "yyyy-MM"),
                "avg_order_value": reports.ratio(F.col("customer_lifetime_value"), F.col("n")),
                "churn_rate": reports.ratio(F.col("pending") * 30, F.col("n")),
            }
        )
        .drop("n", "pending", "month")
    )
    return plain(reports.segment_analysis(segments))


@query(
    "weekly_performance",
    f"""WITH o AS (
         SELECT CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS week_ending, o_custkey,
                o_totalprice::DECIMAL(18,2) AS price,
                min(CAST(date_trunc('week', o_orderdate) AS DATE) + 6) OVER (PARTITION BY o_custkey) AS first_week
         FROM orders),
       w AS (SELECT week_ending, count(*) AS total_orders, sum(price) AS revenue,
               count(DISTINCT o_custkey) FILTER (week_ending = first_week) AS new_customers,
               count(DISTINCT o_custkey) FILTER (week_ending > first_week) AS returning_customers
             FROM o GROUP BY 1),
       l AS (SELECT *, lag(revenue) OVER (ORDER BY week_ending) AS prev FROM w)
       SELECT CAST(week_ending AS VARCHAR) AS week_ending, total_orders,
         CAST(revenue AS DOUBLE) AS total_revenue, CAST(revenue AS DOUBLE) / total_orders AS avg_order_value,
         new_customers, returning_customers,
         {ratio_sql("returning_customers * 100", "new_customers + returning_customers")} AS retention_rate,
         CAST(prev AS DOUBLE) AS prev_week_revenue,
         {ratio_sql("(revenue - prev) * 100", "prev")} AS revenue_growth_pct
       FROM l""",
)
def weekly_performance(wh):
    weeks = reports.weekly_sales(wh.table("orders"), "o_orderdate", "o_custkey", money("o_totalprice"))
    return plain(reports.weekly_trends(weeks))


@query(
    "campaign_roi",
    f"""WITH c AS (
         SELECT s_name AS campaign_name,
           sum(l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(4,2)) AS spend,
           sum({NET_SQL}) AS revenue, count(*) FILTER (l_returnflag <> 'R') AS conversions
         FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
       SELECT campaign_name, CAST(spend AS DOUBLE) AS spend, CAST(revenue AS DOUBLE) AS revenue_generated,
         conversions, {ratio_sql("(revenue - spend) * 100", "spend")} AS roi_percentage,
         {ratio_sql("revenue", "spend")} AS roas_ratio,
         {ratio_sql("spend", "conversions")} AS cost_per_conversion
       FROM c WHERE conversions > 0""",
)
def campaign_roi(wh):
    per_supplier = (
        wh.table("lineitem")
        .groupBy("l_suppkey")
        .agg(
            F.sum(money("l_extendedprice") * F.col("l_discount").cast("decimal(4,2)")).alias("spend"),
            F.sum(net_price()).alias("revenue_generated"),
            F.count_if(F.col("l_returnflag") != "R").alias("conversions"),
        )
    )
    names = wh.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("campaign_name"))
    return plain(reports.campaign_roi(per_supplier.join(names, "l_suppkey").drop("l_suppkey")))


@query(
    "demographic_insights",
    """WITH a AS (SELECT o_custkey, min(o_orderdate) AS f, max(o_orderdate) AS t FROM orders GROUP BY 1)
       SELECT c_mktsegment AS customer_segment,
         CASE WHEN c_acctbal / 100 < 25 THEN '18-24' WHEN c_acctbal / 100 < 35 THEN '25-34'
              WHEN c_acctbal / 100 < 45 THEN '35-44' WHEN c_acctbal / 100 < 55 THEN '45-54'
              ELSE '55+' END AS age_group,
         n_name AS nation, count(*) AS customer_count,
         CAST(sum(c_acctbal::DECIMAL(18,2)) AS DOUBLE) / count(c_acctbal) AS avg_ltv,
         CAST(CAST(min(f) AS DATE) AS VARCHAR) AS first_registration,
         CAST(CAST(max(t) AS DATE) AS VARCHAR) AS latest_purchase
       FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN a ON o_custkey = c_custkey
       GROUP BY 1, 2, 3""",
)
def demographic_insights(wh):
    activity = (
        wh.table("orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(
            F.min("o_orderdate").cast("date").alias("first_order"),
            F.max("o_orderdate").cast("date").alias("last_order"),
        )
    )
    customers = (
        wh.table("customer")
        .withColumnRenamed("c_mktsegment", "customer_segment")
        .join(activity, "c_custkey", "left")
        .join(
            wh.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation")),
            "c_nationkey",
        )
    )
    return plain(
        reports.demographic_insights(
            customers,
            ["customer_segment", "nation"],
            F.col("c_acctbal") / 100,
            money("c_acctbal"),
            "first_order",
            "last_order",
        )
    )


def sales_sources(wh):
    orders = wh.table("orders").select(
        F.concat(F.lit("order "), F.col("o_orderkey")).alias("product_name"),
        F.col("o_orderpriority").alias("category"),
        F.col("o_totalprice").alias("sales"),
        period().alias("quarter"),
    )
    lines = wh.table("lineitem").select(
        F.concat(F.lit("line "), F.col("l_orderkey")).alias("name"),
        F.col("l_returnflag").alias("type"),
        F.col("l_extendedprice").alias("revenue"),
        F.date_format("l_shipdate", "yyyy-MM").alias("month_year"),
        F.col("l_linestatus").alias("store_id"),
    )
    return [(orders, reports.SALES_ALIASES), (lines, reports.BIKE_ALIASES)]


UNIFIED_SQL = f"""SELECT 'order ' || o_orderkey AS name, o_orderpriority AS category, o_totalprice AS value,
        {PERIOD_SQL} AS time_period, CAST(NULL AS VARCHAR) AS region FROM orders
      UNION ALL SELECT 'line ' || l_orderkey, l_returnflag, l_extendedprice,
        strftime(l_shipdate, '%Y-%m'), l_linestatus FROM lineitem"""


@query(
    "unified_sales",
    f"""SELECT * FROM ({UNIFIED_SQL}) WHERE name IS NOT NULL AND value IS NOT NULL
       ORDER BY value DESC, name, category, time_period, region LIMIT 20""",
)
def unified_sales(wh):
    return reports.unified_sales(sales_sources(wh))


@query(
    "coalesce_aliases",
    f"""SELECT category, count(*) AS n, count(region) AS with_region,
              CAST(sum(value::DECIMAL(18,2)) AS DOUBLE) AS value FROM ({UNIFIED_SQL}) GROUP BY 1""",
)
def coalesce_aliases(wh):
    (a, a_names), (b, b_names) = sales_sources(wh)
    both = reports.normalise(a, a_names).unionByName(reports.normalise(b, b_names))
    return plain(
        both.groupBy("category").agg(
            F.count("*").alias("n"),
            F.count("region").alias("with_region"),
            F.sum(money("value")).alias("value"),
        )
    )


@query(
    "user_activity",
    """SELECT strftime(ts, '%Y-%m-%d') AS time_period, event_type AS platform,
              count(DISTINCT user_id) AS active_count, CAST(NULL AS VARCHAR) AS new_count,
              CAST(NULL AS VARCHAR) AS region
       FROM events GROUP BY 1, 2 ORDER BY time_period DESC, platform LIMIT 12""",
)
def user_activity(wh):
    daily = (
        wh.table("events")
        .select(F.date_format("ts", "yyyy-MM-dd").alias("period"), F.col("event_type").alias("source"), "user_id")
        .distinct()
        .groupBy("period", "source")
        .agg(F.count("*").alias("users"))
    )
    return reports.user_activity(daily)


@query(
    "rolling_30d_region_sales",
    """SELECT r_name AS region, CAST(sum(o_totalprice::DECIMAL(18,2)) AS DOUBLE) AS total_sales
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
       WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAYS GROUP BY 1""",
)
def rolling_30d_region_sales(wh):
    orders = wh.table("orders")
    as_of = wh.table("orders").agg(F.max("o_orderdate")).scalar()
    recent = (
        reports.trailing_days(orders, "o_orderdate", 30, as_of)
        .groupBy("o_custkey")
        .agg(F.sum(money("o_totalprice")).alias("sales"))
    )
    return plain(
        recent.join(wh.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(wh.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(wh.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("region"))
        .agg(F.sum("sales").alias("total_sales"))
        .orderBy(F.desc("total_sales"))
    )


# --- declarative specs ---------------------------------------------------


def spec_tables(wh):
    return {name: wh.table(name) for name in ("orders", "lineitem", "customer", "nation", "supplier")}


@query(
    "spec_filter",
    """SELECT o_orderkey, o_orderpriority, o_totalprice FROM (SELECT * FROM orders WHERE
       (o_totalprice >= 300000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')) OR o_orderpriority LIKE '5%')""",
)
def spec_filter(wh):
    spec = QuerySpec(
        ["orders"],
        filters=[
            Filter("o_totalprice", ">=", 300000),
            Filter("o_orderpriority", "IN", ["1-URGENT", "2-HIGH"]),
            Filter("o_orderpriority", "LIKE", "5%", "OR"),
        ],
    )
    return run_spec(spec_tables(wh), spec).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query(
    "spec_aggregate",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n,
              sum(l_quantity) / count(l_quantity) AS avg_qty, max(l_extendedprice) AS max_l_extendedprice,
              min(l_discount) AS min_discount FROM lineitem GROUP BY 1, 2""",
)
def spec_aggregate(wh):
    spec = QuerySpec(
        ["lineitem"],
        group_by=["l_returnflag", "l_linestatus"],
        aggregations=[
            Aggregation("SUM", "l_quantity", "sum_qty"),
            Aggregation("COUNT", "*", "n"),
            Aggregation("AVG", "l_quantity", "avg_qty"),
            Aggregation("MAX", "l_extendedprice"),
            Aggregation("MIN", "l_discount", "min_discount"),
        ],
    )
    return run_spec(spec_tables(wh), spec)


def join_spec(kind: str) -> QuerySpec:
    return QuerySpec(
        ["customer"],
        joins=[Join(kind, "orders", "customer.c_custkey = orders.o_custkey AND o_orderstatus = 'P'")],
        group_by=["c_mktsegment"],
        aggregations=[Aggregation("COUNT", "*", "n"), Aggregation("COUNT", "o_orderkey", "with_order")],
    )


@query(
    "spec_join_left",
    """SELECT c_mktsegment, count(*) AS n, count(o_orderkey) AS with_order
       FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY 1""",
)
def spec_join_left(wh):
    return run_spec(spec_tables(wh), join_spec("LEFT"))


@query(
    "spec_join_right",
    """SELECT c_mktsegment, count(*) AS n, count(o_orderkey) AS with_order
       FROM customer RIGHT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY 1""",
)
def spec_join_right(wh):
    return run_spec(spec_tables(wh), join_spec("RIGHT"))


@query(
    "spec_join_full",
    """SELECT c_mktsegment, count(*) AS n, count(o_orderkey) AS with_order
       FROM customer FULL JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY 1""",
)
def spec_join_full(wh):
    return run_spec(spec_tables(wh), join_spec("FULL"))


@query(
    "outer_join_hot",
    """SELECT n_nationkey, n_name, c_custkey, c_nationkey FROM (SELECT * FROM nation WHERE n_nationkey < 20)
       FULL JOIN (SELECT * FROM customer WHERE c_nationkey > 2) ON n_nationkey = c_nationkey""",
)
def outer_join_hot(wh):
    """Nations and their customers: few keys, each of very many rows of the optional side."""
    nations = wh.table("nation").filter("n_nationkey < 20").select("n_nationkey", "n_name")
    customers = wh.table("customer").filter("c_nationkey > 2").select("c_custkey", "c_nationkey")
    return plain(outer_join(nations, customers, [("n_nationkey", "c_nationkey")], "full"))


@query(
    "spec_sort_limit",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""",
)
def spec_sort_limit(wh):
    spec = QuerySpec(["orders"], sort_by=[Sort("o_totalprice", "DESC"), Sort("o_orderkey")], limit=25)
    return run_spec(spec_tables(wh), spec).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "time_range_filter",
    """SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM orders
       WHERE o_orderdate >= TIMESTAMP '1998-04-01' AND o_orderdate < TIMESTAMP '1998-07-01'""",
)
def time_range_filter(wh):
    span = TimeRange("o_orderdate", period="last_quarter", as_of=dt.date(1998, 8, 2))
    return plain(
        run_spec(spec_tables(wh), QuerySpec(["orders"], time_range=span)).select("o_orderkey", "o_orderdate")
    )


@query(
    "spec_full",
    """SELECT n_name, count(*) AS lines, sum(l_quantity) AS quantity
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'
         AND l_discount > 0.05 AND l_returnflag != 'R'
       GROUP BY 1 ORDER BY quantity DESC, n_name LIMIT 10""",
)
def spec_full(wh):
    spec = QuerySpec(
        ["lineitem"],
        joins=[
            Join("INNER", "supplier", "l_suppkey = s_suppkey"),
            Join("INNER", "nation", "s_nationkey = n_nationkey"),
        ],
        time_range=TimeRange("l_shipdate", period="last_year", as_of=dt.date(1998, 3, 1)),
        filters=[Filter("l_discount", ">", 0.05), Filter("l_returnflag", "!=", "R")],
        group_by=["n_name"],
        aggregations=[Aggregation("COUNT", "*", "lines"), Aggregation("SUM", "l_quantity", "quantity")],
        sort_by=[Sort("quantity", "DESC"), Sort("n_name")],
        limit=10,
    )
    return run_spec(spec_tables(wh), spec)


# --- charts --------------------------------------------------------------


@query(
    "group_sum_category",
    """SELECT o_orderpriority AS label, CAST(sum(o_totalprice::DECIMAL(18,2)) AS DOUBLE) AS value
       FROM orders GROUP BY 1""",
)
def group_sum_category(wh):
    return plain(charts.category_breakdown(quarterly_sales(wh)))


@query(
    "time_series_revenue",
    f"""SELECT {PERIOD_SQL} AS label, CAST(sum(o_totalprice::DECIMAL(18,2)) AS DOUBLE) AS value
       FROM orders GROUP BY 1""",
)
def time_series_revenue(wh):
    return plain(charts.time_series(quarterly_sales(wh), charts.REVENUE_ALIASES))


@query(
    "time_series_orders",
    f"""SELECT {PERIOD_SQL} AS label, CAST(sum(o_custkey) AS BIGINT) AS value FROM orders GROUP BY 1""",
)
def time_series_orders(wh):
    return plain(charts.time_series(quarterly_sales(wh), charts.ORDER_ALIASES))


@query(
    "growth_series",
    f"""SELECT {PERIOD_SQL} AS label, CAST(o_totalprice::DECIMAL(18,2) AS DOUBLE) AS revenue, o_orderkey
       FROM orders""",
)
def growth_series(wh):
    return plain(charts.growth_series(quarterly_sales(wh), ["o_orderkey"], ["o_orderkey"]))


@query(
    "top_n_labels",
    "SELECT p_name AS label, p_retailprice AS value FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10",
)
def top_n_labels(wh):
    return charts.first_bars(
        wh.table("part"), "p_name", "p_retailprice", [F.desc("p_retailprice"), "p_partkey"]
    )


@query(
    "record_bars",
    """SELECT 'Record ' || row_number() OVER (ORDER BY value DESC, event_id) AS label, value
       FROM (SELECT * FROM events ORDER BY value DESC, event_id LIMIT 10)""",
)
def record_bars(wh):
    events = wh.table("events").select("event_id", "value")
    return charts.record_bars(events, "value", [F.desc("value"), F.asc("event_id")])


@query(
    "generic_category_top10",
    """SELECT p_brand AS label, CAST(sum(p_retailprice::DECIMAL(18,2)) AS DOUBLE) AS value
       FROM part GROUP BY 1 ORDER BY sum(p_retailprice::DECIMAL(18,2)) DESC, 1 LIMIT 10""",
)
def generic_category_top10(wh):
    return plain(charts.top_categories(wh.table("part"), "p_brand", money("p_retailprice")))


@query(
    "grouped_metrics_top5",
    """SELECT p_brand AS label, CAST(sum(p_retailprice::DECIMAL(18,2)) AS DOUBLE) AS price,
              CAST(sum(p_size) AS BIGINT) AS size, CAST(sum(p_partkey) AS BIGINT) AS number
       FROM part GROUP BY 1 ORDER BY sum(p_retailprice::DECIMAL(18,2)) DESC, 1 LIMIT 5""",
)
def grouped_metrics_top5(wh):
    part = wh.table("part").select(
        "p_brand",
        money("p_retailprice").alias("price"),
        F.col("p_size").alias("size"),
        F.col("p_partkey").alias("number"),
    )
    return plain(charts.grouped_metrics(part, "p_brand", ["price", "size", "number"]))


@query(
    "kpi_summary",
    """WITH t AS (SELECT CAST(sum(o_totalprice::DECIMAL(18,2)) AS DOUBLE) AS s, count(*) AS n,
                    max(o_totalprice) AS m, CAST(sum(o_custkey) AS DOUBLE) AS o FROM orders),
       c AS (SELECT 1 AS position, 'Total Revenue' AS title, s AS amount, '$' AS unit FROM t
             UNION ALL SELECT 2, 'Average Revenue', s / n, '$' FROM t
             UNION ALL SELECT 3, 'Peak Performance', m, '$' FROM t
             UNION ALL SELECT 4, 'Total Orders', o, '' FROM t)
       SELECT CAST(position AS BIGINT) AS position, title, amount,
              unit || format('{:,}', CAST(round(amount) AS BIGINT)) AS text FROM c""",
)
def kpi_summary(wh):
    return charts.kpi_cards(quarterly_sales(wh), limit=4)


@query(
    "chart_set",
    f"""WITH s AS (SELECT {PERIOD_SQL} AS q, o_orderpriority AS c, o_totalprice::DECIMAL(18,2) AS r, o_custkey AS n FROM orders)
       SELECT 'timeSeries' AS chart, q AS label, CAST(sum(r) AS DOUBLE) AS value FROM s GROUP BY 2
       UNION ALL SELECT 'ordersTrend', q, CAST(sum(n) AS DOUBLE) FROM s GROUP BY 2
       UNION ALL SELECT 'categoryBreakdown', c, CAST(sum(r) AS DOUBLE) FROM s GROUP BY 2
       UNION ALL SELECT 'categoryBar', c, CAST(sum(r) AS DOUBLE) FROM s GROUP BY 2
       UNION ALL SELECT 'growth', q, CAST(r AS DOUBLE) FROM s""",
)
def chart_set(wh):
    return plain(charts.chart_rows(quarterly_sales(wh), ["o_orderkey"]).select("chart", "label", "value"))


@query(
    "chart_set_generic",
    """WITH b AS (SELECT event_type AS label, CAST(sum(value::DECIMAL(18,2)) AS DOUBLE) AS cost,
                 CAST(sum(user_id) AS DOUBLE) AS who FROM events GROUP BY 1)
       SELECT 'genericBar' AS chart, label, NULL AS series, cost AS value FROM b
       UNION ALL SELECT 'genericPie', label, NULL, cost FROM b
       UNION ALL SELECT 'genericGrouped', label, 'Cost', cost FROM b
       UNION ALL SELECT 'genericGrouped', label, 'Who', who FROM b""",
)
def chart_set_generic(wh):
    events = wh.table("events").select(
        F.col("event_type").alias("kind"), money("value").alias("cost"), F.col("user_id").alias("who")
    )
    return charts.chart_rows(events, ["kind", "cost", "who"]).select("chart", "label", "series", "value")


@query(
    "chart_set_channels",
    """SELECT 'channelActivity' AS chart, event_type AS label, CAST(sum(CAST(props->>'k' AS BIGINT)) AS DOUBLE) AS value
         FROM events GROUP BY 2
       UNION ALL SELECT 'userEngagement', event_type, CAST(count(*) AS DOUBLE) FROM events GROUP BY 2""",
)
def chart_set_channels(wh):
    events = wh.table("events").select(
        F.col("event_type").alias("channel"),
        F.get_json_object("props", "$.k").alias("messages"),
        F.lit("1").alias("users"),
    )
    return charts.chart_rows(events, ["channel"]).select("chart", "label", "value")


@query(
    "source_counts",
    """SELECT event_type AS source, count(*) AS records FROM events GROUP BY 1
       UNION ALL SELECT NULL, count(*) FROM events""",
)
def source_counts(wh):
    return charts.source_counts(wh.table("events"), "event_type").withColumnRenamed("event_type", "source")


@query(
    "combine_sources",
    """SELECT 'benchmark' AS source, item_id AS id, text, CAST(NULL AS VARCHAR) AS role FROM benchmark
       UNION ALL SELECT 'conversations', conv_id, text, role FROM conversations
       UNION ALL SELECT 'documents', doc_id, text, NULL FROM documents""",
)
def combine_sources(wh):
    return tables.union_sources(
        {
            "benchmark": wh.table("benchmark").withColumnRenamed("item_id", "id"),
            "conversations": wh.table("conversations").select(F.col("conv_id").alias("id"), "text", "role"),
            "documents": wh.table("documents").select(F.col("doc_id").alias("id"), "text"),
            "missing": wh.find("chat_archive"),
        }
    )


@query(
    "preview_rows",
    """SELECT o_orderkey AS "o orderkey", o_totalprice AS "o totalprice" FROM orders
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""",
)
def preview_rows(wh):
    orders = wh.table("orders").select("o_orderkey", "o_totalprice")
    return charts.preview(orders, [F.desc("o_totalprice"), "o_orderkey"])


@query(
    "classify_columns",
    """SELECT CAST(position AS BIGINT) AS position, column_name, kind FROM (VALUES
         (1, 'event_id', 'numeric'), (2, 'ts', 'string'), (3, 'user_id', 'numeric'),
         (7, 'k', (SELECT CASE WHEN bool_and(TRY_CAST(props->>'k' AS DOUBLE) IS NOT NULL)
                          THEN 'numeric' ELSE 'string' END FROM events)),
         (4, 'event_type', (SELECT CASE WHEN bool_and(TRY_CAST(event_type AS DOUBLE) IS NOT NULL)
                          THEN 'numeric' ELSE 'string' END FROM events)),
         (5, 'value', 'numeric'),
         (6, 'props', (SELECT CASE WHEN bool_and(TRY_CAST(props AS DOUBLE) IS NOT NULL)
                          THEN 'numeric' ELSE 'string' END FROM events)))
       AS t(position, column_name, kind)""",
)
def classify_columns(wh):
    events = wh.table("events").withColumn("k", F.get_json_object("props", "$.k"))
    return charts.classify_columns(events)


@query(
    "lenient_numbers",
    """SELECT event_type, CAST(sum(coalesce(TRY_CAST(props->>'k' AS BIGINT), 0)) AS DOUBLE) AS k,
              CAST(0 AS DOUBLE) AS word, CAST(sum(length(event_type)) AS DOUBLE) / 1000000 AS millions
       FROM events GROUP BY 1""",
)
def lenient_numbers(wh):
    from tallyhouse.functions.values import in_millions, lenient_number

    events = wh.table("events").withColumn("k", F.get_json_object("props", "$.k"))
    return events.groupBy("event_type").agg(
        F.sum(lenient_number(F.col("k"))).alias("k"),
        F.sum(lenient_number(F.col("event_type"))).alias("word"),
        in_millions(F.sum(F.length("event_type")).cast("double")).alias("millions"),
    )


@query(
    "flag_error_payloads",
    """SELECT user_id, day, n_rows, CASE WHEN n_rows = 1 THEN p END AS problem,
              n_rows > 1 OR p IS NULL AS has_real_data FROM (
         SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n_rows,
           min(CASE event_type WHEN 'error' THEN 'Unable to retrieve data: ' || props
                               WHEN 'view' THEN 'Data retrieval issue: ' || props END) AS p
         FROM events GROUP BY 1, 2)""",
)
def flag_error_payloads(wh):
    rows = wh.table("events").select(
        "user_id",
        F.col("ts").cast("date").cast("string").alias("day"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        F.when(F.col("event_type") == "view", F.col("props")).alias("message"),
    )
    return charts.flag_error_payloads(rows, ["user_id", "day"])
