"""Business reports: joins, ratios, bands, lags and rolling windows.

Every join on a fact key is preceded by an aggregation on that key. Spark
combines it on the map side, so a key that holds a third of all rows reaches
the shuffle as one row per task and cannot make one task slow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.values import coalesce_aliases


def ratio(numerator: Column, denominator: Column, scale: int = 2) -> Column:
    """Rounded quotient of two exact numbers; NULL when the divisor is 0."""
    exact = F.try_divide(numerator.cast("decimal(28,4)"), denominator.cast("decimal(28,4)"))
    return F.round(exact, scale).cast("double")


def product_line_revenue(
    details: DataFrame,
    products: DataFrame,
    key: tuple[str, str],
    line: str,
    amount: Column,
    limit: int = 20,
) -> DataFrame:
    """Orders, revenue and average order value per product line, best first."""
    per_product = details.groupBy(F.col(key[0]).alias("_key")).agg(
        F.count("*").alias("_n"), F.sum(amount).alias("_amount")
    )
    lines = products.select(F.col(key[1]).alias("_key"), F.col(line).alias("category"))
    return (
        per_product.join(lines, "_key")
        .groupBy("category")
        .agg(F.sum("_n").alias("orders"), F.sum("_amount").alias("revenue"))
        .withColumn("avg_order_value", F.try_divide(F.col("revenue").cast("double"), F.col("orders")))
        .orderBy(F.desc("revenue"), "category")
        .limit(limit)
    )


def monthly_orders_revenue(
    orders: DataFrame,
    details: DataFrame,
    key: tuple[str, str],
    date: str,
    amount: Column,
    limit: int = 24,
) -> DataFrame:
    """Detail rows and revenue per calendar month, oldest first."""
    per_order = details.groupBy(F.col(key[1]).alias("_key")).agg(
        F.count("*").alias("_n"), F.sum(amount).alias("_amount")
    )
    dated = orders.select(
        F.col(key[0]).alias("_key"),
        F.year(date).cast("long").alias("year"),
        F.month(date).cast("long").alias("month"),
    )
    return (
        dated.join(per_order, "_key")
        .groupBy("year", "month")
        .agg(F.sum("_n").alias("orders"), F.sum("_amount").alias("revenue"))
        .orderBy("year", "month")
        .limit(limit)
    )


def sales_projection(sales: DataFrame) -> DataFrame:
    """Period, category, revenue and units, in report order."""
    return sales.select(
        "quarter", "category", "total_revenue", F.col("quantity").alias("total_sold")
    ).orderBy("quarter", "category", "total_revenue", "total_sold")


def active_users(activity: DataFrame, date: str, user: str, platform: str) -> DataFrame:
    """Distinct users per month and platform.

    The distinct step runs on (month, platform, user), which spreads a busy
    platform over all tasks; only then are users counted.
    """
    return (
        activity.select(
            F.trunc(F.col(date).cast("date"), "month").alias("_month"),
            F.col(platform).alias("platform"),
            F.col(user).alias("_user"),
        )
        .distinct()
        .groupBy("_month", "platform")
        .agg(F.count("_user").alias("active_users"))
        .select(F.date_format("_month", "yyyy-MM").alias("month_year"), "platform", "active_users")
        .orderBy("month_year", "platform")
    )


def indicator_panel(
    wide: DataFrame, names: dict[str, str], year: str, country: str, since: int, limit: int = 100
) -> DataFrame:
    """Indicator codes renamed to readable columns, recent years first."""
    return (
        wide.filter(F.col(year) >= since)
        .withColumnsRenamed(names)
        .orderBy(F.desc(year), country)
        .limit(limit)
    )


def segment_analysis(segments: DataFrame) -> DataFrame:
    """Value-to-cost ratio and churn band for each segment and month."""
    band = (
        F.when(F.col("churn_rate") < 10, "Low Risk")
        .when(F.col("churn_rate") < 20, "Medium Risk")
        .otherwise("High Risk")
    )
    return segments.withColumns(
        {
            "ltv_cac_ratio": ratio(F.col("customer_lifetime_value"), F.col("acquisition_cost")),
            "churn_risk_level": band,
        }
    ).orderBy(F.desc("month_year"), F.desc("customer_lifetime_value"), "segment_name")


def weekly_trends(weeks: DataFrame, partition: list[str] | None = None) -> DataFrame:
    """Retention, previous revenue and growth over a table of weeks.

    The input holds one row per week (and partition), a few hundred rows for
    several years, so the ordered window without a partition is small.
    """
    window = (Window.partitionBy(*partition) if partition else Window.partitionBy()).orderBy(
        "week_ending"
    )
    both = F.col("new_customers") + F.col("returning_customers")
    previous = F.lag("total_revenue").over(window)
    with_lag = weeks.withColumn("prev_week_revenue", previous)
    growth = (F.col("total_revenue") - F.col("prev_week_revenue")) * 100
    return with_lag.withColumns(
        {
            "retention_rate": ratio(F.col("returning_customers") * 100, both),
            "revenue_growth_pct": ratio(growth, F.col("prev_week_revenue")),
        }
    ).orderBy(F.desc("week_ending"))


def weekly_sales(orders: DataFrame, date: str, customer: str, amount: Column) -> DataFrame:
    """Orders, revenue, new and returning customers per week.

    Orders are first combined to one row per customer and week. The window over
    one customer thus sees at most as many rows as there are weeks, however
    many orders the customer placed.
    """
    week = F.date_add(F.trunc(F.col(date).cast("date"), "week"), 6)
    per_customer = orders.groupBy(F.col(customer).alias("_customer"), week.alias("week_ending")).agg(
        F.count("*").alias("_orders"), F.sum(amount).alias("_amount")
    )
    first = F.min("week_ending").over(Window.partitionBy("_customer"))
    return (
        per_customer.withColumn("_new", F.col("week_ending") == first)
        .groupBy("week_ending")
        .agg(
            F.sum("_orders").alias("total_orders"),
            F.sum("_amount").alias("total_revenue"),
            F.count_if("_new").alias("new_customers"),
            F.count_if(~F.col("_new")).alias("returning_customers"),
        )
        .withColumn(
            "avg_order_value",
            F.try_divide(F.col("total_revenue").cast("double"), F.col("total_orders")),
        )
    )


def campaign_roi(campaigns: DataFrame) -> DataFrame:
    """Return, revenue per spend and cost per conversion of converting campaigns."""
    gain = (F.col("revenue_generated") - F.col("spend")) * 100
    return (
        campaigns.filter(F.col("conversions") > 0)
        .withColumns(
            {
                "roi_percentage": ratio(gain, F.col("spend")),
                "roas_ratio": ratio(F.col("revenue_generated"), F.col("spend")),
                "cost_per_conversion": ratio(F.col("spend"), F.col("conversions")),
            }
        )
        .orderBy(F.desc("roi_percentage"), "campaign_name")
    )


def age_band(age: Column) -> Column:
    return (
        F.when(age < 25, "18-24")
        .when(age < 35, "25-34")
        .when(age < 45, "35-44")
        .when(age < 55, "45-54")
        .otherwise("55+")
    )


def demographic_insights(
    customers: DataFrame,
    keys: list[str],
    age: Column,
    value: Column,
    first_date: str,
    last_date: str,
) -> DataFrame:
    """Customers, mean value and activity span for each segment, age band and key."""
    segment, *others = keys
    return (
        customers.withColumn("age_group", age_band(age))
        .groupBy(segment, "age_group", *others)
        .agg(
            F.count("*").alias("customer_count"),
            F.try_divide(F.sum(value).cast("double"), F.count(value)).alias("avg_ltv"),
            F.min(first_date).alias("first_registration"),
            F.max(last_date).alias("latest_purchase"),
        )
        .orderBy(segment, F.desc("avg_ltv"), "age_group", *others)
    )


# Alias columns of the two sales sources, by output column.
SALES_ALIASES = {
    "name": ["product_name", "name", "item_name"],
    "category": ["category", "type", "class"],
    "value": ["total_sales", "sales", "revenue", "amount"],
    "time_period": ["quarter", "period", "month"],
    "region": ["region", "location", "area"],
}
BIKE_ALIASES = {
    "name": ["bike_model", "product_name", "name"],
    "category": ["bike_category", "category", "type"],
    "value": ["total_revenue", "revenue", "sales"],
    "time_period": ["quarter", "period", "month_year"],
    "region": ["region", "store_id", "location"],
}
USER_ALIASES = {
    "time_period": ["month_year", "period", "date"],
    "active_count": ["active_users", "users", "count"],
    "new_count": ["new_users", "new_count", "acquisitions"],
    "platform": ["platform", "source", "channel"],
    "region": ["region", "location", "area"],
}


def normalise(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Project a source onto common columns, whichever alias columns it has."""
    return df.select(*[coalesce_aliases(df, names).alias(out) for out, names in aliases.items()])


def unified_sales(sources: list[tuple[DataFrame, dict[str, list[str]]]], limit: int = 20) -> DataFrame:
    """Sales of several sources under common column names, largest first."""
    combined = None
    for df, aliases in sources:
        part = normalise(df, aliases)
        combined = part if combined is None else combined.unionByName(part)
    return (
        combined.filter(F.col("name").isNotNull() & F.col("value").isNotNull())
        .orderBy(F.desc("value"), "name", "category", "time_period", "region")
        .limit(limit)
    )


def user_activity(activity: DataFrame, limit: int = 12) -> DataFrame:
    """Active and new users per period under common column names."""
    known = [c for c in ("month_year", "period") if c in activity.columns]
    if not known:
        raise ValueError("the activity table has neither month_year nor period")
    return (
        activity.filter(F.coalesce(*known).isNotNull())
        .transform(normalise, USER_ALIASES)
        .orderBy(F.desc("time_period"), "platform", "region")
        .limit(limit)
    )


def trailing_days(df: DataFrame, timestamp: str, days: int, as_of: Column) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``."""
    return df.filter(F.col(timestamp) >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
