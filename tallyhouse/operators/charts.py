"""Chart and KPI data preparation.

Everything is one aggregation (combined on the map side) or a top-n; charts
that show the first rows take an explicit order, because a distributed table
has no arrival order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions.text import strip
from tallyhouse.functions.values import (
    first_truthy,
    grouped_digits,
    humanise,
    in_millions,
    lenient_number,
    number_from_text,
)
from tallyhouse.sources.tables import union_sources

# Alias columns in order of preference.
PERIOD_ALIASES = ["quarter", "Quarter", "month", "Month", "month_year"]
REVENUE_ALIASES = ["total_revenue", "revenue", "Revenue"]
ORDER_ALIASES = ["orders", "Orders", "quantity", "total_bikes_sold"]
CATEGORY_ALIASES = ["bike_category", "category", "Category"]
COUNT_ALIASES = ["orders", "Orders", "quantity", "total_bikes_sold", "users", "messages"]

# KPI value column, unit and the three titles, by priority.
KPI_KINDS = [
    ("revenue", "$", "Total Revenue", "Average Revenue", "Peak Performance"),
    ("sales", "M", "Total Sales", "Average Sales", "Top Game Sales"),
    ("births", "", "Total Births", "Average Births", "Most Popular Name"),
    ("messages", "", "Total Messages", "Average Messages", "Most Active Channel"),
    ("vaccinated", "", "Total Vaccinated", "Average per State", "Highest State"),
]


def number_of(df: DataFrame, names: list[str]) -> Column:
    """First non-zero of the columns that exist, else 0.

    Exact columns stay exact; strings and floats are read leniently.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    have = [n for n in names if n in types]
    exact = (T.DecimalType, T.IntegralType)
    if have and all(isinstance(types[n], exact) for n in have):
        return F.coalesce(*[F.nullif(F.col(n), F.lit(0)) for n in have], F.lit(0))
    return lenient_number(first_truthy(df, have))


def group_sum(df: DataFrame, label: Column, value: Column) -> DataFrame:
    """One sum per label."""
    return df.groupBy(label.alias("label")).agg(F.sum(F.coalesce(value, F.lit(0))).alias("value"))


def category_breakdown(df: DataFrame) -> DataFrame:
    return group_sum(df, first_truthy(df, CATEGORY_ALIASES), number_of(df, REVENUE_ALIASES))


def time_series(df: DataFrame, values: list[str]) -> DataFrame:
    return group_sum(df, first_truthy(df, PERIOD_ALIASES), number_of(df, values)).orderBy("label")


def growth_series(df: DataFrame, order: list, keep: list[str] | None = None) -> DataFrame:
    """Revenue of every row in period order, without aggregation.

    ``order`` settles the order within a period; it also lets the sort spread
    a period with very many rows over several tasks.
    """
    names = [c for c in ("quarter", "Quarter") if c in df.columns] or ["month", "Month"]
    ordered = df.withColumns(
        {"_label": first_truthy(df, names), "_value": number_of(df, REVENUE_ALIASES)}
    ).orderBy("_label", *order)
    return ordered.select(F.col("_label").alias("label"), F.col("_value").alias("revenue"), *(keep or []))


def first_bars(df: DataFrame, label: str, value: str, order: list, n: int = 10) -> DataFrame:
    """Label and value of the first ``n`` rows in the given order."""
    return (
        df.orderBy(*order).limit(n).select(F.col(label).alias("label"), F.col(value).alias("value"))
    )


def record_bars(df: DataFrame, value: str, order: list, n: int = 10) -> DataFrame:
    """The first ``n`` rows labelled "Record 1", "Record 2", …

    The window without a partition numbers the ``n`` rows kept by the limit.
    """
    first = df.orderBy(*order).limit(n)
    position = F.row_number().over(Window.orderBy(*order))
    return first.select(
        F.concat(F.lit("Record "), position.cast("string")).alias("label"),
        lenient_number(F.col(value)).alias("value"),
    )


def category_or_unknown(df: DataFrame, category: str) -> Column:
    return F.coalesce(first_truthy(df, [category]), F.lit("Unknown"))


def top_categories(df: DataFrame, category: str, value: Column, n: int = 10) -> DataFrame:
    """The ``n`` categories with the largest sums."""
    return (
        group_sum(df, category_or_unknown(df, category), value)
        .orderBy(F.desc("value"), "label")
        .limit(n)
    )


def grouped_metrics(
    df: DataFrame, category: str, values: list[str], n_categories: int = 5, n_values: int = 3
) -> DataFrame:
    """Sums of up to three metrics for the five categories that lead by the first.

    Rows without a category rank as "Unknown", but their metrics are not shown.
    Ranking and sums come out of one aggregation.
    """
    values = values[:n_values]
    known = first_truthy(df, [category]).isNotNull()
    sums = [
        F.coalesce(F.sum(F.when(known, F.col(v))), F.lit(0)).alias(v) for v in values
    ]
    rank = F.sum(F.coalesce(F.col(values[0]), F.lit(0))).alias("_rank")
    return (
        df.groupBy(category_or_unknown(df, category).alias("label"))
        .agg(rank, *sums)
        .orderBy(F.desc("_rank"), "label")
        .limit(n_categories)
        .drop("_rank")
    )


def kpi_cards(df: DataFrame, limit: int = 3) -> DataFrame:
    """Total, mean and maximum of the main value, and a count-like total.

    Only the first three cards are shown by default. The mean divides by all
    rows, also those without a value.
    """
    names = [c.lower() for c in df.columns]
    kind = next((k for k in KPI_KINDS if any(k[0] in n for n in names)), KPI_KINDS[0])
    field, unit, *titles = kind
    value = number_of(df, list(dict.fromkeys([field, *REVENUE_ALIASES])))
    totals = df.select(value.alias("v"), number_of(df, COUNT_ALIASES).alias("n")).agg(
        F.sum("v").cast("double").alias("total"),
        F.count("*").alias("rows"),
        F.max("v").cast("double").alias("peak"),
        F.sum("n").cast("double").alias("orders"),
    )

    def card(position: int, title: str, amount: Column, text: Column) -> Column:
        return F.struct(
            F.lit(position).cast("long").alias("position"),
            F.lit(title).alias("title"),
            amount.alias("amount"),
            text.alias("text"),
        )

    amounts = [F.col("total"), F.col("total") / F.col("rows"), F.col("peak")]
    cards = [
        card(i, title, amount, F.concat(F.lit(unit), grouped_digits(amount)))
        for i, (title, amount) in enumerate(zip(titles, amounts), start=1)
    ]
    extra = F.when(
        F.col("orders") > 0,
        card(4, "Total Orders", F.col("orders"), grouped_digits(F.col("orders"))),
    )
    return (
        totals.filter(F.col("rows") > 0)
        .select(F.explode(F.slice(F.array_compact(F.array(*cards, extra)), 1, limit)).alias("c"))
        .select("c.*")
    )


def source_counts(df: DataFrame, source: str = "source") -> DataFrame:
    """Records per source, and the total in the row without a source.

    The total is rolled up from the counts, so rows are not read twice.
    """
    counts = df.groupBy(source).agg(F.count("*").alias("records"))
    return counts.rollup(source).agg(F.sum("records").alias("records"))


def preview(df: DataFrame, order: list, n: int = 50) -> DataFrame:
    """The first rows under readable headers."""
    first = df.orderBy(*order).limit(n)
    return first.toDF(*[c.replace("_", " ") for c in first.columns])


def classify_columns(df: DataFrame) -> DataFrame:
    """Numeric or string, per column.

    Typed columns follow the schema. A string column is numeric when every
    value is a number (NULL and '' count as such), found in one pass.
    """
    cells = []
    for i, f in enumerate(df.schema.fields, start=1):
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            numeric = F.lit(True)
        elif isinstance(f.dataType, T.StringType):
            odd = (strip(F.col(f.name)) != "") & number_from_text(F.col(f.name)).isNull()
            numeric = F.count_if(odd) == 0
        else:
            numeric = F.lit(False)
        cells.append(
            F.struct(
                F.lit(i).cast("long").alias("position"),
                F.lit(f.name).alias("column_name"),
                F.when(numeric, "numeric").otherwise("string").alias("kind"),
            )
        )
    return df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


def flag_error_payloads(rows: DataFrame, result_id: list[str]) -> DataFrame:
    """Result sets that are no data but one row with an error or a message."""
    problem = F.coalesce(
        F.concat(F.lit("Unable to retrieve data: "), F.col("error")),
        F.concat(F.lit("Data retrieval issue: "), F.col("message")),
    )
    return (
        rows.groupBy(*result_id)
        .agg(F.count("*").alias("n_rows"), F.min(problem).alias("_problem"))
        .withColumn("problem", F.when(F.col("n_rows") == 1, F.col("_problem")))
        .withColumn("has_real_data", F.col("problem").isNull())
        .drop("_problem")
    )


# Charts by the words that must occur in column names, with the
# alias columns of label and value. A number gives the rows of a first-rows chart.
PERIOD = ("quarter", "month")
SUM_CHARTS = [
    ("genderBreakdown", ["name", "births", "gender"], ["gender", "Gender"], ["births", "Births"]),
    ("platformBreakdown", ["game", "sales"], ["platform", "Platform"], ["sales", "Sales"]),
    ("channelActivity", ["channel", "messages"], ["channel", "Channel"], ["messages", "Messages"]),
    ("userEngagement", ["channel", "messages", "users"], ["channel", "Channel"], ["users", "Users"]),
    ("timeSeries", [PERIOD, "revenue"], PERIOD_ALIASES, REVENUE_ALIASES),
    ("ordersTrend", [PERIOD, "order"], PERIOD_ALIASES, ORDER_ALIASES),
    ("categoryBreakdown", ["category", "revenue"], CATEGORY_ALIASES, REVENUE_ALIASES),
    ("categoryBar", ["category", "revenue"], CATEGORY_ALIASES, REVENUE_ALIASES),
]
FIRST_ROW_CHARTS = [
    ("topNames", ["name", "births", "gender"], ["name", "Name"], ["births", "Births"], 10),
    ("topGames", ["game", "sales"], ["game", "Game"], ["sales", "Sales"], 8),
    ("topStates", ["state", "vaccinated"], ["state", "State"], ["vaccinated", "Vaccinated"], 10),
    (
        "vaccinationPercentage",
        ["state", "vaccinated", "percentage"],
        ["state", "State"],
        ["percentage", "Percentage"],
        10,
    ),
]
IN_MILLIONS = {"topStates"}


def _applies(names: list[str], needed: list) -> bool:
    def occurs(word) -> bool:
        words = (word,) if isinstance(word, str) else word
        return any(w in n for w in words for n in names)

    return all(occurs(word) for word in needed)


def prepare_charts(df: DataFrame, order: list) -> dict[str, DataFrame]:
    """The charts that fit the column names, as tables of label and value.

    ``order`` stands for the order of arrival and has to be total. Without a
    fitting chart, generic charts are made from the column types.
    """
    names = [c.lower() for c in df.columns]
    charts = {}
    for name, needed, labels, amounts in SUM_CHARTS:
        if _applies(names, needed):
            charts[name] = group_sum(df, first_truthy(df, labels), number_of(df, amounts))
    for name, needed, labels, amounts, n in FIRST_ROW_CHARTS:
        if _applies(names, needed):
            amount = number_of(df, amounts)
            if name in IN_MILLIONS:
                amount = in_millions(amount)
            first = df.orderBy(*order).limit(n)
            charts[name] = first.select(first_truthy(df, labels).alias("label"), amount.alias("value"))
    if _applies(names, [PERIOD]):
        charts["growth"] = growth_series(df, order).withColumnRenamed("revenue", "value")
    return charts or _generic_charts(df, order)


def chart_rows(df: DataFrame, order: list) -> DataFrame:
    """The charts of ``prepare_charts`` in one table: chart, label, (series) and value.

    All charts of sums come out of one scan and one grouping: every row is laid out once
    for each kind of label, as grouping sets do, and the sums of a label are then dealt
    to the charts that show them. Charts of first rows share their first rows. Only the
    growth chart, which has every row, is a scan of its own.
    """
    names = [c.lower() for c in df.columns]
    sums = [c for c in SUM_CHARTS if _applies(names, c[1])]
    firsts = [c for c in FIRST_ROW_CHARTS if _applies(names, c[1])]
    parts = []
    if sums:
        parts.append(_summed(df, sums))
    if firsts:
        first = df.orderBy(*order).limit(max(c[4] for c in firsts))
        numbered = first.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
        cells = []
        for name, _, labels, amounts, n in firsts:
            amount = number_of(df, amounts)
            amount = in_millions(amount) if name in IN_MILLIONS else amount
            cells.append(F.when(F.col("_n") <= n, _cell(name, first_truthy(df, labels), amount)))
        parts.append(numbered.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*"))
    if _applies(names, [PERIOD]):
        growth = growth_series(df, order)
        parts.append(growth.select(_cell("growth", F.col("label"), F.col("revenue")).alias("c")).select("c.*"))
    if not parts:
        return _generic_rows(df, order)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def _cell(chart: str, label: Column, value: Column) -> Column:
    return F.struct(
        F.lit(chart).alias("chart"), label.cast("string").alias("label"), value.cast("double").alias("value")
    )


def _summed(df: DataFrame, charts: list) -> DataFrame:
    kinds, amounts = [], []
    for _, _, labels, values in charts:
        kinds += [labels] if labels not in kinds else []
        amounts += [values] if values not in amounts else []
    laid_out = [
        F.struct(F.lit(i).alias("kind"), first_truthy(df, k).cast("string").alias("label")) for i, k in enumerate(kinds)
    ]
    totals = (
        df.select(
            F.explode(F.array(*laid_out)).alias("_key"),
            *[F.coalesce(number_of(df, a), F.lit(0)).alias(f"_a{i}") for i, a in enumerate(amounts)],
        )
        .groupBy("_key.kind", "_key.label")
        .agg(*[F.sum(f"_a{i}").alias(f"_a{i}") for i in range(len(amounts))])
    )
    cells = [
        F.when(
            F.col("kind") == kinds.index(labels), _cell(name, F.col("label"), F.col(f"_a{amounts.index(values)}"))
        )
        for name, _, labels, values in charts
    ]
    return totals.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*")


def _generic_rows(df: DataFrame, order: list) -> DataFrame:
    """Bars, pie and grouped bars of the leading categories, out of one aggregation."""
    kinds = classify_columns(df).orderBy("position").collect()
    numbers = [k.column_name for k in kinds if k.kind == "numeric"]
    texts = [k.column_name for k in kinds if k.kind == "string"]
    if not numbers or not texts:
        return charts_as_rows(_generic_charts(df, order))
    shown = numbers[:3]
    typed = df.select(texts[0], *[number_of(df, [c]).alias(c) for c in shown])
    known = first_truthy(typed, [texts[0]]).isNotNull()
    leading = (
        typed.groupBy(category_or_unknown(typed, texts[0]).alias("label"))
        .agg(
            F.sum(F.coalesce(F.col(shown[0]), F.lit(0))).alias("_value"),
            *[F.coalesce(F.sum(F.when(known, F.col(c))), F.lit(0)).alias(f"_m{i}") for i, c in enumerate(shown)],
        )
        .orderBy(F.desc("_value"), "label")
        .limit(10)
    )
    ranked = leading.withColumns(
        {
            "_n": F.row_number().over(Window.orderBy(F.desc("_value"), "label")),
            "_all": F.count("*").over(Window.partitionBy()),
        }
    )

    def bar(chart: str, series: Column, value: Column) -> Column:
        return F.struct(
            F.lit(chart).alias("chart"), series.alias("series"), value.cast("double").alias("value")
        )

    none = F.lit(None).cast("string")
    cells = [bar("genericBar", none, F.col("_value")), F.when(F.col("_all") >= 2, bar("genericPie", none, F.col("_value")))]
    if len(numbers) > 1:
        cells += [
            F.when(F.col("_n") <= 5, bar("genericGrouped", F.lit(humanise(c)), F.col(f"_m{i}")))
            for i, c in enumerate(shown)
        ]
    return ranked.select("label", F.explode(F.array_compact(F.array(*cells))).alias("c")).select("label", "c.*")


def _generic_charts(df: DataFrame, order: list) -> dict[str, DataFrame]:
    kinds = classify_columns(df).orderBy("position").collect()
    numbers = [k.column_name for k in kinds if k.kind == "numeric"]
    texts = [k.column_name for k in kinds if k.kind == "string"]
    if not numbers:
        return {}
    if not texts:
        return {"genericBar": record_bars(df, numbers[0], order)}
    typed = df.select(texts[0], *[number_of(df, [c]).alias(c) for c in numbers[:3]])
    bars = top_categories(typed, texts[0], F.col(numbers[0]))
    shown = F.count("*").over(Window.partitionBy())  # over the ten bars at most
    charts = {
        "genericBar": bars,
        "genericPie": bars.withColumn("_n", shown).filter(F.col("_n") >= 2).drop("_n"),
    }
    if len(numbers) > 1:
        grouped = grouped_metrics(typed, texts[0], numbers)
        series = F.array(
            *[
                F.struct(F.lit(humanise(c)).alias("series"), F.col(c).cast("double").alias("value"))
                for c in numbers[:3]
            ]
        )
        charts["genericGrouped"] = grouped.select("label", F.explode(series).alias("s")).select("label", "s.*")
    return charts


def charts_as_rows(charts: dict[str, DataFrame]) -> DataFrame:
    """All charts in one table, tagged with their names."""
    rows = {name: c.withColumn("value", F.col("value").cast("double")) for name, c in charts.items()}
    return union_sources(rows, "chart")
