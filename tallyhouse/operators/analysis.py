"""The data side of an analysis request: counts, structure and sample rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS = 3


def data_summary(combined: DataFrame, source: str, order: list) -> DataFrame:
    """One row about combined sources: total, text on sources and columns, sample rows.

    Sources are counted in one aggregation; the sample is the first rows in the
    given order, as JSON.
    """
    columns = [c for c in combined.columns if c != source]
    counts = combined.groupBy(source).agg(F.count("*").alias("n"))
    per_source = counts.agg(
        F.sum("n").alias("total"),
        F.array_sort(F.collect_list(F.struct(F.col(source).alias("name"), "n"))).alias("sources"),
    )
    structure = "".join(f"- {c}\n" for c in columns)
    lines = F.transform("sources", lambda s: F.format_string("- %s: %d records\n", s["name"], s["n"]))
    overview = F.concat(
        F.lit("Data Sources:\n"),
        F.array_join(lines, ""),
        F.when(F.col("total") > 0, F.lit(f"\nSample Data Structure:\n{structure}")).otherwise(""),
    )
    # the window orders the few rows that are left, so that the list keeps the order
    place = F.row_number().over(Window.orderBy(*order)).alias("place")
    first = combined.orderBy(*order).limit(SAMPLE_ROWS).select(
        F.struct(place, F.to_json(F.struct(*columns)).alias("row")).alias("row")
    )
    rows = F.array_sort(F.collect_list("row"))["row"]
    sample = first.agg(F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")))
    return per_source.select(
        F.coalesce("total", F.lit(0)).alias("total"), overview.alias("overview"), sample.scalar().alias("sample")
    )


def analysis_context(questions: DataFrame, text: str, summary: DataFrame) -> DataFrame:
    """Add the context of each question with a planner intent, and the data sample.

    The summary is a single row and joins each question as a scalar value.
    """

    def listed(title: str, values: str) -> Column:
        return F.when(
            F.size(values) > 0, F.concat(F.lit(f"{title}: "), F.array_join(values, ", "), F.lit("\n"))
        ).otherwise("")

    # one scalar for all members, so that the summary is computed once
    known = summary.select(F.struct("total", "overview", "sample")).scalar()

    header = F.concat(
        F.lit("Enhanced Data Analysis Context:\nUser Query: "),
        F.col(text),
        F.format_string(
            "\nDetected Intent: %s (Confidence: %.2f)\nMain Action: %s\nTotal Records: ",
            "intent",
            "confidence",
            "main_action",
        ),
        known["total"].cast("string"),
        F.lit("\n"),
        listed("Identified Metrics", "metrics"),
        listed("Identified Dimensions", "dimensions"),
        known["overview"],
    )
    return questions.withColumns({"context": header, "sample": known["sample"]})
