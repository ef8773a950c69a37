"""Helpers shared by the operators of this subpackage.

Every operator takes the columns it needs under names given by the caller and
returns only those it defines. Other columns of the input never reach its
plan, so they may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.session import written  # noqa: F401 - used by the operators


def column(name: str):
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id and whole text; a null text is empty."""
    return docs.select(
        column(id_col).alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text")
    )


def id_type(docs: DataFrame, id_col: str) -> str:
    return docs.select(column(id_col)).schema[0].dataType.simpleString()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
