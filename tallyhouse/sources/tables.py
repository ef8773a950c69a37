"""Table scans: registry, catalog listing, unions of differing schemas."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Warehouse:
    """Named parquet tables below one root folder."""

    def __init__(self, spark: SparkSession, root: str, names: Iterable[str] = ()):
        self.spark = spark
        self.root = root.rstrip("/")
        self.names = tuple(names)
        self._opened: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """The table; its footer is read once per warehouse object."""
        if name not in self._opened:
            self._opened[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._opened[name]

    def find(self, name: str) -> DataFrame | None:
        """The table, or None when it does not exist; other errors are errors."""
        try:
            return self.table(name)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def register(self, names: Iterable[str] | None = None) -> None:
        for name in names or self.names:
            self.table(name).createOrReplaceTempView(name)


def read_table(
    spark: SparkSession, source: str, path: str, schema=None, **options
) -> DataFrame:
    """Scan one relational source: parquet, orc, csv, json or jdbc.

    CSV and JSON ask for a schema, so that no extra pass over the data is
    spent on inferring one.
    """
    if source in ("csv", "json") and schema is None:
        raise ValueError(f"a {source} source needs a schema")
    reader = spark.read.format(source).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if source == "jdbc":
        return reader.option("dbtable", path).load()
    if source == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def write_table(df: DataFrame, sink: str, path: str, mode: str = "overwrite") -> None:
    """Export to csv, json or parquet."""
    writer = df.write.mode(mode).format(sink)
    if sink == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def as_json_rows(df: DataFrame, name: str = "row_json") -> DataFrame:
    """One JSON document per row, the shape of a response body."""
    return df.select(F.to_json(F.struct("*")).alias(name))


def parameter_query(spark: SparkSession, query: str, values: list) -> DataFrame:
    """A parameterised SELECT with positional markers ``$1 … $n``.

    Every marker has to occur, and their number has to equal that of the values.
    """
    markers = {int(m) for m in re.findall(r"\$(\d+)", query)}
    if markers != set(range(1, len(values) + 1)):
        raise ValueError(f"query has markers {sorted(markers)} for {len(values)} values")
    named = re.sub(r"\$(\d+)", r":p\1", query)
    return spark.sql(named, args={f"p{i}": v for i, v in enumerate(values, start=1)})


def union_sources(
    parts: Mapping[str, DataFrame | None], tag: str = "source", need_rows: bool = False
) -> DataFrame:
    """Rows of several sources, appended by name and tagged with their source.

    A source that could not be read (None) is left out; columns a source lacks
    are NULL. With ``need_rows`` it is an error if no source has a row.
    """
    frames = [
        df.withColumn(tag, F.lit(name)) for name, df in parts.items() if df is not None
    ]
    if not frames:
        raise ValueError("no source could be read")
    combined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if need_rows and combined.isEmpty():
        raise ValueError("no source has rows")
    return combined


def first_nonempty(candidates: Iterable[DataFrame | None]) -> DataFrame | None:
    """The first candidate that exists and has rows (each test reads one row)."""
    for df in candidates:
        if df is not None and not df.isEmpty():
            return df
    return None


def explode_chart_payload(payloads: DataFrame, column: str, row_type: str) -> DataFrame:
    """Rows of the first result block of chart responses ``{"result":[{"data":[…]}]}``."""
    parsed = F.from_json(F.col(column), f"struct<result: array<struct<data: array<{row_type}>>>>")
    keep = [c for c in payloads.columns if c != column]
    return payloads.select(*keep, F.explode(parsed["result"][0]["data"]).alias("_row")).select(
        *keep, "_row.*"
    )


def _like(character: str) -> str:
    """A character of a LIKE pattern as a regular expression."""
    return {"%": ".*", "_": "."}.get(character) or re.escape(character)


def column_listing(
    tables: Mapping[str, DataFrame],
    hidden: tuple[str, ...] = ("pg_%", "sql_%"),
    limit: int | None = None,
) -> DataFrame:
    """One row per column: table, column, position, type and non-null count.

    The listing itself comes from schemas alone. The counts are one pass per
    table, aggregated before the columns are laid out as rows. Hidden tables are not
    read.
    """
    shapes = [re.compile("".join(_like(c) for c in p), re.DOTALL) for p in hidden]
    frames = []
    for name, df in tables.items():
        if any(s.fullmatch(name) for s in shapes):
            continue
        fields = df.schema.fields
        counts = df.selectExpr(*[f"count(`{f.name}`) AS n{i}" for i, f in enumerate(fields)])
        cells = [
            f"struct('{name}' AS table_name, '{f.name}' AS column_name, {i + 1}L AS ordinal_position, "
            f"'{f.dataType.simpleString()}' AS data_type, n{i} AS n_nonnull)"
            for i, f in enumerate(fields)
        ]
        frames.append(counts.selectExpr(f"inline(array({', '.join(cells)}))"))
    if not frames:
        raise ValueError("all tables are hidden")
    listing = reduce(DataFrame.unionAll, frames)
    listing = listing.orderBy("table_name", "ordinal_position")
    return listing if limit is None else listing.limit(limit)
