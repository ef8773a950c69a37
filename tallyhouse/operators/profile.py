"""Profiles of tables: column roles, samples and relationships.

The result of a profile has one row per column of the catalog. That is
metadata as large as the schemas, so the roles are settled on the driver from
one summary row per column; the tables themselves are only aggregated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions import text as tx

MAX_DIMENSION_VALUES = 50
MAX_DIMENSION_SHARE = 0.01
# Estimates of distinct values are trusted outside this band of relative error.
ESTIMATE_BAND = 0.25
# Small summary jobs that are submitted side by side.
CONCURRENT_JOBS = 8
CURRENCY_WORDS = ("amount", "price", "revenue", "value", "cost", "bal", "spend", "budget")

CATALOG_SCHEMA = (
    "table_idx int, table_name string, position int, column_name string, data_type string, "
    "n_rows bigint, n_nonnull bigint, is_id boolean, is_metric boolean, is_dimension boolean, "
    "is_datetime boolean, is_currency boolean, nullable boolean, is_unique boolean, "
    "samples array<string>"
)


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def _quoted(text: str) -> str:
    """A string constant for an SQL expression."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _column(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _laid_out(df: DataFrame, totals: list[str], cells: list[str]) -> DataFrame:
    """One aggregation of the table, then one row per cell."""
    return df.selectExpr(*totals).selectExpr(f"inline(array({', '.join(cells)}))")


def _gather(frames: list[DataFrame]) -> list[Row]:
    """The few rows of each frame. The frames are independent jobs and run side by side."""
    if not frames:
        return []
    collect = inheritable_thread_target(frames[0].sparkSession)(lambda df: df.collect())
    with ThreadPoolExecutor(max_workers=CONCURRENT_JOBS) as pool:
        return [row for rows in pool.map(collect, frames) for row in rows]


def _summaries(tables: Mapping[str, DataFrame], all_estimates: bool, smallest: bool) -> list[Row]:
    """Row count, non-null count, estimated distinct count and minimum of every column.

    Without ``all_estimates`` distinct values are estimated for texts only.
    """
    frames = []
    for name, df in tables.items():
        totals, cells = ["count(*) AS _rows"], []
        for i, f in enumerate(df.schema.fields):
            c = _column(f.name)
            estimated = isinstance(f.dataType, T.StringType) or (all_estimates and _maybe_unique(f))
            estimate = f"approx_count_distinct({c})" if estimated else "CAST(NULL AS bigint)"
            least = f"min({c})" if smallest and not _nested(f.dataType) else "NULL"
            totals += [f"count({c}) AS n{i}", f"{estimate} AS d{i}", f"CAST({least} AS string) AS m{i}"]
            cells.append(
                f"struct({_quoted(name)} AS table_name, {i} AS position, _rows AS n_rows, "
                f"n{i} AS n_nonnull, d{i} AS estimate, m{i} AS least)"
            )
        frames.append(_laid_out(df, totals, cells))
    return _gather(frames)


def _is_id(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.IntegralType) and f.name.lower().endswith(("id", "key"))


def _maybe_unique(f: T.StructField) -> bool:
    return not _nested(f.dataType) and not isinstance(f.dataType, T.FractionalType)


def _exact_counts(columns: list[tuple[str, str, DataFrame, T.DataType]]) -> dict:
    """Exact number of distinct values and of rows of the most frequent value.

    The columns of a table are counted together: its values are tagged with their
    column and grouped once. Long text is grouped by its SHA-256 digest, which is what
    is shuffled.
    """
    cells: dict[str, list[str]] = {}
    sources = {}
    for table, name, df, kind in columns:
        value = _column(name)
        if isinstance(kind, T.StringType):
            value = f"CASE WHEN length({value}) > 32 THEN sha2({value}, 256) ELSE {value} END"
        sources[table] = df
        cells.setdefault(table, []).append(f"struct({_quoted(name)} AS c, CAST({value} AS string) AS v)")
    frames = [
        sources[table]
        .selectExpr(f"inline(array({', '.join(of_table)}))")
        .filter("v IS NOT NULL")
        .groupBy("c", "v")
        .count()
        .groupBy("c")
        .agg(F.count("*").alias("n_distinct"), F.max("count").alias("most"))
        .select(F.lit(table).alias("t"), "*")
        for table, of_table in cells.items()
    ]
    found = {(t, name): (0, 0) for t, name, _, _ in columns}
    return found | {(r.t, r.c): (r.n_distinct, r.most) for r in _gather(frames)}


def _smallest(
    wanted: Mapping[str, list[T.StructField]], tables: Mapping[str, DataFrame], found: dict, n: int
) -> dict:
    """The ``n`` smallest distinct values of each column, as text.

    ``found`` holds the smallest. Each further round is one pass per table that
    looks for the smallest value above the one before: no values are shuffled
    or collected into lists.
    """
    for _ in range(n - 1):
        frames = []
        for table, fields in wanted.items():
            totals, cells = [], []
            for i, f in enumerate(fields):
                value, seen = _column(f.name), found[table, f.name]
                if not seen:
                    continue
                least = f"CAST({_quoted(seen[-1])} AS {f.dataType.simpleString()})"
                value = f"CASE WHEN {value} > {least} THEN {value} END"
                totals.append(f"CAST(min({value}) AS string) AS v{i}")
                cells.append(f"struct({_quoted(table)} AS t, {_quoted(f.name)} AS c, v{i} AS v)")
            if cells:
                frames.append(_laid_out(tables[table], totals, cells))
        if not frames:
            break
        for r in _gather(frames):
            if r.v is not None:
                found[r.t, r.c].append(r.v)
    return found


def profile_columns(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    samples: int = 3,
    check_unique: bool = True,
) -> DataFrame:
    """One row per column with its type, roles, uniqueness and smallest values.

    Roles: datetime is a date or timestamp; id an integer named ``…id`` or
    ``…key``; metric any other number; dimension a text of few distinct values;
    currency a metric with a money word in its name. One pass estimates distinct
    counts; only columns whose estimate does not settle the matter are counted
    exactly.
    """
    first_pass = _summaries(tables, check_unique, samples > 0)
    summary = {(r.table_name, r.position): r for r in first_pass}
    limits, unsettled = {}, []
    for table, df in tables.items():
        for i, f in enumerate(df.schema.fields):
            row = summary[table, i]
            limit = max(MAX_DIMENSION_VALUES, MAX_DIMENSION_SHARE * row.n_rows)
            limits[table, f.name] = limit
            if row.estimate is None:
                continue
            text = isinstance(f.dataType, T.StringType)
            borderline = text and abs(row.estimate - limit) <= ESTIMATE_BAND * limit
            maybe_unique = (
                check_unique and row.n_nonnull > 0 and row.estimate >= (1 - ESTIMATE_BAND) * row.n_nonnull
            )
            if borderline or maybe_unique:
                unsettled.append((table, f.name, df, f.dataType))
    exact = _exact_counts(unsettled)

    rows, wanted = [], {}
    for idx, (table, df) in enumerate(tables.items()):
        for i, f in enumerate(df.schema.fields):
            row, key = summary[table, i], (table, f.name)
            number = isinstance(f.dataType, T.NumericType)
            is_id = _is_id(f)
            distinct = exact[key][0] if key in exact else row.estimate
            dimension = isinstance(f.dataType, T.StringType) and distinct <= limits[key]
            metric = number and not is_id
            when = isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
            currency = metric and any(w in f.name.lower() for w in CURRENCY_WORDS)
            unique = exact[key][1] == 1 if key in exact and check_unique else None if not check_unique else False
            if is_id or metric or dimension or when:
                wanted.setdefault(table, []).append(f)
            rows.append(
                [idx, table, i + 1, f.name, f.dataType.simpleString(), row.n_rows, row.n_nonnull]
                + [is_id, metric, dimension, when, currency, row.n_nonnull < row.n_rows, unique]
            )
    least = {
        (t, f.name): [summary[t, tables[t].columns.index(f.name)].least] for t, fs in wanted.items() for f in fs
    }
    found = {k: [v for v in values if v is not None] for k, values in least.items()}
    smallest = _smallest(wanted, tables, found, samples) if samples else {}
    data = [tuple(r) + (smallest.get((r[1], r[3]), []),) for r in rows]
    return spark.createDataFrame(data, CATALOG_SCHEMA)


# --- relationships -----------------------------------------------------------


def bare_name(column: Column) -> Column:
    """A column name without a table prefix of one or two letters."""
    return F.regexp_replace(column, "^[a-z]{1,2}_", "")


def _substrings(name: Column) -> Column:
    """All distinct substrings of an identifier (identifiers are short)."""
    length = F.length(name)
    parts = F.transform(
        F.sequence(F.lit(1), length),
        lambda i: F.transform(F.sequence(F.lit(1), length - i + 1), lambda n: F.substring(name, i, n)),
    )
    return F.array_distinct(F.flatten(parts))


def table_relationships(catalog: DataFrame, key: Column | None = None) -> DataFrame:
    """Pairs of id columns of two tables that look like a foreign key.

    Either the names are equal, or one name contains the singular of the other
    table's name. ``key`` is the name to compare, by default the column name.
    The containment test is an equality join on the substrings of the names.
    """
    ids = catalog.filter("is_id").select(
        "table_idx", "table_name", "column_name", (F.col("column_name") if key is None else key).alias("key")
    )
    names = catalog.select("table_idx", "table_name").distinct().withColumn("part", tx.singular(F.col("table_name")))
    parts = ids.withColumn("part", F.explode(_substrings(F.col("key"))))

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{tag}_{c}") for c in df.columns])

    pair = ["a_table_idx", "a_table_name", "a_column_name", "b_table_idx", "b_table_name", "b_column_name"]
    a, b = side(ids, "a"), side(ids, "b")
    later = F.col("a_table_idx") < F.col("b_table_idx")
    equal = a.join(b, (F.col("a_key") == F.col("b_key")) & later).select(*pair)
    first_names_second = (
        side(parts, "a")
        .join(side(names, "n"), (F.col("a_part") == F.col("n_part")) & (F.col("a_table_idx") < F.col("n_table_idx")))
        .join(b, F.col("n_table_idx") == F.col("b_table_idx"))
        .select(*pair)
    )
    second_names_first = (
        side(parts, "b")
        .join(side(names, "n"), (F.col("b_part") == F.col("n_part")) & (F.col("n_table_idx") < F.col("b_table_idx")))
        .join(a, F.col("n_table_idx") == F.col("a_table_idx"))
        .select(*pair)
    )
    found = equal.unionByName(first_names_second).unionByName(second_names_first).distinct()
    return found.select(
        F.col("a_table_name").alias("from_table"),
        F.col("b_table_name").alias("to_table"),
        F.col("a_column_name").alias("from_column"),
        F.col("b_column_name").alias("to_column"),
        F.lit("one_to_many").alias("relation_type"),
        F.lit(0.8).alias("confidence"),
    )


# --- inclusion of values -----------------------------------------------------


def _comparable(f: T.StructField) -> str | None:
    """SQL text that is equal for equal values of comparable types, and for no others.

    Numbers are compared with numbers, times with times. Long text is represented
    by its SHA-256 digest. Nested values are not compared.
    """
    c, kind = _column(f.name), f.dataType
    if isinstance(kind, T.IntegralType):
        return f"concat('n', CAST({c} AS string))"
    if isinstance(kind, T.NumericType):
        number = f"CAST({c} AS double)"
        whole = f"{number} = floor({number}) AND abs({number}) < 1e15"
        return f"concat('n', CASE WHEN {whole} THEN CAST(CAST({c} AS bigint) AS string) ELSE CAST({number} AS string) END)"
    if isinstance(kind, T.StringType):
        return f"concat('t', CASE WHEN length({c}) > 32 THEN sha2({c}, 256) ELSE {c} END)"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return f"concat('d', CAST(CAST({c} AS timestamp) AS string))"
    if isinstance(kind, T.BooleanType):
        return f"concat('b', CAST({c} AS string))"
    return None


def shared_values(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """Numbers of distinct values that pairs of columns share: ``a`` and ``b`` are
    numbers of columns in the order of ``columns``; ``a = b`` counts a column's own.

    Every table is scanned once for all of its columns. Values are tagged with their
    column, grouped once to the set of columns that hold them, and counted from
    these sets. Spark combines equal values before the shuffle, so a frequent value is
    one row per task; a set has at most as many members as there are columns.
    """
    frames, tag = [], 0
    for table, names in columns.items():
        df, cells = tables[table], []
        for name in names:
            value = _comparable(df.schema[name])
            if value is not None:
                cells.append(f"struct({tag} AS tag, {value} AS value)")
            tag += 1
        if cells:
            frames.append(df.select(F.explode(F.expr(f"array({', '.join(cells)})")).alias("cell")).select("cell.*"))
    if not frames:
        raise ValueError("there are no columns to compare")
    values = reduce(DataFrame.unionAll, frames).filter("value IS NOT NULL")
    sets = values.groupBy("value").agg(F.collect_set("tag").alias("tags"))
    pairs = sets.select(F.explode("tags").alias("a"), "tags").select("a", F.explode("tags").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


def inclusions(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """Pairs of columns that share values: how many distinct ones each has, how many
    both, and the share of the ``to`` column's that the ``from`` column holds."""
    names = [(t, c) for t, cs in columns.items() for c in cs]
    spark = next(iter(tables.values())).sparkSession
    counts = shared_values(tables, columns)
    own = counts.filter("a = b")
    known = spark.createDataFrame(
        [(i, t, c) for i, (t, c) in enumerate(names)], "tag int, table_name string, column_name string"
    )
    sides = [
        known.join(own, known["tag"] == own["a"]).select(
            F.col("tag").alias(f"_{side}"),
            F.col("table_name").alias(f"{side}_table"),
            F.col("column_name").alias(f"{side}_column"),
            F.col("shared").alias(f"{side}_keys"),
        )
        for side in ("from", "to")
    ]
    pairs = counts.filter("a <> b").select(F.col("a").alias("_from"), F.col("b").alias("_to"), "shared")
    found = pairs.join(sides[0], "_from").join(sides[1], "_to")
    return found.select(
        "from_table",
        "from_column",
        "to_table",
        "to_column",
        "from_keys",
        "to_keys",
        F.col("shared").alias("found_keys"),
        (F.col("shared") / F.col("to_keys")).alias("containment"),
    )


def containment(relationships: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Share of the distinct ``to`` keys that occur among the ``from`` keys.

    All relationships together take one scan per table (``shared_values``).
    """
    ends = ["from_table", "from_column", "to_table", "to_column"]
    wanted = [tuple(r) for r in relationships.select(*ends).distinct().collect()]
    columns: dict[str, list[str]] = {}
    for table, column in sorted({e for r in wanted for e in (r[:2], r[2:])}):
        columns.setdefault(table, []).append(column)
    schema = "from_table string, from_column string, to_table string, to_column string, a int, b int"
    spark = relationships.sparkSession
    if not wanted:
        empty = spark.createDataFrame([], schema).select(*ends)
        zero = F.lit(0).cast("long")
        return empty.select(
            *ends, zero.alias("child_keys"), zero.alias("found_keys"), F.lit(0.0).alias("containment")
        )
    tags = {e: i for i, e in enumerate((t, c) for t, cs in columns.items() for c in cs)}
    numbered = spark.createDataFrame([(*r, tags[r[:2]], tags[r[2:]]) for r in wanted], schema)
    counts = shared_values(tables, columns).filter(F.col("a") <= F.col("b"))
    own = counts.filter("a = b").select("b", F.col("shared").alias("child_keys"))
    both = counts.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("shared").alias("found_keys"))
    pair = (F.least("a", "b") == F.col("_a")) & (F.greatest("a", "b") == F.col("_b"))
    found = numbered.join(own, "b", "left").join(both, pair, "left")
    return found.select(
        *ends, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("child_keys", "found_keys")]
    ).withColumn("containment", F.try_divide(F.col("found_keys").cast("double"), F.col("child_keys")))


def schema_ids(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The id columns of all tables as a catalog, from their schemas alone."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (i, table, p, f.name, True)
        for i, (table, df) in enumerate(tables.items())
        for p, f in enumerate(df.schema.fields, start=1)
        if _is_id(f)
    ]
    return spark.createDataFrame(
        rows, "table_idx int, table_name string, position int, column_name string, is_id boolean"
    )
