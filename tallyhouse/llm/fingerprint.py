"""Document fingerprints: bottom-k sketches of word shingles, in SQL alone.

A sketch holds the k smallest distinct hashes of a text's shingles, in order;
with fewer shingles it holds all of them, and what it tells is exact. Sketches
of parts merge into the sketch of the whole. A shingle is five words in a row; a
text of fewer words is one shingle, a text without words has none.

``likeness`` of two sketches without shingles is 1, of one with and one without
0. Null texts are empty ones; equal texts have equal sketches; an empty table
has none.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tallyhouse.llm.common import column, written

SHINGLE = 5
K = 256
#: Hashes are cut to so many bits, which a double holds exactly.
BITS = 48
SPACE = r"[\x09-\x0D\x20]+"


def words_of(text: Column) -> Column:
    """Words between white space."""
    return F.array_remove(F.split(text, SPACE), "")


def shingle_hashes(words: Column, length: int = SHINGLE) -> Column:
    """Hashes of all runs of ``length`` words. ``words`` has to be a column of
    its own: the lambda reads it again for every place."""
    mask = F.lit((1 << BITS) - 1)
    runs = F.transform(
        F.sequence(F.lit(0), F.size(words) - length),
        lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(length)]).bitwiseAND(mask),
    )
    whole = F.array(F.xxhash64(F.concat_ws(" ", words)).bitwiseAND(mask))
    return (
        F.when(F.size(words) >= length, runs)
        .when(F.size(words) > 0, whole)
        .otherwise(F.array().cast("array<bigint>"))
    )


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str, name: str, k: int = K) -> DataFrame:
    """Adds the sketch of a text column."""
    words = f"{name}_words"
    return (
        df.withColumn(words, words_of(F.col(text)))
        .withColumn(name, smallest(shingle_hashes(F.col(words)), k))
        .drop(words)
    )


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts taken together."""
    return smallest(F.concat(a, b), k)


def merge_parts(parts: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each key of any number of parts.

    Hashes are ranked within their key, and Spark cuts each task's to the k
    smallest before they are shuffled, so that a key of very many parts stays small.
    """
    hashes = parts.select(*keys, F.explode(sketch).alias("hash")).distinct()
    ranked = hashes.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("hash")))
    found = (
        ranked.filter(F.col("place") <= k)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("hash")).alias(sketch))
    )
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    everyone = parts.select(*keys).distinct()
    return (
        everyone.alias("a")
        .join(found.alias("b"), same, "left")
        .select(
            *[F.col(f"a.{key}") for key in keys],
            F.coalesce(F.col(f"b.{sketch}"), F.array().cast("array<bigint>")).alias(sketch),
        )
    )


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Number of distinct shingles: exact below k, else from the k-th hash."""
    largest = F.array_max(sketch).cast("double") + 1
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(
        (k - 1) * F.lit(float(1 << BITS)) / largest
    )


def likeness(a: Column, b: Column, k: int = K) -> Column:
    """Resemblance: the shared part of the smallest hashes of both together."""
    both = F.array_union(a, b)
    known = F.when((F.size(a) < k) & (F.size(b) < k), F.size(both)).otherwise(
        F.least(F.lit(k), F.size(both))
    )
    union = F.slice(F.sort_array(both), 1, F.greatest(known, F.lit(1)))
    shared = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, 1.0).otherwise(shared / known)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of the first text's shingles that the second has, too."""
    alike = likeness(a, b, k)
    size_a, size_b = distinct_shingles(a, k), distinct_shingles(b, k)
    shared = alike * (size_a + size_b) / (1 + alike)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / size_a))


def _by_number(rows: DataFrame, ranges: int) -> DataFrame:
    """Adds ``range`` (-1 for no id): between quantiles of numeric ids."""
    at = rows.withColumn("at", F.col("doc_id").cast("double"))
    cuts = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        found = at.agg(F.percentile_approx("at", shares, 20 * ranges).alias("cuts")).first()
        cuts = sorted(set(found["cuts"] or []))
    splits = [float("-inf"), *cuts, float("inf")]
    if len(splits) < 3:
        splits.insert(1, 0.0)
    return (
        Bucketizer(splits=splits, inputCol="at", outputCol="range", handleInvalid="keep")
        .transform(at)
        .withColumn("range", F.when(F.col("at").isNull(), -1).otherwise(F.col("range").cast("int")))
        .drop("at")
    )


def _by_order(rows: DataFrame, ranges: int) -> DataFrame:
    """Adds ``range`` (-1 for no id) by the order of ids of any other type. It is the
    partition that Spark's own sampled ranges give, so it is written once: a
    second run could draw other borders."""
    dealt = rows.repartitionByRange(ranges, F.col("doc_id").asc_nulls_first())
    place = F.when(F.col("doc_id").isNull(), -1).otherwise(F.spark_partition_id())
    return written(dealt.withColumn("range", place), "ranges")


def with_next(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_per_range: int = 512,
    most_ranges: int = 1 << 17,
) -> tuple[DataFrame, Window]:
    """Rows (doc_id, text, guest) in ranges of ids, and the window that orders a
    range by descending id.

    The ranges hold about equally many rows, whatever the ids are like, and follow
    the order of the ids' own type: numbers by value, texts by their bytes. The
    first row of the range below is a guest at the end of each range (of the
    last range: the very first row), so that ``lead`` finds every row's next one
    within its range, and no task gets more than a range. Rows without id come
    last; rows that repeat an id follow each other by a hash of their text.
    """
    rows = docs.select(
        column(id_col).alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text")
    )
    n = rows.count()
    ranges = max(1, min(most_ranges, n // rows_per_range))
    if isinstance(rows.schema["doc_id"].dataType, NumericType):
        ranged = _by_number(rows, ranges)
    else:
        ranged = _by_order(rows, ranges)
    # one row a range, at most most_ranges + 2 in all
    firsts = ranged.groupBy("range").agg(F.max("doc_id").alias("first"))
    in_order = Window.orderBy("range")
    everywhere = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    guests = firsts.select(
        "first",
        F.coalesce(F.lead("range").over(in_order), F.min("range").over(everywhere)).alias("host"),
    )
    own = F.struct(F.col("range"), F.lit(False).alias("guest"))
    visit = F.struct(F.col("host").alias("range"), F.lit(True).alias("guest"))
    dealt = ranged.join(
        F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("first")), "left"
    ).select(
        "doc_id",
        "text",
        F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, visit))).alias("p"),
    )
    order = Window.partitionBy("range").orderBy(
        "guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text")
    )
    return dealt.select("doc_id", "text", "p.range", "p.guest"), order


def edited_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K
) -> DataFrame:
    """Sketches of each text and of its edit, and their likeness.

    The edit replaces the last third of a text, in code points, by the beginning
    of the next document's. A table of one row is its own next document.
    """
    rows, order = with_next(docs, id_col, text_col)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), n - third),
        F.substring(F.col("next_text"), F.lit(1), third),
    )
    rows = rows.withColumn("next_text", F.lead("text").over(order))
    rows = with_sketch(rows, "text", "sketch", k)
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(order)).filter("NOT guest")
    rows = rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "sketch",
        "next_sketch",
        edited.alias("edited"),
    )
    rows = with_sketch(rows, "edited", "edited_sketch", k)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "sketch",
        "edited_sketch",
        likeness(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("kept_share"),
        distinct_shingles(F.col("sketch"), k).alias("n_shingles"),
    )
