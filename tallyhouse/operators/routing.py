"""Routing of questions to datasets and to sources."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import text as tx
from tallyhouse.operators.questions import extract_keywords
from tallyhouse.session import written

GRAM = 3


def _grams(word: Column) -> Column:
    """Distinct parts of a word of up to ``GRAM`` characters: about ``GRAM`` per character."""
    sizes = F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length(word)))
    parts = F.transform(
        sizes,
        lambda n: F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, n)),
    )
    return F.array_distinct(F.flatten(parts))


def containing(needles: DataFrame, needle: str, haystacks: DataFrame, haystack: str) -> DataFrame:
    """Pairs of distinct words of which the second contains the first.

    An inverted index: a word is listed under all its grams, and looked up by its
    first one. So only words that share a gram are compared.
    """
    listed = haystacks.select(haystack, F.explode(_grams(F.col(haystack))).alias("_gram"))
    sought = needles.select(needle, F.substring(needle, 1, GRAM).alias("_gram"))
    found = sought.join(listed, "_gram").filter(F.col(haystack).contains(F.col(needle)))
    return found.select(needle, haystack)


def dataset_titles(catalog: DataFrame, id: str, titles: Sequence[str], order: str | None) -> DataFrame:
    """Each distinct title, the first dataset that has it, and a number that ascends with
    the dataset. A dataset's title is the first of its ``titles`` that is not NULL."""
    named = catalog.select(
        F.struct(F.col(order or id).alias("order"), F.col(id).alias("id")).alias("_dataset"),
        F.coalesce(*[F.col(t) for t in titles]).alias("title"),
    )
    first = named.filter(F.col("title").isNotNull()).groupBy("title").agg(F.min("_dataset").alias("_dataset"))
    numbered = first.orderBy("_dataset", "title").withColumn("_title", F.monotonically_increasing_id())
    return written(numbered, "dataset_titles")


def keyword_hits(keywords: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``_hits`` of each keyword that matches a title word: every word that contains it or
    is contained in it, and after a tab, in one entry, all words that contain it."""
    pairs = (
        containing(keywords, "_keyword", vocabulary, "_word")
        .select("_keyword", "_word", F.lit(True).alias("_whole"))
        .unionByName(
            containing(vocabulary, "_word", keywords, "_keyword").select(
                "_keyword", "_word", F.lit(False).alias("_whole")
            )
        )
        .groupBy("_keyword", "_word")
        .agg(F.max("_whole").alias("_whole"))
    )
    whole = F.array_sort(F.collect_list(F.when(F.col("_whole"), F.col("_word"))))
    hits = pairs.groupBy("_keyword").agg(F.collect_list("_word").alias("_words"), whole.alias("_in"))
    entry = F.when(F.size("_in") > 0, F.array(F.concat(F.lit("\t"), F.array_join("_in", "\t"))))
    none = F.array().cast("array<string>")
    return hits.select("_keyword", F.concat("_words", F.coalesce(entry, none)).alias("_hits"))


def hit_points(spelled: DataFrame, matched: DataFrame) -> DataFrame:
    """``_points`` of each title for one of the entries in ``_hits``: how often the title
    has that word, or 2 if it has any of the words that contain the keyword."""
    entries = matched.select(F.explode("_hits").alias("_hit")).filter(F.col("_hit").startswith("\t")).distinct()
    in_words = entries.select("_hit", F.explode(F.split(F.substr("_hit", F.lit(2)), "\t")).alias("_word"))
    whole = in_words.join(spelled, "_word").select("_hit", "_title", F.lit(2).cast("long").alias("_points")).distinct()
    part = spelled.select(F.col("_word").alias("_hit"), "_title", F.col("_times").alias("_points"))
    return part.unionByName(whole)


def match_datasets(
    df: DataFrame,
    text: str,
    catalog: DataFrame,
    id: str = "id",
    titles: Sequence[str] = ("dashboard_title", "title"),
    order: str | None = None,
) -> DataFrame:
    """Add the best dataset of ``catalog`` for each question: ``dataset_id``, ``title``
    and ``score``.

    A keyword of the question scores 2 when the title contains it and 1 for every
    title word that contains it or is contained in it; a keyword that is said twice
    counts twice. Of equal scores the dataset that is first by ``order`` (and id) wins.
    Without a hit, dataset and title are NULL and the score 0. Datasets without any
    title are never found.

    Keywords and title words are compared as distinct words through an index of
    their grams. What a question's keywords match is all that counts of it: questions that
    match the same are scored once, as are equal titles. The scores of a set of matches are
    added up where it lies, so what is shuffled grows with the questions. The tables of
    titles, matched keywords and points are written, so that Spark knows their sizes; that
    of the distinct sets of keywords, so that texts are cut into words once for them.
    """
    named = dataset_titles(catalog, id, titles, order)
    spelled = (
        named.select("_title", F.explode(tx.words(F.lower("title"))).alias("_word"))
        .groupBy("_title", "_word")
        .agg(F.count("*").alias("_times"))
    )
    keyed = extract_keywords(df, text)
    if "keywords" in df.columns:
        raise ValueError("questions must not have a column keywords")
    keyed = keyed.withColumn("_bag", F.concat_ws("\n", F.array_sort("keywords")))
    bags = written(keyed.select("_bag").filter("_bag <> ''").distinct(), "keyword_sets")
    said = bags.select("_bag", F.explode(F.split("_bag", "\n")).alias("_keyword"))
    matched = keyword_hits(said.select("_keyword").distinct(), spelled.select("_word").distinct())
    matched = written(matched, "matched_keywords")
    points = written(hit_points(spelled, matched), "dataset_points")
    # one number for all questions that match the same words as often
    met = (
        said.join(matched, "_keyword")
        .groupBy("_bag")
        .agg(F.array_join(F.array_sort(F.flatten(F.collect_list("_hits"))), "\n").alias("_met"))
    )
    met = written(met, "met_titles")
    sets = written(
        met.select("_met").distinct().withColumn("_set", F.monotonically_increasing_id()), "sets_met"
    )
    counted = (
        sets.select("_set", F.explode(F.split("_met", "\n")).alias("_hit"))
        .groupBy("_set", "_hit")
        .agg(F.count("*").alias("_said"))
        .repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_set")
    )
    best = (
        counted.join(points, "_hit")
        .groupBy("_set", "_title")
        .agg(F.sum(F.col("_said") * F.col("_points")).alias("_score"))
        .groupBy("_set")
        .agg(F.min(F.struct((-F.col("_score")).alias("_score"), "_title")).alias("_best"))
        .select("_set", F.col("_best._title").alias("_title"), (-F.col("_best._score")).alias("score"))
    )
    chosen = sets.join(best, "_set").join(named, "_title").select(
        "_met", F.col("_dataset.id").alias("dataset_id"), "title", "score"
    )
    found = met.join(chosen, "_met").select("_bag", F.struct("dataset_id", "title", "score").alias("_best"))
    return (
        keyed.join(found, "_bag", "left")
        .withColumns(
            {
                "dataset_id": F.col("_best.dataset_id"),
                "title": F.col("_best.title"),
                "score": F.coalesce("_best.score", F.lit(0)),
            }
        )
        .drop("_bag", "_best", "keywords")
    )


def dataset_rows(df: DataFrame, wanted: str, catalog: DataFrame, id: str = "id", order: str | None = None) -> DataFrame:
    """Add ``dataset``, the catalog's row of the id in column ``wanted``, as a struct;
    NULL if the catalog has no such id. Of several rows of an id the first counts."""
    whole = F.struct(*[F.col(c) for c in catalog.columns])
    first = catalog.groupBy(F.col(id).alias("_id")).agg(
        F.min_by(whole, F.col(order or id)).alias("dataset")
    )
    return df.join(first, F.col(wanted) == F.col("_id"), "left").drop("_id")


# Words that call for a source type.
TYPE_WORDS = {
    "superset": ["dashboard", "chart", "trend", "analytics", "visualization"],
    "postgres": ["sales", "customers", "orders", "revenue", "data", "records"],
}


def _active_types(sources: DataFrame) -> list[str]:
    """The distinct types of connected sources: a handful of names."""
    rows = sources.filter(F.col("status") == "connected").select("type").distinct().collect()
    return sorted(r.type for r in rows)


def _connected(sources: DataFrame) -> DataFrame:
    return sources.filter(F.col("status") == "connected").select(F.col("id").alias("source_id"), "type")


def by_type(types: list[str], value: Callable[[str], Column]) -> Column:
    """A map from each type to its value (empty without types)."""
    pairs = [x for t in types for x in (F.lit(t), value(t).cast("int"))]
    return F.create_map(*pairs).cast("map<string,int>")


def _expand(
    df: DataFrame,
    key: str,
    priority: Callable[[str], Column],
    types: list[str],
    sources: DataFrame,
) -> DataFrame:
    """One row per question and connected source of a chosen type.

    ``priority`` gives each type its priority; types without one are left
    out, and if none is left all types are taken.
    """
    chosen = F.map_filter(by_type(types, priority), lambda _, p: p.isNotNull())
    everything = by_type(types, lambda _: F.lit(0))
    typed = df.withColumn("_chosen", chosen).select(
        key,
        F.explode(F.when(F.size("_chosen") > 0, F.col("_chosen")).otherwise(everything)).alias(
            "type", "priority"
        ),
    )
    return typed.join(_connected(sources), "type").select(key, "source_id", "type", "priority")


def _split_by_request(
    df: DataFrame, key: str, requested: str, connected: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(question, source) pairs of the connected sources asked for, and the other questions.

    The ids of the registry are one value to every row, so that rows which
    share a key, or have none, are each split by their own request.
    """
    wanted = df.schema[requested].dataType
    ids = connected.agg(F.collect_set("source_id")).scalar().cast(wanted)
    asked = F.array_intersect(F.array_distinct(F.col(requested)), ids)
    marked = df.withColumn("_asked", F.coalesce(asked, F.array().cast(wanted)))
    pairs = marked.select(key, F.explode("_asked").alias("source_id"))
    return pairs.join(connected, "source_id"), marked.filter(F.size("_asked") == 0).drop("_asked")


def route_queries(
    df: DataFrame, key: str, text: str, sources: DataFrame, requested: str | None = None
) -> DataFrame:
    """Sources for each question, chosen by its words.

    Requested sources come first; questions that request none, or none that is
    connected, are routed by words, and to all connected sources if no word
    fits.
    """
    types = _active_types(sources)

    def priority(t: str) -> Column:
        words = TYPE_WORDS.get(t)
        return F.when(tx.contains_any(F.col("_lower"), words), 0) if words else F.lit(0)

    def by_words(questions: DataFrame) -> DataFrame:
        lower = questions.withColumn("_lower", F.lower(F.col(text)))
        return _expand(lower, key, priority, types, sources)

    if requested is None:
        return by_words(df)
    pairs, rest = _split_by_request(df, key, requested, _connected(sources))
    direct = pairs.select(key, "source_id", "type", F.lit(0).alias("priority"))
    return direct.unionByName(by_words(rest))


def route_by_intent(
    df: DataFrame, key: str, intent: str, action: str, sources: DataFrame, requested: str | None = None
) -> DataFrame:
    """Sources for each question, chosen by its planner intent.

    Priority 0 is asked before priority 1. Questions that request connected sources
    get these alone; those that request none, or none that is connected, go by intent.
    """
    types = _active_types(sources)
    kind, act = F.col(intent), F.lower(F.col(action))
    on_board = tx.contains_any(act, ["dashboard", "chart"])

    def priority(t: str) -> Column:
        bi, database = F.lit(t == "superset"), F.lit(t == "postgres")
        return (
            F.when(kind == "visualization", F.when(bi, 0).otherwise(1))
            .when(kind == "sql", F.when(database, 0))
            .when(kind == "analytics", F.when(F.when(on_board, bi).otherwise(database), 0))
            .otherwise(0)
        )

    if requested is None:
        return _expand(df, key, priority, types, sources)
    pairs, rest = _split_by_request(df, key, requested, _connected(sources))
    direct = pairs.select(key, "source_id", "type", F.lit(0).alias("priority"))
    return direct.unionByName(_expand(rest, key, priority, types, sources))
