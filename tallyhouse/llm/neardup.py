"""MinHash near-dedup: DartMinHash signatures, banded joining, exact check.

A text is the weighted set of its shingles of five words, each weighing as
often as it occurs. Think of every shingle as an axis of weights, and of darts
thrown at the plane of weight and rank by a hash. A text is hit by the darts
below a shingle's weight; the earliest dart of each of the signature's
coordinates is its value there. Two texts share a value with a chance of their
weighted Jaccard similarity. The plane is cut into cells that are the same for
all texts, and a cell's darts are made only when a text reaches into it, so the
work follows the number of darts that a signature needs.

A text in which a shingle repeats has a second signature, with all weights 1, so
that texts alike by distinct shingles alone meet as well. In other texts the two
signatures are the same.

Equal texts are one node. Nodes that share a band meet in its bucket. In every
bucket each node is compared with the bucket's first, in an order drawn by a
hash; the similarity is computed exactly, and pairs of the least similarity or
more are linked. In the opening round a node meets a few of its buckets' firsts,
which joins most copies. Then the buckets that still hold several classes are
drawn in several other orders at once, and nodes meet all firsts of another class.
Such a round is repeated while it links as much as a fair share of all before, so
the number of rounds does not follow the few pairs that meet by chance in buckets
of unlike texts. What the draws have left open is finished exactly: nodes of
buckets that still hold several classes are joined on the rarest of the shingles
that several classes share. Two sets of the least similarity have one in common
among the first few of them, and are of like sizes, so that no pair is missed.
Pairs of one class, or without such a shingle, are never made.

Bounds: a task holds a batch of texts; bucket rows are ids; hot buckets are
combined per task before they are shuffled, and their joins can be split. Links
and classes never reach the driver.

Similarity is the larger of the weighted Jaccard similarity (by occurrence) and
the plain one (by distinct shingles). A text of one to four words is one
shingle; null texts are empty ones, and all texts without words of the same
characters are equal. Rows with the same id are one document. Rows without an
id are never near copies of others; they keep their place, without a class.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import column, id_type, texts, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
U64 = np.uint64
#: The multipliers of the splitmix64 finaliser and its increment.
MIX_A, MIX_B, STEP = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)
#: The first cell of ranks ends at 2 ** FIRST; each further one is twice as long.
FIRST = -1


@dataclass(frozen=True)
class Settings:
    """``bands`` of ``rows`` values: texts of similarity 0.8 share a band with a
    chance of 0.997, of 0.9 with one of 1 - 1e-8."""

    shingle: int = 5
    least: float = 0.8
    bands: int = 32
    rows: int = 8

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * MIX_A
    x = (x ^ (x >> U64(27))) * MIX_B
    return x ^ (x >> U64(31))


#: Hashes of words met before. Rare words are most of what a larger one would hold.
_WORDS: dict[str, int] = {}
KNOWN_WORDS = 50_000


def shingles(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and how often each occurs."""
    words = WORD.findall(text)
    if not words:
        return np.empty(0, U64), np.empty(0, np.int64)
    if len(_WORDS) > KNOWN_WORDS:
        _WORDS.clear()
    known = []
    for word in words:
        found = _WORDS.get(word)
        if found is None:
            found = _WORDS[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        known.append(found)
    hashes = np.array(known, U64)
    with np.errstate(over="ignore"):
        length = min(n, len(hashes))
        grams = hashes[: len(hashes) - length + 1].copy()
        for i in range(1, length):
            grams = mixed(grams + STEP) + hashes[i : len(hashes) - length + 1 + i]
        return np.unique(mixed(grams), return_counts=True)


@lru_cache(maxsize=256)
def _chances(mean: float) -> np.ndarray:
    """Cumulative chances of 0, 1, 2, … darts in a cell with that mean."""
    counts = np.arange(int(mean + 12 * np.sqrt(mean) + 24))
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.maximum(counts[1:], 1)))))
    return np.cumsum(np.exp(counts * np.log(mean) - mean - logs))


def darts(
    keys: np.ndarray, weights: np.ndarray, theta: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rank, coordinate draw, name, element) of all darts that hit an element's
    weight below its rank ``theta``. Which darts there are depends on the cells
    alone."""
    ranks, draws, names, elements_hit = [], [], [], []
    top = 0.0
    cell = 0
    while True:
        reach = np.flatnonzero(theta > top)
        if not len(reach):
            break
        low, high = (0.0, 2.0**FIRST) if cell == 0 else (top, top * 2)
        level = 0
        while True:
            base, width = 2.0**level - 1, 2.0**level
            reach = reach[weights[reach] > base]
            if not len(reach):
                break
            seeds = mixed(keys[reach] + U64(cell + 1) * STEP + U64(level + 1) * MIX_A)
            u = (mixed(seeds ^ MIX_B) >> U64(11)) * 2.0**-53
            counts = np.searchsorted(_chances((high - low) * width), u, side="right")
            owner = np.repeat(np.arange(len(reach)), counts)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            name = mixed(seeds[owner] + (place.astype(U64) + U64(1)) * MIX_B)
            rank = low + (name >> U64(11)) * 2.0**-53 * (high - low)
            element = reach[owner]
            early = rank < theta[element]
            rank, name, element = rank[early], name[early], element[early]
            second = mixed(name + STEP)
            hit = base + (second >> U64(32)) * 2.0**-32 * width < weights[element]
            ranks.append(rank[hit])
            draws.append(second[hit] & U64(0xFFFFFFFF))
            names.append(name[hit])
            elements_hit.append(element[hit])
            level += 1
        top, cell = high, cell + 1
    return tuple(map(np.concatenate, (ranks, draws, names, elements_hit)))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """The earliest dart of each of ``k`` coordinates, a row for each set of keys
    and weights. No set is empty. Sets are only computed together, each row
    follows from its own set."""
    found = np.empty((len(sets), k), U64)
    theta = np.array([k * (np.log(k) + 2) / float(weights.sum()) for _, weights in sets])
    left = np.arange(len(sets))
    with np.errstate(over="ignore"):
        while len(left):
            keys = np.concatenate([sets[i][0] for i in left])
            weights = np.concatenate([sets[i][1] for i in left])
            of = np.repeat(np.arange(len(left)), [len(sets[i][0]) for i in left])
            rank, draw, name, element = darts(keys, weights, theta[left][of])
            slot = of[element] * k + (draw % U64(k)).astype(np.int64)
            earliest = np.full(len(left) * k, np.inf)
            np.minimum.at(earliest, slot, rank)
            first = rank == earliest[slot]
            values = np.zeros(len(left) * k, U64)
            values[slot[first]] = name[first]
            whole = np.isfinite(earliest).reshape(-1, k).all(axis=1)
            found[left[whole]] = values.reshape(-1, k)[whole]
            # the others look further up, for their later darts
            left = left[~whole]
            theta[left] *= 2
    return found


def signature(keys: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    return signatures([(keys, weights)], k)[0]


def buckets(values: np.ndarray, settings: Settings) -> np.ndarray:
    """One key for each band, of its number and values; a row for each signature."""
    with np.errstate(over="ignore"):
        rows = values.reshape(-1, settings.bands, settings.rows)
        keys = np.arange(1, settings.bands + 1, dtype=U64) * MIX_B
        for i in range(settings.rows):
            keys = mixed(keys + rows[:, :, i] + STEP)
        return keys.view(np.int64)


#: Texts whose signatures are computed together, and their shingles at most
#: (a longer text is alone).
TOGETHER, TOGETHER_SHINGLES = 32, 1 << 17


def signed(texts_: Iterable[str], settings: Settings) -> Iterator[np.ndarray]:
    """The bucket keys of each text in turn, by occurrence and, if a shingle
    repeats, by distinct shingles too; none for a text without words."""
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[np.ndarray]:
        filled = [i for i, (keys, _) in enumerate(waiting) if len(keys)]
        repeating = [i for i in filled if waiting[i][1].max() > 1]
        keys = [np.empty(0, np.int64)] * len(waiting)
        if filled:
            sets = [waiting[i] for i in filled]
            sets += [(waiting[i][0], np.ones(len(waiting[i][0]))) for i in repeating]
            rows = buckets(signatures(sets, settings.coordinates), settings)
            for i, row in zip(filled, rows):
                keys[i] = row
            for i, row in zip(repeating, rows[len(filled) :]):
                keys[i] = np.unique(np.concatenate([keys[i], row]))
        waiting.clear()
        yield from keys

    size = 0
    for text in texts_:
        keys, counts = shingles(text, settings.shingle)
        if waiting and (len(waiting) == TOGETHER or size + len(keys) > TOGETHER_SHINGLES):
            yield from flush()
            size = 0
        waiting.append((keys, counts.astype(float)))
        size += len(keys)
    yield from flush()


def elements(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The weighted set as a plain one (the first, second, … occurrence of a
    shingle are elements of their own), in 32 bits, and where the first are."""
    keys, counts = shingles(text, n)
    with np.errstate(over="ignore"):
        nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        hashed = (mixed(np.repeat(keys, counts) + nth.astype(U64) * MIX_A) >> U64(32)).astype("<u4")
    hashed = np.unique(hashed) if len(hashed) else hashed
    return hashed, np.unique((keys >> U64(32)).astype("<u4"))


def alike(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def nodes_of(docs: DataFrame, id_col: str, text_col: str, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, node) and nodes (node, buckets). The node of equal texts
    is their smallest id."""
    kind = id_type(docs, id_col)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(signed(batch["text"], settings))
            if found:
                yield batch[["doc_id", "digest"]].assign(buckets=found)

    rows = texts(docs, id_col, text_col).withColumn("digest", F.unhex(F.sha1("text")))
    with_buckets = written(
        rows.filter("doc_id IS NOT NULL").mapInPandas(
            sign, f"doc_id {kind}, digest binary, buckets array<bigint>"
        ),
        "signatures",
    )
    firsts = with_buckets.groupBy("digest").agg(F.min("doc_id").alias("node"))
    members = written(with_buckets.join(firsts, "digest").select("doc_id", "node", "buckets"), "members")
    nodes = members.filter("doc_id = node").select("node", "buckets")
    return members.select("doc_id", "node").distinct(), nodes


#: Firsts that a node is compared with in the opening round; later rounds know no limit.
OPENING = 4
#: Orders that a later round draws at once; it is repeated while it makes at least one
#: link for every so many that were made before it.
DRAWS, AGAIN = 4, 4


def drawn_pairs(bucket_rows: DataFrame, salts: range, limit: int | None = None) -> DataFrame:
    """Pairs (node, other, class, other_class) of each node with the firsts of
    its buckets, once each, if their classes differ; with the earliest ``limit``
    of them only, if given. The firsts of a salt are drawn by one order over all
    buckets, so that the same few serve a group of copies."""
    orders = [F.struct(F.xxhash64("node", F.lit(s)).alias("at"), "node", "class") for s in salts]
    heads = (
        bucket_rows.groupBy("bucket")
        .agg(
            F.array(*map(F.min, orders)).alias("firsts"),
            F.min("class").alias("low"),
            F.max("class").alias("high"),
        )
        .filter("low <> high")
        .select("bucket", "firsts")
    )
    if limit is None:
        # the same node may come first in several orders, whose places do not matter
        plain = F.transform("firsts", lambda f: F.struct(f["node"].alias("node"), f["class"].alias("class")))
        heads = heads.select("bucket", F.array_distinct(plain).alias("firsts"))
    # a node has as many firsts as buckets times orders at most; one shuffle by node
    # serves both their union and the join with the node's set. Buckets hand over the
    # array of theirs, so that a row is made of a first once, not in each bucket
    others = F.filter("firsts", lambda f: f["class"] != F.col("class"))
    met = (
        bucket_rows.join(heads, "bucket")
        .select("node", "class", others.alias("others"))
        .filter(F.size("others") > 0)
        .groupBy("node")
        .agg(
            F.min("class").alias("class"),
            F.array_distinct(F.flatten(F.collect_list("others"))).alias("firsts"),
        )
    )
    firsts = F.col("firsts") if limit is None else F.slice(F.sort_array("firsts"), 1, limit)
    met = met.select("node", "class", F.explode(firsts).alias("first"))
    return met.select(
        "node", "class", F.col("first.node").alias("other"), F.col("first.class").alias("other_class")
    )


def verified(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Links (class, other_class) by pairs of at least the least similarity,
    which is computed exactly."""
    kind = id_type(pairs, "node")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = [
                max(alike(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")),
                    alike(np.frombuffer(c, "<u4"), np.frombuffer(d, "<u4")))
                for a, b, c, d in zip(batch["a"], batch["b"], batch["plain_a"], batch["plain_b"])
            ]
            found = batch[["class", "other_class"]].assign(similarity=near)
            yield found[found["similarity"] >= settings.least]

    left = sets.select("node", F.col("all").alias("a"), F.col("plain").alias("plain_a"))
    right = sets.select(
        F.col("node").alias("other"), F.col("all").alias("b"), F.col("plain").alias("plain_b")
    )
    return (
        pairs.join(left, "node")
        .join(right, "other")
        .mapInPandas(compare, f"class {kind}, other_class {kind}, similarity double")
        .select(F.col("class").alias("node"), F.col("other_class").alias("other"))
        .distinct()
    )


def mixed_buckets(rows: DataFrame) -> DataFrame:
    """Buckets (bucket) that hold several classes."""
    of = rows.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    return of.filter("low <> high").select("bucket")


def left_pairs(rows: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """All pairs (node, other, class, other_class) of different classes that can
    be of the least similarity, among the nodes of buckets of several classes.

    A set of n elements shares n * least of them at least with any that is near
    it. Ordered alike in all sets, those that two classes share by how many sets
    hold them, the first elements of two near sets so have one in common: s -
    ceil(n * least) + 1 of a set's s shared ones. Places in that order bound how
    many more can be common."""
    least = settings.least
    nodes = rows.join(mixed_buckets(rows), "bucket", "left_semi").select("node", "class").distinct()

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node, class_, all_, plain in zip(*(batch[c] for c in ("node", "class", "all", "plain"))):
                # by occurrence and by distinct shingles are two kinds of sets; without
                # repetition by one of the two, the plain similarity is the larger
                kinds = [(1, np.frombuffer(plain, "<u4"))]
                if len(all_) > len(plain):
                    kinds.append((2, np.frombuffer(all_, "<u4")))
                for kind, own in kinds:
                    yield pd.DataFrame(
                        {
                            "node": node,
                            "class": class_,
                            "n": len(own),
                            "element": own.astype(np.int64) * 2 + kind - 1,
                        }
                    )

    id_ = id_type(rows, "node")
    held = written(
        sets.join(nodes, "node").mapInPandas(
            listed, f"node {id_}, class {id_}, n bigint, element bigint"
        ),
        "elements",
    )
    shared = (
        held.groupBy("element")
        .agg(F.count("*").alias("held"), F.min("class").alias("low"), F.max("class").alias("high"))
        .filter("low <> high")
        .select("element", "held")
    )
    of_set = Window.partitionBy("node", F.col("element") % 2)
    ordered = of_set.orderBy("held", "element")
    needed = F.ceil(F.col("n") * least - 1e-9)
    first = written(
        held.join(shared, "element")
        .withColumn("s", F.count("*").over(of_set))
        .withColumn("place", F.row_number().over(ordered))
        .filter(F.col("place") <= F.col("s") - needed + 1)
        .select("element", "node", "class", "n", (F.col("s") - F.col("place")).alias("after")),
        "firsts",
    )
    others = first.select(
        "element",
        F.col("node").alias("other"),
        F.col("class").alias("other_class"),
        F.col("n").alias("other_n"),
        F.col("after").alias("other_after"),
    )
    common = F.ceil((F.col("n") + F.col("other_n")) * (least / (1 + least)) - 1e-9)
    return (
        first.join(others, "element")
        .filter((F.col("node") < F.col("other")) & (F.col("class") != F.col("other_class")))
        .filter((F.col("n") >= F.col("other_n") * least - 1e-9) & (F.col("other_n") >= F.col("n") * least - 1e-9))
        .filter(F.least("after", "other_after") + 1 >= common)
        .select("node", "other", "class", "other_class")
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, class): the smallest node that links lead to. Labels are taken from
    neighbours and then from the label's own label, until none changes."""
    both = written(
        links.unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other"))),
        "links",
    )
    labels = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("class"))
    labels = written(labels, "classes")
    while True:
        of_other = labels.select(F.col("node").alias("other"), "class")
        seen = both.join(of_other, "other").select("node", "class", F.lit(None).alias("before"))
        own = labels.select("node", "class", F.col("class").alias("before"))
        lowest = (
            own.unionByName(seen)
            .groupBy("node")
            .agg(F.min("class").alias("next"), F.max("before").alias("before"))
        )
        jump = labels.select(F.col("node").alias("next"), F.col("class").alias("jumped"))
        moved = written(
            lowest.join(jump, "next").select("node", F.least("next", "jumped").alias("class"), "before"),
            "classes",
        )
        labels = moved.select("node", "class")
        if moved.filter("class <> before").isEmpty():
            return labels


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Settings = Settings(),
) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id of its class) and
    whether it is the one that stays."""
    kind = id_type(docs, id_col)
    members, nodes = nodes_of(docs, id_col, text_col, settings)
    bucket_rows = nodes.select("node", F.explode("buckets").alias("bucket"))
    crowded = bucket_rows.groupBy("bucket").count().filter("count > 1").select("bucket")
    bucket_rows = written(bucket_rows.join(crowded, "bucket").select("node", "bucket"), "buckets")

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [elements(t, settings.shingle) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "node": batch["doc_id"],
                    "all": [a.tobytes() for a, _ in found],
                    "plain": [p.tobytes() for _, p in found],
                }
            )

    # texts of the nodes that meet others, once for all rounds
    met = bucket_rows.select(F.col("node").alias("doc_id")).distinct()
    sets = written(
        texts(docs, id_col, text_col)
        .join(met, "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"))
        .mapInPandas(sets_of, f"node {kind}, all binary, plain binary"),
        "sets",
    )
    # links join classes: what earlier rounds have linked is one node to later ones
    classes, salt, linked, drawing = None, 0, 0, True
    rows = bucket_rows.withColumn("class", F.col("node"))
    while True:
        if not drawing:
            pairs = left_pairs(rows, sets, settings)
        elif salt == 0:
            pairs = drawn_pairs(rows, range(1), OPENING)
        else:
            pairs = drawn_pairs(rows, range(salt, salt + DRAWS))
        found = written(verified(pairs, sets, settings), "similar")
        links, exact = found.count(), not drawing
        # the opening round sees but some of the pairs, and draws may miss some
        drawing = drawing and (salt == 0 or links * AGAIN >= max(linked, 1))
        salt, linked = salt + (DRAWS if salt else 1), linked + links
        if links == 0:
            if exact:
                break
            continue
        joined = components(found).select(F.col("node").alias("class"), F.col("class").alias("into"))
        if classes is None:
            classes = joined.select(F.col("class").alias("node"), F.col("into").alias("class"))
        else:
            kept = classes.join(joined, "class", "left").select(
                "node", F.coalesce("into", "class").alias("class")
            )
            fresh = joined.join(classes, joined["class"] == classes["node"], "left_anti")
            classes = kept.unionByName(
                fresh.select(F.col("class").alias("node"), F.col("into").alias("class"))
            )
        classes = written(classes, "classes")
        rows = bucket_rows.join(classes, "node", "left").withColumn(
            "class", F.coalesce("class", "node")
        )
        if exact:
            break  # all pairs of different classes were compared
    if classes is None:
        classes = members.select("node", F.col("node").alias("class")).limit(0)
    found = members.join(classes, "node", "left").select(
        "doc_id", F.coalesce("class", "node").alias("class_id")
    )
    # rows that share an id and differ in text are one document
    found = found.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    without = texts(docs, id_col, text_col).filter("doc_id IS NULL").select(
        "doc_id", F.lit(None).cast(kind).alias("class_id")
    )
    return found.unionByName(without).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True))
    )


def without_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, and all without an id."""
    stay = near_duplicates(docs, id_col, text_col, settings).filter("kept AND doc_id IS NOT NULL")
    stay = stay.select(F.col("doc_id").alias(id_col))
    place = Window.partitionBy(column(id_col)).orderBy(F.xxhash64(column(text_col)))
    names = docs.columns
    rank = "rank_" + "_".join(names)
    one = (
        docs.join(stay, id_col, "left_semi")
        .withColumn(rank, F.row_number().over(place))
        .filter(column(rank) == 1)
        .select(*map(column, names))
    )
    return one.unionByName(docs.filter(column(id_col).isNull()))
