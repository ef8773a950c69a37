"""Mixing to target weights by soft membership.

A classifier learnt from the labelled table gives every document its chances
p of belonging to each domain. Nonnegative rates r of the documents are then
fitted so that the expected tokens of the domains, sum of r * tokens * p, meet
their targets, by projected gradient steps on

    1/2 sum_d (share_d(r) - target_d)^2 / share_d(1) + ridge/2 sum_i w_i (r_i - 1)^2

with w the documents' shares of the tokens. Measured in w, a document's gradient
is a function of its p alone, and all steps so far add up to one pull per domain:
r = max(0, 1 - pull . p). What the shares miss is the slope of a convex function of the
pulls. Steps are scaled by the Gram matrix of the documents still above 0 and make that
function smaller, or else are halved: so they are few (about seven, a dozen for targets
that cannot be met). Each is one aggregation, which every task combines before a handful
of rows are shuffled.

The driver holds the pulls, a Gram matrix of the domains, a lexicon of bounded size and the
classifier. Without labels of two domains every chance is the domain's share of
the labels, or an even one without any. A target of a domain that no document
can belong to is given up, and the others are scaled up. Documents without
tokens have the rate that their chances give. Null texts are empty ones.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import column, written

DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.90, "poor": 0.08, "toxic": 0.02}
SURFACE = ("marks", "upper", "bars", "digits", "word_length", "variety", "size")


def label_domain(quality: Column, toxic: Column) -> Column:
    """Domain of a labelled document; null if the labels do not tell."""
    return (
        F.when(toxic == 1, "toxic").when(quality == 1, "good").when(quality == 0, "poor")
    )


@dataclass(frozen=True)
class Settings:
    """``labelled``: about so many labelled documents are learnt from.
    ``lexicon``: words kept for each domain. ``ridge``: weight of rates near 1; small,
    so that targets that can be met are, and rates stay finite where they cannot.
    ``steps``: a guard against endless loops, far above what is needed."""

    labelled: int = 10_000
    lexicon: int = 100
    least_documents: int = 3
    penalty: float = 1e-3
    iterations: int = 25
    steps: int = 200
    ridge: float = 1e-6
    tolerance: float = 1e-6


def with_words(rows: DataFrame) -> DataFrame:
    """Adds ``words``, the runs of letters in lower case."""
    return rows.withColumn("words", F.array_remove(F.split(F.lower("text"), r"[^\p{L}]+"), ""))


def n_tokens() -> Column:
    return F.regexp_count("text", F.lit(r"\S++")).cast("long").alias("n_tokens")


def with_features(rows: DataFrame, lexicons: list[list[str]]) -> DataFrame:
    """doc_id, n_tokens and features of rows that have ``words``: the text's
    surface, and what share of its distinct words each lexicon holds."""
    n = F.greatest(F.length("text"), F.lit(1))
    # one pass over the text for all kinds of signs, which are then told apart
    signs = F.array_join(F.regexp_extract_all("text", F.lit(r"[#*$%&<>!|0-9\p{Lu}]++"), 0), "")
    named = (
        rows.withColumn("distinct", F.array_distinct("words"))
        .withColumn("n_tokens", n_tokens())
        .withColumn("signs", signs)
    )

    def listed(words: list[str]) -> Column:
        return F.array(*[F.lit(w) for w in words]).cast("array<string>")

    # few words are in any lexicon, so each is compared with those alone
    named = named.withColumn(
        "known_words", F.array_intersect("distinct", listed(sorted({w for words in lexicons for w in words})))
    )
    tokens = F.greatest(F.col("n_tokens"), F.lit(1))
    kinds = F.greatest(F.size("distinct"), F.lit(1))
    held = [F.size(F.array_intersect("known_words", listed(words))) / kinds for words in lexicons]
    surface = {
        "marks": F.regexp_count("signs", F.lit(r"[#*$%&<>!]")) / n,
        "upper": F.regexp_count("signs", F.lit(r"\p{Lu}")) / n,
        "bars": F.regexp_count("signs", F.lit(r"\|")) / n,
        "digits": F.regexp_count("signs", F.lit(r"[0-9]")) / n,
        "word_length": n / tokens,
        "variety": kinds / tokens,
        "size": F.log(tokens.cast("double")),
    }
    return named.select(
        *[c for c in named.columns if c not in ("text", "words", "distinct", "known_words", "signs")],
        *[c.cast("double").alias(name) for name, c in surface.items()],
        *[c.cast("double").alias(f"lexicon_{i}") for i, c in enumerate(held)],
    )


def posteriors(
    docs: DataFrame,
    labels: DataFrame,
    domain: Column,
    domains: tuple[str, ...] = DOMAINS,
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Settings = Settings(),
    carry: bool = False,
) -> DataFrame:
    """doc_id, n_tokens and ``p``, the chances of the domains in order, and with
    ``carry`` the whole row of ``docs``. ``domain`` is a column of ``labels``,
    which share ``id_col`` with ``docs``."""
    kept = ["doc_id", *["carried"] * carry]
    known = labels.select(column(id_col).alias("id"), domain.alias("domain"))
    known = known.filter(F.col("id").isNotNull() & F.col("domain").isin(*domains))
    known = known.groupBy("id").agg(F.min("domain").alias("domain"))
    sizes = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    total = sum(sizes.values())
    whole = F.struct(*map(column, docs.columns)).alias("carried")
    rows = docs.select(
        column(id_col).alias("doc_id"),
        F.coalesce(column(text_col), F.lit("")).alias("text"),
        *[whole] * carry,
    )
    rows = with_words(rows)
    prior = [sizes.get(d, 0) / total if total else 1 / len(domains) for d in domains]
    constant = F.array(*[F.lit(float(p)) for p in prior])
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.filter(place < min(1.0, settings.labelled / max(total, 1)))
    # the sample's size is a setting, so it may be sent to every task
    learnt = written(
        rows.join(F.broadcast(sample), F.col("doc_id") == F.col("id")).select("text", "words", "domain"),
        "labelled",
    )
    found = {r["domain"] for r in learnt.select("domain").distinct().collect()}
    if len(found) < 2:
        return rows.select(*kept, n_tokens(), constant.alias("p"))
    present = [d for d in domains if d in found]
    own = {d: F.sum((F.col("domain") == d).cast("double")) for d in present}
    counted = (
        learnt.select("domain", F.explode(F.array_distinct("words")).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"), *[c.alias(f"n_{i}") for i, c in enumerate(own.values())])
        .filter(F.col("n") >= settings.least_documents)
        .withColumn("some", F.lit(True))
    )
    lexicons = []
    for i, name in enumerate(present):
        share = sizes[name] / total
        expected = F.col("n") * share
        surplus = (F.col(f"n_{i}") - expected) / F.sqrt(expected * (1 - share) + 0.5)
        top = counted.filter(surplus > 2).orderBy(surplus.desc(), "word").limit(settings.lexicon)
        lexicons.append([r["word"] for r in top.collect()])
    names = [*SURFACE, *[f"lexicon_{i}" for i in range(len(lexicons))]]
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    index = F.create_map(*[x for i, d in enumerate(present) for x in (F.lit(d), F.lit(float(i)))])
    train = assembler.transform(with_features(learnt, lexicons)).select(
        "features", index[F.col("domain")].alias("label")
    )
    train = train.coalesce(4).persist()
    model = LogisticRegression(
        family="multinomial", regParam=settings.penalty, maxIter=settings.iterations
    ).fit(train)
    train.unpersist()
    scored = model.transform(assembler.transform(with_features(rows, lexicons)))
    scored = scored.select(*kept, "n_tokens", vector_to_array("probability").alias("known"))
    p = [F.get("known", present.index(d)) if d in present else F.lit(0.0) for d in domains]
    return scored.select(*kept, "n_tokens", F.array(*p).alias("p"))


def rate(p: list[Column], pull: list[float], least: Column) -> Column:
    """The rate that the pulls of the domains give, never below ``least``."""
    return F.greatest(least, F.lit(1.0) - sum((x * F.lit(float(g)) for x, g in zip(p, pull)), F.lit(0.0)))


@dataclass(frozen=True)
class Mix:
    """``rows``: doc_id, n_tokens, p, rate (and carried). ``shares``: what the rates make
    of the tokens, domain by domain, as shares of all tokens. ``residuals``: what
    the shares miss the targets by; above the tolerance only if the targets cannot
    be met."""

    rows: DataFrame
    shares: dict[str, float]
    steps: int
    residuals: dict[str, float]


def fit_rates(
    chances: DataFrame,
    targets: Mapping[str, float],
    domains: tuple[str, ...] = DOMAINS,
    total: float = 1.0,
    settings: Settings = Settings(),
    whole: str | None = None,
) -> Mix:
    """Rates for ``total`` times the corpus's tokens. ``chances`` should be a
    written table, which each step reads once.

    Documents that most likely belong to the domain ``whole`` have a rate of 1 at
    least; ``total`` then grows to what the domain needs for that."""
    p = [F.get("p", i) for i in range(len(domains))]
    tokens = F.col("n_tokens").cast("double")
    base = chances.agg(F.sum(tokens), *[F.sum(tokens * x) for x in p]).first()
    all_tokens = base[0] or 0.0
    if not all_tokens:
        return Mix(chances.withColumn("rate", F.lit(1.0)), dict.fromkeys(domains, 0.0), 0, dict.fromkeys(domains, 0.0))
    mass = [b / all_tokens for b in base[1:]]
    wanted = [targets.get(d, 0.0) if m > 0 else 0.0 for d, m in zip(domains, mass)]
    wanted = [w / (sum(wanted) or 1.0) for w in wanted]
    least = F.lit(0.0)
    if whole is not None:
        of = domains.index(whole)
        if wanted[of] > 0:
            total = max(total, mass[of] / wanted[of])
        least = F.when(p[of] >= F.array_max("p"), 1.0).otherwise(0.0)
    wanted = [total * w for w in wanted]
    can = [i for i, m in enumerate(mass) if m > 0]
    scale, goal = np.array([mass[i] for i in can]), np.array([wanted[i] for i in can])

    room = F.lit(1.0) - least

    def measured(pull: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Shares of the domains, the Gram matrix of the documents above their least rate,
        and the value whose slope is what the shares miss."""
        full = np.zeros(len(domains))
        full[can] = pull
        r = rate(p, list(full), least)
        pulled = sum((x * F.lit(float(g)) for x, g in zip(p, full)), F.lit(0.0))
        free = F.lit(1.0) - pulled >= least
        given = F.when(free, pulled - pulled * pulled / 2).otherwise(
            room - room * room / 2 + least * (pulled - room)
        )
        w = tokens / F.lit(all_tokens)
        pairs = [(i, j) for i in can for j in can if i <= j]
        row = chances.agg(
            *[F.sum(w * r * p[i]) for i in can],
            *[F.sum(F.when(free, w * p[i] * p[j])) for i, j in pairs],
            F.sum(w * given),
        ).first()
        gram = np.zeros((len(can), len(can)))
        for (i, j), value in zip(pairs, row[len(can) : -1]):
            a, b = can.index(i), can.index(j)
            gram[a, b] = gram[b, a] = value or 0.0
        value = goal @ pull + settings.ridge / 2 * (scale * pull**2).sum() - row[-1]
        return np.array(row[: len(can)]), gram, float(value)

    def miss(found: np.ndarray, pull: np.ndarray) -> np.ndarray:
        return found - goal - settings.ridge * scale * pull

    def met(found: np.ndarray, pull: np.ndarray) -> bool:
        return np.abs(miss(found, pull)).max() <= settings.tolerance

    pull = np.zeros(len(can))
    found, gram, value = measured(pull)
    steps, part = 1, 1.0
    while steps < settings.steps and not met(found, pull) and part > 1e-6:
        error = miss(found, pull)
        way = np.linalg.lstsq(gram + settings.ridge * np.diag(scale), error, rcond=None)[0]
        slope, part = error @ way, 1.0
        while steps < settings.steps and part > 1e-6:
            trial = pull + part * way
            there, gram_there, value_there = measured(trial)
            steps += 1
            if value_there <= value - 1e-4 * part * slope or met(there, trial):
                pull, found, gram, value = trial, there, gram_there, value_there
                break
            part /= 2
    shares, pulls = np.zeros(len(domains)), np.zeros(len(domains))
    shares[can], pulls[can] = found, pull
    rows = chances.withColumn("rate", rate(p, list(pulls), least))
    missed = {d: float(s - w) for d, s, w in zip(domains, shares, wanted)}
    return Mix(rows, dict(zip(domains, shares.tolist())), steps, missed)


def mix(
    docs: DataFrame,
    labels: DataFrame,
    domain: Column,
    targets: Mapping[str, float],
    domains: tuple[str, ...] = DOMAINS,
    total: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Settings = Settings(),
    carry: bool = False,
    whole: str | None = None,
) -> Mix:
    chances = posteriors(docs, labels, domain, domains, id_col, text_col, settings, carry)
    return fit_rates(written(chances, "chances"), targets, domains, total, settings, whole)


def copies(rate_: Column, key: Column) -> Column:
    """Whole copies for a rate: its whole part, and one more with the chance of
    the rest, told by a hash of the key."""
    place = F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate_) + (place < rate_ - F.floor(rate_)).cast("long")).cast("int")


def mixed_rows(found: Mix) -> DataFrame:
    """The rows that a mix carries, as often as their rates ask."""
    n = copies(F.col("rate"), F.col("doc_id"))
    rows = found.rows.select("carried", n.alias("n")).filter("n > 0")
    return rows.select(F.explode(F.array_repeat("carried", F.col("n"))).alias("row")).select("row.*")
