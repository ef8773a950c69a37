"""Language ID: sparse multinomial logistic regression on character n-grams.

Features are hashed character n-grams of the whole text, weighted by TF-IDF.
Document frequencies are counted over all labelled texts. The weights are
learnt by follow-the-regularised-leader with elastic-net penalties, on a sample
bounded for each language: shards learn side by side and their weights are
averaged. A temperature, fitted on texts kept back from learning, makes the
softmax scores honest.

What the driver holds is bounded by the number of features, languages and
calibration rows, never by the corpus. A text that is null or has no letter is
``und`` with score 0. Without any labelled text every text is ``und``. Of
equal scores, the language that comes first in code point order wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import column, id_type, written

UNDETERMINED = "und"
LETTER = r"\p{L}"


@dataclass(frozen=True)
class Settings:
    """``per_language``: about so many labelled texts of each language are
    learnt from, and a quarter as many more are kept back for calibration."""

    bits: int = 16
    longest: int = 3
    per_language: int = 2000
    shards: int = 8
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # language x (feature..., intercept)
    temperature: float
    settings: Settings


def counts(text: str, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text and how often each occurs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    size, shift = 1 << settings.bits, np.uint32(32 - settings.bits)
    mixed = codes * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B)
    gram, hashed = mixed, [mixed >> shift]
    for n in range(2, settings.longest + 1):
        if len(gram) < 2:
            break
        gram = (gram[:-1] ^ (gram[:-1] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + mixed[n - 1 :]
        hashed.append((gram * np.uint32(0x9E3779B1)) >> shift)
    found = np.concatenate(hashed)
    if len(found) * 16 < size:
        return np.unique(found, return_counts=True)
    whole = np.bincount(found, minlength=size)
    places = np.flatnonzero(whole)
    return places, whole[places]


def vector(text: str, idf: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Sparse TF-IDF of length one, with the intercept as its last feature."""
    places, found = counts(text, settings)
    values = (1 + np.log(found)) * idf[places]
    norm = np.sqrt(np.square(values).sum()) or 1.0
    return np.append(places, 1 << settings.bits), np.append(values / norm, 0.1)


def softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return powers / powers.sum(axis=-1, keepdims=True)


class Ftrl:
    """Per-coordinate FTRL-proximal for a multinomial logistic loss."""

    def __init__(self, n_classes: int, settings: Settings):
        shape = (n_classes, (1 << settings.bits) + 1)
        self.z, self.n, self.settings = np.zeros(shape), np.zeros(shape), settings

    def weights(self, places) -> np.ndarray:
        s = self.settings
        z, n = self.z[:, places], self.n[:, places]
        step = -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)
        return np.where(np.abs(z) <= s.l1, 0.0, step)

    def learn(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        weights = self.weights(places)
        error = softmax(weights @ values)
        error[label] -= 1
        gradient = error[:, None] * values
        n = self.n[:, places]
        more = n + gradient**2
        self.z[:, places] += gradient - (np.sqrt(more) - np.sqrt(n)) / self.settings.alpha * weights
        self.n[:, places] = more


def document_frequencies(labelled: DataFrame, settings: Settings) -> tuple[int, np.ndarray]:
    """Number of texts, and of texts with each feature. A task sends at most
    one row per feature."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((1 << settings.bits) + 1, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                total[counts(text, settings)[0]] += 1
            n += len(batch)
        total[-1] = n
        places = np.flatnonzero(total)
        yield pd.DataFrame({"feature": places, "n": total[places]})

    rows = (
        labelled.select("text")
        .mapInPandas(partial, "feature long, n long")
        .groupBy("feature")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    total = np.zeros((1 << settings.bits) + 1, np.int64)
    total[rows["feature"]] = rows["n"]
    return int(total[-1]), total[:-1]


def sampled(labelled: DataFrame, languages: dict[str, int], settings: Settings) -> DataFrame:
    """About ``per_language`` rows of each language by a hash of the text, with
    their shard; shard -1 is for calibration."""
    place = F.xxhash64("text", F.lit(1)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    share = F.create_map(
        *[
            x
            for name, n in languages.items()
            for x in (F.lit(name), F.lit(min(1.0, 1.25 * settings.per_language / n)))
        ]
    )[F.col("lang")]
    shard = F.pmod(F.xxhash64("text", F.lit(2)), F.lit(settings.shards)).cast("int")
    kept_back = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(5)) == 0
    return (
        labelled.withColumn("place", place)
        .filter(F.col("place") < share)
        .select("text", "lang", F.when(kept_back, -1).otherwise(shard).alias("shard"))
    )


#: Texts whose vectors a task holds and hands over together; a vector can be many times
#: longer than its text's place in a batch suggests.
TOGETHER = 128


def examples_of(
    batches: Iterable[pd.DataFrame], idf: np.ndarray, names: tuple[str, ...], settings: Settings
) -> Iterator[pd.DataFrame]:
    """Shard, label and vector of each row (text, lang, shard), a few rows at a time."""
    for batch in batches:
        for start in range(0, len(batch), TOGETHER):
            part = batch.iloc[start : start + TOGETHER]
            places, values = [], []
            for text in part["text"]:
                at, value = vector(text, idf, settings)
                places.append(at.astype(np.int32))
                values.append(value.astype(np.float32))
            yield pd.DataFrame(
                {
                    "shard": part["shard"].to_numpy(),
                    "label": [names.index(x) for x in part["lang"]],
                    "places": places,
                    "values": values,
                }
            )


def train(
    docs: DataFrame,
    labelled: Column,
    text_col: str = "text",
    lang_col: str = "lang",
    settings: Settings = Settings(),
) -> Model:
    """Learns from the rows of ``docs`` for which ``labelled`` holds, which have
    a language and a letter."""
    rows = docs.filter(labelled).select(
        column(text_col).alias("text"), column(lang_col).cast("string").alias("lang")
    )
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    names = tuple(sorted(sizes))
    n_features = 1 << settings.bits
    if not names:
        return Model((), np.zeros(n_features), np.zeros((0, n_features + 1)), 1.0, settings)
    n, frequency = document_frequencies(rows, settings)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    shared = rows.sparkSession.sparkContext.broadcast(idf)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return examples_of(batches, shared.value, names, settings)

    examples = written(
        sampled(rows, sizes, settings).mapInPandas(
            vectors, "shard int, label int, places array<int>, values array<float>"
        ),
        "langid",
    )

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        learner = Ftrl(len(names), settings)
        # an order of its own in each shard, whatever order its rows arrive in
        order = [
            (crc32(p.tobytes() + v.tobytes()), label)
            for p, v, label in zip(group["places"], group["values"], group["label"])
        ]
        group = group.iloc[sorted(range(len(order)), key=order.__getitem__)]
        for _ in range(settings.epochs):
            for places, values, label in zip(group["places"], group["values"], group["label"]):
                learner.learn(places, values.astype(float), label)
        return pd.DataFrame({"weights": [learner.weights(slice(None)).astype("<f4").tobytes()]})

    shards = examples.filter("shard >= 0")
    # one row a shard, of a size that the numbers of features and languages set
    learnt = [
        np.frombuffer(r["weights"], "<f4")
        for r in shards.groupBy("shard").applyInPandas(learn, "weights binary").collect()
    ]
    shape = (len(names), n_features + 1)
    weights = np.mean(learnt, axis=0).reshape(shape) if learnt else np.zeros(shape)

    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def logits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sent.value[:, p] @ v for p, v in zip(batch["places"], batch["values"])]
            yield pd.DataFrame({"label": batch["label"], "logits": found})

    back = (
        examples.filter("shard < 0").mapInPandas(logits, "label int, logits array<double>").toPandas()
    )
    return Model(names, idf, weights, temperature(back), settings)


def temperature(calibration: pd.DataFrame) -> float:
    """The temperature of least loss on the calibration rows; 1 without rows."""
    if calibration.empty:
        return 1.0
    logits = np.stack(calibration["logits"].to_numpy())
    labels = calibration["label"].to_numpy()
    grid = np.geomspace(0.02, 20, 121)
    losses = [
        -np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean()
        for t in grid
    ]
    return float(grid[int(np.argmin(losses))])


def best(texts: Iterable[str | None], model: Model) -> tuple[list[str], list[float]]:
    """Languages and scores of texts; None stands for a text without a letter."""
    names, scores = [], []
    for text in texts:
        if text is None or not model.languages:
            names.append(UNDETERMINED)
            scores.append(0.0)
            continue
        places, values = vector(text, model.idf, model.settings)
        chances = softmax(model.weights[:, places] @ values / model.temperature)
        first = int(np.argmax(chances))
        names.append(model.languages[first])
        scores.append(float(chances[first]))
    return names, scores


def lettered(text: Column) -> Column:
    return F.when(text.rlike(LETTER), text)


def predict(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, lang_pred and score of every row's whole text."""
    rows = docs.select(
        column(id_col).alias("doc_id"), lettered(column(text_col)).alias("text")
    )
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                names, scores = best(batch["text"], sent.value)
                yield pd.DataFrame(
                    {"doc_id": batch["doc_id"], "lang_pred": names, "score": scores}
                )

    return rows.mapInPandas(
        told, f"doc_id {id_type(docs, id_col)}, lang_pred string, score double"
    )


def accepted(
    docs: DataFrame, model: Model, text_col: str = "text", least_score: float = 0.5
) -> DataFrame:
    """The rows of ``docs`` whose language is told with at least that score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def sure(text: pd.Series) -> pd.Series:
        names, scores = best(text, sent.value)
        return pd.Series([n != UNDETERMINED and s >= least_score for n, s in zip(names, scores)])

    return docs.filter(sure(lettered(column(text_col))))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id's text, modulo 3, is 1."""
    text = F.coalesce(column(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 3 == 1
