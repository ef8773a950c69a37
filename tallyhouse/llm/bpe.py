"""Byte-level BPE encoding and decoding by overlapping chunks.

Merges never cross pre-tokens, so a text may be cut at any place where a
pre-token ends. A long text is dealt out as chunks that overlap. Every chunk is
pre-tokenised on its own, wherever it begins: the pattern never looks back, so
from the first pre-token end that two neighbours share they agree for good.
There one stops and the next goes on. A stitch has text before it, not white
space, because white space is matched by what follows it. The pieces between
stitches are encoded, each wherever its chunk is, and their ids are put
together by place.

Pre-tokens longer than an overlap leave no common place; such a text is
encoded as one piece. Decoding concatenates the bytes of the ids.

A null text is an empty one, without ids. Nothing is a special token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import id_type, texts


@dataclass(frozen=True)
class Vocabulary:
    """Ranks by their bytes, and the pattern that pre-tokenises.

    Sent to every task: tens of thousands of short tokens, about a megabyte.
    """

    ranks: tuple[tuple[bytes, int], ...]
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            ranks = tuple((base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines))
        return cls(ranks, pattern)

    @classmethod
    def public(cls, name: str = "byte_bpe_50k.tiktoken") -> Vocabulary:
        import public_tokenizers

        return cls.load(public_tokenizers.path(name), public_tokenizers.PATTERN)


class Codec:
    """One worker's encoder, decoder and pre-tokeniser."""

    def __init__(self, vocabulary: Vocabulary):
        ranks = dict(vocabulary.ranks)
        self.encoding = tiktoken.Encoding(
            "own", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.pattern = regex.compile(vocabulary.pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_ordinary(text), dtype=np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def ends(self, text: str) -> list[int]:
        """Ends of pre-tokens at which a text may be cut."""
        return [m.end() for m in self.pattern.finditer(text) if not text[m.end() - 1].isspace()]


_CODECS: dict[str, Codec] = {}


class _Shared:
    """A broadcast vocabulary; a worker builds one codec of it and keeps it."""

    def __init__(self, spark, vocabulary: Vocabulary):
        self.value = spark.sparkContext.broadcast(vocabulary)
        self.key = hashlib.sha256(repr(vocabulary).encode()).hexdigest()

    def codec(self) -> Codec:
        if self.key not in _CODECS:
            _CODECS.clear()
            _CODECS[self.key] = Codec(self.value.value)
        return _CODECS[self.key]


def _chunked(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """A row per chunk: overlapping parts of whole texts, in order of ``no``."""
    n = F.length("text")
    parts = F.greatest(F.ceil((n - overlap) / chunk), F.lit(1))
    return docs.withColumn("parts", parts.cast("int")).select(
        "row",
        "doc_id",
        "parts",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.col("parts") - 1),
                lambda i: F.struct(
                    i.alias("no"),
                    F.substring(F.col("text"), i * chunk + 1, F.lit(chunk + overlap)).alias("part"),
                ),
            )
        ).alias("c"),
    ).select("row", "doc_id", "parts", "c.no", "c.part")


#: Rows that a worker hands on at once, so that ids of few texts are in memory.
SLICE = 256


def _ids(codec: Codec, ids: np.ndarray) -> tuple:
    return (ids,)


def _digests(codec: Codec, ids: np.ndarray) -> tuple:
    whole = ids.astype("<u4").tobytes()
    return (
        len(ids),
        hashlib.sha256(whole).hexdigest(),
        hashlib.sha256(codec.decode(ids.tolist())).hexdigest(),
    )


def _digests_and_ids(codec: Codec, ids: np.ndarray) -> tuple:
    return *_digests(codec, ids), ids


def encode(
    docs: DataFrame,
    vocabulary: Vocabulary,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = 1 << 15,
    overlap: int = 1 << 10,
) -> DataFrame:
    """doc_id, ids (array of int) of every row's whole text."""
    shape = (id_col, text_col, chunk, overlap)
    return _encoded(docs, vocabulary, *shape, {"ids": "array<int>"}, _ids)


def round_trip(
    docs: DataFrame,
    vocabulary: Vocabulary,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = 1 << 15,
    overlap: int = 1 << 10,
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids (as little-endian unsigned
    32-bit integers) and of the bytes they decode to. The ids are decoded where
    they were made, so that they need not travel; ``with_ids`` returns them, too."""
    shape = (id_col, text_col, chunk, overlap)
    columns = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    if with_ids:
        columns["ids"] = "array<int>"
        return _encoded(docs, vocabulary, *shape, columns, _digests_and_ids)
    return _encoded(docs, vocabulary, *shape, columns, _digests)


def _encoded(
    docs: DataFrame,
    vocabulary: Vocabulary,
    id_col: str,
    text_col: str,
    chunk: int,
    overlap: int,
    columns: dict[str, str],
    told: Callable[[Codec, np.ndarray], tuple],
) -> DataFrame:
    """doc_id and what ``told`` tells of the ids of every row's whole text.

    ``chunk`` characters are a task's unit of work; texts up to one chunk and
    its overlap need no stitch and stay in their row. Longer ones are spread by
    chunk, so that one text's work is not one task's.
    """
    if not 0 < overlap < chunk:
        raise ValueError("the overlap has to be shorter than a chunk")
    shared = _Shared(docs.sparkSession, vocabulary)
    rows = texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    kind = id_type(docs, id_col)
    one = F.length("text") <= chunk + overlap

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = shared.codec()
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.iloc[at : at + SLICE]
                found = [told(codec, codec.encode(t)) for t in part["text"]]
                found = pd.DataFrame(found, columns=list(columns), index=part.index)
                found.insert(0, "doc_id", part["doc_id"])
                yield found

    def pretokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = shared.codec()
        for batch in batches:
            heads, tails = [], []
            for no, part, parts in zip(batch["no"], batch["part"], batch["parts"]):
                # the last pre-token may go on beyond the chunk
                ends = codec.ends(part) if no == parts - 1 else codec.ends(part)[:-1]
                start = no * chunk
                heads.append([start + e for e in ends if e <= overlap] if no else [])
                tails.append([start + e for e in ends if e >= chunk])
            yield batch.assign(heads=heads, tails=tails)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = shared.codec()
        for batch in batches:
            ids = [
                None
                if loose
                else codec.encode(part[a - no * chunk : b - no * chunk]).astype("<i4").tobytes()
                for no, part, a, b, loose in zip(
                    batch["no"], batch["part"], batch["a"], batch["b"], batch["loose"]
                )
            ]
            part = batch["part"].where(batch["loose"], None)
            yield batch[["row", "doc_id", "no"]].assign(part=part, ids=ids)

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("no")
        if group["ids"].isna().any():
            *before, last = group["part"]
            ids = shared.codec().encode("".join(p[:chunk] for p in before) + last)
        else:
            ids = np.frombuffer(b"".join(group["ids"]), "<i4")
        found = pd.DataFrame([told(shared.codec(), ids)], columns=list(columns))
        found.insert(0, "doc_id", group["doc_id"].iloc[:1].to_numpy())
        return found

    result = ", ".join([f"doc_id {kind}", *(f"{name} {of}" for name, of in columns.items())])
    short = rows.filter(one).select("doc_id", "text").mapInPandas(whole, result)
    in_order = Window.partitionBy("row").orderBy("no")
    last = F.col("no") == F.col("parts") - 1
    end = F.when(last, F.col("no") * chunk + F.length("part")).otherwise(F.col("cut"))
    stitched = (
        _chunked(rows.filter(~one), chunk, overlap)
        .repartition("row", "no")
        .mapInPandas(
            pretokenise,
            f"row long, doc_id {kind}, parts int, no int, part string, "
            "heads array<int>, tails array<int>",
        )
        .withColumn("next_heads", F.lead("heads").over(in_order))
        .withColumn("cut", F.array_min(F.array_intersect("tails", "next_heads")))
        .withColumn("a", F.coalesce(F.lag("cut").over(in_order), F.lit(0)))
        .withColumn("b", F.coalesce(end, F.lit(-1)))
        .withColumn("loose", F.min("b").over(Window.partitionBy("row")) < 0)
    )
    long = (
        stitched.select("row", "doc_id", "no", "part", "a", "b", "loose")
        .mapInPandas(pieces, f"row long, doc_id {kind}, no int, part string, ids binary")
        .groupBy("row")
        .applyInPandas(gather, result)
    )
    return short.unionByName(long)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of the ids, one after another."""
    shared = _Shared(encoded.sparkSession, vocabulary)

    @F.pandas_udf("binary")
    def joined(ids: pd.Series) -> pd.Series:
        codec = shared.codec()
        return ids.map(codec.decode)

    return encoded.withColumn("decoded", joined(F.col(ids_col)))
