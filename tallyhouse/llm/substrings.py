"""Removal of passages that an earlier document has word for word.

A window is ``window`` consecutive words of a document. Words are removed that lie in
a window whose words also start in a document with a smaller id. Suffix automata of
reference shards decide: each of their states knows the smallest document it occurs
in, and texts are streamed through them for the longest match at every word, of which
``window`` words are enough. Runs of such matches are the maximal spans that go.

Not every text has to meet every shard. A window's anchor is the least hash of the
``gram`` words long sequences in it, so equal windows have equal anchors. Neighbouring
windows of one anchor are a piece. Then

1. pieces are told by anchor and the hash of their words (``pieces``); equal ones are
   one from here on, however many copies there are;
2. only pieces whose anchor occurs in two documents go on, with the words of their
   first document (``worded``);
3. a piece that is the only one of its anchor is reference text. Where pieces of an
   anchor differ, windows in two documents are found by hash, and the first piece with
   such a window is reference text; pieces without one are done (``referenced``);
4. reference text is dealt to shards by anchor, and every shard becomes an automaton;
5. a shard is broadcast to all blocks of its pieces, which are streamed through its
   automaton (``matched``). All shards together have no bound, so this is a shuffle;
6. matches go back to all documents with those pieces.

Hashes have 64 bits and only choose what is compared. What is removed, the automata
decide on the words themselves.

- A null text has no words. A text of fewer words than a window keeps all.
- Windows of a document with a null id are neither removed nor a reason to remove.
- Rows of one id are documents of their own with equal ids: none is smaller than the
  other, and both are judged by smaller ids. Equal rows have equal results.
- A passage twice in one document stays, unless a smaller id has it.
- An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyhouse.llm.common import column, written


@dataclass(frozen=True)
class Settings:
    window: int = 50
    gram: int = 10
    #: Windows in a piece at most.
    piece_windows: int = 256
    #: Words in an automaton, about.
    shard_words: int = 100_000
    #: Pieces that are streamed through an automaton by one task, about.
    block_pieces: int = 20_000


# Words and hashes. ``bytes.split`` splits at the white space of ASCII: blank and 9 to 13.

PIECE_BYTES = 1 << 21
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the differences of 64-bit hashes over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Powers:
    """Powers of the base and of its inverse, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            self.up, self.down = (
                np.multiply.accumulate(np.append(np.uint64(1), np.full(size - 1, b, dtype=np.uint64)))
                for b in (BASE, INVERSE)
            )
        return self.up[:n], self.down[:n]


class Hashes:
    """Hashes of runs of words, from sums up to every word."""

    def __init__(self, words: np.ndarray, powers: Powers) -> None:
        self.words, n = words, len(words)
        self.up, down = powers(n + 1)
        self.sums = np.append(np.uint64(0), np.cumsum(words * down[:n], dtype=np.uint64))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        runs = (self.sums[ends] - self.sums[starts]) * self.up[starts]
        return mixed(runs + (ends - starts).astype(np.uint64)).view(np.int64)


def least_in_runs(values: np.ndarray, n: int) -> np.ndarray:
    """The least of every ``n`` neighbours, by doubling."""
    span = 1
    while span * 2 <= n:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = n - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def cut(hashes: Hashes, settings: Settings) -> tuple[np.ndarray, ...]:
    """Anchors, hashes of the words, starts and numbers of windows of a document's pieces."""
    n = len(hashes.words)
    starts = np.arange(n - settings.gram + 1)
    grams = hashes.of(starts, starts + settings.gram)
    anchors = least_in_runs(grams, settings.window - settings.gram + 1)
    first = np.append(0, np.flatnonzero(anchors[1:] != anchors[:-1]) + 1)
    run = np.arange(len(anchors)) - np.repeat(first, np.diff(np.append(first, len(anchors))))
    # one word again and again has one anchor: such runs are cut, windows meet by anchor
    first = np.flatnonzero(run % settings.piece_windows == 0)
    windows = np.diff(np.append(first, len(anchors)))
    return anchors[first], hashes.of(first, first + windows + settings.window - 1), first, windows


def found_at(parts: tuple[np.ndarray, ...]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Starts and numbers of windows of a document's pieces, by anchor and words."""
    places: dict = {}
    for anchor, body, start, n in zip(*[p.tolist() for p in parts]):
        places.setdefault((anchor, body), []).append((start, n))
    return places


def split_texts(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of the texts of a batch, in runs of bounded size: (first row, words)."""
    first, size, words = 0, 0, []
    for i, text in enumerate(texts):
        data = text.as_py() or ""
        words.append(data.encode().split())
        size += len(data)
        if size >= PIECE_BYTES:
            yield first, words
            first, size, words = i + 1, 0, []
    if words:
        yield first, words


def coded(words: list[list[bytes]]) -> list[np.ndarray]:
    """64-bit hashes of words, text by text."""
    flat = np.array([w for text in words for w in text], dtype=object)
    codes = pd.util.hash_array(flat) if len(flat) else np.empty(0, dtype=np.uint64)
    return np.split(codes, np.cumsum([len(text) for text in words])[:-1])


# Suffix automata


class Automaton:
    """Of several word sequences; each state knows the smallest document it occurs in."""

    def __init__(self) -> None:
        self.place: dict[bytes, int] = {}
        self.follow: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [None]

    def _clone(self, q: int, length: int, p: int, word: int) -> int:
        clone = len(self.length)
        self.follow.append(self.follow[q].copy())
        self.link.append(self.link[q])
        self.length.append(length)
        self.least.append(self.least[q])
        self.link[q] = clone
        while p != -1 and self.follow[p].get(word) == q:
            self.follow[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: Sequence[bytes], document) -> None:
        follow, link, length, least, place = self.follow, self.link, self.length, self.least, self.place
        last = 0
        for word in (place.setdefault(w, len(place)) for w in words):
            q, target = follow[last].get(word), length[last] + 1
            if q is None:
                new = len(length)
                follow.append({})
                link.append(0)
                length.append(target)
                least.append(None)
                p = last
                while p != -1 and word not in follow[p]:
                    follow[p][word] = new
                    p = link[p]
                if p != -1:
                    q = follow[p][word]
                    if length[q] == length[p] + 1:
                        link[new] = q
                    else:
                        link[new] = self._clone(q, length[p] + 1, p, word)
                last = new
            else:
                last = q if length[q] == target else self._clone(q, target, last, word)
            if least[last] is None or document < least[last]:
                least[last] = document

    def handed_on(self) -> list:
        """The smallest document of every state, also of those it is a suffix of."""
        least, link = self.least.copy(), self.link
        for state in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            parent = link[state]
            if parent and (least[parent] is None or least[state] < least[parent]):
                least[parent] = least[state]
        return least


class Matcher:
    """Streams words through an automaton."""

    def __init__(self, automaton: Automaton, window: int) -> None:
        self.automaton, self.least, self.window = automaton, automaton.handed_on(), window

    def smallest(self, words: Sequence[bytes]) -> list:
        """For every window its smallest document in the automaton, or None.

        ``size`` is the length of the longest match that ends at a word (as far as a
        window's), ``state`` the state of that match.
        """
        follow, link, length = self.automaton.follow, self.automaton.link, self.automaton.length
        least, window = self.least, self.window
        found, state, size = [], 0, 0
        for place in map(self.automaton.place.get, words):
            target = follow[state].get(place)
            while target is None and state:
                state = link[state]
                size = length[state]
                target = follow[state].get(place)
            if target is not None:
                state, size = target, size + 1
            if size >= window:
                size = window
                while length[link[state]] >= window:
                    state = link[state]
                found.append(least[state])
            else:
                found.append(None)
        return found[window - 1 :]


# Stages


def pieces(docs: DataFrame, settings: Settings) -> DataFrame:
    """Pieces of all documents: id and digest of the text, anchor, and hash of the
    piece's words (``body``)."""

    def find(batches):
        powers = Powers()
        for batch in batches:
            for first, words in split_texts(batch.column(2)):
                found = []
                for i, codes in enumerate(coded(words)):
                    if len(codes) >= settings.window:
                        anchors, bodies, _, _ = cut(Hashes(codes, powers), settings)
                        found.append((np.full(len(anchors), first + i), anchors, bodies))
                if found:
                    rows, anchors, bodies = map(np.concatenate, zip(*found))
                    rows = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(anchors), pa.array(bodies)],
                        names=["doc_id", "digest", "anchor", "body"],
                    )

    schema = T.StructType([docs.schema["doc_id"], docs.schema["digest"]])
    schema = schema.add("anchor", "long").add("body", "long")
    known = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "digest", "text")
    return written(known.mapInArrow(find, schema), "pieces")


def candidates(parts: DataFrame) -> DataFrame:
    """Pieces whose anchor is in two documents; ``several``, if pieces of it differ."""
    shared = parts.groupBy("anchor").agg(
        F.min("doc_id").alias("_least"),
        F.max("doc_id").alias("_most"),
        (F.min("body") != F.max("body")).alias("several"),
    )
    shared = shared.filter("_least < _most").select("anchor", "several")
    return written(parts.join(shared, "anchor"), "shared-pieces")


def worded(docs: DataFrame, shared: DataFrame, settings: Settings) -> DataFrame:
    """Distinct pieces with their first and last document, their words and, if pieces of
    the anchor differ, the hashes of their windows."""
    distinct = shared.groupBy("anchor", "body", "several").agg(
        F.min(F.struct("doc_id", "digest")).alias("first"), F.max("doc_id").alias("last")
    )
    wanted = distinct.groupBy("first.doc_id", "first.digest").agg(
        F.collect_list(F.struct("anchor", "body", "last", "several")).alias("wanted")
    )
    kind = docs.schema["doc_id"].dataType

    def take(batches):
        powers, seen = Powers(), set()
        for batch in batches:
            ids, digests = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, words in split_texts(batch.column(2)):
                rows = []
                for i, codes in enumerate(coded(words), first):
                    if (ids[i], digests[i]) in seen:  # an equal row
                        continue
                    seen.add((ids[i], digests[i]))
                    hashes = Hashes(codes, powers)
                    places = found_at(cut(hashes, settings))
                    for p in batch.column(3)[i].as_py():
                        start, n = places[p["anchor"], p["body"]][0]
                        starts = start + np.arange(n)
                        windows = hashes.of(starts, starts + settings.window) if p["several"] else None
                        text = b" ".join(words[i - first][start : start + n + settings.window - 1])
                        rows.append((p["anchor"], p["body"], ids[i], p["last"], text.decode(), windows))
                if rows:
                    id_type = batch.column(0).type
                    kinds = [pa.int64(), pa.int64(), id_type, id_type, pa.string(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)],
                        names=["anchor", "body", "doc_id", "last", "words", "hashes"],
                    )

    schema = T.StructType().add("anchor", "long").add("body", "long").add("doc_id", kind).add("last", kind)
    schema = schema.add("words", "string").add("hashes", T.ArrayType(T.LongType()))
    texts = docs.select("doc_id", "digest", "text").join(wanted, ["doc_id", "digest"])
    return written(texts.mapInArrow(take, schema), "worded-pieces")


def referenced(worded_pieces: DataFrame) -> DataFrame:
    """Pieces to be streamed; ``own``, if they are reference text."""
    alone = worded_pieces.filter(F.col("hashes").isNull()).withColumn("own", F.lit(True))
    several = worded_pieces.filter(F.col("hashes").isNotNull())
    windows = several.select("body", "doc_id", "last", F.explode("hashes").alias("window"))
    repeated = (
        windows.groupBy("window")
        .agg(F.min(F.struct("doc_id", "body")).alias("first"), F.max("last").alias("_most"))
        .filter("first.doc_id < _most")
        .select("window", F.col("first.body").alias("_first"))
    )
    # written, so that the join is dealt anew and a window of very many pieces can be split
    repeated = written(repeated, "repeated-windows")
    own = (
        windows.select("window", "body")
        .join(repeated, "window")
        .groupBy("body")
        .agg(F.max(F.col("body") == F.col("_first")).alias("own"))
    )
    columns = ["anchor", "body", "doc_id", "words", "own"]
    return alone.select(columns).unionByName(several.join(own, "body").select(columns))


def matched(chosen: DataFrame, settings: Settings) -> DataFrame:
    """For pieces with a match, ``smallest``: the smallest document of each of their
    windows (null if the automaton has none). A piece has a row per automaton it met.

    Reference text is dealt to shards by anchor. A shard of much text is in parts, one of
    many pieces in blocks; every block meets every part, and has its automaton built
    where it is streamed, from text much smaller than the automaton.
    """
    n_words = F.size(F.split("words", " "))
    own_words = F.sum(F.when(F.col("own"), n_words).otherwise(0))
    total = chosen.agg(own_words).first()[0]
    shards = max(1, -(-(total or 0) // settings.shard_words))
    dealt = chosen.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    sizes = dealt.groupBy("shard").agg(
        F.greatest(F.lit(1), F.ceil(own_words / (2 * settings.shard_words))).cast("int").alias("parts"),
        F.ceil(F.count("*") / settings.block_pieces).cast("int").alias("blocks"),
    )

    def share(n: str) -> Column:
        return F.pmod(F.xxhash64("body"), F.col(n)).cast("int")

    def places(kind: int, part: Column, block: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), part.cast("int").alias("part"), block.cast("int").alias("block"))

    of_text = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: places(0, share("parts"), b))
    of_piece = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: places(1, p, share("blocks")))
    keys = ["shard", "part", "block"]
    rows = (
        dealt.join(sizes, "shard")
        .withColumn("place", F.explode(F.when(F.col("own"), F.concat(of_text, of_piece)).otherwise(of_piece)))
        .select("shard", "place.part", "place.block", "place.kind", "anchor", "body", "doc_id", "words")
        .repartition(*keys)
        .sortWithinPartitions(*keys, "kind")
    )

    def stream(batches):
        unit, automaton, matcher = None, None, None
        for batch in batches:
            units = list(zip(*[batch.column(i).to_pylist() for i in range(3)]))
            ids = batch.column(6).to_pylist()
            rows, smallest = [], []
            for i, kind in enumerate(batch.column(3).to_pylist()):
                if units[i] != unit:
                    unit, automaton, matcher = units[i], Automaton(), None
                words = batch.column(7)[i].as_py().encode().split()
                if kind == 0:
                    automaton.add(words, ids[i])
                    continue
                if matcher is None:
                    matcher = Matcher(automaton, settings.window)
                found = matcher.smallest(words)
                if any(m is not None for m in found):
                    rows.append(i)
                    smallest.append(found)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(4).take(at), batch.column(5).take(at), pa.array(smallest, arrow_ids)],
                names=["anchor", "body", "smallest"],
            )

    kind = chosen.schema["doc_id"].dataType
    arrow_ids = pa.list_(to_arrow_type(kind))
    schema = T.StructType().add("anchor", "long").add("body", "long").add("smallest", T.ArrayType(kind))
    return rows.mapInArrow(stream, schema)


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Settings = Settings(),
    texts: bool = False,
) -> DataFrame:
    """A row per document: id, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept
    words, joined by one blank). With ``texts`` there are ``kept``, and ``spans``, the
    removed ranges of words (start, end exclusive)."""
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    docs = docs.select(
        column(id_col).alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text")
    )
    shared = candidates(pieces(docs, settings))
    chosen = written(referenced(worded(docs, shared, settings)), "reference-pieces")
    found = matched(chosen, settings)
    hit = F.transform("smallest", lambda m: F.coalesce(m < F.col("doc_id"), F.lit(False)))
    hits = shared.join(found, ["anchor", "body"]).select(
        "doc_id", "digest", F.struct("anchor", "body", hit.alias("hit")).alias("mark")
    )
    marks = (
        hits.filter(F.exists("mark.hit", lambda h: h))
        .groupBy("doc_id", "digest")
        .agg(F.collect_set("mark").alias("marks"))
    )
    schema = T.StructType([docs.schema["doc_id"]])
    schema = schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    if texts:
        schema = schema.add("kept", "string").add("spans", T.ArrayType(T.ArrayType(T.LongType())))
    marked = docs.join(marks, ["doc_id", "digest"], "left").select("doc_id", "text", "marks")
    return marked.mapInArrow(_removed(settings, texts), schema).withColumnRenamed("doc_id", id_col)


def covered(codes: np.ndarray, marks: list[dict], powers: Powers, settings: Settings) -> np.ndarray:
    """Words that lie in a window marked by one of the document's pieces."""
    begins = np.zeros(len(codes), dtype=np.int64)
    places = found_at(cut(Hashes(codes, powers), settings))
    for mark in marks:
        for start, n in places[mark["anchor"], mark["body"]]:
            begins[start : start + n] |= mark["hit"]
    upto = np.cumsum(begins)
    return upto > np.append(np.zeros(settings.window, dtype=np.int64), upto)[: len(codes)]


def _removed(settings: Settings, texts: bool) -> Callable:
    def remove(batches):
        powers = Powers()
        for batch in batches:
            for first, split in split_texts(batch.column(1)):
                marks = batch.column(2).slice(first, len(split)).to_pylist()
                codes = iter(coded([w for w, m in zip(split, marks) if m]))
                sizes, removed, sums, kept_texts, spans = [], [], [], [], []
                for words, marked in zip(split, marks):
                    gone = np.zeros(len(words), dtype=bool)
                    if marked:
                        gone = covered(next(codes), marked, powers, settings)
                    stays = [w for w, g in zip(words, gone.tolist()) if not g] if marked else words
                    kept = b" ".join(stays)
                    sizes.append(len(words))
                    removed.append(len(words) - len(stays))
                    sums.append(sha256(kept).hexdigest())
                    if texts:
                        kept_texts.append(kept.decode())
                        edges = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
                        spans.append(np.flatnonzero(edges).reshape(-1, 2).tolist())
                ids = batch.column(0).slice(first, len(split))
                arrays = [ids, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums)]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if texts:
                    arrays += [pa.array(kept_texts), pa.array(spans, pa.list_(pa.list_(pa.int64())))]
                    names += ["kept", "spans"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return remove
