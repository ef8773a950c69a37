"""Per-key throttle over a table of events.

The rule: the first event of a key is allowed and counts 1. An event more than
``gap`` after the last allowed event is allowed and starts a new count. Else an
event is rejected when ``max_events`` are counted, and otherwise allowed and
counted.

An event that starts a count is called a start here. What follows a start is
settled by the events after it alone: the next ``max_events`` events pass unless a
pause longer than ``gap`` comes first, and the next start is the first event more
than ``gap`` after the last of them. After a pause longer than ``gap`` there is
always a start. So the events of a key can be looked at in blocks of so many rows,
however busy the key is:

1. Events are counted per key and time, ordered by range and numbered, which cuts
   them into blocks of ``block_rows`` rows. A block also sees the row before it and the
   ``max_events`` rows after it.
2. Each block is summarised as a function: for every start that may enter it (and every
   start after a pause in it) the time from which on the next start leaves the block.
3. Functions are composed over blocks: the first event after such a time is looked
   up in its own block, and chains are followed by pointer doubling, in as many rounds
   as the logarithm of the longest chain of blocks; keys that pause need none.
4. Each block marks the events that pass, from its known starts on.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.session import cut_lineage

BLOCK_ROWS = 200_000


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The blocks of a partition that is sorted by block, one by one."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        block = batch["block"].to_numpy()
        cuts = np.flatnonzero(np.diff(block)) + 1
        for part in np.split(np.arange(len(batch)), cuts):
            rows = batch.iloc[part]
            if rest and rest[0]["block"].iat[0] != rows["block"].iat[0]:
                yield pd.concat(rest, ignore_index=True)
                rest = []
            rest.append(rows)
    if rest:
        yield pd.concat(rest, ignore_index=True)


class _Block:
    """The rows of a block and its neighbours', on one axis of time.

    On the axis keys follow one another, and gaps of time are no longer than is
    needed to tell that they are pauses.
    """

    def __init__(self, rows: pd.DataFrame, max_events: int, gap: int, block_rows: int) -> None:
        self.t, self.n = rows["t"].to_numpy(), rows["n"].to_numpy()
        number, size = rows["number"].to_numpy(), len(rows)
        self.own = number // block_rows == rows["block"].to_numpy()
        key = rows["key"].to_numpy()
        same = np.append(False, key[1:] == key[:-1])
        apart = np.where(same, np.diff(self.t, prepend=self.t[0]), gap + 1)
        self.axis = np.cumsum(np.minimum(apart, gap + 1))
        #: Starts whatever came before; the row before a block is not looked at.
        self.natural = (apart > gap) & (self.own | (number == 0))
        breaks = np.append(np.flatnonzero(apart > gap), size)
        ends = breaks[np.searchsorted(breaks, np.arange(size), side="right")]
        total = np.cumsum(self.n)
        self.before = total - self.n
        # the last row that passes after a start at each row, and the next start
        last = np.searchsorted(total, self.before + max_events, side="left")
        full = last < ends
        self.last = np.minimum(last, ends - 1)
        following = np.searchsorted(self.axis, self.axis[self.last] + gap, side="right")
        within = full & (following < ends)
        inside = within & self.own[np.minimum(following, size - 1)]
        self.following = np.where(inside, following, -1)
        # after a pause there is a start anyway; where rows end, they may go on elsewhere
        self.leaves = full & ~inside & (within | (ends == size))
        self.after = self.t[self.last] + gap
        # a run from before the block ends within its first rows; a chain enters by the
        # first row after a time up to gap after such an end
        latest = self.axis[min(max_events, size - 1)] + gap
        entry = np.append(0, self.axis[:-1]) <= latest
        self.may_enter = self.own & entry & (np.cumsum(~same) == 1)

    def exits(self) -> tuple[np.ndarray, np.ndarray]:
        """For each row as a start, whether its chain leaves the block, and after when."""
        at = np.where(self.following >= 0, self.following, np.arange(len(self.t)))
        while True:
            further = at[at]
            if (further == at).all():
                return self.leaves[at], self.after[at]
            at = further


def _block_functions(max_events: int, gap: int, block_rows: int, firsts: list[tuple[str, int]]):
    """The functions that run over partitions sorted by block and number."""

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _blocks(batches):
            block = _Block(rows, max_events, gap, block_rows)
            leaves, after = block.exits()
            wanted = block.natural | (block.may_enter & leaves)
            found = rows.loc[wanted, ["key", "t"]]
            keys, times = found["key"].to_numpy(), after[wanted]
            in_block = [
                bisect_right(firsts, (k, x)) - 1 if leave else -1
                for k, x, leave in zip(keys, times.tolist(), leaves[wanted])
            ]
            yield found.assign(natural=block.natural[wanted], after=times, found_in=in_block)

    def enters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For times looked for in a block, the time of the first row after them."""
        for rows in _blocks(batches):
            asked = rows["number"].to_numpy() < 0
            if not asked.any():
                continue
            stored, sought = rows[~asked], rows[asked]
            codes, _ = pd.factorize(pd.concat([stored["key"], sought["key"]]))
            spans = {}
            code, t = codes[: len(stored)], stored["t"].to_numpy()
            borders = np.flatnonzero(np.diff(code)) + 1
            for part in np.split(np.arange(len(code)), borders):
                if len(part):
                    spans[code[part[0]]] = (part[0], part[-1] + 1)
            found = []
            for k, x in zip(codes[len(stored) :].tolist(), sought["t"].tolist()):
                start, end = spans.get(k, (0, 0))
                at = start + np.searchsorted(t[start:end], x, side="right")
                found.append(int(t[at]) if at < end else None)
            out = sought[["key"]].assign(after=sought["t"], leave=pd.array(found, dtype="Int64"))
            yield out[out["leave"].notna()]

    def passes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for both in _blocks(batches):
            starts = both.loc[both["start"], "number"].to_numpy()
            rows = both[~both["start"]]
            block = _Block(rows, max_events, gap, block_rows)
            at = np.searchsorted(rows["number"].to_numpy(), np.unique(starts))
            while len(at):
                sizes = block.last[at] - at + 1
                first = np.repeat(at, sizes)
                upto = first + np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                left = block.before[first] + max_events - block.before[upto]
                yield pd.DataFrame(
                    {
                        "key": rows["key"].to_numpy()[upto],
                        "t": block.t[upto],
                        "allowed": np.minimum(block.n[upto], left),
                    }
                )
                at = block.following[at]
                at = np.unique(at[at >= 0])

    return exits, enters, passes


def by_block(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    sorted_blocks = df.repartition("block").sortWithinPartitions("block", "number", "t")
    return sorted_blocks.mapInPandas(function, schema)


def _numbered(runs: DataFrame, block_rows: int) -> DataFrame:
    """``runs`` with a ``number`` by key and time, from 0 without gaps.

    Rows are dealt by range, numbered in their partition, and the partitions' sizes
    added up; so no task orders a key of its own.
    """
    spark = runs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // block_rows))
    ranged = runs.repartitionByRange(parts, "key", "t").sortWithinPartitions("key", "t")
    # the number of a row in its partition, below the number of the partition
    placed = cut_lineage(ranged.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sizes.select("_part", (F.sum("_size").over(before) - F.col("_size")).alias("_start"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(starts, part == F.col("_part"))
        .withColumn("number", F.col("_start") + inside)
        .drop("_place", "_part", "_start")
    )


def _reachable(links: DataFrame) -> DataFrame:
    """Times at which chains enter a block, by pointer doubling."""
    links = cut_lineage(links)
    entered = links.filter("natural AND leave IS NOT NULL").select("key", F.col("leave").alias("t")).distinct()
    entered = cut_lineage(entered)
    jumps = links.filter("leave IS NOT NULL").select("key", "t", "leave").distinct()
    while not entered.isEmpty():
        further = cut_lineage(
            entered.join(jumps, ["key", "t"])
            .select("key", F.col("leave").alias("t"))
            .join(entered, ["key", "t"], "left_anti")
            .distinct()
        )
        if further.isEmpty():
            break
        entered = cut_lineage(entered.unionByName(further))
        twice = jumps.select("key", F.col("t").alias("leave"), F.col("leave").alias("far"))
        jumps = cut_lineage(
            jumps.join(twice, ["key", "leave"]).select("key", "t", F.col("far").alias("leave"))
        )
    starts = links.filter("natural").select("key", "t")
    return starts.unionByName(entered)


def throttle(
    events: DataFrame,
    key: str,
    timestamp: str,
    id: str,
    max_events: int = 60,
    gap_seconds: int = 60,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The events with a column ``allowed``. Ids are unique; equal times go by id.

    Events without a key are those of one more key. Events without a time are rejected.
    No task holds more than about ``block_rows`` distinct times of a key at once.
    """
    gap = gap_seconds * 1_000_000
    block_rows = max(block_rows, max_events + 1)

    time = F.unix_micros(F.col(timestamp).cast("timestamp"))
    # a text that is never NULL, so that NULL is a key like others
    named = F.concat(F.when(F.col(key).isNull(), "-").otherwise("+"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    timed = events.withColumns({"_key": named, "_t": time})
    known = timed.filter("_t IS NOT NULL")
    runs = cut_lineage(known.groupBy(F.col("_key").alias("key"), F.col("_t").alias("t")).agg(F.count("*").alias("n")))
    rows = cut_lineage(_numbered(runs, block_rows))

    block, place = F.floor(F.col("number") / block_rows), F.col("number") % block_rows
    firsts = [tuple(r) for r in rows.filter(place == 0).select("key", "t").orderBy("number").collect()]
    exits, enters, passes = _block_functions(max_events, gap, block_rows, firsts)

    # a row belongs to its block, to the one it comes after, and to the one before
    # whose last starts it may still be allowed by
    blocks = F.array_compact(
        F.array(
            block,
            F.when((place < max_events) & (block > 0), block - 1),
            F.when(place == block_rows - 1, block + 1),
        )
    )
    in_blocks = rows.withColumn("block", F.explode(blocks)).select("key", "t", "n", "number", "block")

    def rows_at(times: DataFrame, start: Column) -> DataFrame:
        return times.select("key", "t", F.lit(0).cast("long").alias("n"), "number", "block", start.alias("start"))

    links = cut_lineage(
        by_block(in_blocks, exits, "key string, t long, natural boolean, after long, found_in long")
    )
    sought = links.filter("found_in >= 0").select(
        "key",
        F.col("after").alias("t"),
        F.lit(0).cast("long").alias("n"),
        F.lit(-1).cast("long").alias("number"),
        F.col("found_in").alias("block"),
    )
    entries = by_block(in_blocks.unionByName(sought.distinct()), enters, "key string, after long, leave long")
    chains = links.join(entries, ["key", "after"], "left").select(
        "key", "t", "natural", F.when(F.col("found_in") >= 0, F.col("leave")).alias("leave")
    )
    own_block = rows.withColumn("block", block)
    starts = rows_at(_reachable(chains).distinct().join(own_block, ["key", "t"]), F.lit(True))
    marked = in_blocks.withColumn("start", F.lit(False)).unionByName(starts)
    allowed = by_block(marked, passes, "key string, t long, allowed long")
    passed = cut_lineage(runs.join(allowed, ["key", "t"]))

    # where only some events of one time pass, they are those up to a cut-off id
    partial = passed.filter("allowed < n").select(
        F.col("key").alias("_key"), F.col("t").alias("_t"), "allowed"
    )
    by_id = Window.partitionBy("_key", "_t").orderBy(id)
    cuts = (
        timed.select("_key", "_t", id)
        .join(partial.select("_key", "_t"), ["_key", "_t"], "left_semi")
        .withColumn("_n", F.row_number().over(by_id))
        .filter(F.col("_n") <= max_events)
        .join(partial, ["_key", "_t"])
        .filter(F.col("_n") <= F.col("allowed"))
        .groupBy("_key", "_t")
        .agg(F.max(id).alias("_cut"))
    )
    verdicts = (
        passed.select(F.col("key").alias("_key"), F.col("t").alias("_t"), (F.col("allowed") >= F.col("n")).alias("_all"))
        .join(cuts, ["_key", "_t"], "left")
    )
    return timed.join(verdicts, ["_key", "_t"], "left").select(
        *events.columns,
        F.coalesce(F.col("_all") | (F.col(id) <= F.col("_cut")), F.lit(False)).alias("allowed"),
    )
