"""Streaming jobs: running statistics and the throttle rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyhouse.operators.history import user_stats


def running_user_stats(log: DataFrame) -> DataFrame:
    """Totals per user so far (update mode)."""
    return user_stats(log)


def windowed_user_stats(log: DataFrame, width: str, lateness: str | None = None) -> DataFrame:
    """Totals per user and tumbling window of the event time.

    With a lateness, rows later than the watermark are dropped, and so is the
    state of windows that can no longer change: for a live stream. A stored
    table's files are in no order of time; without a lateness every row counts.
    """
    timed = log.withColumn("created_at", F.col("created_at").cast("timestamp"))
    window = F.window("created_at", width)
    if lateness is not None:
        timed = timed.withWatermark("created_at", lateness)
    stats = user_stats(timed, by=[window.alias("window"), "user_id"])
    return stats.withColumn("window_start", F.col("window.start")).drop("window")


def throttle_stream(
    events: DataFrame,
    key: str,
    timestamp: str,
    id: str,
    max_events: int = 60,
    gap_seconds: int = 60,
    lateness: str | None = None,
) -> DataFrame:
    """Key, id and ``allowed`` for each event, in append mode.

    The state of a key is the count and the time of the last allowed event.
    Events of one micro-batch are taken in order of time and id; the intake of
    a micro-batch bounds their number. With ``lateness`` (a watermark) the
    state of a key is given up once the next event would start a new count
    anyway; without it every key keeps its two numbers.
    """
    gap = gap_seconds * 1_000_000
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    out = f"{key} {kinds[key]}, {id} {kinds[id]}, allowed boolean"
    expiring = lateness is not None

    def decide(
        group: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, last = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches)).sort_values(["_t", id])
        times = rows["_t"].to_numpy()
        # positions after a pause, and the end; each round takes one run of events
        breaks = np.append(np.flatnonzero(np.diff(times) > gap) + 1, len(times))
        allowed = np.zeros(len(times), dtype=bool)
        at = 0
        while at < len(times):
            if last is None or times[at] - last > gap:
                count = 0
            elif count >= max_events:
                at = int(np.searchsorted(times, last + gap, side="right"))
                continue
            pause = breaks[np.searchsorted(breaks, at, side="right")]
            end = int(min(at + max_events - count, pause))
            allowed[at:end] = True
            count, last, at = count + end - at, int(times[end - 1]), end
        state.update((count, last))
        if expiring:
            free_at = (last + gap) // 1000 + 1
            state.setTimeoutTimestamp(max(free_at, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: group[0], id: rows[id].to_numpy(), "allowed": allowed})

    timed = events.select(key, id, F.col(timestamp).cast("timestamp").alias("_time"))
    timeout = GroupStateTimeout.NoTimeout
    if expiring:
        timed = timed.withWatermark("_time", lateness)
        timeout = GroupStateTimeout.EventTimeTimeout
    return (
        timed.withColumn("_t", F.unix_micros("_time"))
        .groupBy(key)
        .applyInPandasWithState(decide, out, "count long, last long", "append", timeout)
    )
