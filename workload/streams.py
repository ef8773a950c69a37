"""Throttle and streaming queries over the events."""

from __future__ import annotations


from tallyhouse.operators.throttle import throttle
from tallyhouse.streaming import jobs, tables
from workload.base import plain, query
from workload.understanding import HISTORY_SQL, as_history

MAX_EVENTS, GAP_HOURS = 3, 6

THROTTLE_SQL = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, ts,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    run AS (
      SELECT user_id, event_id, n, ts AS last, 1 AS cnt, true AS allowed FROM e WHERE n = 1
      UNION ALL
      SELECT e.user_id, e.event_id, e.n,
        CASE WHEN e.ts - run.last > INTERVAL {GAP_HOURS} HOURS OR run.cnt < {MAX_EVENTS} THEN e.ts ELSE run.last END,
        CASE WHEN e.ts - run.last > INTERVAL {GAP_HOURS} HOURS THEN 1
             WHEN run.cnt < {MAX_EVENTS} THEN run.cnt + 1 ELSE run.cnt END,
        e.ts - run.last > INTERVAL {GAP_HOURS} HOURS OR run.cnt < {MAX_EVENTS}
      FROM run JOIN e ON e.user_id = run.user_id AND e.n = run.n + 1)
    SELECT user_id, event_id, allowed FROM run"""


@query("throttle_flags", THROTTLE_SQL)
def throttle_flags(wh):
    events = wh.table("events").select("user_id", "event_id", "ts")
    flagged = throttle(events, "user_id", "ts", "event_id", MAX_EVENTS, GAP_HOURS * 3600)
    return flagged.select("user_id", "event_id", "allowed")


def event_stream(wh):
    return tables.stream_table(wh.spark, wh.root, "events.parquet", wh.table("events").schema)


@query("stream_throttle", THROTTLE_SQL)
def stream_throttle(wh):
    stream = jobs.throttle_stream(
        event_stream(wh), "user_id", "ts", "event_id", MAX_EVENTS, GAP_HOURS * 3600
    )
    written, _ = tables.drain(stream, "append", "throttle")
    return written.drop("batch_id")


STATS_SQL = """count(*) AS total_queries, count(*) FILTER (status = 'success') AS successful_queries,
    count(*) FILTER (status = 'error') AS failed_queries,
    CAST(sum(execution_time_ms::DECIMAL(18,2)) AS DOUBLE) / count(execution_time_ms) AS avg_execution_time_ms,
    CAST(sum(row_count) AS BIGINT) AS total_rows_returned"""


@query("stream_user_stats", f"WITH {HISTORY_SQL} SELECT user_id, {STATS_SQL} FROM log GROUP BY 1")
def stream_user_stats(wh):
    stream = jobs.running_user_stats(as_history(event_stream(wh)))
    written, _ = tables.drain(stream, "update", "user-stats")
    return tables.latest(written, ["user_id"])


@query(
    "stream_windowed_stats",
    f"""WITH {HISTORY_SQL} SELECT user_id, CAST(date_trunc('hour', created_at) AS VARCHAR) AS window_start, {STATS_SQL}
        FROM log GROUP BY 1, 2""",
)
def stream_windowed_stats(wh):
    stream = jobs.windowed_user_stats(as_history(event_stream(wh)), "1 hour")
    written, _ = tables.drain(stream, "update", "windowed-stats")
    return plain(tables.latest(written, ["user_id", "window_start"]))
