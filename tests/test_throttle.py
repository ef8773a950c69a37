import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators.throttle import throttle
from tallyhouse.streaming import jobs, tables

START = dt.datetime(2024, 1, 1)
SCHEMA = "user_id string, event_id long, ts timestamp_ntz"


def expected(rows, max_events, gap):
    state, result = {}, {}
    for user, event, ts in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        count, last = state.get(user, (0, None))
        if last is None or (ts - last).total_seconds() > gap:
            state[user], allowed = (1, ts), True
        elif count >= max_events:
            allowed = False
        else:
            state[user], allowed = (count + 1, ts), True
        result[event] = allowed
    return result


def trace(seed, n, users, seconds):
    rng = random.Random(seed)
    return [
        (rng.choice(users), i, START + dt.timedelta(seconds=rng.randrange(seconds))) for i in range(n)
    ]


@pytest.mark.parametrize(
    "seed,n,users,seconds,max_events,gap",
    [
        (1, 400, ["a", "b"], 300, 3, 5),
        (2, 900, ["a"], 3000, 2, 4),
        (3, 600, ["a", "b", "c"], 60, 4, 1),
        (4, 1500, ["a"], 2500, 1, 3),
        (5, 3000, ["a", "b"], 2000, 1, 8),  # no pauses: chains cross all blocks
    ],
)
def test_same_as_one_by_one(spark, seed, n, users, seconds, max_events, gap):
    rows = trace(seed, n, users, seconds)
    for block_rows in (7, 200_000):
        events = spark.createDataFrame(rows, SCHEMA)
        flagged = throttle(events, "user_id", "ts", "event_id", max_events, gap, block_rows)
        got = {r.event_id: r.allowed for r in flagged.collect()}
        assert got == expected(rows, max_events, gap)


def test_a_key_with_most_events(spark, monkeypatch):
    """However dense the events of a key, no block has more rows than its own and its neighbours'."""
    from tallyhouse.operators import throttle as module

    rng = random.Random(3)
    rows = [
        ("hot" if rng.random() < 0.9 else rng.choice("abc"), i, START + dt.timedelta(milliseconds=rng.randrange(90_000)))
        for i in range(3000)
    ]
    sizes, by_block = [], module.by_block

    def measured(df, function, schema):
        sizes.extend(r["count"] for r in df.filter("number >= 0").groupBy("block").count().collect())
        return by_block(df, function, schema)

    monkeypatch.setattr(module, "by_block", measured)
    events = spark.createDataFrame(rows, SCHEMA)
    flagged = throttle(events, "user_id", "ts", "event_id", 5, 10, 50)
    assert {r.event_id: r.allowed for r in flagged.collect()} == expected(rows, 5, 10)
    # own rows, neighbours and starts
    assert max(sizes) <= 50 + 6 + 50 and len(sizes) > 100


def test_hand_timed_trace(spark):
    seconds = [0, 10, 20, 30, 80, 81, 142, 500]
    rows = [("a", i, START + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)]
    flagged = throttle(spark.createDataFrame(rows, SCHEMA), "user_id", "ts", "event_id", 3, 60)
    got = [r.allowed for r in flagged.orderBy("event_id").collect()]
    # the third event is the last allowed one; at 80 s it is exactly 60 s ago
    assert got == [True, True, True, False, False, True, True, True]


def test_many_events_at_one_time(spark):
    rows = [("a", i, START) for i in range(50)] + [("a", 99, START + dt.timedelta(seconds=61))]
    flagged = throttle(spark.createDataFrame(rows, SCHEMA), "user_id", "ts", "event_id", 7, 60)
    got = {r.event_id for r in flagged.filter("allowed").collect()}
    assert got == {0, 1, 2, 3, 4, 5, 6, 99}


def test_null_keys_are_a_key(spark):
    rows = [(u or None, i, t) for u, i, t in trace(11, 500, ["a", "", "b"], 600)]
    late = spark.createDataFrame([("a", 9000, None), (None, 9001, None)], SCHEMA)
    events = spark.createDataFrame(rows, SCHEMA)
    flagged = throttle(events.unionByName(late), "user_id", "ts", "event_id", 3, 5)
    got = {r.event_id: r.allowed for r in flagged.collect()}
    assert not got.pop(9000) and not got.pop(9001)
    assert got == expected([(u or "", i, t) for u, i, t in rows], 3, 5)
    numbers = events.withColumn("user_id", F.when(F.col("user_id") == "a", 2**60 + 1).when(F.col("user_id") == "b", 2**60))
    again = {r.event_id: r.allowed for r in throttle(numbers, "user_id", "ts", "event_id", 3, 5).collect()}
    assert again == got


@pytest.mark.parametrize("lateness", [None, "1 hour"])
def test_stream_in_several_batches(spark, tmp_path, lateness):
    rows = sorted(trace(7, 600, ["a", "b", ""], 900), key=lambda r: (r[2], r[1]))
    folder = str(tmp_path / "in")
    # equal times stay in one file, as a micro-batch is ordered within itself
    cut = START + dt.timedelta(seconds=450)
    for part in ([r for r in rows if r[2] < cut], [r for r in rows if r[2] >= cut]):
        part = [(u or None, i, t) for u, i, t in part]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    stream = tables.stream_table(spark, folder, "*.parquet", schema, files_per_trigger=1)
    flagged = jobs.throttle_stream(stream, "user_id", "ts", "event_id", 5, 20, lateness)
    written, _ = tables.drain(flagged, "append", "throttle-test")
    assert written.select("batch_id").distinct().count() >= 2
    got = {r.event_id: r.allowed for r in written.collect()}
    assert got == expected(rows, 5, 20)


def test_running_stats_over_batches(spark, tmp_path):
    folder = str(tmp_path / "log")
    schema = "id long, user_id string, status string, execution_time_ms double, row_count long, created_at timestamp"
    rows = [(i, "ab"[i % 2], "success" if i % 3 else "error", i / 4, i, START) for i in range(40)]
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = tables.stream_table(spark, folder, "*.parquet", spark.read.parquet(folder).schema, 1)
    written, _ = tables.drain(jobs.running_user_stats(stream), "update", "stats-test")
    got = {r.user_id: r.asDict() for r in tables.latest(written, ["user_id"]).collect()}
    from tallyhouse.operators.history import user_stats

    want = {r.user_id: r.asDict() for r in user_stats(spark.read.parquet(folder)).collect()}
    assert got == want
    assert got["a"]["total_queries"] == 20


def test_stats_of_nothing_are_zero(spark):
    from tallyhouse.operators.history import user_stats

    log = spark.createDataFrame(
        [("a", "success", None, None)], "user_id string, status string, execution_time_ms double, row_count long"
    )
    row = user_stats(log).first()
    assert (row.total_rows_returned, row.avg_execution_time_ms) == (0, 0.0)


def test_history_append_and_entry(spark, tmp_path):
    from tallyhouse.operators import history

    path = str(tmp_path / "history")
    rows = spark.createDataFrame([(1, "a", START)], "id long, user_id string, created_at timestamp_ntz")
    rows = rows.withColumn("result_preview", F.array(F.struct(F.lit(7).alias("k"))))
    history.append_history(rows, path)
    history.append_history(rows.withColumn("id", F.lit(2).cast("long")), path)
    log = spark.read.parquet(path)
    assert log.count() == 2
    assert history.entry(log, 2, "a", "array<struct<k:int>>").first().result_preview[0].k == 7
    assert history.entry(log, 2, "b", "array<struct<k:int>>").isEmpty()
    assert [r.id for r in history.user_page(log, "a", 1, 1).collect()] == [2]
    assert history.clamp_page(0, -1) == (50, 0) and history.clamp_page(101, 3) == (50, 3)
