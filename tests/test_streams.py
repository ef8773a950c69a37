"""Streams over stored tables: files and folders, files in any order of time."""

import os

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators.history import user_stats
from tallyhouse.operators.vectors import delete, upsert
from tallyhouse.sources.tables import Warehouse
from tallyhouse.streaming import jobs, tables
from workload.understanding import as_history

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The events as a folder of six files, the newest events in the oldest file."""
    root = tmp_path_factory.mktemp("stored")
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    events.repartitionByRange(6, F.desc("ts")).write.parquet(f"{root}/events.parquet")
    names = sorted(f for f in os.listdir(f"{root}/events.parquet") if f.endswith(".parquet"))
    for age, name in enumerate(names):
        os.utime(f"{root}/events.parquet/{name}", (1e9 + age, 1e9 + age))
    assert len(names) == 6
    return str(root)


def stream(spark, root, files=1):
    schema = spark.read.parquet(f"{root}/events.parquet").schema
    return tables.stream_table(spark, root, "events.parquet", schema, files)


def total(df):
    return df.agg(F.sum("total_queries")).first()[0]


@pytest.mark.parametrize("windowed", [False, True])
def test_folder_in_reverse_order(spark, folder, windowed):
    log = as_history(stream(spark, folder))
    job = jobs.windowed_user_stats(log, "1 hour") if windowed else jobs.running_user_stats(log)
    written, _ = tables.drain(job, "update", "stats")
    keys = ["user_id", "window_start"] if windowed else ["user_id"]
    got = tables.latest(written, keys)
    stored = user_stats(as_history(Warehouse(spark, folder, ["events"]).table("events")))
    assert total(got) == total(stored) == 1000


def test_empty_input(spark, tmp_path):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    os.mkdir(f"{tmp_path}/events.parquet")
    source = tables.stream_table(spark, str(tmp_path), "events.parquet", events.schema)
    written, _ = tables.drain(source, "append", "empty")
    assert written.count() == 0 and written.columns == [*events.columns, "batch_id"]


def test_vectors_keep_to_their_collection(spark):
    rows = spark.createDataFrame(
        [("a", "x", 1), ("a", "y", 1), ("b", "x", 1)], "id string, collection string, version int"
    )
    new = spark.createDataFrame([("a", "x", 2)], rows.schema)
    got = {tuple(r) for r in upsert(rows, new, "id", "version").collect()}
    assert got == {("a", "x", 2), ("a", "y", 1), ("b", "x", 1)}
    left = {tuple(r)[:2] for r in delete(rows, new, "id").collect()}
    assert left == {("a", "y"), ("b", "x")}
