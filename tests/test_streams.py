"""Stateful streams against batch: late rows, rows out of order, and a restart from the checkpoint."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane.operators import events
from corvane.streaming import requests

START = datetime(2024, 1, 30)


def write(spark, path, rows):
    full = [(i, START + timedelta(seconds=s), u, "view", 1.0, "{}") for i, s, u in rows]
    spark.createDataFrame(full, requests.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def run(spark, stream, tmp_path):
    query = stream.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(300)


def batches(seed, n, span, late):
    """Rows in files by time, each up to `late` seconds late, and a last row far behind that brings all others out."""
    rng = random.Random(seed)
    rows = [(i, rng.randrange(span), rng.randrange(3)) for i in range(n)]
    arrival = sorted(rows, key=lambda r: r[1] + rng.uniform(0, late))
    cut = [arrival[k : k + n // 4 + 1] for k in range(0, n, n // 4 + 1)]
    return rows, cut, [(n, span + 100 * 86_400, 9)]


@pytest.fixture(autouse=True)
def on_disk(spark):
    requests.keep_state_on_disk(spark)


def compare(spark, tmp_path, make, want, seed, span, late):
    rows, cut, last = batches(seed, 160, span, late)
    for k, part in enumerate([*cut, last]):
        write(spark, tmp_path / "in", part)
        if k in (1, 3, len(cut)):  # each run goes on from the checkpoint of the one before
            run(spark, make(requests.read(spark, str(tmp_path / "in"), files_per_trigger=1)), tmp_path)
    write(spark, tmp_path / "in", [(10_000, 0, 1), (10_001, span + 200 * 86_400, 9)])  # far too late: left out
    run(spark, make(requests.read(spark, str(tmp_path / "in"), files_per_trigger=1)), tmp_path)
    got = spark.read.parquet(str(tmp_path / "out")).filter("event_id < 160").collect()
    all_rows = spark.createDataFrame([(i, START + timedelta(seconds=s), u) for i, s, u in rows], "event_id bigint, ts timestamp, user_id bigint")
    assert {r.event_id: (r.ts, r.accepted) for r in got} == {r.event_id: (r.ts, r.accepted) for r in want(all_rows).collect()} and len(got) == 160
    assert spark.read.parquet(str(tmp_path / "out")).filter("event_id = 10000").count() == 0


def test_sliding_limit(spark, tmp_path):
    compare(spark, tmp_path, lambda e: requests.rate_limit(e, 2, 60), lambda e: events.rate_limit(e, 2, 60, "user_id").select("event_id", "ts", "accepted"), 3, 2000, 500)


def test_month_budget(spark, tmp_path):
    make = lambda e: requests.calendar_budget(e, 12, 30, lateness="20 hours")
    compare(spark, tmp_path, make, lambda e: events.calendar_budget(e, 12, 30).select("event_id", "ts", "accepted"), 4, 6 * 86_400, 60_000)


def test_empty_stream(spark, tmp_path):
    write(spark, tmp_path / "in", [])
    run(spark, requests.rate_limit(requests.read(spark, str(tmp_path / "in")), 2, 60), tmp_path)
    assert spark.read.schema("event_id bigint").parquet(str(tmp_path / "out")).agg(F.count("*")).first()[0] == 0
