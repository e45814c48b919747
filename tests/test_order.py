"""Numbers, neighbours and recurrences over ranges against one pass over all rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.operators import events, ordering

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, deep boolean"


def stream(spark, seed, n, seconds):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=rng.randrange(seconds)), rng.randrange(6), rng.random() < 0.3) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA), sorted(rows, key=lambda r: (r[1], r[0]))


def test_numbers_and_neighbours(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None, "c"]), i * 7919 % 1000, rng.choice([None, "x", "y"])) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, at int, v string")
    w = Window.partitionBy("g").orderBy("at")
    want = df.select("*", F.row_number().over(w).alias("n"), F.lag("v").over(w).alias("before"), F.lead("v").over(w).alias("behind"))
    got = ordering.neighbours(ordering.numbered(df, ["g"], ["at"], "n", 7), ["g"], ["at"], "v", "before", "behind", 5)
    key = lambda r: str(tuple(r))
    assert sorted(got.select(want.columns).collect(), key=key) == sorted(want.collect(), key=key)
    assert ordering.numbered(df, [], ["at"], "n", 6).filter("n <> at + 1").count() == 0
    assert ordering.numbered(df.limit(0), ["g"], ["at"]).count() == 0


def sliding(rows, most, seconds):
    kept, out = [], {}
    for i, t, *_ in rows:
        kept = [k for k in kept if k >= t - timedelta(seconds=seconds)]
        out[i] = len(kept) < most
        if out[i]:
            kept.append(t)
    return out


@pytest.mark.parametrize(("most", "seconds", "total"), [(3, 600, 9), (50, 60, 1), (2, 5, 10_000), (50, 100_000, 40)])
def test_two_level_limit_is_the_recurrence(spark, most, seconds, total):
    df, rows = stream(spark, most, 900, 40_000)
    own = {}
    for u in range(6):
        own |= sliding([r for r in rows if r[2] == u], most, seconds)
    both = sliding([r for r in rows if own[r[0]]], total, seconds)
    report = []
    got = events.two_level_limit(df, most, seconds, total, "user_id", parts=9, report=report).collect()
    assert {r.event_id: (r.own_ok, r.accepted) for r in got} == {i: (ok, both.get(i, False)) for i, ok in own.items()}
    assert len(got) == 900 and report[0] > 1


def budget(rows, limits):
    used, day, month, out = [0, 0, 0, 0], None, None, {}
    for i, t, _, deep in rows:
        if t.date() != day:
            day, used[0], used[2] = t.date(), 0, 0
        if (t.year, t.month) != month:
            month, used[1], used[3] = (t.year, t.month), 0, 0
        mine = range(4) if deep else range(2)
        out[i] = all(not limits[k] or used[k] < limits[k] for k in mine)
        for k in mine if out[i] else ():
            used[k] += 1
    return out


@pytest.mark.parametrize("limits", [(10, 200, 3, 40), (0, 0, 0, 5), (7, 0, 0, 0), (0, 60, 0, 30), (1000, 1000, 1000, 1000)])
def test_deep_budget_is_the_recurrence(spark, limits):
    df, rows = stream(spark, 5, 1200, 86400 * 75)
    report = []
    got = events.deep_budget(df, dict(zip(events.DEEP_LIMITS, limits)), parts=8, report=report).collect()
    assert {r.event_id: r.accepted for r in got} == budget(rows, limits) and got[0].asDict().keys() == {"event_id", "ts", "user_id", "deep", "accepted"}
    if limits == (1000,) * 4:
        assert sum(report[1:]) <= 2  # guesses are right but where a day ends with a block


def test_calendar_budget_is_the_recurrence(spark):
    df, rows = stream(spark, 6, 800, 86400 * 50)
    got = {r.event_id: r.accepted for r in events.calendar_budget(df, 12, 150).collect()}
    assert got == budget(rows, (12, 150, 0, 0))


def test_limits_of_nothing(spark):
    df, _ = stream(spark, 1, 0, 10)
    assert events.two_level_limit(df, 1, 1, 1, "user_id").count() == events.deep_budget(df, {}).count() == events.calendar_budget(df, 1, 1).count() == 0
