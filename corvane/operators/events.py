"""Operational analytics on request events, in batch."""

from __future__ import annotations

import json
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType

from corvane.functions.plan import stored
from corvane.operators.ordering import numbered
from corvane.operators.speculate import fold_all


def micros(ts: str) -> Column:
    """Microseconds of a timestamp; one without a zone is in the session's."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def sliding_counts(events: DataFrame, seconds: int, ts: str = "ts", by: list[str] | None = None) -> DataFrame:
    """events with window_count: events of the group in the last `seconds`, both ends included."""
    w = Window.partitionBy(*(by or [])).orderBy(micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("window_count", F.count("*").over(w))


#: Blocks to a window's length; it divides a million, so that a block has whole microseconds.
BLOCKS = 64


def spikes(events: DataFrame, seconds: int, threshold: int, ts: str = "ts", by: list[str] | None = None) -> DataFrame:
    """sliding_counts with is_spike; every event counts, whatever became of it.

    Without a group the window is over all events. Time is cut into blocks of a
    64th of the window's length. A block begins with the number of events in the
    64 before it; each of its own adds one, and each of the 64th block before
    takes one away when it leaves the window. The counts are running sums, so
    work grows with the events and not with those in a window, and no task gets
    all events. Events without a time count each other, as in SQL.
    """
    if by:
        return sliding_counts(events, seconds, ts, by).withColumn("is_spike", F.col("window_count") >= threshold)
    span = seconds * 1_000_000
    length = span // BLOCKS
    src = events.withColumn("__t", micros(ts)).withColumn("__block", F.col("__t") - F.pmod("__t", F.lit(length)))
    timed = src.filter("__t is not null").select("__t", "__block")
    arriving = src.withColumn("__step", F.lit(1).cast("long")).withColumn("__own", F.lit(True))
    leaving = timed.select((F.col("__t") + span + 1).alias("__t"), (F.col("__block") + span).alias("__block"), F.lit(-1).cast("long").alias("__step"), F.lit(False).alias("__own"))
    before = _before(timed.groupBy("__block").agg(F.count("*").alias("__n")), span)
    begin = before.select(F.col("__block").alias("__t"), "__block", F.col("__n").alias("__step"), F.lit(False).alias("__own"))
    w = Window.partitionBy("__block").orderBy("__t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    steps = arriving.unionByName(leaving.unionByName(begin), allowMissingColumns=True)
    counted = steps.withColumn("window_count", F.sum("__step").over(w)).filter("__own").drop("__t", "__block", "__step", "__own")
    return counted.withColumn("is_spike", F.col("window_count") >= threshold)


def _before(counts: DataFrame, span: int) -> DataFrame:
    """(__block, __n) of each block: __n of all blocks that begin up to `span` before it, without its own; a task gets those of two spans."""
    window = F.col("__block") - F.pmod("__block", F.lit(span))
    both = counts.select("__block", "__n", F.lit(True).alias("__own"), window.alias("__window")).unionByName(counts.select("__block", "__n", F.lit(False).alias("__own"), (window + span).alias("__window")))
    w = Window.partitionBy("__window").orderBy("__block").rangeBetween(-span, -1)
    return both.withColumn("__n", F.coalesce(F.sum("__n").over(w), F.lit(0))).filter("__own").select("__block", "__n")


def alert_reasons(failed: Column, spike: Column, slow: Column) -> Column:
    """Sorted names of the alerts that hold."""
    named = F.array(F.when(failed, "failed_call"), F.when(slow, "slow_call"), F.when(spike, "traffic_spike"))
    return F.filter(named, lambda x: x.isNotNull())


def last_n(events: DataFrame, n: int, value: str, by: list[str], order: list[str]) -> DataFrame:
    """events with the mean and maximum of the last n values of the group, own included."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)
    return events.withColumn("last_mean", F.avg(value).over(w)).withColumn("last_max", F.max(value).over(w))


def _limit_fold(times: Column, most: int, span: int) -> Column:
    """Which of ascending times are accepted when at most `most` accepted ones may lie in a closed window."""

    def step(s: Column, t: Column) -> Column:
        live = F.filter(s["kept"], lambda k: k >= t - span)
        ok = F.size(live) < most
        return F.struct(F.when(ok, F.concat(live, F.array(t))).otherwise(live).alias("kept"), F.concat(s["out"], F.array(ok)).alias("out"))

    start = F.struct(F.array().cast("array<bigint>").alias("kept"), F.array().cast("array<boolean>").alias("out"))
    return F.aggregate(times, start, step, lambda s: s["out"])


def rate_limit(events: DataFrame, most: int, seconds: int, by: str, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """events with accepted and retry_after: a sliding limit per group in which rejected requests use up nothing.

    A recurrence over a group's events in time order. A group is handled in one
    pass with `most` accepted times as its only state, over rows that Spark
    sorts and may spill, so a group is never held in memory as a whole.
    """
    span = seconds * 1_000_000
    src = events.withColumn("__t", micros(ts))
    fields = src.schema.add("accepted", BooleanType()).add("retry_after", IntegerType())
    key, at = src.columns.index(by), src.columns.index("__t")

    def fold(it):
        group, kept = object(), []
        for pdf in it:
            ok, wait = [], []
            for g, t in zip(pdf.iloc[:, key], pdf.iloc[:, at]):
                if g != group:
                    group, kept = g, []
                while kept and kept[0] < t - span:
                    kept.pop(0)
                free = len(kept) < most
                ok.append(free)
                wait.append(None if free else max(1, int(seconds - (t - kept[0]) / 1_000_000)))
                if free:
                    kept.append(t)
            yield pdf.assign(accepted=ok, retry_after=pd.array(wait, "Int32"))

    dealt = src.repartition(by).sortWithinPartitions(by, "__t", order)
    return dealt.mapInPandas(fold, fields).drop("__t")


def sliding_fold(most: int, seconds: int, at: str = "__t"):
    """A fold (speculate.fold_all) of a sliding limit over all rows: the state is the accepted times in the window."""
    span = seconds * 1_000_000

    def fold(state: str, rows: pd.DataFrame) -> tuple[str, list[bool]]:
        kept, out = deque(json.loads(state)), []
        for t in rows[at].tolist():
            while kept and kept[0] < t - span:
                kept.popleft()
            out.append(len(kept) < most)
            if out[-1]:
                kept.append(t)
        last = rows[at].iloc[-1] if len(rows) else 0
        return json.dumps([k for k in kept if k >= last - span]), out

    return fold


def two_level_limit(events: DataFrame, most: int, seconds: int, global_most: int, by: str, ts: str = "ts", order: str = "event_id", parts: int | None = None, report: list | None = None) -> DataFrame:
    """(order, own_ok, accepted): rate_limit per group, then over all accepted by it; a request that the second level rejects has used its own quota.

    The second level is one recurrence over all requests. Its blocks are folded
    at once, each from an empty window, and again where the block before has left
    another one.
    """
    first = stored(rate_limit(events, most, seconds, by, ts, order).select(order, ts, F.col("accepted").alias("own_ok")), "first-level")
    passed = first.filter("own_ok").select(order, micros(ts).alias("__t"))
    second = fold_all(passed, ["__t", order], sliding_fold(global_most, seconds), "[]", "global_ok", "boolean", parts=parts, report=report)
    both = first.join(second.select(order, "global_ok"), order, "left")
    return both.select(order, F.col("own_ok"), F.coalesce("global_ok", F.lit(False)).alias("accepted"))


def calendar_budget(events: DataFrame, daily: int, monthly: int, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """events with accepted: at most `daily` per UTC day and `monthly` per month, and rejected ones don't count.

    The day's rank is exact because a day's rejects come after its last accepted
    one, and it is counted across ranges, so that no task gets a whole day; the
    month's rank is over those that the day lets through, `daily` for each of its
    days at most.
    """
    ranked = stored(numbered(events.withColumn("__date", F.to_date(ts)), ["__date"], [ts, order], "__day"), "days")
    month = Window.partitionBy(F.date_format(ts, "yyyy-MM")).orderBy(F.col(ts), F.col(order))
    through = ranked.filter(F.col("__day") <= daily).withColumn("accepted", F.row_number().over(month) <= monthly)
    late = ranked.filter(F.col("__day") > daily).withColumn("accepted", F.lit(False))
    return through.unionByName(late).drop("__day", "__date")


DEEP_LIMITS = ("daily", "monthly", "daily_deep", "monthly_deep")


def deep_fold(most: list[int], deep: str):
    """A fold of budgets: the state is a day, a month and what is used of each of DEEP_LIMITS."""

    def fold(state: str, rows: pd.DataFrame) -> tuple[str, list[bool]]:
        day, month, *used = state.split("|")
        used, out = list(map(int, used)), []
        for d, m, is_deep in zip(rows["__date"], rows["__month"], rows[deep]):
            if d != day:
                day, used[0], used[2] = d, 0, 0
            if m != month:
                month, used[1], used[3] = m, 0, 0
            counters = (0, 1, 2, 3) if is_deep else (0, 1)
            out.append(not any(most[k] > 0 and used[k] >= most[k] for k in counters))
            if out[-1]:
                for k in counters:
                    used[k] += 1
        return "|".join([day, month, *map(str, used)]), out

    return fold


def deep_budget(events: DataFrame, limits: dict[str, int], ts: str = "ts", order: str = "event_id", deep: str = "deep", parts: int | None = None, report: list | None = None) -> DataFrame:
    """events with accepted under daily, monthly, daily_deep and monthly_deep limits (0: none); deep requests count in both kinds.

    One recurrence over all requests, in blocks. A block is first folded as if
    all requests before it in its day and month had been let through as far as
    the limits go, which is right for limits that are used up or far away.
    """
    most = [limits.get(n, 0) for n in DEEP_LIMITS]
    src = events.withColumn("__date", F.date_format(ts, "yyyy-MM-dd")).withColumn("__month", F.date_format(ts, "yyyy-MM")).withColumn("__t", micros(ts))

    def guess(cut: DataFrame) -> DataFrame:
        first = cut.groupBy("__part").agg(F.min_by(F.struct("__date", "__month"), F.struct("__t", order)).alias("at")).select("__part", "at.*")
        sums = first
        for key, name in (("__date", "d"), ("__month", "m")):
            before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
            per = cut.groupBy("__part", key).agg(F.count("*").alias("all"), F.count(F.when(F.col(deep), 1)).alias("deep"))
            per = per.select("__part", key, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{name}_{c}") for c in ("all", "deep")))
            sums = sums.join(per, ["__part", key])
        used = [F.least(F.col(c), F.lit(n)) if n > 0 else F.col(c) for c, n in zip(("d_all", "m_all", "d_deep", "m_deep"), most)]
        return sums.select("__part", F.concat_ws("|", "__date", "__month", *(u.cast("string") for u in used)).alias("guess"))

    done = fold_all(src, ["__t", order], deep_fold(most, deep), "||0|0|0|0", "accepted", "boolean", guess, parts, report)
    return done.drop("__date", "__month", "__t")


def snapshot(events: DataFrame, status: str = "event_type", value: str = "value", error: Column | None = None) -> DataFrame:
    """One row: totals, errors and the last event's time."""
    failed = error if error is not None else F.col(status) == "error"
    return events.agg(F.count("*").alias("requests_total"), F.count(F.when(failed, 1)).alias("errors_total"), F.max("ts").alias("last_request_at"), F.round(F.max(value), 2).alias("max_latency"))


#: Size of a window's quantile sketch: ranks are off by 1.33 % of the rows at most, with a chance of 99 %.
SKETCH_K = 200


def window_summaries(events: DataFrame, seconds: int, ts: str = "ts", status: str = "event_type", value: str = "value", by: list[str] | None = None, k: int = SKETCH_K) -> DataFrame:
    """(window_start, ...by, status, n, errors, n_values, max_value, last_at, sketch): one row for each window, group and status, which can be merged to any range.

    The sketch is of the values that are not null; a window's row is of a bounded
    size however many events it has.
    """
    start = F.window(F.col(ts), f"{seconds} seconds")["start"].alias("window_start")
    grouped = events.groupBy(start, *(by or []), F.col(status).alias("status"))
    v = F.col(value).cast("double")
    return grouped.agg(
        F.count("*").alias("n"), F.count(F.when(F.col(status) == "error", 1)).alias("errors"), F.count(v).alias("n_values"), F.max(v).alias("max_value"),
        F.max(ts).alias("last_at"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"),
    )


def merged_snapshot(summaries: DataFrame, since: Column | None = None, until: Column | None = None, by: list[str] | None = None, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(...by, requests_total, errors_total, by_status map, latency_count, p50, p95, ..., max_latency, last_request_at) of all windows that begin in [since, until), from their summaries alone."""
    rows = summaries
    if since is not None:
        rows = rows.filter(F.col("window_start") >= since)
    if until is not None:
        rows = rows.filter(F.col("window_start") < until)
    per = rows.groupBy(*(by or []), "status").agg(
        F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.sum("n_values").alias("n_values"), F.max("max_value").alias("max_value"), F.max("last_at").alias("last_at"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )
    whole = per.groupBy(*(by or [])).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("requests_total"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors_total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("by_status"),
        F.coalesce(F.sum("n_values"), F.lit(0)).alias("latency_count"), F.max("max_value").alias("max_latency"), F.max("last_at").alias("last_request_at"), F.kll_merge_agg_double("sketch").alias("sketch"),
    )
    at = lambda p: F.when(F.col("latency_count") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p)))
    picks = [F.round(at(p), 2).alias(f"p{round(100 * p)}") for p in quantiles]
    return whole.select(*(by or []), "requests_total", "errors_total", "by_status", "latency_count", *picks, F.round("max_latency", 2).alias("max_latency"), "last_request_at")


def rank_error(events: DataFrame, snapshot_row: DataFrame, value: str = "value", quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(quantile, estimate, rank, error): the share of values at most the estimate, and how far the quantile lies outside of the estimate's ranks."""
    names = F.explode(F.array(*(F.struct(F.lit(p).alias("quantile"), F.col(f"p{round(100 * p)}").alias("estimate")) for p in quantiles))).alias("x")
    asked = F.broadcast(snapshot_row.select(names).select("x.*"))  # a row for each quantile
    v = F.round(F.col(value), 2)
    counted = events.filter(F.col(value).isNotNull()).select(v.alias("v")).crossJoin(asked).groupBy("quantile", "estimate").agg(F.avg((F.col("v") <= F.col("estimate")).cast("double")).alias("rank"), F.avg((F.col("v") < F.col("estimate")).cast("double")).alias("below"))
    return counted.select("quantile", "estimate", "rank", F.greatest(F.lit(0.0), F.col("below") - F.col("quantile"), F.col("quantile") - F.col("rank")).alias("error"))


def identity(user: Column, headers: list[Column], client: Column, session: Column, salt: str) -> Column:
    """Private identity of a request: the user, else the first proxy header's first entry or the client, else the session, else anonymous."""

    def filled(c: Column) -> Column:
        return F.nullif(F.trim(c), F.lit(""))

    def hashed(kind: str, c: Column) -> Column:
        return F.concat(F.lit(kind + ":"), F.substring(F.sha2(F.concat(F.lit(salt + ":"), c), 256), 1, 20))

    hosts = [filled(F.split(h, ",")[0]) for h in headers] + [filled(client)]
    return F.coalesce(hashed("user", filled(user)), hashed("ip", F.coalesce(*hosts)), hashed("session", filled(session)), F.lit("anonymous:unknown"))
