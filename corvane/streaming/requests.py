"""Request streams: limits, budgets, windows, and logs with Structured Streaming."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corvane.operators.events import alert_reasons

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read(spark, path: str, schema: str = EVENT_SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet event files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def keep_state_on_disk(spark: SparkSession) -> None:
    """Let stateful streams keep their state in RocksDB, which transformWithState needs; set it before a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Rows (event_id, t in microseconds) of a key wait until the watermark has passed them and are then taken in the order of time.

    So what a row gets depends neither on the batch in which it comes nor on how
    late it is, up to the watermark. One timer a key is set for the first row
    that waits, or else for when `leave` says that the key's state can go.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t bigint, event_id bigint")
        self.timer = handle.getValueState("timer", "ms bigint")

    def take(self, key: tuple, rows: list[tuple[int, int]]) -> list[bool]:
        """What becomes of rows (t, event_id), in order."""
        raise NotImplementedError

    def leave(self, key: tuple) -> int | None:
        """When the state of a key without waiting rows is of no more use, in milliseconds; None if there is none."""
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def _set(self, ms: int | None) -> None:
        if self.timer.exists():
            (old,) = self.timer.get()
            if old == ms:
                return
            self.handle.deleteTimer(old)
            self.timer.clear()
        if ms is not None:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        soonest = self.timer.get()[0] if self.timer.exists() else None
        for pdf in rows:  # as they come: a key's rows are never all in memory here
            here = [(int(t), int(i)) for t, i in zip(pdf["t"], pdf["event_id"])]
            self.waiting.appendList(here)
            first = min(here)[0] // 1000
            soonest = first if soonest is None else min(first, soonest)
        if soonest is not None:
            self._set(max(soonest, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"grp": pd.Series([], dtype=object), "event_id": [], "t": [], "accepted": []})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        rows = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in rows if r[0] // 1000 <= now]
        rest = rows[len(due) :]
        self.waiting.put(rest) if rest else self.waiting.clear()
        ok = self.take(key, due) if due else []
        if rest:
            self._set(rest[0][0] // 1000)
        else:
            end = self.leave(key)
            if end is not None and end <= now:
                self.forget()
            elif end is not None:
                self._set(end)
        yield pd.DataFrame({"grp": pd.Series([key[0]] * len(due), dtype=object), "event_id": [i for _, i in due], "t": [t for t, _ in due], "accepted": ok})

    def close(self) -> None:
        pass


class SlidingLimit(InOrder):
    """At most `most` accepted rows in a closed window; the state is their times."""

    def __init__(self, most: int, seconds: int):
        self.most, self.span = most, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getListState("kept", "t bigint")

    def take(self, key: tuple, rows: list[tuple[int, int]]) -> list[bool]:
        kept, ok = deque(t for (t,) in self.kept.get()), []
        for t, _ in rows:
            while kept and kept[0] < t - self.span:
                kept.popleft()
            ok.append(len(kept) < self.most)
            if ok[-1]:
                kept.append(t)
        self.kept.put([(t,) for t in kept]) if kept else self.kept.clear()
        return ok

    def leave(self, key: tuple) -> int | None:
        kept = [t for (t,) in self.kept.get()]
        return (kept[-1] + self.span) // 1000 + 1 if kept else None

    def forget(self) -> None:
        self.kept.clear()


class MonthBudget(InOrder):
    """At most `daily` rows a day and `monthly` in the key's month (UTC); the state is a day and two counters."""

    def __init__(self, daily: int, monthly: int):
        self.daily, self.monthly = daily, monthly

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.used = handle.getValueState("used", "day bigint, today bigint, total bigint")

    def take(self, key: tuple, rows: list[tuple[int, int]]) -> list[bool]:
        day, today, total = self.used.get() if self.used.exists() else (-1, 0, 0)
        ok = []
        for t, _ in rows:
            if t // 86_400_000_000 != day:
                day, today = t // 86_400_000_000, 0
            ok.append(today < self.daily and total < self.monthly)
            today, total = today + ok[-1], total + ok[-1]
        self.used.update((day, today, total))
        return ok

    def leave(self, key: tuple) -> int | None:
        if not self.used.exists():
            return None
        year, month = map(int, key[0].split("-"))
        following = datetime(year + month // 12, month % 12 + 1, 1, tzinfo=timezone.utc)
        return int(following.timestamp() * 1000)

    def forget(self) -> None:
        self.used.clear()


def _in_order(events: DataFrame, key: Column, ts: str, lateness: str, processor: InOrder, name: str) -> DataFrame:
    src = events.withWatermark(ts, lateness).filter(F.col(ts).isNotNull()).select(key.alias("grp"), "event_id", F.col(ts), F.unix_micros(F.col(ts)).alias("t"))
    kind = src.schema["grp"].dataType.simpleString()
    out = src.groupBy("grp").transformWithStateInPandas(processor, f"grp {kind}, event_id bigint, t bigint, accepted boolean", "Append", "EventTime")
    return out.select(F.col("grp").alias(name), "event_id", F.timestamp_micros("t").alias("ts"), "accepted")


def rate_limit(events: DataFrame, most: int, seconds: int, by: str = "user_id", ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """(group, event_id, ts, accepted) under a sliding limit per group, as events.rate_limit gives it for what is not later than the watermark.

    A row comes out when the watermark has passed it. The state is rows that wait
    and accepted times in the window; it goes when the watermark has passed that.
    """
    return _in_order(events, F.col(by), ts, lateness, SlidingLimit(most, seconds), by)


def calendar_budget(events: DataFrame, daily: int, monthly: int, ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """(month, event_id, ts, accepted) under budgets per UTC day and month, as events.calendar_budget gives it; a month's counters go when it has passed."""
    return _in_order(events, F.date_format(ts, "yyyy-MM"), ts, lateness, MonthBudget(daily, monthly), "month")


def window_counts(events: DataFrame, seconds: int, slide: int | None = None, lateness: str = "10 minutes", ts: str = "ts", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts, errors and latency per sliding or tumbling window of event time."""
    w = F.window(ts, f"{seconds} seconds", f"{slide or seconds} seconds")
    grouped = events.withWatermark(ts, lateness).groupBy(w, *by)
    out = grouped.agg(F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("max_value"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n", "errors", "mean_value", "max_value")


def alerts(events: DataFrame, slow: float) -> DataFrame:
    """Rows of the alert log that need no window: failed and slow calls."""
    reasons = alert_reasons(F.col("event_type") == "error", F.lit(False), F.col("value") >= slow)
    return events.withColumn("reasons", reasons).filter(F.size("reasons") > 0)


def distinct_events(events: DataFrame, lateness: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Each event_id once, within the watermark."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["event_id"])


def write_log(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append a stream to a JSON-lines log, exactly once per row."""
    w = rows.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
