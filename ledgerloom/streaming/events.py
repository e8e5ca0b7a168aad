"""Structured Streaming over events: bursts in sliding windows, sessions, and the fullest burst per user as custom state.

All three take an unbounded frame with event time `ts`; late events beyond the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def sliding_bursts(events: DataFrame, width: str = "48 hours", slide: str = "12 hours", least: int = 5, late: str = "1 day") -> DataFrame:
    """user_id, window_start, window_end, n, total of windows with at least `least` events."""
    g = event_time(events, late).groupBy("user_id", F.window("ts", width, slide)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.where(F.col("n") >= least).select("user_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n", "total")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    g = event_time(events, late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n", "total")


def fullest_of(times: list[int], span: int) -> tuple[int, int | None]:
    """The most of the sorted times that lie within `span`, and the first time of the first such stretch."""
    best, at, low = 0, None, 0
    for i, t in enumerate(times):
        while times[low] < t - span:
            low += 1
        if i - low + 1 > best:
            best, at = i - low + 1, times[low]
    return best, at


def fullest_burst(events: DataFrame, hours: int = 48, late: str = "1 day") -> DataFrame:
    """user_id, n, start: the fullest window of `hours` so far, whenever it grows.

    The state holds the times that a late event may still share a window with (those behind the watermark less `hours`),
    so an event counts in its own place however late it comes; once a user is quiet they go, and the best number stays.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    span = hours * 3_600_000_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times, best = state.get if state.exists else ([], 0)
        if state.hasTimedOut:
            state.update(([], best))
            return
        times = sorted([*times, *(x for b in batches for x in b["m"].tolist())])
        n, at = fullest_of(times, span)
        horizon = state.getCurrentWatermarkMs() * 1000 - span
        times = [t for t in times if t >= horizon]
        state.update((times, max(n, best)))
        if times:
            state.setTimeoutTimestamp(max((times[-1] + span) // 1000, state.getCurrentWatermarkMs()) + 1)
        if n > best:
            yield pd.DataFrame({"user_id": [key[0]], "n": [n], "start": [pd.Timestamp(at, unit="us")]})

    timed = event_time(events, late).select("user_id", "ts", F.unix_micros("ts").alias("m"))
    return timed.groupBy("user_id").applyInPandasWithState(run, "user_id long, n long, start timestamp", "times array<long>, best long", "update", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what its source holds now into a table in memory (for checks and small reports)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
