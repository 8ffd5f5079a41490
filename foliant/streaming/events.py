"""Streaming queries over events: windows with watermarks, progress, and a stateful rate limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; a stream or a table."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    own = events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return own.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    own = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return own.select("user_id", F.col("session_window.start").alias("session_start"), "n")


def progress_percent(index: Column, total: Column) -> Column:
    """Percent done while pages are read: from 30 to 80."""
    return (30 + (index / total * 50).cast("int")).cast("int")


def latest_progress(announced: DataFrame, task: str = "task") -> DataFrame:
    """Of each task the announcement that came last (ts, then event_id), with its percent; a stream or a table."""
    return announced.groupBy(task).agg(F.max_by("percent", F.struct("ts", "event_id")).alias("percent"), F.max("ts").alias("ts"))


def rate_limited(requests: DataFrame, key: str, limit: int = 6, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """A stream of (key, ts, event_id) with accepted. Each key's state is the times accepted within the window.

    Requests of a micro-batch are taken in time order; state goes when the watermark has passed the window.
    """

    def admit(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        accepted = []
        for t in rows["ts"].astype("int64") // (1000 if rows["ts"].dt.unit == "ns" else 1):
            held = [h for h in held if t - h <= seconds * 1_000_000]
            accepted.append(len(held) < limit)
            if accepted[-1]:
                held.append(int(t))
        state.update((held,))
        state.setTimeoutTimestamp(max(held[-1] // 1000 + seconds * 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({key: own[0], "event_id": rows["event_id"], "accepted": accepted})

    kind = requests.schema[key].dataType.simpleString()
    picked = requests.select(key, "ts", "event_id").withWatermark("ts", late)
    return picked.groupBy(key).applyInPandasWithState(admit, f"{key} {kind}, event_id long, accepted boolean", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)
