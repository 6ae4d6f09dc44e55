"""Run-length and session operators over unbounded event streams. These have no twin in
batch annotation; they show the interval operators with event time and bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Event counts by tumbling window; rows later than ``late`` are dropped with their windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Islands of events that lie within ``gap`` of each other: the streaming form of merging."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"), F.max("value").alias("top"))


def label_runs(events: DataFrame, key: str, label: str, late: str = "2 hours") -> DataFrame:
    """Runs of equal labels per key in event order: key, label, n, closed by the next label or
    by the watermark. State is one open run a key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            held, n = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], label: [held], "n": [n]})
            return
        held, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for value in rows[label]:
            if n and value != held:
                out.append((k[0], held, n))
                n = 0
            held, n = value, n + 1
        state.update((held, n))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(rows["ts"].max().timestamp() * 1000)))
        yield pd.DataFrame(out, columns=[key, label, "n"])

    kinds = dict(events.dtypes)
    watched = events.select(key, label, "ts").withWatermark("ts", late)
    return watched.groupBy(key).applyInPandasWithState(
        step, f"{key} {kinds[key]}, {label} {kinds[label]}, n long", f"{label} {kinds[label]}, n long", "append", GroupStateTimeout.EventTimeTimeout
    )
