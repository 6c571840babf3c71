"""Streaming forms of the event operators.

All but the latest positions set a watermark; rows later than it are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE_LIFE_MS = 24 * 3600 * 1000


def coalesced_changes(
    events: DataFrame, window: str = "2 seconds", late: str = "10 seconds"
) -> DataFrame:
    """Distinct ``window, path`` of a stream of change events (``ts, path``)."""
    return (
        events.withWatermark("ts", late)
        .select(F.window("ts", window).alias("window"), "path")
        .dropDuplicates(["window", "path"])
    )


def debounced(
    events: DataFrame, key: str, value: str, gap: str = "300 milliseconds", late: str = "10 seconds"
) -> DataFrame:
    """The last value of each burst, once its key was quiet for ``gap``."""
    return (
        events.withWatermark("ts", late)
        .groupBy(key, F.session_window("ts", gap).alias("burst"))
        .agg(F.max_by(value, F.struct("ts", "event_id")).alias(value), F.max("ts").alias("ts"))
    )


def latest_positions(log: DataFrame) -> DataFrame:
    """Last position per book; run it in update mode."""
    return log.groupBy("book_id").agg(
        F.max_by("position", F.struct("ts", "event_id")).alias("position"),
        F.max("ts").alias("last_opened"),
    )


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(["ts", "event_id"])


def _expire(state: GroupState, last: pd.Timestamp) -> None:
    """Drop the state of a key a day after its last event, in event time."""
    seen = max(last.value // 1_000_000, state.getCurrentWatermarkMs())
    state.setTimeoutTimestamp(int(seen) + STATE_LIFE_MS)


def throttled(
    events: DataFrame, key: str, interval_seconds: float, late: str = "10 seconds"
) -> DataFrame:
    """Events reported at most once per interval and key (``event_id, key, ts``)."""
    step = pd.Timedelta(seconds=interval_seconds)

    def report(
        name: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        kept, seen = [], _in_order(batches)
        for row in seen.itertuples():
            if last is None or row.ts - last > step:
                kept.append((row.event_id, name[0], row.ts))
                last = row.ts
        state.update((last.value // 1000,))
        _expire(state, seen["ts"].iloc[-1])
        yield pd.DataFrame(kept, columns=["event_id", key, "ts"])

    return _stateful(events, key, report, "last_us bigint", ["event_id", key, "ts"], late)


def without_repeats(
    events: DataFrame, key: str, value: str, late: str = "10 seconds"
) -> DataFrame:
    """Events whose value differs from the previous one of their key."""

    def report(
        name: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        started, last = state.exists, state.get[0] if state.exists else None
        kept, seen = [], _in_order(batches)
        for row in seen.to_dict("records"):
            if not started or row[value] != last:
                kept.append((row["event_id"], name[0], row["ts"], row[value]))
            started, last = True, row[value]
        state.update((last,))
        _expire(state, seen["ts"].iloc[-1])
        yield pd.DataFrame(kept, columns=["event_id", key, "ts", value])

    kind = events.schema[value].dataType.simpleString()
    return _stateful(events, key, report, f"last {kind}", ["event_id", key, "ts", value], late)


def _stateful(
    events: DataFrame, key: str, report, state: str, columns: list[str], late: str
) -> DataFrame:
    out = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in columns)
    return events.withWatermark("ts", late).groupBy(key).applyInPandasWithState(
        report, out, state, "append", GroupStateTimeout.EventTimeTimeout
    )
