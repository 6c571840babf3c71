"""Batch forms of the event operators: coalesce, apply, debounce, throttle, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import file_format
from foliant.operators.ordering import greedy_groups, neighbor


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def _time_block(ts: Column, seconds: int) -> Column:
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000))


def coalesce_changes(events: DataFrame, window: str = "2 seconds") -> DataFrame:
    """Distinct paths that changed in each window (``window_start, path``)."""
    start = F.window("ts", window)["start"]
    return events.select(start.alias("window_start"), "path").distinct()


def last_state(events: DataFrame) -> DataFrame:
    """``path, file_exists`` after the last event of each supported path."""
    supported = events.filter(file_format(F.col("path")).isNotNull())
    return supported.groupBy("path").agg(
        F.max_by("file_exists", F.struct("ts", "event_id")).alias("file_exists")
    )


def apply_changes(books: DataFrame, events: DataFrame) -> DataFrame:
    """``path, action`` for the catalog: insert new files, delete vanished ones."""
    known = books.select(F.col("file_path").alias("path"), F.lit(True).alias("known"))
    action = F.when(F.col("file_exists") & F.col("known").isNull(), "insert").when(
        ~F.col("file_exists") & F.col("known").isNotNull(), "delete"
    )
    return (
        last_state(events)
        .join(known, "path", "left")
        .select("path", action.alias("action"))
        .filter(F.col("action").isNotNull())
    )


def debounce_last(
    events: DataFrame, key: str, gap_seconds: float, block_seconds: int = 3600
) -> DataFrame:
    """Events followed by a quiet gap of at least ``gap_seconds`` on their key.

    The last event of a burst is one whose next event comes at or after the gap (or never),
    so a burst needs no group of its own and a busy key is cut into time blocks.
    """
    placed = neighbor(
        events.withColumn("_micros", micros(F.col("ts"))),
        [key], ["_micros", "event_id"], "_micros", "_next",
        _time_block(F.col("ts"), block_seconds), ahead=True,
    )
    quiet = F.col("_next").isNull() | (
        F.col("_next") - F.col("_micros") >= F.lit(int(gap_seconds * 1_000_000))
    )
    return placed.filter(quiet).drop("_micros", "_next")


def drop_repeats(
    events: DataFrame, key: str, value: str, block_seconds: int = 3600
) -> DataFrame:
    """Events whose value differs from the previous one of their key."""
    placed = neighbor(
        events.withColumn("_micros", micros(F.col("ts"))).withColumn("_seen", F.struct(value)),
        [key], ["_micros", "event_id"], "_seen", "_last",
        _time_block(F.col("ts"), block_seconds),
    )
    same = F.col("_last").isNotNull() & F.col("_last")[value].eqNullSafe(F.col(value))
    return placed.filter(~same).drop("_micros", "_seen", "_last")


def throttle(
    events: DataFrame, key: str, interval_seconds: float, span: int = 8
) -> DataFrame:
    """Events reported when more than ``interval_seconds`` passed since the last report.

    Events of one key at the same instant count once (the first by id), as only that one
    can be reported.
    """
    stamped = events.withColumn("_micros", micros(F.col("ts")))
    instants = stamped.groupBy(key, "_micros").agg(F.min("event_id").alias("event_id"))
    marked = greedy_groups(
        instants, [key], "_micros", "_micros", "_micros",
        interval_seconds * 1_000_000, span, "_group", "_opens",
    )
    kept = marked.filter("_opens").select(key, "event_id")
    return events.join(kept, [key, "event_id"], "left_semi")


def latest_position(log: DataFrame) -> DataFrame:
    """Last reading position and time per book."""
    return log.groupBy("book_id").agg(
        F.max_by("position", F.struct("ts", "event_id")).alias("position"),
        F.max("ts").alias("last_opened"),
    )
