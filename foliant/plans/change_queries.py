"""Batch forms of the event operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import changes
from foliant.plans.registry import query
from foliant.plans.views import Library

# event gaps in the tables are hours, so bursts are cut at six hours here
GAP_SECONDS = 6 * 3600
_GAP_MICROS = GAP_SECONDS * 1_000_000
_FORMAT_OK = "regexp_matches(lower(path), '\\.(pdf|epub|chm|mobi|azw3|fb2)$')"


@query(
    "window_start bigint, path string",
    "SELECT DISTINCT epoch_us(ts) // 2000000 * 2000000 AS window_start, path FROM file_event",
)
def coalesce_changes(lib: Library) -> DataFrame:
    rows = changes.coalesce_changes(lib.file_event)
    return rows.withColumn("window_start", changes.micros(F.col("window_start")))


@query(
    "path string, action string",
    f"""SELECT f.path, CASE WHEN f.present THEN 'insert' ELSE 'delete' END AS action FROM (
      SELECT path, last(file_exists ORDER BY ts, event_id) AS present FROM file_event WHERE {_FORMAT_OK} GROUP BY path) f
    LEFT JOIN book b ON b.file_path = f.path WHERE f.present = (b.book_id IS NULL)""",
)
def apply_changes(lib: Library) -> DataFrame:
    return changes.apply_changes(lib.book, lib.file_event)


@query(
    "event_id bigint, user_id bigint, event_type string",
    f"""SELECT event_id, user_id, event_type FROM (SELECT *, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events) e
    WHERE following IS NULL OR following - epoch_us(ts) >= {_GAP_MICROS}""",
)
def debounce_last(lib: Library) -> DataFrame:
    return changes.debounce_last(lib.events, "user_id", GAP_SECONDS)


@query(
    "event_id bigint, user_id bigint",
    f"""SELECT event_id, user_id FROM (
      WITH RECURSIVE src AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      walk AS (SELECT user_id, event_id, n, us AS reported, true AS emits FROM src WHERE n = 1
        UNION ALL SELECT s.user_id, s.event_id, s.n, CASE WHEN s.us - w.reported > {_GAP_MICROS} THEN s.us ELSE w.reported END, s.us - w.reported > {_GAP_MICROS}
        FROM walk w JOIN src s ON s.user_id = w.user_id AND s.n = w.n + 1)
      SELECT * FROM walk) r WHERE emits""",
)
def throttle(lib: Library) -> DataFrame:
    return changes.throttle(lib.events, "user_id", GAP_SECONDS, span=8)


@query(
    "event_id bigint, user_id bigint, event_type string",
    """SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) e
    WHERE previous IS NULL OR previous <> event_type""",
)
def drop_repeats(lib: Library) -> DataFrame:
    return changes.drop_repeats(lib.events, "user_id", "event_type")


@query(
    "book_id bigint, position string, last_opened bigint",
    "SELECT book_id, last(position ORDER BY ts, event_id) AS position, epoch_us(max(ts)) AS last_opened FROM reading_log GROUP BY book_id",
)
def latest_position(lib: Library) -> DataFrame:
    rows = changes.latest_position(lib.reading_log)
    return rows.withColumn("last_opened", changes.micros(F.col("last_opened")))


@query(
    "scope string, key string, n bigint",
    """SELECT 'format' AS scope, format AS key, count(*) AS n FROM book GROUP BY format
    UNION ALL SELECT 'language', language, count(*) FROM book GROUP BY language""",
)
def live_counts(lib: Library) -> DataFrame:
    from foliant.streaming.live import library_counts

    return library_counts(lib.book)
