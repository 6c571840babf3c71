"""Queries cover all of their input, against plain counts over the raw tables."""

import os

import pytest
from pyspark.sql import functions as F

from foliant.plans.registry import load_all
from foliant.plans.views import Library
from tests.conftest import rows

FOLDER = os.environ.get("FOLIANT_CHECK_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def test_reading_log_holds_every_event(spark):
    events = Library(spark, FOLDER).events
    decoded = load_all()["decode_positions"].run(spark, FOLDER)
    assert rows(decoded, "event_id") == rows(events, "event_id")
    last = events.groupBy((F.col("event_id") % 200).alias("book_id")).agg(F.unix_micros(F.max(F.col("ts").cast("timestamp"))).alias("t"))
    opened = load_all()["latest_position"].run(spark, FOLDER)
    assert rows(opened, "book_id", "last_opened") == rows(last)
