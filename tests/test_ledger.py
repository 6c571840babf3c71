"""Restartable jobs: catalog changes with cascade, embedding with retries."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import changes
from foliant.streaming import ledger as L
from tests.conftest import rows

EVENTS = "event_id long, ts timestamp_ntz, path string, file_exists boolean"


def made(spark, *events):
    import datetime as d

    start = d.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, start + d.timedelta(seconds=i), p, e) for i, p, e in events], EVENTS)


def test_inserts_deletes_and_cascade(spark, tmp_path):
    book = L.catalog_ledger(spark, str(tmp_path / "c"))
    L.apply_catalog_batch(book, made(spark, (1, "/a.pdf", True), (2, "/b.epub", True), (3, "/n.txt", True), (4, "/gone.pdf", False)), 0)
    first = {r["path"]: r["book_id"] for r in book.before().filter("is_there").collect()}
    assert sorted(first) == ["/a.pdf", "/b.epub"]
    chunks = spark.createDataFrame([(i, t) for i in first.values() for t in "xy"], "book_id long, text string")
    L.apply_catalog_batch(book, made(spark, (5, "/a.pdf", False), (6, "/b.epub", True)), 1)
    assert rows(L.live_rows(chunks, book), "book_id") == [(first["/b.epub"],)] * 2
    # a file that comes back is another book
    L.apply_catalog_batch(book, made(spark, (7, "/a.pdf", True)), 2)
    again = {r["path"]: r["book_id"] for r in book.before().filter("is_there").collect()}
    assert again["/b.epub"] == first["/b.epub"] and again["/a.pdf"] != first["/a.pdf"]
    assert L.live_rows(chunks, book).count() == 2


def test_batches_run_twice_and_snapshots(spark, tmp_path):
    """Any split into batches, with repeats and snapshots, ends where the batch form ends."""
    rng = random.Random(6)
    events = [(i, f"/{rng.choice('abcdef')}.pdf", rng.random() < 0.5) for i in range(60)]
    plain, seen = L.catalog_ledger(spark, str(tmp_path / "p"), 99), L.catalog_ledger(spark, str(tmp_path / "s"), 2)
    for n in range(5):
        part = made(spark, *events[n * 12 : n * 12 + 12])
        L.apply_catalog_batch(plain, part, n)
        for _ in range(2 if n in (1, 3) else 1):
            L.apply_catalog_batch(seen, part, n)
    assert rows(seen.before()) == rows(plain.before())
    assert rows(seen.before(3)) == rows(plain.before(3))
    there = {r["path"] for r in seen.before().filter("is_there").collect()}
    want = changes.last_state(made(spark, *events)).filter("file_exists")
    assert there == {r["path"] for r in want.collect()}


def test_change_stream(spark, tmp_path):
    source, marks = str(tmp_path / "e"), str(tmp_path / "m")
    book = L.catalog_ledger(spark, str(tmp_path / "c"), 2)
    for part in ([(1, "/a.pdf", True)], [(2, "/a.pdf", False), (3, "/b.pdf", True)], [(4, "/a.pdf", True)]):
        made(spark, *part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        L.apply_catalog_changes(stream, book, marks).awaitTermination(120)
    assert rows(book.before().filter("is_there"), "path") == [("/a.pdf",), ("/b.pdf",)]


@pytest.fixture
def library(spark):
    chunks = [(b * 10 + i, b, f"text {b} {i}") for b in range(5) for i in range(b)]
    return (
        spark.createDataFrame([(b,) for b in range(5)], "book_id long"),
        spark.createDataFrame(chunks, "chunk_id long, book_id long, text string"),
    )


def test_embedding_jobs_retry_what_failed(spark, library, tmp_path):
    books, chunks = library
    jobs, vectors = L.job_ledger(spark, str(tmp_path / "j"), 2), str(tmp_path / "v")

    def model(broken):
        bad = F.col("chunk_id").isin(*broken) if broken else F.lit(False)
        return lambda df: df.withColumn("embedding", F.when(~bad, F.array(F.col("chunk_id").cast("float"))))

    def run(batch, broken, times=1):
        for _ in range(times):
            L.embed_batch(jobs, vectors, books, chunks, model(broken), batch, most=3)

    run(0, [20], times=3)  # a batch that was killed twice is run again
    assert rows(jobs.before()) == [(0, "done", 0, 0, 1), (1, "done", 1, 1, 1), (2, "retry", 2, 1, 1)]
    assert rows(L.progress(jobs, books)) == [(2, 1, 5, 3, 2)]
    run(1, [41], times=2)
    run(2, [41])
    run(3, [41])
    assert rows(jobs.before().filter("book_id = 4")) == [(4, "retry", 4, 3, 3)]
    run(4, [])  # three tries were all
    assert rows(jobs.before().filter("book_id = 4")) == [(4, "retry", 4, 3, 3)]
    ids = [r[0] for r in rows(L.stored_vectors(spark, vectors), "chunk_id")]
    assert ids == sorted(set(ids)) == sorted({r["chunk_id"] for r in chunks.collect()} - {41})
    assert rows(L.open_books(jobs, books, 9, tries=4)) == [(4, 3)]
