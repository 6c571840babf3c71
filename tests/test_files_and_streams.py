"""File ingest, table writes and streaming jobs in temporary folders."""

import hashlib
import zipfile

import numpy as np
from pyspark.sql import functions as F

from foliant.operators import changes, documents, embedding
from foliant.plans.jobs import onboard_cookbooks, unfinished_books
from foliant.sources import files, sinks
from foliant.streaming import changes as live_changes
from foliant.streaming import jobs
from foliant.streaming.live import library_counts
from tests.conftest import rows

CONTAINER = '<container xmlns="urn:c"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>'
PACKAGE = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/">
<metadata><dc:title> A Book </dc:title><dc:creator>Ann</dc:creator><dc:language>en</dc:language></metadata>
<manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>
<item id="a" href="t/a%201.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/></manifest>
<spine><itemref idref="b"/><itemref idref="zzz"/><itemref idref="a"/></spine></package>"""
NAV = """<html xmlns="http://www.w3.org/1999/xhtml"><body><nav><ol><li><a href="b.xhtml">One</a>
<ol><li><a href="b.xhtml#1">One <i>point</i> one</a></li></ol></li><li><span>no link</span></li></ol></nav></body></html>"""
FB2 = """<FictionBook xmlns="http://fb2"><description><title-info><author><first-name>Leo</first-name><last-name>T</last-name></author>
<book-title>War</book-title><lang>ru</lang></title-info></description>
<body><section><title><p>I</p></title><p>Text <b>bold</b> tail.</p><section><p>inner</p></section></section><section><p>two</p></section></body></FictionBook>"""


def _library(folder):
    (folder / "sub").mkdir(parents=True)
    (folder / ".hidden").mkdir()
    with zipfile.ZipFile(folder / "sub" / "a.epub", "w") as z:
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("OPS/p.opf", PACKAGE)
        z.writestr("OPS/nav.xhtml", NAV)
        z.writestr("OPS/t/a 1.xhtml", "<p>first</p>")
        z.writestr("OPS/b.xhtml", "<p>second</p>")
    (folder / "broken.epub").write_bytes(b"not a zip")
    (folder / "b.FB2").write_text(FB2)
    (folder / "notes.txt").write_text("x")
    (folder / ".hidden" / "c.pdf").write_text("x")


def test_scan_and_ingest(spark, tmp_path):
    folder = tmp_path / "books"
    _library(folder)
    found = files.scan_files(spark, str(folder))
    assert rows(found, "file_name", "format") == [("a.epub", "epub"), ("b.FB2", "fb2"), ("broken.epub", "epub")]
    raw = files.read_files(spark, str(folder))
    books = files.read_epubs(raw)
    assert rows(books, "title", "author", "language", "publisher") == [("A Book", "Ann", "en", None), (None, None, None, None)]
    assert rows(files.spine_items(books), "spine_index", "href", "html") == [
        (0, "b.xhtml", "<p>second</p>"), (1, "t/a%201.xhtml", "<p>first</p>")]
    toc = files.toc_entries(books)
    assert rows(toc, "seq", "level", "title") == [(0, 1, "One"), (1, 2, "One point one"), (2, 1, "Untitled")]
    assert rows(documents.toc_tree(toc), "seq", "parent_seq") == [(0, None), (1, 0), (2, None)]
    fb2 = files.read_fb2s(raw)
    assert rows(fb2, "title", "first_name", "last_name", "language") == [("War", "Leo", "T", "ru")]
    assert rows(files.fb2_sections(fb2)) [0][1:] == (0, "IText bold tail.inner")


def test_scan_leaves_contents_unread(spark, tmp_path):
    folder = tmp_path / "books"
    _library(folder)
    plan = files.scan_files(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "content#" not in plan.split("FileScan")[-1].split("]")[0]


def test_verify_manifest(spark, tmp_path):
    (tmp_path / "m" / "deep").mkdir(parents=True)
    for name in ("ok", "size", "sum"):
        (tmp_path / "m" / name).write_text("data")
    (tmp_path / "m" / "deep" / "ok").write_text("other")
    digest = hashlib.sha256(b"data").hexdigest()
    manifest = spark.createDataFrame(
        [("ok", digest.upper(), 4), ("size", None, 5), ("sum", "0" * 64, 4), ("gone", None, 4)],
        "file_name string, sha256 string, expected_bytes long",
    )
    manifest = manifest.union(spark.createDataFrame([("deep/ok", None, 5)], manifest.schema))
    got = files.verify_manifest(files.read_files(spark, str(tmp_path / "m")), manifest, str(tmp_path / "m"))
    want = [("deep/ok", "ready"), ("gone", "pending"), ("ok", "ready"), ("size", "error"), ("sum", "error")]
    assert rows(got) == want


def test_replace_books_in_table(spark, tmp_path):
    path = str(tmp_path / "t")
    table = spark.createDataFrame([(b, i, f"old{b}") for b in range(20) for i in range(3)], "book_id long, chunk_id long, text string")
    sinks.write_by_book(table, path, buckets=8, row_key="chunk_id")
    scope = spark.createDataFrame([(3,), (4,), (19,)], "book_id long")
    fresh = spark.createDataFrame([(3, 9, "new3"), (5, 9, "out of scope")], "book_id long, chunk_id long, text string")
    sinks.replace_in_table(spark, path, fresh, scope, buckets=8, row_key="chunk_id")
    want = [(b, i, f"old{b}") for b in range(20) for i in range(3) if b not in (3, 4, 19)] + [(3, 9, "new3")]
    assert rows(sinks.read_books(spark, path), "book_id", "chunk_id", "text") == sorted(want, key=repr)
    assert rows(sinks.read_books(spark, path, scope, buckets=8), "book_id", "text") == [(3, "new3")]
    # with every book gone, no folder keeps old rows
    everything = table.select("book_id").distinct()
    sinks.replace_in_table(spark, path, fresh.filter("book_id = 3"), everything, buckets=8)
    assert rows(sinks.read_books(spark, path), "book_id", "text") == [(3, "new3")]


def test_a_growing_table_splits_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")

    def part(first, n):
        return spark.range(first, first + n).selectExpr("id AS book_id", "id * 10 AS chunk_id", "repeat(hex(id), 40) AS text")

    def files():
        found = spark.read.parquet(path).select("bucket", F.input_file_name().alias("f")).distinct().collect()
        return {b: {r["f"] for r in found if r["bucket"] == b} for b in {r["bucket"] for r in found}}

    sinks.write_by_book(part(0, 40), path, buckets=2, row_key="chunk_id")
    size = sinks.table_bytes(spark, path) // 2
    assert sinks.grow_table(spark, path, size, buckets=2) == 3
    before = files()
    assert sinks.table_buckets(spark, path) == 3 and sorted(before) == [0, 1, 2]
    sinks.replace_in_table(spark, path, part(40, 4000), part(40, 4000), row_key="chunk_id")
    n = sinks.grow_table(spark, path, size * 8)
    assert n > 4 and sinks.table_buckets(spark, path) == n
    assert sorted(rows(sinks.read_books(spark, path), "book_id")) == [(i,) for i in range(4040)]
    # one book is one bucket's work, and the other buckets keep their files
    before = files()
    sinks.replace_in_table(spark, path, part(7, 1).withColumn("text", F.lit("new")), part(7, 1))
    after = files()
    assert sum(before[b] != after[b] for b in before) == 1
    assert rows(sinks.read_books(spark, path, part(7, 1)), "text") == [("new",)]
    # a step that stopped before its number was stored changes nothing, and can run again
    stray = part(0, 5).withColumn("bucket", F.lit(n))
    stray.write.mode("append").partitionBy("bucket").parquet(path)
    assert sinks.read_books(spark, path).count() == 4040
    assert sinks.grow_table(spark, path, size * 4) > n
    assert sorted(rows(sinks.read_books(spark, path), "book_id")) == [(i,) for i in range(4040)]


def test_cookbook_onboarding(spark, tmp_path):
    recipe = "Apple Tart\nIngredients:\n- 2 cups flour\nInstructions:\nPreheat, stir and bake for 20 minutes at 200 c"
    chunks = spark.createDataFrame(
        [(1, 1, 0, recipe, None), (2, 1, 1, "prose", [1.0] + [0.0] * 63), (3, 2, 0, recipe, None)],
        "chunk_id long, book_id long, chunk_index int, text string, embedding array<float>",
    )
    collections = spark.createDataFrame([(7, "cookbook"), (8, "default")], "collection_id int, collection_type string")
    membership = spark.createDataFrame([(1, 7), (2, 8)], "book_id long, collection_id int")
    chunk_table, hint_table = str(tmp_path / "c"), str(tmp_path / "h")
    sinks.write_by_book(chunks, chunk_table)
    old = spark.createDataFrame([(9, 0.9, "old", 1), (3, 0.5, "kept", 2)], "chunk_id long, score double, title string, book_id long")
    sinks.write_by_book(old, hint_table)
    onboard_cookbooks(spark, collections, membership, sinks.read_books(spark, chunk_table), chunk_table, hint_table)
    after = sinks.read_books(spark, chunk_table)
    assert rows(after.select("chunk_id", F.col("embedding").isNotNull())) == [(1, True), (2, True), (3, False)]
    assert after.filter("chunk_id = 2").first()["embedding"][0] == 1.0
    assert rows(sinks.read_books(spark, hint_table), "chunk_id", "title") == [(1, "Apple Tart"), (3, "kept")]
    assert rows(unfinished_books(chunks.select("book_id").distinct(), after)) == [(2,)]


def test_model_hook(spark):
    chunks = spark.createDataFrame([(i, "w " * i) for i in range(1, 70)], "chunk_id long, text string")

    def make_model():
        return lambda texts: np.array([[float(len(t)), 1.0] for t in texts], dtype="float32")

    got = embedding.model_vectors(chunks, make_model, 2)
    assert rows(got.select("chunk_id", F.col("embedding")[0].cast("int"))) == sorted(((i, 2 * i) for i in range(1, 70)), key=repr)


def test_folder_stream_adds_each_file_once(spark, tmp_path):
    folder, catalog, marks = tmp_path / "books", str(tmp_path / "cat"), str(tmp_path / "cp")
    _library(folder)
    jobs.ingest_folder(spark, str(folder), catalog, marks).awaitTermination(120)
    assert spark.read.parquet(catalog).count() == 3
    (folder / "d.pdf").write_text("pdf")
    jobs.ingest_folder(spark, str(folder), catalog, marks).awaitTermination(120)
    got = spark.read.parquet(catalog)
    assert rows(got, "file_name") == [("a.epub",), ("b.FB2",), ("broken.epub",), ("d.pdf",)]


def test_change_stream_keeps_last_state(spark, tmp_path):
    source, log, marks = str(tmp_path / "e"), str(tmp_path / "log"), str(tmp_path / "cp")
    schema = "event_id long, ts timestamp, path string, file_exists boolean"

    def send(*events):
        data = [(i, p, e) for i, p, e in events]
        df = spark.createDataFrame(data, "event_id long, path string, file_exists boolean")
        df.select("event_id", F.timestamp_seconds("event_id").alias("ts"), "path", "file_exists").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.apply_change_stream(stream, log, marks).awaitTermination(120)

    send((1, "/a.pdf", True), (2, "/b.epub", True), (3, "/a.pdf", False), (4, "/n.txt", True))
    assert rows(jobs.current_files(spark, log)) == [("/b.epub",)]
    send((5, "/a.pdf", True), (6, "/b.epub", False))
    assert rows(jobs.current_files(spark, log)) == [("/a.pdf",)]


def test_index_stream_with_progress(spark, tmp_path):
    source, out, marks = str(tmp_path / "d"), str(tmp_path / "o"), str(tmp_path / "cp")
    docs = spark.createDataFrame([(i, "word " * 1500) for i in range(4)], "book_id long, text string")
    seen, listener = [], jobs.RowsSeen()
    spark.streams.addListener(listener)
    for part in (docs.filter("book_id < 3"), docs.filter("book_id = 3")):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(docs.schema).parquet(source)
        jobs.index_documents(stream, out, marks, seen.append).awaitTermination(120)
    spark.streams.removeListener(listener)
    assert seen == [3, 1]
    assert spark.read.parquet(out).groupBy("book_id").count().filter("count = 2").count() == 4


def _run(spark, df, mode, tmp_path, name):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)
    return spark.table(name)


def test_streams_match_their_batch_forms(spark, tmp_path):
    rnd = [(i, f"u{i % 3}", 1000 + (i * 37) % 400 * 0.25, "ab"[(i // 5) % 2], f"/p{i % 7}") for i in range(300)]
    base = spark.createDataFrame(rnd, "event_id long, u string, s double, v string, path string")
    events = base.withColumn("ts", F.timestamp_micros((F.col("s") * 1000000).cast("long") + F.col("event_id"))).drop("s")
    source = str(tmp_path / "ev")
    events.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)

    got = _run(spark, live_changes.throttled(stream, "u", 3.0), "append", tmp_path, "throttled")
    assert rows(got, "event_id") == rows(changes.throttle(events, "u", 3.0), "event_id")
    got = _run(spark, live_changes.without_repeats(stream, "u", "v"), "append", tmp_path, "changed")
    assert rows(got, "event_id") == rows(changes.drop_repeats(events, "u", "v"), "event_id")
    got = _run(spark, live_changes.coalesced_changes(stream), "append", tmp_path, "coalesced")
    want = changes.coalesce_changes(events)
    assert rows(got.select("window.start", "path")) == rows(want)
    log = stream.select((F.col("event_id") % 7).alias("book_id"), "event_id", "ts", F.col("path").alias("position"))
    got = _run(spark, live_changes.latest_positions(log), "complete", tmp_path, "latest")
    flat = events.select((F.col("event_id") % 7).alias("book_id"), "event_id", "ts", F.col("path").alias("position"))
    assert rows(got, "book_id", "position") == rows(changes.latest_position(flat), "book_id", "position")
    got = _run(spark, live_changes.debounced(stream, "u", "v", "1 second"), "append", tmp_path, "quiet")
    batch = {(r["u"], r["ts"]) for r in changes.debounce_last(events, "u", 1.0).collect()}
    # bursts still open at the watermark are not out yet
    assert got.count() > 0 and {(r["u"], r["ts"]) for r in got.collect()} <= batch
    books = stream.select(F.col("u").alias("format"), F.col("v").alias("language"))
    got = _run(spark, library_counts(books), "complete", tmp_path, "counts")
    flat = events.select(F.col("u").alias("format"), F.col("v").alias("language"))
    assert rows(got) == rows(library_counts(flat))
