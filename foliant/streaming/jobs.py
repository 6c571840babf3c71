"""Folder watching and incremental indexing as restartable stream jobs.

Every micro-batch writes its own ``batch=<id>`` folder with overwrite, so a batch that is
run again after a failure replaces its output and the tables hold every row once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from foliant.functions.text import file_format
from foliant.operators.chunking import chunk_chars
from foliant.operators.ordering import first_per_key
from foliant.sources.files import listed_files, plain_path

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of all batches written so far (none before the first)."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _write_batch(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def ingest_folder(
    spark: SparkSession, folder: str, catalog: str, checkpoint: str
) -> StreamingQuery:
    """Add new supported files below ``folder`` to the catalog table, each path once."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .withColumn("path", plain_path(F.col("path")))
    )
    listed = listed_files(files)
    schema = listed.schema

    def add(batch: DataFrame, number: int) -> None:
        # rows of this very batch may be there from an interrupted run
        known = _batches(spark, catalog, _with_batch(schema)).filter(F.col("batch") != number)
        fresh = first_per_key(batch, ["path"], ["modified"]).join(
            known.select("path"), "path", "left_anti"
        )
        _write_batch(fresh.select(*schema.names), catalog, number)

    return (
        listed.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch", T.LongType())])


def apply_change_stream(
    events: DataFrame, log: str, checkpoint: str
) -> StreamingQuery:
    """Append the last state of each supported path per batch; :func:`current_files` reads it."""

    def add(batch: DataFrame, number: int) -> None:
        supported = batch.filter(file_format(F.col("path")).isNotNull())
        last = supported.groupBy("path").agg(
            F.max_by(F.struct("file_exists", "ts", "event_id"), F.struct("ts", "event_id")).alias("_last")
        )
        _write_batch(last.select("path", "_last.*"), log, number)

    return (
        events.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_files(spark: SparkSession, log: str) -> DataFrame:
    """Paths that exist after all applied changes."""
    rows = spark.read.parquet(log)
    last = rows.groupBy("path").agg(F.max_by("file_exists", F.struct("ts", "event_id")).alias("there"))
    return last.filter("there").select("path")


def index_documents(
    docs: DataFrame, out: str, checkpoint: str, on_progress: Callable[[int], None] | None = None
) -> StreamingQuery:
    """Chunk newly arrived documents (``book_id, text``) into the chunk table."""
    spark = docs.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        chunks = chunk_chars(batch, "book_id")
        _write_batch(chunks, out, number)
        if on_progress is not None:
            written = spark.read.parquet(f"{out}/batch={number}")
            on_progress(written.select("book_id").distinct().count())

    return (
        docs.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class RowsSeen(StreamingQueryListener):
    """Counts the input rows of all finished micro-batches."""

    def __init__(self) -> None:
        self.rows = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
