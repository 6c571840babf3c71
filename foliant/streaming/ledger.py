"""Keyed state of restartable batch jobs: a log of batches and now and then a snapshot.

Batch ``n`` writes ``log/batch=n`` with overwrite, so a batch that is run again after a failure
replaces its own rows. The state before batch ``n`` is the last snapshot before it and the
few batches since; it depends on earlier batches only, so a repeated batch decides the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import file_format

SNAPSHOT_EVERY = 20


class Ledger:
    """Latest row per ``key``; ``schema`` lists key and values."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, every: int = SNAPSHOT_EVERY):
        self.spark, self.path, self.key, self.every = spark, path, key, every
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.names

    def _read(self, part: str) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def before(self, batch: int | None = None) -> DataFrame:
        """The state that batch ``batch`` starts from (None: after all batches)."""
        past = F.lit(True) if batch is None else F.col("batch") < batch
        taken = self._read("snapshot").filter(past)
        last = taken.agg(F.max("batch")).first()[0]
        recent = self._read("log").filter(past)
        if last is not None:
            # folders of older batches are pruned
            recent = taken.filter(F.col("batch") == last).unionByName(recent.filter(F.col("batch") > last))
        values = F.struct(*[c for c in self.columns if c != self.key])
        latest = recent.groupBy(self.key).agg(F.max_by(values, "batch").alias("_row"))
        return latest.select(self.key, "_row.*").select(*self.columns)

    def write(self, batch: int, rows: DataFrame) -> None:
        """Record the new rows of ``batch``, one per key, and a snapshot where one is due."""
        rows.select(*self.columns).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")
        if batch % self.every == self.every - 1:
            self.before(batch + 1).write.mode("overwrite").parquet(f"{self.path}/snapshot/batch={batch}")


# --- catalog changes --------------------------------------------------------------------

CATALOG = "path string, book_id long, is_there boolean"


def catalog_ledger(spark: SparkSession, path: str, every: int = SNAPSHOT_EVERY) -> Ledger:
    return Ledger(spark, path, "path", CATALOG, every)


def apply_catalog_batch(ledger: Ledger, events: DataFrame, batch: int) -> None:
    """Insert files that appeared and delete those that went (``path, file_exists, ts, event_id``).

    The last event of a path in the batch counts. A file that comes back is a new book with a
    new id, so nothing that belonged to the old one returns with it.
    """
    last = events.filter(file_format(F.col("path")).isNotNull()).groupBy("path").agg(
        F.max_by("file_exists", F.struct("ts", "event_id")).alias("_now")
    )
    known = ledger.before(batch)
    rows = last.join(known, "path", "left")
    there = F.coalesce("is_there", F.lit(False))
    new_id = F.xxhash64("path", F.lit(batch))
    changed = rows.filter(F.col("_now") != there).select(
        "path", F.when(F.col("_now"), new_id).otherwise(F.col("book_id")).alias("book_id"),
        F.col("_now").alias("is_there"),
    )
    ledger.write(batch, changed)


def apply_catalog_changes(events: DataFrame, ledger: Ledger, checkpoint: str):
    """The stream form of :func:`apply_catalog_batch`."""
    return (
        events.writeStream.foreachBatch(lambda df, number: apply_catalog_batch(ledger, df, number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def live_rows(table: DataFrame, ledger: Ledger) -> DataFrame:
    """Rows (``book_id``, others) of books that are in the catalog; the cascade of all deletes."""
    return table.join(ledger.before().filter("is_there").select("book_id"), "book_id", "left_semi")


# --- embedding jobs ---------------------------------------------------------------------

JOBS = "book_id long, status string, n_chunks long, n_embedded long, attempt int"


def job_ledger(spark: SparkSession, path: str, every: int = SNAPSHOT_EVERY) -> Ledger:
    return Ledger(spark, path, "book_id", JOBS, every)


def open_books(ledger: Ledger, books: DataFrame, batch: int, tries: int) -> DataFrame:
    """Books (``book_id, attempt``) without a job, or whose last one left chunks out."""
    known = ledger.before(batch).select("book_id", "status", "attempt")
    rows = books.select("book_id").distinct().join(known, "book_id", "left")
    attempt = F.coalesce("attempt", F.lit(0))
    return rows.filter((F.coalesce("status", F.lit("pending")) != "done") & (attempt < tries)).select(
        "book_id", attempt.alias("attempt")
    )


def embed_batch(
    ledger: Ledger,
    vectors: str,
    books: DataFrame,
    chunks: DataFrame,
    model: Callable[[DataFrame], DataFrame],
    batch: int,
    most: int,
    tries: int = 3,
    order: Column | None = None,
) -> None:
    """Embed the chunks of the next ``most`` open books and record how far each came.

    ``chunks`` is ``chunk_id, book_id, text``; ``model`` adds ``embedding``, null where it
    failed. Chunks that have a vector from an earlier batch aren't embedded again. A book is
    done when all its chunks have one, else it is tried again, ``tries`` times in all.
    """
    spark = books.sparkSession
    turn = open_books(ledger, books, batch, tries).orderBy(order if order is not None else "book_id").limit(most)
    mine = chunks.join(turn, "book_id")
    done = stored_vectors(spark, vectors, batch)
    todo = mine.join(done.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "book_id", "text")
    made = model(todo).filter(F.col("embedding").isNotNull())
    made.select("chunk_id", "book_id", "embedding").write.mode("overwrite").parquet(f"{vectors}/batch={batch}")
    have = stored_vectors(spark, vectors, batch + 1).groupBy("book_id").agg(F.count("*").alias("n_embedded"))
    total = mine.groupBy("book_id").agg(F.count("*").alias("n_chunks"))
    n, k = F.coalesce("n_chunks", F.lit(0)), F.coalesce("n_embedded", F.lit(0))
    rows = turn.join(total, "book_id", "left").join(have, "book_id", "left").select(
        "book_id", F.when(k >= n, "done").otherwise("retry").alias("status"),
        n.alias("n_chunks"), k.alias("n_embedded"), (F.col("attempt") + 1).alias("attempt"),
    )
    ledger.write(batch, rows)


def stored_vectors(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """Vectors that batches before ``batch`` (None: all) have written."""
    schema = "chunk_id long, book_id long, embedding array<float>, batch long"
    try:
        rows = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    return (rows if batch is None else rows.filter(F.col("batch") < batch)).drop("batch")


def progress(ledger: Ledger, books: DataFrame) -> DataFrame:
    """One row: ``n_done, n_retry, n_total`` books and ``n_chunks, n_embedded`` of those seen."""
    rows = books.select("book_id").distinct().join(ledger.before(), "book_id", "left")
    return rows.agg(
        F.count_if(F.col("status") == "done").alias("n_done"),
        F.count_if(F.col("status") == "retry").alias("n_retry"),
        F.count("*").alias("n_total"),
        F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"),
        F.coalesce(F.sum("n_embedded"), F.lit(0)).alias("n_embedded"),
    )
