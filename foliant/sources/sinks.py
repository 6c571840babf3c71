"""Writing tables that are read and replaced by book.

A table lies in folders by book bucket. The number of buckets is stored beside it and grows with
its bytes by linear hashing: one more bucket takes rows from exactly one other, so growing
rewrites what is split and nothing else, and replacing a book rewrites one bucket of bounded
size whatever the table's.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import durable

#: Buckets of a table that has never grown.
BUCKETS = 64
#: Mean size of a bucket that a table grows towards.
BUCKET_BYTES = 256 << 20

_LAYOUT = "step long, buckets int"


def _bucket(buckets: int) -> Column:
    """Bucket of a book among ``buckets``; the last ones are split off the first ones."""
    low = 1 << (buckets.bit_length() - 1)
    h = F.pmod(F.xxhash64("book_id"), F.lit(2 * low))
    return F.when(h < buckets, h).otherwise(F.pmod(h, F.lit(low))).cast("int")


def _layout(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """Last step and number of buckets of a table that has grown."""
    try:
        steps = spark.read.schema(_LAYOUT).parquet(f"{path}.layout").select("step", "buckets")
        rows = steps.orderBy(F.col("step").desc()).take(1)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    return tuple(rows[0]) if rows else None


def table_buckets(spark: SparkSession, path: str) -> int:
    found = _layout(spark, path)
    return found[1] if found else BUCKETS


def _rows(spark: SparkSession, path: str, buckets: int | None = None) -> DataFrame:
    """The table with ``bucket``; rows that growing has left behind in another bucket don't count."""
    df = spark.read.parquet(path)
    found = _layout(spark, path)
    if found is None and buckets is None:
        return df
    return df.filter(F.col("bucket") == _bucket(buckets or found[1]))


def table_bytes(spark: SparkSession, path: str) -> int:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.endswith("path", F.lit(".parquet"))).agg(F.sum("length")).first()[0] or 0


def grow_table(
    spark: SparkSession,
    path: str,
    bucket_bytes: int = BUCKET_BYTES,
    buckets: int | None = None,
    row_key: str | None = None,
) -> int:
    """Split buckets until they hold ``bucket_bytes`` on average; returns their number.

    Rows that move are copied to their new bucket, then the new number is stored, which is
    when they count there and no longer in the old one, then the old bucket is written
    without them. A run that stops in between is simply run again. ``buckets`` is the
    number of a table that was written with another than :data:`BUCKETS` and never grew.
    """
    step, n = _layout(spark, path) or (0, buckets or BUCKETS)
    wanted = -(-table_bytes(spark, path) // bucket_bytes)
    while n < wanted:
        # each bucket of the present level is split once at most
        low, following = 1 << (n.bit_length() - 1), min(wanted, 1 << n.bit_length())
        source = F.col("bucket").between(n - low, following - low - 1)
        moved = durable(_rows(spark, path, n).filter(source & (_bucket(following) >= n)).drop("bucket"))
        _put(spark, path, moved, following, range(n, following), row_key)
        step += 1
        line = spark.createDataFrame([(step, following)], _LAYOUT).coalesce(1)
        line.write.mode("overwrite").parquet(f"{path}.layout/at={step}")
        stayed = durable(_rows(spark, path, following).filter(source).drop("bucket"))
        _put(spark, path, stayed, following, range(n - low, following - low), row_key)
        n = following
    return n


def _put(
    spark: SparkSession, path: str, rows: DataFrame, buckets: int, places: Iterable[int], row_key: str | None
) -> None:
    """Make ``rows`` the whole content of the buckets ``places``."""
    write_by_book(rows, path, buckets, row_key=row_key)
    filled = {r["bucket"] for r in rows.select(_bucket(buckets).alias("bucket")).distinct().collect()}
    # buckets without rows are not part of the write; at most one entry per bucket
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for bucket in set(places) - filled:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}"), True)


def write_by_book(
    df: DataFrame, path: str, buckets: int | None = None, files_per_bucket: int = 4, row_key: str | None = None
) -> None:
    """Write ``df`` in folders by book bucket; only the folders present in ``df`` change.

    Rows of one bucket go to several tasks by ``row_key``, so a book that holds much of the
    table does not end up in one task or file.
    """
    buckets = buckets or table_buckets(df.sparkSession, path)
    salt = F.pmod(F.xxhash64(row_key or "book_id"), F.lit(files_per_bucket))
    placed = df.withColumn("bucket", _bucket(buckets))
    (
        placed.repartition(F.col("bucket"), salt)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )


def read_books(
    spark: SparkSession, path: str, scope: DataFrame | None = None, buckets: int | None = None
) -> DataFrame:
    """The table, or the rows of the books in ``scope`` with other bucket folders pruned."""
    df = _rows(spark, path, buckets)
    if scope is None:
        return df.drop("bucket")
    n = buckets or table_buckets(spark, path)
    ids = scope.select("book_id").distinct().withColumn("bucket", _bucket(n))
    return df.join(ids, ["bucket", "book_id"], "left_semi").drop("bucket")


def replace_in_table(
    spark: SparkSession,
    path: str,
    fresh: DataFrame,
    scope: DataFrame,
    buckets: int | None = None,
    row_key: str | None = None,
) -> None:
    """Delete-then-insert of the books in ``scope``; only their bucket folders are rewritten.

    The kept rows are made durable before their folders are replaced.
    """
    buckets = buckets or table_buckets(spark, path)
    ids = scope.select("book_id").distinct()
    touched = ids.select(_bucket(buckets).alias("bucket")).distinct()
    kept = (
        _rows(spark, path, buckets)
        .join(touched, "bucket", "left_semi")
        .drop("bucket")
        .join(ids, "book_id", "left_anti")
    )
    rows = durable(kept.unionByName(fresh.join(ids, "book_id", "left_semi").select(*kept.columns)))
    places = [r["bucket"] for r in touched.collect()]  # at most one entry per bucket
    _put(spark, path, rows, buckets, places, row_key)
