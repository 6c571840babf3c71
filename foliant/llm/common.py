"""Helpers shared by the operators: word rules, shared storage, stable column names."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import checkpoint_dir

#: Words are runs of characters other than these (fixed by the word rule `[^\x20\x09-\x0D]+`).
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Folder that new tables go to while a :func:`scratch` is open.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share."""
    base = _SCRATCH.get() or checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are stored inside the block go when it ends.

    The block gets a function that stores what must outlast it; only that may be read later.
    """
    path = shared_path(spark, name)
    outer = _SCRATCH.get()

    def keep(df: DataFrame) -> DataFrame:
        inner = _SCRATCH.set(outer)
        try:
            return stored(df, name)
        finally:
            _SCRATCH.reset(inner)

    opened = _SCRATCH.set(path)
    try:
        yield keep
    finally:
        _SCRATCH.reset(opened)
        system, inside = fs.FileSystem.from_uri(path)
        if system.get_file_info(inside).type != fs.FileType.NotFound:
            system.delete_dir(inside)


def stored(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read on from it.

    This cuts the lineage: a lost executor costs only the tasks it was running,
    and every reader sees the same rows.
    """
    path = shared_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(column: str | Column = "text") -> Column:
    """The text with null read as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for a text without words."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(
        F.split(bare, r"[\x20\x09-\x0D]+")
    )


def beside_extreme(
    df: DataFrame, key: str, value: str, name: str, largest: bool = False, salts: int = 64
) -> DataFrame:
    """Add to each row the smallest (or largest) ``value`` among the rows of its ``key``.

    A key may hold a third of all rows: the rows of a key are spread over ``salts`` parts
    by their value, parts are aggregated first, and the result joins back part by part, so
    no task gets a whole key. Rows with a null key are left out.
    """
    best = F.max if largest else F.min
    rows = df.where(F.col(key).isNotNull()).withColumn(
        "_salt", F.pmod(F.xxhash64(value), F.lit(salts))
    )
    parts = rows.groupBy(key, "_salt").agg(best(value).alias(name), F.count("*").alias("_n"))
    tops = parts.groupBy(key).agg(
        best(name).alias(name), F.sum("_n").alias(f"{name}_rows"), F.collect_list("_salt").alias("_salts")
    )
    tops = tops.select(
        F.col(key).alias("_key"), name, f"{name}_rows", F.explode("_salts").alias("_part")
    )
    return rows.join(
        tops, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_part"))
    ).drop("_key", "_part", "_salt")


def salted_lookup(
    rows: DataFrame, key: str, spread_by: str, facts: DataFrame, salts: int = 64
) -> DataFrame:
    """Join ``facts`` (one row per ``key``) to rows of which one key may hold a third.

    Keys are spread by ``spread_by``; a fact is repeated once per part in which its key stands.
    """
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    parts = rows.select(key, "_salt").distinct().join(facts, key)
    return rows.join(parts, [key, "_salt"]).drop("_salt")
