"""Batch jobs that compose several operators and write tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import embedding, hybrid, mutations
from foliant.sources.sinks import replace_in_table


def onboard_cookbooks(
    spark: SparkSession,
    collections: DataFrame,
    membership: DataFrame,
    chunks: DataFrame,
    chunk_table: str,
    hint_table: str,
    embed: Callable[[DataFrame], DataFrame] = embedding.hashed_vectors,
) -> None:
    """Embed what is missing in the books of cookbook collections, then rebuild their hints.

    ``chunks`` is ``chunk_id, book_id, chunk_index, text, embedding``. Books whose chunks all
    have vectors keep them; the tables are replaced for the books in scope only.
    """
    cookbooks = collections.filter("collection_type = 'cookbook'").select("collection_id")
    scope = membership.join(cookbooks, "collection_id", "left_semi").select("book_id").distinct()
    scoped = chunks.join(scope, "book_id", "left_semi")
    ready = scoped.filter(F.col("embedding").isNotNull())
    todo = embedding.missing_vectors(scoped.drop("embedding"), ready)
    made = ready.unionByName(embed(todo).select(*ready.columns))
    # hints read the old chunk table, so they are written before it is replaced
    hints = hybrid.build_hints(scoped).join(scoped.select("chunk_id", "book_id"), "chunk_id")
    replace_in_table(spark, hint_table, hints, scope, row_key="chunk_id")
    replace_in_table(spark, chunk_table, made, scope, row_key="chunk_id")


def unfinished_books(books: DataFrame, chunks: DataFrame) -> DataFrame:
    """Books with chunks that still lack a vector."""
    return mutations.index_state(books, chunks).filter("status = 'retry'").select("book_id")
