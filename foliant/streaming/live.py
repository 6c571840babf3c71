"""Queries that give their result anew when their tables change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def library_counts(books: DataFrame) -> DataFrame:
    """Books per format and per language; the same plan serves batch and stream."""
    scopes = F.array(
        F.struct(F.lit("format").alias("scope"), F.col("format").alias("key")),
        F.struct(F.lit("language").alias("scope"), F.col("language").alias("key")),
    )
    return books.select(F.inline(scopes)).groupBy("scope", "key").agg(F.count("*").alias("n"))
