"""Reading Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table as its files are cut; split sizes are a matter of the session's settings."""
    return spark.read.parquet(path)
