"""Named queries over the library views, each with its checking SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.plans.checks import CHECK_VIEWS
from foliant.plans.views import Library, for_duckdb

_DUCKDB_TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@dataclass(frozen=True)
class NamedQuery:
    name: str
    columns: list[tuple[str, str]]
    build: Callable[[Library], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Library(spark, folder))
        return df.select(*[F.col(c).cast(t).alias(c) for c, t in self.columns])

    def check_sql(self) -> str | None:
        if self.sql is None:
            return None
        casts = ", ".join(f"CAST({c} AS {_DUCKDB_TYPES[t]}) AS {c}" for c, t in self.columns)
        return for_duckdb(f"SELECT {casts} FROM ({self.sql.strip()}) result", CHECK_VIEWS)


REGISTRY: dict[str, NamedQuery] = {}


def query(columns: str, sql: str | None = None):
    """Register a function of a :class:`Library` under its own name."""
    typed = [(c.split()[0], c.split()[1]) for c in columns.split(",")]

    def add(build: Callable[[Library], DataFrame]) -> Callable[[Library], DataFrame]:
        name = build.__name__
        REGISTRY[name] = NamedQuery(name, typed, build, sql)
        return build

    return add


def load_all() -> dict[str, NamedQuery]:
    from foliant.plans import (  # noqa: F401
        catalog_queries,
        change_queries,
        search_queries,
        text_queries,
    )

    return REGISTRY
