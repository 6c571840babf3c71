"""Catalog changes as table-to-table transforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.catalog import in_folder
from foliant.operators.ordering import first_per_key


def cascade_delete(tables: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows that belong to deleted books.

    ``tables`` may hold ``books, membership, annotations, chunks, hints, text_rows`` and
    ``postings``; all but hints are keyed by ``book_id``, hints follow their chunk.
    """
    gone = deleted.select("book_id").distinct()
    kept = {
        name: table.join(gone, "book_id", "left_anti")
        for name, table in tables.items()
        if name != "hints"
    }
    if "hints" in tables:
        lost = tables["chunks"].join(gone, "book_id", "left_semi").select("chunk_id")
        kept["hints"] = tables["hints"].join(lost, "chunk_id", "left_anti")
    return kept


def delete_folder(tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    inside = tables["books"].filter(in_folder(F.col("file_path"), F.lit(folder)))
    return cascade_delete(tables, inside)


def delete_annotations(
    annotations: DataFrame, ids: DataFrame | None = None, books: DataFrame | None = None
) -> DataFrame:
    """Without single annotations, or without all annotations of some books."""
    if ids is not None:
        annotations = annotations.join(ids.select("annotation_id"), "annotation_id", "left_anti")
    if books is not None:
        annotations = annotations.join(books.select("book_id"), "book_id", "left_anti")
    return annotations


def delete_groups(
    groups: DataFrame, collections: DataFrame, deleted: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Groups without the deleted ones; their collections become ungrouped."""
    gone = deleted.select("group_id", F.lit(True).alias("_gone"))
    loose = collections.join(gone, "group_id", "left").withColumn(
        "group_id", F.when(F.col("_gone").isNull(), F.col("group_id"))
    )
    kept = groups.join(deleted.select("group_id"), "group_id", "left_anti")
    return kept, loose.select(*collections.columns)


def delete_collections(
    collections: DataFrame, membership: DataFrame, deleted: DataFrame
) -> tuple[DataFrame, DataFrame]:
    gone = deleted.select("collection_id")
    return (
        collections.join(gone, "collection_id", "left_anti"),
        membership.join(gone, "collection_id", "left_anti"),
    )


def apply_membership(
    membership: DataFrame, added: DataFrame, removed: DataFrame
) -> DataFrame:
    """Pairs after adding (known pairs ignored, first addition wins) and removing.

    ``membership`` and ``added`` are ``book_id, collection_id, date_added``.
    """
    pair = ["book_id", "collection_id"]
    fresh = (
        added.groupBy(*pair)
        .agg(F.min("date_added").alias("date_added"))
        .join(membership, pair, "left_anti")
    )
    rows = membership.select(*pair, "date_added").unionByName(fresh)
    return rows.join(removed.select(*pair), pair, "left_anti")


def apply_updates(
    base: DataFrame,
    updates: DataFrame,
    key: str,
    order: Sequence[str],
    columns: Sequence[str],
    flags: dict[str, str] | None = None,
) -> DataFrame:
    """Base rows with the latest update of each column.

    An update sets a column when its value isn't null, or when the boolean column named
    for it in ``flags`` is true; so a flagged null clears the value. Updates are reduced
    per key before the join; keys without a base row are ignored.
    """
    place, flags = F.struct(*order), flags or {}
    sets = {c: F.col(flags[c]) if c in flags else F.col(c).isNotNull() for c in columns}
    latest = updates.groupBy(key).agg(
        *[F.max_by(F.struct(c), F.when(sets[c], place)).alias(f"_{c}") for c in columns]
    )
    joined = base.join(latest, key, "left")
    return joined.select(
        *[
            F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.col(f"_{c}")[c]).alias(c)
            if c in columns
            else F.col(c)
            for c in base.columns
        ]
    )


def insert_missing(base: DataFrame, rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``base`` with the rows of unknown keys, the first by ``order`` for each key."""
    fresh = rows.join(base.select(key), key, "left_anti")
    return base.unionByName(first_per_key(fresh, [key], order))


def replace_books(
    table: DataFrame, fresh: DataFrame, scope: DataFrame
) -> DataFrame:
    """Re-index: rows of the books in ``scope`` are replaced by ``fresh`` ones."""
    ids = scope.select("book_id").distinct()
    kept = table.join(ids, "book_id", "left_anti")
    return kept.unionByName(fresh.join(ids, "book_id", "left_semi").select(*table.columns))


def index_state(books: DataFrame, chunks: DataFrame) -> DataFrame:
    """``book_id, status, n_chunks, n_embedded``; a book without text counts as done."""
    counts = chunks.groupBy("book_id").agg(
        F.count("*").alias("n_chunks"), F.count("embedding").alias("n_embedded")
    )
    n_chunks = F.coalesce("n_chunks", F.lit(0))
    n_embedded = F.coalesce("n_embedded", F.lit(0))
    return books.select("book_id").join(counts, "book_id", "left").select(
        "book_id",
        F.when(n_embedded < n_chunks, "retry").otherwise("done").alias("status"),
        n_chunks.alias("n_chunks"),
        n_embedded.alias("n_embedded"),
    )
