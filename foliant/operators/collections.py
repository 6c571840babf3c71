"""Collection groups, collections and their books."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant import constants as K


def books_in_collection(
    books: DataFrame, membership: DataFrame, collection_id: int
) -> DataFrame:
    ids = membership.filter(F.col("collection_id") == collection_id).select("book_id")
    return books.join(ids, "book_id").orderBy(F.col("title").asc_nulls_first(), "book_id")


def member_ids(membership: DataFrame, collection_id: int) -> DataFrame:
    """Book ids of a collection in the order they were added."""
    return (
        membership.filter(F.col("collection_id") == collection_id)
        .select("book_id", "date_added")
        .orderBy("date_added", "book_id")
    )


def list_collections(collections: DataFrame, groups: DataFrame) -> DataFrame:
    """Every collection with its group; ungrouped ones have no group name."""
    names = groups.select(
        "group_id",
        F.col("name").alias("group_name"),
        F.col("sort_order").alias("group_order"),
    )
    return (
        collections.join(names, "group_id", "left")
        .select(
            "collection_id", "name", "collection_type", "sort_order",
            "group_id", "group_name", "group_order",
            F.col("group_id").isNull().alias("is_ungrouped"),
        )
        .orderBy(F.col("group_order").asc_nulls_first(), "sort_order", "collection_id")
    )


def next_sort_order(collections: DataFrame) -> DataFrame:
    """The sort order a new collection would get, per group; NULL is the ungrouped list."""
    return collections.groupBy("group_id").agg(
        (F.coalesce(F.max("sort_order"), F.lit(-10)) + 10).alias("next_order")
    )


def next_group_order(groups: DataFrame) -> DataFrame:
    return groups.agg((F.coalesce(F.max("sort_order"), F.lit(-10)) + 10).alias("next_order"))


def corpus_stats(
    membership: DataFrame,
    collections: DataFrame,
    chunks: DataFrame,
    hints: DataFrame,
    text_rows: DataFrame,
) -> DataFrame:
    """Books, chunks, embedded chunks, hints and keyword rows per collection.

    All counts are reduced to one row per book before anything meets the membership
    table, so the joins move books and not chunks.
    """
    hinted = chunks.select("chunk_id", "book_id").join(
        hints.select("chunk_id"), "chunk_id", "left_semi"
    )
    counts = [
        chunks.groupBy("book_id").agg(
            F.count("*").alias("chunks"), F.count("embedding").alias("embedded_chunks")
        ),
        hinted.groupBy("book_id").agg(F.count("*").alias("hints")),
        text_rows.groupBy("book_id").agg(F.count("*").alias("text_rows")),
    ]
    rows = membership.select("collection_id", "book_id")
    for part in counts:
        rows = rows.join(part, "book_id", "left")
    measures = ["chunks", "embedded_chunks", "hints", "text_rows"]
    totals = rows.groupBy("collection_id").agg(
        F.count("*").alias("books"), *[F.sum(m).alias(m) for m in measures]
    )
    return collections.select("collection_id").join(totals, "collection_id", "left").na.fill(
        0, ["books", *measures]
    )


def corpus_status(stats: DataFrame) -> DataFrame:
    """Why a search over a collection may find nothing."""
    status = (
        F.when((F.col("chunks") == 0) & (F.col("text_rows") == 0), "not_indexed")
        .when(F.col("chunks") == 0, "no_chunks")
        .when(F.col("embedded_chunks") == 0, "no_vectors")
        .otherwise("no_match")
    )
    return stats.select("collection_id", status.alias("status"))


def first_ids_of_payloads(payloads: DataFrame) -> DataFrame:
    """Distinct valid ids of each drop, with where each was seen first.

    ``payloads`` is ``drop_id, item_index, payload``; a payload is one id or
    ``BOOKS:`` and a comma-separated list. Other tokens are ignored.
    """
    is_list = F.startswith("payload", F.lit(K.ID_LIST_PREFIX))
    listed = F.substr(F.col("payload"), F.lit(len(K.ID_LIST_PREFIX) + 1))
    tokens = F.when(is_list, F.split(listed, ",", -1)).otherwise(F.array("payload"))
    found = (
        payloads.select("drop_id", "item_index", F.posexplode(tokens).alias("token_index", "id"))
        .filter(F.rlike("id", F.lit(K.UUID_PATTERN)))
        .groupBy("drop_id", F.lower("id").alias("id"))
        .agg(F.min(F.struct("item_index", "token_index")).alias("_first"))
    )
    return found.select(
        "drop_id",
        "id",
        F.col("_first")["item_index"].alias("item_index"),
        F.col("_first")["token_index"].alias("token_index"),
    )


def encode_payloads(selected: DataFrame) -> DataFrame:
    """``drop_id, payload`` for a selection of ids (``drop_id, id``).

    One selected id is written alone, more as one sorted list.
    """
    ids = selected.select("drop_id", "id").distinct()
    csv = F.expr("listagg(id, ',') WITHIN GROUP (ORDER BY id)")
    packed = ids.groupBy("drop_id").agg(csv.alias("_csv"), F.count("*").alias("_n"))
    payload = F.when(F.col("_n") == 1, F.col("_csv")).otherwise(
        F.concat(F.lit(K.ID_LIST_PREFIX), "_csv")
    )
    return packed.select("drop_id", payload.alias("payload"))
