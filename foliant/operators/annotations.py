"""Annotations and reading positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant import constants as K
from foliant.functions.positions import (
    annotation_position,
    annotation_sort_key,
    position_label,
    reading_position,
)
from foliant.operators.ordering import with_position


def by_book_and_tool(annotations: DataFrame, book_id: int, tool: str | None = None) -> DataFrame:
    rows = annotations.filter(F.col("book_id") == book_id)
    if tool is not None:
        rows = rows.filter(F.col("tool") == tool)
    return rows.orderBy("date_created", "annotation_id")


def classify(annotations: DataFrame, books: DataFrame) -> DataFrame:
    """Whether a tool marks text, and whether the book's format offers it."""
    formats = books.select("book_id", "format")
    is_text = F.col("tool").isin(K.TEXT_TOOLS)
    return annotations.join(formats, "book_id").select(
        "annotation_id", "tool", "format",
        is_text.alias("is_text"),
        ((F.col("format") == "pdf") | is_text).alias("is_allowed"),
    )


def sort_keys(annotations: DataFrame) -> DataFrame:
    return annotations.select(
        "annotation_id", "book_id", annotation_sort_key(F.col("position")).alias("sort_key")
    )


def labels(annotations: DataFrame) -> DataFrame:
    return annotations.select(
        "annotation_id", position_label(F.col("position")).alias("label")
    )


def sorted_in_book(annotations: DataFrame) -> DataFrame:
    """Place of each annotation in its book: position, then creation time, then id."""
    keyed = annotations.select(
        "annotation_id", "book_id", "date_created",
        annotation_sort_key(F.col("position")).alias("sort_key"),
    )
    order = [F.col("sort_key"), F.col("date_created"), F.col("annotation_id")]
    return with_position(keyed, order, "place", within=["book_id"]).select(
        "annotation_id", "book_id", "sort_key", "place"
    )


def decode_positions(log: DataFrame) -> DataFrame:
    place = reading_position(F.col("position"))
    return log.select("event_id", place.alias("_place")).select(
        "event_id",
        F.col("_place")["type"].alias("type"),
        F.col("_place")["page_index"].alias("page_index"),
        F.col("_place")["spine_index"].alias("spine_index"),
        F.col("_place")["scroll_fraction"].alias("scroll_fraction"),
    )


def split_by_page(selections: DataFrame) -> DataFrame:
    """One annotation row per page a text selection touches.

    ``selections`` is ``selection_id, book_id, first_page, last_page``.
    """
    pages = F.sequence("first_page", "last_page")
    rows = selections.filter(F.col("first_page") <= F.col("last_page")).select(
        "selection_id", "book_id", F.explode(pages).alias("page_index")
    )
    position = F.to_json(F.struct(F.struct("page_index").alias("pdf")))
    return rows.withColumn(
        "position", F.regexp_replace(position, "page_index", "pageIndex")
    )


def page_of(annotations: DataFrame) -> DataFrame:
    place = annotation_position(F.col("position"))
    return annotations.select("annotation_id", place["pdf"]["pageIndex"].alias("page_index"))
