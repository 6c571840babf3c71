"""Positions stored as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTENT_DDL = (
    "pdf struct<pageIndex:int>, epub struct<spineIndex:int,href:string>, "
    "fb2 struct<sectionIndex:int>, mobi struct<offsetFraction:double>, "
    "chm struct<fileIndex:int,fileName:string>"
)
READING_DDL = "type string, pageIndex int, spineIndex int, scrollFraction double"
ANNOTATION_DDL = (
    "pdf struct<pageIndex:int,bounds:array<double>>, "
    "reflowable struct<chapterIndex:int,startXPath:string,startOffset:bigint,"
    "endXPath:string,endOffset:bigint,selectedText:string>"
)


def annotation_position(json: Column) -> Column:
    return F.from_json(json, ANNOTATION_DDL)


def annotation_sort_key(json: Column) -> Column:
    """Page plus height on it, or chapter and offset; 0 when it cannot be read."""
    place = annotation_position(json)
    pdf, flow = place["pdf"], place["reflowable"]
    height = F.when(
        F.size(pdf["bounds"]) >= 4, F.lit(1.0) - F.get(pdf["bounds"], F.lit(1)) / F.lit(1000.0)
    ).otherwise(F.lit(0.0))
    key = F.coalesce(
        pdf["pageIndex"].cast("double") + height,
        flow["chapterIndex"].cast("double") * F.lit(1000000.0)
        + flow["startOffset"].cast("double"),
        F.lit(0.0),
    )
    return F.round(key, 6)


def position_label(json: Column) -> Column:
    place = annotation_position(json)
    page, chapter = place["pdf"]["pageIndex"], place["reflowable"]["chapterIndex"]
    return (
        F.when(page.isNotNull(), F.concat(F.lit("Page "), (page + 1).cast("string")))
        .when(chapter.isNotNull(), F.concat(F.lit("Chapter "), (chapter + 1).cast("string")))
        .otherwise("")
    )


def reading_position(json: Column) -> Column:
    """Decoded reading position; NULL when a required field is missing."""
    raw = F.from_json(json, READING_DDL)
    kind = F.when(raw["type"].isin("pdf", "epub", "fb2"), raw["type"]).otherwise("web")
    lacks = (
        raw["type"].isNull()
        | ((raw["type"] == "pdf") & raw["pageIndex"].isNull())
        | ((raw["type"] == "epub") & raw["spineIndex"].isNull())
    )
    return F.when(
        ~lacks,
        F.struct(
            kind.alias("type"),
            F.when(raw["type"] == "pdf", raw["pageIndex"]).alias("page_index"),
            F.when(raw["type"] == "epub", raw["spineIndex"]).alias("spine_index"),
            F.coalesce(raw["scrollFraction"], F.lit(0.0)).alias("scroll_fraction"),
        ),
    )


def content_position(fmt: Column, index: Column, total: Column, href: Column) -> Column:
    """JSON of the position of a chunk, by format."""
    place = F.struct(
        F.when(fmt == "pdf", F.struct(index.cast("int").alias("pageIndex"))).alias("pdf"),
        F.when(
            fmt == "epub", F.struct(index.cast("int").alias("spineIndex"), href.alias("href"))
        ).alias("epub"),
        F.when(fmt == "fb2", F.struct(index.cast("int").alias("sectionIndex"))).alias("fb2"),
        F.when(
            fmt.isin("mobi", "azw3"),
            F.struct(
                (index / F.greatest(total, F.lit(1))).cast("double").alias("offsetFraction")
            ),
        ).alias("mobi"),
        F.when(
            fmt == "chm", F.struct(index.cast("int").alias("fileIndex"), href.alias("fileName"))
        ).alias("chm"),
    )
    return F.to_json(place)
