"""Book files: folder scans, checksums, ePub and FB2 ingest."""

from __future__ import annotations

import io
import posixpath
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import file_format

_NAME = r"([^/]+)$"


def plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, modificationTime, length, content`` of all files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return reader.load(folder).withColumn("path", plain_path(F.col("path")))


def listed_files(files: DataFrame) -> DataFrame:
    """Supported, visible files; works for batch and stream. File contents are not read."""
    name = F.regexp_extract("path", _NAME, 1)
    hidden = F.rlike("path", F.lit(r"/[._][^/]*(/|$)"))
    return files.select(
        "path",
        name.alias("file_name"),
        file_format(F.col("path")).alias("format"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("modified"),
    ).filter(F.col("format").isNotNull() & ~hidden)


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    return listed_files(read_files(spark, folder))


def verify_manifest(files: DataFrame, manifest: DataFrame, folder: str) -> DataFrame:
    """``file_name, status``: ready, error (size or checksum differs) or pending (missing).

    ``manifest`` is ``file_name, sha256, expected_bytes`` with names relative to ``folder``,
    so equal names in two folders below it stay apart; a NULL checksum is not compared.
    """
    found = files.select(
        F.substr(F.col("path"), F.lit(len(folder.rstrip("/")) + 2)).alias("file_name"),
        F.col("length").alias("_bytes"),
        F.sha2("content", 256).alias("_sha"),
    )
    wrong = (F.col("_bytes") != F.col("expected_bytes")) | (
        F.coalesce(F.lower("sha256"), "_sha") != F.col("_sha")
    )
    status = F.when(F.col("_sha").isNull(), "pending").when(wrong, "error").otherwise("ready")
    return manifest.join(found, "file_name", "left").select("file_name", status.alias("status"))


# --- one file to one record ------------------------------------------------------------------


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _all(root: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [e for e in root.iter() if isinstance(e.tag, str) and _local(e.tag) == name]


def _text(root: ElementTree.Element | None, name: str) -> str | None:
    """Trimmed text of the first element called ``name``; None if missing or blank."""
    found = _all(root, name) if root is not None else []
    return ("".join(found[0].itertext()).strip() or None) if found else None


def _child(element: ElementTree.Element, name: str) -> ElementTree.Element | None:
    return next((c for c in element if isinstance(c.tag, str) and _local(c.tag) == name), None)


def _outline(listed: ElementTree.Element, level: int, out: list[dict]) -> None:
    """Entries of a nested nav list, depth first."""
    for item in listed:
        if _local(item.tag) != "li":
            continue
        link, below = _child(item, "a"), _child(item, "ol")
        title = "".join(link.itertext()).strip() if link is not None else "Untitled"
        href = link.get("href", "") if link is not None else ""
        out.append({"seq": len(out), "level": level, "title": title, "href": href})
        if below is not None:
            _outline(below, level + 1, out)


def _nav_points(parent: ElementTree.Element, level: int, out: list[dict]) -> None:
    """Entries of a nested NCX map, depth first."""
    for point in parent:
        if _local(point.tag) != "navPoint":
            continue
        content = _child(point, "content")
        out.append(
            {
                "seq": len(out),
                "level": level,
                "title": _text(_child(point, "navLabel"), "text") or "Untitled",
                "href": content.get("src", "") if content is not None else "",
            }
        )
        _nav_points(point, level + 1, out)


EPUB_DDL = (
    "title string, author string, language string, publisher string, description string, "
    "spine array<struct<spine_index:int,href:string,html:string>>, "
    "toc array<struct<seq:int,level:int,title:string,href:string>>"
)
_EMPTY_EPUB = dict.fromkeys(["title", "author", "language", "publisher", "description"])


def _read_epub(data: bytes) -> dict:
    """Metadata, chapters in spine order and contents; an unreadable file gives no values."""
    record = {**_EMPTY_EPUB, "spine": [], "toc": []}
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
        container = ElementTree.fromstring(book.read("META-INF/container.xml"))
        package_path = _all(container, "rootfile")[0].get("full-path")
        package = ElementTree.fromstring(book.read(package_path))
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, TypeError):
        return record
    folder = posixpath.dirname(package_path)

    def member(href: str) -> bytes | None:
        path = posixpath.normpath(posixpath.join(folder, unquote(href)))
        return book.read(path) if path in names else None

    names = set(book.namelist())
    meta = next(iter(_all(package, "metadata")), None)
    record.update(
        title=_text(meta, "title"),
        author=_text(meta, "creator"),
        language=_text(meta, "language"),
        publisher=_text(meta, "publisher"),
        description=_text(meta, "description"),
    )
    items = {i.get("id"): i for i in _all(package, "item") if i.get("href") and i.get("media-type")}
    known = [items[r.get("idref")] for r in _all(package, "itemref") if r.get("idref") in items]
    for index, item in enumerate(known):
        html = member(item.get("href"))
        if html is not None:
            text = html.decode("utf-8", "replace")
            record["spine"].append({"spine_index": index, "href": item.get("href"), "html": text})
    nav = next((i for i in items.values() if "nav" in i.get("properties", "").split()), None)
    ncx = next((i for i in items.values() if i.get("media-type") == "application/x-dtbncx+xml"), None)
    try:
        if nav is not None and (data := member(nav.get("href"))):
            navs = _all(ElementTree.fromstring(data), "nav")
            typed = [n for n in navs if any(_local(k) == "type" and v == "toc" for k, v in n.attrib.items())]
            listed = _child((typed or navs)[0], "ol") if navs else None
            if listed is not None:
                _outline(listed, 1, record["toc"])
        if not record["toc"] and ncx is not None and (data := member(ncx.get("href"))):
            maps = _all(ElementTree.fromstring(data), "navMap")
            if maps:
                _nav_points(maps[0], 1, record["toc"])
    except ElementTree.ParseError:
        pass
    return record


FB2_DDL = (
    "title string, first_name string, middle_name string, last_name string, language string, "
    "description string, sections array<struct<section_index:int,text:string>>"
)


def _read_fb2(data: bytes) -> dict:
    """Metadata and the text of the top sections of each body."""
    record = dict.fromkeys(
        ["title", "first_name", "middle_name", "last_name", "language", "description"]
    )
    record["sections"] = []
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError:
        return record
    info = next(iter(_all(root, "title-info")), None)
    author = _child(info, "author") if info is not None else None
    record.update(
        title=_text(info, "book-title"),
        first_name=_text(author, "first-name"),
        middle_name=_text(author, "middle-name"),
        last_name=_text(author, "last-name"),
        language=_text(info, "lang"),
        description=_text(info, "annotation"),
    )
    for body in _all(root, "body"):
        for section in body:
            if _local(section.tag) == "section":
                record["sections"].append(
                    {"section_index": len(record["sections"]), "text": "".join(section.itertext())}
                )
    return record


def read_epubs(files: DataFrame) -> DataFrame:
    """``path`` with metadata, ``spine`` and ``toc`` of each ePub; one file per record."""

    @F.pandas_udf(EPUB_DDL)
    def read(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_read_epub(c) for c in contents])

    books = files.filter(file_format(F.col("path")) == "epub")
    return books.select("path", read("content").alias("_book")).select("path", "_book.*")


def read_fb2s(files: DataFrame) -> DataFrame:
    """``path`` with metadata and ``sections`` of each FB2 file."""

    @F.pandas_udf(FB2_DDL)
    def read(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_read_fb2(c) for c in contents])

    books = files.filter(file_format(F.col("path")) == "fb2")
    return books.select("path", read("content").alias("_book")).select("path", "_book.*")


def spine_items(epubs: DataFrame) -> DataFrame:
    return epubs.select("path", F.inline("spine"))


def toc_entries(epubs: DataFrame) -> DataFrame:
    return epubs.select(F.col("path").alias("doc_id"), F.inline("toc"))


def fb2_sections(fb2s: DataFrame) -> DataFrame:
    return fb2s.select("path", F.inline("sections"))
