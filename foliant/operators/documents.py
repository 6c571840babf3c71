"""Structure of documents: parts, headings, links, tables of contents, find-in-book."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliant import constants as K
from foliant.functions.text import (
    body_content,
    html_to_text,
    is_relative,
    join_path,
    null_if_blank,
    rewrite_links,
    strip,
)
from foliant.operators.ordering import running_total

_LINK = r"(?i)(?:src|href)=[\"']([^\"'#][^\"']*?)[\"']"
_STYLE = r"(?i)<link[^>]+href=[\"']([^\"']+)[\"'][^>]*>"


def assemble(parts: DataFrame) -> DataFrame:
    """Texts of a book in reading order, a newline after each part.

    ``parts`` is ``book_id, part_index, text``; a book gives one row whatever its length.
    """
    joined = F.expr("listagg(text || '\n', '') WITHIN GROUP (ORDER BY part_index)")
    return parts.groupBy("book_id").agg(joined.alias("text"), F.count("*").alias("n_parts"))


def page_metadata(pages: DataFrame) -> DataFrame:
    """Title, language, description, author, publisher and isbn of HTML pages; blank becomes NULL."""

    def meta(name: str):
        pattern = rf"(?is)<meta[^>]+name=[\"']{name}[\"'][^>]+content=[\"']([^\"']*)[\"']"
        return null_if_blank(F.regexp_extract("html", pattern, 1))

    return pages.select(
        "page_id",
        null_if_blank(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        null_if_blank(F.regexp_extract("html", r"(?is)<html[^>]*\slang=[\"']([^\"']*)[\"']", 1)).alias("language"),
        meta("description").alias("description"),
        meta("author").alias("author"),
        meta("publisher").alias("publisher"),
        meta("isbn").alias("isbn"),
    )


def heading_outline(pages: DataFrame) -> DataFrame:
    """Headings of the highest level a page has (h1, else h2, else h3)."""

    def titles(level: int):
        found = F.regexp_extract_all("html", F.lit(rf"(?is)<h{level}[^>]*>(.*?)</h{level}>"), 1)
        clean = F.transform(found, lambda t: strip(F.regexp_replace(t, r"<[^>]+>", "")))
        return F.filter(clean, lambda t: t != "")

    h1, h2, h3 = titles(1), titles(2), titles(3)
    best = (
        F.when(F.size(h1) > 0, F.struct(F.lit(1).alias("level"), h1.alias("titles")))
        .when(F.size(h2) > 0, F.struct(F.lit(2).alias("level"), h2.alias("titles")))
        .otherwise(F.struct(F.lit(3).alias("level"), h3.alias("titles")))
    )
    rows = pages.select("page_id", best.alias("_best"))
    return rows.select(
        "page_id",
        F.col("_best")["level"].alias("level"),
        F.posexplode(F.col("_best")["titles"]).alias("seq", "title"),
    ).withColumn("anchor", F.concat(F.lit("ch_"), F.col("seq").cast("string")))


def nav_links(pages: DataFrame) -> DataFrame:
    """Links of the first ``nav`` block of each page, in order, as a level-1 outline."""
    nav = F.regexp_extract("html", r"(?is)<nav[^>]*>(.*?)</nav>", 1)
    links = F.regexp_extract_all(nav, F.lit(r"(?is)(<a\s[^>]*>.*?</a>)"), 1)
    rows = pages.select("page_id", F.posexplode(links).alias("seq", "_link"))
    title = strip(F.regexp_replace("_link", r"<[^>]+>", ""))
    return rows.select(
        "page_id", "seq",
        F.when(title == "", "Untitled").otherwise(title).alias("title"),
        F.regexp_extract("_link", r"(?i)href=[\"']([^\"']*)[\"']", 1).alias("href"),
    )


def sitemap_toc(docs: DataFrame) -> DataFrame:
    """Entries of a sitemap table of contents (``doc_id, html``), blocks without a name dropped."""
    blocks = F.regexp_extract_all(
        "html", F.lit(r"(?is)<object[^>]*type=\"text/sitemap\"[^>]*>(.*?)</object>"), 1
    )

    def param(name: str):
        pattern = rf"(?i)<param\s+name=\"{name}\"\s+value=\"([^\"]*)\""
        return F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all("_block", F.lit(pattern), 1)), -1)

    rows = docs.select("doc_id", F.posexplode(blocks).alias("_at", "_block"))
    named = rows.select(
        "doc_id", "_at", param("name").alias("title"), param("local").alias("path")
    )
    return named.filter(F.col("title") != "").withColumnRenamed("_at", "seq")


def toc_tree(entries: DataFrame) -> DataFrame:
    """Add ``parent_seq`` to a flat outline (``doc_id, seq, level``, any others).

    The parent is the nearest earlier entry of a lower level. Each entry asks, for every lower
    level of its document, for the last entry there; so the work grows with the entries
    times the levels in use, and one level of one document is the largest group.
    """
    levels = entries.groupBy("doc_id").agg(F.collect_set("level").alias("_levels"))
    lower = F.explode(F.filter("_levels", lambda x: x < F.col("level")))
    asked = entries.join(levels, "doc_id").select(
        "doc_id", lower.alias("level"), "seq", F.lit(None).cast("bigint").alias("_own")
    )
    placed = entries.select("doc_id", "level", "seq", F.col("seq").cast("bigint").alias("_own"))
    before = W.partitionBy("doc_id", "level").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    last = F.last("_own", ignorenulls=True).over(before)
    seen = placed.unionByName(asked).withColumn("_last", last).filter("_own IS NULL")
    parents = seen.groupBy("doc_id", "seq").agg(F.max("_last").alias("parent_seq"))
    return entries.join(parents, ["doc_id", "seq"], "left")


def nav_tree(docs: DataFrame) -> DataFrame:
    """Nested contents of a navigation page: ``doc_id, seq, parent_seq, depth, title, href``.

    ``docs`` is ``doc_id, html``. The list is the first ``ol`` of the ``nav`` marked as toc, or
    of the first ``nav``. Every ``li`` is an entry, below the ``li`` around it; its link
    stands before any inner list, and an entry without one is ``Untitled``. Depth is the
    running balance of list tags, so one document costs one sort of its tags.
    """
    navs = F.regexp_extract_all("html", F.lit(r"(?is)<nav\b[^>]*>.*?</nav>"), 0)
    marked = F.filter(
        "_navs",
        lambda n: F.rlike(n, F.lit(r"(?is)^<nav\b[^>]*type=[\"']toc[\"']")) & F.rlike(n, F.lit(r"(?i)<ol\b")),
    )
    nav = F.coalesce(F.get(marked, F.lit(0)), F.get("_navs", F.lit(0)))
    tags = F.regexp_extract_all("_nav", F.lit(r"(?is)<ol\b[^>]*>|</ol>|<li\b[^>]*>|<a\b[^>]*>.*?</a>"), 0)
    opens = lambda t, name: F.startswith(F.lower(t), F.lit(name))
    listed = F.transform(
        "_tags",
        lambda t, i: F.struct(
            i.alias("at"),
            F.when(opens(t, "<ol"), 1).when(opens(t, "</ol"), -1).otherwise(0).alias("step"),
            opens(t, "<li").alias("is_entry"),
            F.when(opens(F.get("_tags", i + 1), "<a"), F.get("_tags", i + 1)).alias("link"),
        ),
    )
    rows = (
        docs.select("doc_id", navs.alias("_navs"))
        .select("doc_id", nav.alias("_nav"))
        .filter("_nav IS NOT NULL")
        .select("doc_id", tags.alias("_tags"))
        .select("doc_id", F.inline(F.filter(listed, lambda x: x["is_entry"] | (x["step"] != 0))))
    )
    along = W.partitionBy("doc_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    deep = rows.withColumn("depth", F.sum("step").over(along).cast("int"))
    ended = (F.col("step") < 0) & (F.col("depth") <= 0)
    deep = deep.withColumn("_ended", F.sum(ended.cast("int")).over(along))
    kept = deep.filter("is_entry AND depth > 0 AND _ended = 0")
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("at")) - 1
    title = strip(F.regexp_replace("link", r"<[^>]+>", ""))
    entries = kept.select(
        "doc_id", number.alias("seq"), F.col("depth").alias("level"),
        F.coalesce(title, F.lit("Untitled")).alias("title"),
        F.coalesce(F.regexp_extract("link", r"(?i)href=[\"']([^\"']*)[\"']", 1), F.lit("")).alias("href"),
    )
    return toc_tree(entries).withColumnRenamed("level", "depth")


def extract_bodies(pages: DataFrame) -> DataFrame:
    return pages.select(
        "page_id",
        body_content(F.col("html")).alias("body_to_last"),
        body_content(F.col("html"), last_close=False).alias("body_to_first"),
    )


def chapter_folder(href):
    return F.regexp_extract(href, r"^(.*/)", 1)


def resolve_links(chapters: DataFrame) -> DataFrame:
    """Every ``src`` and ``href`` value of a chapter and where it points.

    ``chapters`` is ``book_id, spine_index, href, html``.
    """
    rows = chapters.select(
        "book_id", "spine_index",
        chapter_folder(F.col("href")).alias("_base"),
        F.posexplode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("seq", "link"),
    )
    target = F.when(
        is_relative(F.col("link")) & (F.col("_base") != ""), join_path(F.col("_base"), F.col("link"))
    ).otherwise(F.col("link"))
    return rows.select("book_id", "spine_index", "seq", "link", target.alias("target"))


def style_links(chapters: DataFrame) -> DataFrame:
    """Distinct stylesheet targets per book, relative to the book folder."""
    rows = chapters.select(
        "book_id",
        chapter_folder(F.col("href")).alias("_base"),
        F.explode(F.regexp_extract_all("html", F.lit(_STYLE), 1)).alias("link"),
    )
    outside = F.startswith("link", F.lit("http")) | F.startswith("link", F.lit("/"))
    target = F.when(outside, F.col("link")).otherwise(F.concat("_base", "link"))
    return rows.select("book_id", target.alias("target")).distinct()


def combine_chapters(chapters: DataFrame) -> DataFrame:
    """Chapters of a book wrapped and joined in spine order, one row per book."""
    base = chapter_folder(F.col("href"))
    wrapped = F.concat(
        F.lit('<div class="chapter" data-chapter="'), F.col("spine_index").cast("string"),
        F.lit('" data-base="'), base, F.lit('">'),
        rewrite_links(body_content(F.col("html")), base), F.lit("</div>"),
    )
    placed = chapters.select("book_id", "spine_index", wrapped.alias("_part"))
    return placed.groupBy("book_id").agg(
        F.expr("listagg(_part, '\n') WITHIN GROUP (ORDER BY spine_index)").alias("html"),
        F.count("*").alias("n_chapters"),
    )


def spine_resolve(itemrefs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Spine items with their file, in spine order; unknown references are dropped."""
    return itemrefs.join(manifest, ["book_id", "item_id"]).select(
        "book_id", "seq", "item_id", "href", "media_type"
    )


def toc_order(entries: DataFrame, toc: DataFrame, defaults: DataFrame) -> DataFrame:
    """Files of a help book in reading order (``book_id, is_default, seq, name``).

    A contents path names the first file (by ``entry_index``) whose name ends with it.
    Each name is expanded into its endings, so the suffix test is an equi-join. The
    default topic of a book sorts first. Books whose contents match no file list all pages.
    """
    ends = F.transform(
        F.sequence(F.lit(1), F.length("name")), lambda i: F.substr(F.col("name"), i)
    )
    endings = entries.select("book_id", "entry_index", "name", F.explode(ends).alias("path"))
    wanted = toc.select("book_id", "path").distinct()
    first = (
        endings.join(wanted, ["book_id", "path"])
        .groupBy("book_id", "path")
        .agg(F.min_by("name", "entry_index").alias("name"))
    )
    listed = toc.join(first, ["book_id", "path"]).select("book_id", "seq", "name")
    # books whose contents name no file: all pages, by place where there are contents, else by name
    pages = entries.filter(F.rlike("name", F.lit(r"(?i)\.html?$")) & ~F.startswith("name", F.lit("/#")))
    with_toc = toc.select("book_id").distinct().withColumn("_has_toc", F.lit(True))
    bare = pages.join(listed.select("book_id").distinct(), "book_id", "left_anti").join(
        with_toc, "book_id", "left"
    )
    order = [F.when(F.col("_has_toc"), F.col("entry_index")), F.col("name"), F.col("entry_index")]
    place = F.row_number().over(W.partitionBy("book_id").orderBy(*order)) - 1
    everything = listed.unionByName(
        bare.select("book_id", place.cast(toc.schema["seq"].dataType).alias("seq"), "name")
    )
    rows = everything.join(defaults.select("book_id", "topic"), "book_id", "left")
    opening = (
        rows.filter(F.endswith("name", F.col("topic")))
        .groupBy("book_id")
        .agg(F.min("seq").alias("_opening"))
    )
    is_default = F.coalesce(F.col("seq") == F.col("_opening"), F.lit(False))
    return (
        rows.join(opening, "book_id", "left")
        .select("book_id", is_default.alias("is_default"), "seq", "name")
        .orderBy("book_id", F.col("is_default").desc(), "seq")
    )


def _hits(texts: pd.Series, needle: str, context: int) -> pd.Series:
    """Start and surroundings of every non-overlapping hit in each text."""

    def scan(text: str) -> list[dict]:
        low, found, at = text.lower(), [], 0
        while (at := low.find(needle, at)) >= 0:
            end = at + len(needle)
            found.append(
                {"start": at, "context": f"...{text[max(at - context, 0) : end + context]}..."}
            )
            at = end
        return found

    return texts.map(scan)


def find_in_book(chapters: DataFrame, query: str, context: int = K.FIND_CONTEXT) -> DataFrame:
    """Every case-insensitive hit of ``query`` with context and numbering.

    ``chapters`` is ``book_id, chapter_index, text``. Chapters without a hit never leave
    the JVM. Hits are found inside the chapter row; only hit counts cross chapters, so
    the book-wide number needs no shuffle of hits or texts. ``reader_label`` is what a reader
    of the book's ``format`` (if ``chapters`` has it) shows beside a hit.
    """
    kind = F.col("format") if "format" in chapters.columns else F.lit(None).cast("string")
    chapters = chapters.select("book_id", "chapter_index", kind.alias("format"), "text")
    needle = query.lower()

    @F.pandas_udf("array<struct<start:int,context:string>>")
    def hits(texts: pd.Series) -> pd.Series:
        return _hits(texts, needle, context)

    found = chapters.filter(F.contains(F.lower("text"), F.lit(needle))).select(
        "book_id", "chapter_index", "format", hits("text").alias("_hits")
    )
    placed = running_total(found, ["book_id"], "chapter_index", F.size("_hits"), "_earlier")
    rows = placed.select(
        "book_id", "chapter_index", "format", "_earlier", F.posexplode("_hits").alias("_at", "_hit")
    )
    number = (F.col("_at") + 1).cast("string")
    return rows.select(
        "book_id", "chapter_index",
        (F.col("_at") + 1).alias("match_in_chapter"),
        (F.col("_earlier") + F.col("_at")).alias("match_index"),
        F.col("_hit")["start"].alias("start"),
        F.col("_hit")["context"].alias("context"),
        F.concat(
            F.lit("Ch. "), (F.col("chapter_index") + 1).cast("string"), F.lit(", match "), number
        ).alias("label"),
        reader_label(F.col("format"), F.col("chapter_index"), number, F.col("_earlier") + F.col("_at")).alias(
            "reader_label"
        ),
    )


def reader_label(fmt: Column, chapter: Column, number: Column, whole: Column) -> Column:
    """Page of a paged book, chapter and hit of one read by chapters, else the hit in the document."""
    place = (chapter + 1).cast("string")
    return (
        F.when(fmt == "pdf", F.concat(F.lit("Page "), place))
        .when(fmt == "epub", F.concat(F.lit("Chapter "), place, F.lit(", match "), number))
        .otherwise(F.concat(F.lit("Document, match "), (whole + 1).cast("string")))
    )


def page_texts(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", html_to_text(F.col("html")).alias("text"))


