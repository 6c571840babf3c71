"""Catalog of files: lookup, filters, scopes, order, import and differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import contains_folded, file_format, parent_folder, strip
from foliant.operators.matching import INLINE_NEEDLES, small_rows
from foliant.operators.ordering import top_per_key, with_position

SORT_KEYS = ("title", "author", "date_added", "file_size", "format")


def display_title() -> Column:
    return F.coalesce("title", "file_name")


# --- lookup and filters -------------------------------------------------------------


def lookup_by_id(books: DataFrame, book_id: int) -> DataFrame:
    return books.filter(F.col("book_id") == book_id).limit(1)


def lookup_by_path(books: DataFrame, path: str) -> DataFrame:
    return books.filter(F.col("file_path") == path).limit(1)


def by_ids(books: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose ``book_id`` is listed; Spark broadcasts ``ids`` only if it is small."""
    return books.join(ids.select("book_id"), "book_id", "left_semi")


def by_format(books: DataFrame, fmt: str) -> DataFrame:
    return books.filter(F.col("format") == fmt).orderBy(
        F.col("title").asc_nulls_first(), "book_id"
    )


def in_folder(path: Column, folder: Column) -> Column:
    """Exact, case-sensitive folder prefix."""
    return F.startswith(path, F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/")))


def by_folder(books: DataFrame, folder: str) -> DataFrame:
    return books.filter(in_folder(F.col("file_path"), F.lit(folder)))


def search(books: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring of file name, title or author."""
    needle = F.lit(text)
    return books.filter(
        contains_folded(F.col("file_name"), needle)
        | contains_folded(F.col("title"), needle)
        | contains_folded(F.col("author"), needle)
    )


def with_ancestors(books: DataFrame) -> DataFrame:
    """One row per book and enclosing folder, so a folder test is an equi-join."""
    parts = F.split("file_path", "/", -1)
    depths = F.sequence(F.lit(1), F.size(parts) - 1)
    folders = F.transform(depths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return books.select("book_id", F.explode(folders).alias("folder"))


def scope_books(books: DataFrame, membership: DataFrame, scopes: DataFrame) -> DataFrame:
    """Books of each scope row (``scope_id, kind, collection_id, folder``).

    ``kind`` is all, recent, folder or collection. Result: ``scope_id, book_id``.
    """
    slim = books.select("book_id", "file_path", "date_last_opened")
    library = _library_wide(slim, scopes.filter(F.col("kind").isin("all", "recent")))
    folders = scopes.filter(F.col("kind") == "folder").select(
        "scope_id", F.regexp_replace("folder", "/+$", "").alias("folder")
    )
    foldered = with_ancestors(slim).join(folders, "folder").select("scope_id", "book_id")
    collections = scopes.filter(F.col("kind") == "collection").select("scope_id", "collection_id")
    collected = (
        membership.join(collections, "collection_id")
        .select("scope_id", "book_id")
        .join(slim.select("book_id"), "book_id", "left_semi")
        .select("scope_id", "book_id")
    )
    return library.unionByName(foldered).unionByName(collected)


def _library_wide(books: DataFrame, scopes: DataFrame) -> DataFrame:
    """Every book (or every opened one) for each library-wide scope.

    A short scope list is a literal next to each book. A longer one is spread over the
    books by pairing both with the same few salts.
    """
    opened = F.col("date_last_opened").isNotNull()
    listed = small_rows(scopes.select("scope_id", "kind"), INLINE_NEEDLES)
    if listed is not None:
        if not listed:
            return books.join(scopes.select("scope_id"), F.lit(False)).select("scope_id", "book_id")
        kinds = F.array(
            *[F.struct(F.lit(r["scope_id"]).cast("bigint").alias("scope_id"), F.lit(r["kind"]).alias("kind")) for r in listed]
        )
        fitting = F.filter(kinds, lambda k: (k["kind"] == "all") | opened)
        return books.select("book_id", F.explode(fitting).alias("_scope")).select(
            F.col("_scope")["scope_id"].alias("scope_id"), "book_id"
        )
    salts = 1024
    salted = books.withColumn("_salt", F.pmod(F.xxhash64("book_id"), F.lit(salts)))
    repeated = scopes.select(
        "scope_id", "kind", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("_salt")
    )
    paired = salted.join(repeated, "_salt")
    return paired.filter((F.col("kind") == "all") | opened).select("scope_id", "book_id")


def lazy_scope(
    books: DataFrame, membership: DataFrame, scopes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Scopes as searches take them: ``scope_id, book_id`` rows, and ``scope_id`` of whole libraries.

    A scope of all books stays a flag, so no row per book and scope is made for it.
    """
    some = scopes.filter("kind <> 'all'")
    return scope_books(books, membership, some), scopes.filter("kind = 'all'").select("scope_id")


def in_scope(rows: DataFrame, scope: DataFrame, everywhere: DataFrame) -> DataFrame:
    """Rows (``query_id, book_id``, others) of the books that their query may see."""
    seen = scope.select("query_id", "book_id").distinct().withColumn("_seen", F.lit(True))
    free = everywhere.select("query_id").distinct().withColumn("_free", F.lit(True))
    marked = rows.join(seen, ["query_id", "book_id"], "left").join(free, "query_id", "left")
    return marked.filter("_seen OR _free").select(*rows.columns)


def scope_fallback(books: DataFrame, membership: DataFrame, scopes: DataFrame) -> DataFrame:
    """As :func:`scope_books`, but an empty scope means all books.

    Scopes with ``cookbook`` set stay empty.
    """
    found = scope_books(books, membership, scopes)
    hit = found.select("scope_id").distinct()
    empty = scopes.filter(~F.col("cookbook")).join(hit, "scope_id", "left_anti")
    rest = _library_wide(
        books.select("book_id", "date_last_opened"), empty.select("scope_id", F.lit("all").alias("kind"))
    )
    return found.unionByName(rest)


def pending(books: DataFrame) -> DataFrame:
    """Books that still miss an index, with which one."""
    return books.filter(~F.col("full_text_indexed") | ~F.col("embedding_indexed")).select(
        "book_id",
        (~F.col("full_text_indexed")).alias("needs_text"),
        (~F.col("embedding_indexed")).alias("needs_vectors"),
    )


# --- order ----------------------------------------------------------------------------


def sort_order(key: str, ascending: bool) -> list[Column]:
    if key not in SORT_KEYS:
        raise ValueError(f"unknown sort key {key!r}")
    c = F.col(key)
    return [c.asc_nulls_first() if ascending else c.desc_nulls_last(), F.col("book_id").asc()]


def sorted_library(
    books: DataFrame, key: str = "title", ascending: bool = True, position: str | None = None
) -> DataFrame:
    """The library in display order; ``position`` adds the place as a column."""
    order = sort_order(key, ascending)
    if position is None:
        return books.orderBy(*order)
    return with_position(books, order, position)


def recently_opened(books: DataFrame, limit: int = 50) -> DataFrame:
    opened = books.filter(F.col("date_last_opened").isNotNull())
    return opened.orderBy(F.col("date_last_opened").desc(), "book_id").limit(limit)


def cyclic_neighbors(
    df: DataFrame, key: str, order: Sequence[Column], wrap: bool = True
) -> DataFrame:
    """``key`` with the keys before and after it in ``order``; the ends meet if ``wrap``."""
    placed = with_position(df.select(key), order, "_at")
    n = F.lit(placed.count())
    back, ahead = F.col("_at") - 1, F.col("_at") + 1
    if wrap:
        back = F.when(back == 0, n).otherwise(back)
        ahead = F.when(ahead > n, F.lit(1)).otherwise(ahead)
    else:
        back, ahead = F.greatest(back, F.lit(1)), F.least(ahead, n)
    own = placed.select(key, back.alias("_back"), ahead.alias("_ahead"))
    left = placed.select(F.col(key).alias("previous"), F.col("_at").alias("_back"))
    right = placed.select(F.col(key).alias("next"), F.col("_at").alias("_ahead"))
    return own.join(left, "_back").join(right, "_ahead").select(key, "previous", "next")


def top_by_score(scores: DataFrame, keys: Sequence[str], score: str, tie: str, k: int) -> DataFrame:
    """Best ``k`` rows per key by score, ties by ``tie``."""
    return top_per_key(scores, keys, [F.col(score).desc(), F.col(tie).asc()], k)


# --- counts -----------------------------------------------------------------------------


def counts_by_scope(
    books: DataFrame,
    folders: DataFrame,
    collections: DataFrame,
    membership: DataFrame,
    annotations: DataFrame,
) -> DataFrame:
    """Badge counts as ``scope, key, n``; empty folders, collections and books count 0."""
    whole = books.agg(
        F.count("*").alias("all"), F.count("date_last_opened").alias("recent")
    ).select(F.explode(F.create_map(F.lit("all"), "all", F.lit("recent"), "recent")).alias("scope", "n"))
    whole = whole.select("scope", F.lit("").alias("key"), "n")

    listed = folders.select(F.regexp_replace("folder", "/+$", "").alias("folder"))
    per_folder = with_ancestors(books).groupBy("folder").count()
    in_folders = _counted(listed, per_folder, "folder", "folder")

    members = membership.join(books.select("book_id"), "book_id", "left_semi")
    per_collection = members.groupBy("collection_id").count()
    in_collections = _counted(collections, per_collection, "collection_id", "collection")

    per_book = annotations.groupBy("book_id").count()
    on_books = _counted(books, per_book, "book_id", "annotations")
    return whole.unionByName(in_folders).unionByName(in_collections).unionByName(on_books)


def _counted(owners: DataFrame, counts: DataFrame, key: str, scope: str) -> DataFrame:
    return (
        owners.select(key)
        .join(counts, key, "left")
        .select(
            F.lit(scope).alias("scope"),
            F.col(key).cast("string").alias("key"),
            F.coalesce("count", F.lit(0)).alias("n"),
        )
    )


# --- import -----------------------------------------------------------------------------


def new_files(files: DataFrame, books: DataFrame) -> DataFrame:
    """Supported files (``path``) that are not cataloged yet, one row per path."""
    supported = files.select("path", file_format(F.col("path")).alias("format")).filter(
        F.col("format").isNotNull()
    )
    known = books.select(F.col("file_path").alias("path"))
    return supported.distinct().join(known, "path", "left_anti")


def insert_ignore(existing: DataFrame, incoming: DataFrame, key: str, arrival: str) -> DataFrame:
    """Existing rows plus the first arriving row of every new key.

    ``incoming`` has the columns of ``existing`` and ``arrival``. First-of-key is a
    partial aggregate, so a key repeated in a third of the rows is reduced in place.
    """
    columns = existing.columns
    firsts = incoming.groupBy(key).agg(
        F.min_by(F.struct(*[c for c in columns if c != key]), F.col(arrival)).alias("_row")
    )
    fresh = firsts.join(existing.select(key), key, "left_anti").select(
        *[F.col(key) if c == key else F.col("_row")[c].alias(c) for c in columns]
    )
    return existing.unionByName(fresh)


def import_selected(files: DataFrame, folders: DataFrame, books: DataFrame) -> DataFrame:
    """Picked files to import, with whether their folder gets a new partial entry.

    ``folders`` is ``folder, is_full``. Files below an already complete folder entry,
    unsupported files and known paths are skipped.
    """
    picked = files.select(
        "path", parent_folder(F.col("path")).alias("folder"), file_format(F.col("path")).alias("format")
    ).distinct()
    full = folders.filter("is_full").select("folder")
    partial = folders.filter("not is_full").select("folder", F.lit(False).alias("new_folder"))
    known = books.select(F.col("file_path").alias("path"))
    return (
        picked.filter(F.col("format").isNotNull())
        .join(full, "folder", "left_anti")
        .join(known, "path", "left_anti")
        .join(partial, "folder", "left")
        .select("path", "folder", "format", F.coalesce("new_folder", F.lit(True)).alias("new_folder"))
    )


def catalog_diff(books: DataFrame, listing: DataFrame) -> DataFrame:
    """``path, status``: added, removed or kept."""
    known = books.select(F.col("file_path").alias("path"), F.lit(True).alias("known")).distinct()
    listed = (
        listing.select("path")
        .filter(file_format(F.col("path")).isNotNull())
        .distinct()
        .withColumn("listed", F.lit(True))
    )
    status = (
        F.when(F.col("known").isNull(), "added")
        .when(F.col("listed").isNull(), "removed")
        .otherwise("kept")
    )
    return known.join(listed, "path", "full").select("path", status.alias("status"))


def detect_formats(files: DataFrame) -> DataFrame:
    found = files.select("path", file_format(F.col("path")).alias("format"))
    return found.filter(F.col("format").isNotNull())


def compose_author(df: DataFrame) -> DataFrame:
    """Add ``author`` from first, middle and last name; NULL when all are missing."""
    joined = F.concat_ws(" ", "first_name", "middle_name", "last_name")
    return df.withColumn("author", F.nullif(joined, F.lit("")))


def progress_fraction(models: DataFrame) -> DataFrame:
    """Add ``fraction`` of the download and ``is_ready``."""
    fraction = F.when(
        F.col("expected_bytes") > 0,
        F.col("downloaded_bytes").cast("double") / F.col("expected_bytes").cast("double"),
    ).otherwise(0.0)
    return models.withColumn("fraction", F.round(fraction, 6)).withColumn(
        "is_ready", F.col("status") == "ready"
    )


def language_names(df: DataFrame, code: str) -> DataFrame:
    from foliant import constants as K

    pairs = [F.lit(x) for pair in K.LANGUAGES.items() for x in pair]
    low_byte = F.col(code).bitwiseAND(F.lit(255)).cast("int")
    name = F.try_element_at(F.create_map(*pairs), low_byte)
    return df.withColumn("language", F.coalesce(name, F.lit("Unknown")))


def preview_excerpts(parts: DataFrame, books: DataFrame, limit: int) -> DataFrame:
    """``book_id, excerpt``: the description, else the start of the first part's text.

    ``parts`` is ``book_id, part_index, text``; ``books`` has ``book_id, description``.
    """
    first = parts.groupBy("book_id").agg(
        F.min_by(F.substr(F.col("text"), F.lit(1), F.lit(limit)), "part_index").alias("_text")
    )
    return books.join(first, "book_id", "left").select(
        "book_id",
        F.coalesce(
            F.nullif("description", F.lit("")), F.nullif(strip(F.col("_text")), F.lit(""))
        ).alias("excerpt"),
    )
