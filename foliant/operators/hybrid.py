"""Blending keyword and vector results into one ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant import constants as K
from foliant.functions.scoring import guess_title, is_content, pattern_score
from foliant.functions.text import strip
from foliant.operators.catalog import display_title
from foliant.operators.chunking import chunk_windows
from foliant.operators.keyword import with_snippets
from foliant.operators.matching import keep_where, named_by, once
from foliant.operators.ordering import top_per_key
from foliant.session import durable, measured


# --- hints --------------------------------------------------------------------------------


def build_hints(chunks: DataFrame) -> DataFrame:
    """``chunk_id, score, title`` of chunks that look like a recipe."""
    scored = keep_where(
        chunks.select("chunk_id", "text"),
        "score",
        pattern_score(F.col("text")),
        lambda s: s > K.HINT_STORE,
    )
    return scored.select("chunk_id", "score", guess_title(F.col("text")).alias("title"))


def upsert_hints(old: DataFrame, new: DataFrame) -> DataFrame:
    """New hints replace old ones of the same chunk; other old ones stay."""
    kept = old.join(new.select("chunk_id"), "chunk_id", "left_anti")
    return new.unionByName(kept)


def hint_lookup(candidates: DataFrame, hints: DataFrame) -> DataFrame:
    """Add ``is_hinted`` to rows with a ``chunk_id``."""
    strong = hints.filter(F.col("score") >= K.HINT_MATCH).select(
        "chunk_id", F.lit(True).alias("is_hinted")
    )
    return candidates.join(strong, "chunk_id", "left").withColumn(
        "is_hinted", F.coalesce("is_hinted", F.lit(False))
    )


def good_text(text: Column) -> Column:
    """Content that looks enough like a recipe to be shown.

    Few texts reach the gate, so it is asked first.
    """
    return (pattern_score(text) >= K.QUALITY_GATE) & is_content(text)


# --- candidates -----------------------------------------------------------------------------


def merge_candidates(vector_hits: DataFrame, keyword_hits: DataFrame) -> DataFrame:
    """``query_id, book_id, chunk_id, score`` from both sides.

    A keyword hit lifts a vector hit by a fixed amount or enters with a base score.
    """
    rows = vector_hits.select(
        "query_id", "book_id", "chunk_id",
        F.col("similarity").alias("similarity"), F.lit(0).alias("keyword"),
    ).unionByName(
        keyword_hits.select(
            "query_id", "book_id", "chunk_id",
            F.lit(None).cast("double").alias("similarity"), F.lit(1).alias("keyword"),
        )
    )
    merged = rows.groupBy("query_id", "book_id", "chunk_id").agg(
        F.max("similarity").alias("_similarity"), F.max("keyword").alias("_keyword")
    )
    lifted = F.col("_similarity") + F.col("_keyword") * F.lit(K.KEYWORD_BOOST)
    return merged.select(
        "query_id", "book_id", "chunk_id",
        F.round(F.coalesce(lifted, F.lit(K.KEYWORD_BASE)), 6).alias("score"),
    )


def best_chunks(candidates: DataFrame) -> DataFrame:
    """The best chunk of each (query, book); the lower chunk id on ties."""
    return candidates.groupBy("query_id", "book_id").agg(
        F.max("score").alias("score"),
        F.max_by("chunk_id", F.struct("score", -F.col("chunk_id"))).alias("chunk_id"),
    )


def keyword_value(mode: str) -> Column:
    """Keyword rank as a number where more is better.

    ``reference`` negates every rank alike, so name matches come out lowest.
    """
    if mode == "reference":
        return -F.col("rank_value")
    return F.col("rank_value")


def minmax_normalize(
    rows: DataFrame, key: str, value: str, name: str, floor: float = K.RANGE_FLOOR
) -> DataFrame:
    """Scale ``value`` to 0..1 within ``key``; ranges under ``floor`` count as ``floor``.

    Bounds are a partial aggregate joined back, so a key with most rows is never sorted
    or held in one task. The rows are written once, as both sides of that join read them.
    """
    rows = durable(rows)
    bounds = rows.groupBy(key).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    scaled = (F.col(value) - F.col("_low")) / F.greatest(
        F.col("_high") - F.col("_low"), F.lit(floor)
    )
    return rows.join(bounds, key).withColumn(name, F.round(scaled, 6)).drop("_low", "_high")


# --- book level -----------------------------------------------------------------------------


#: What a blended row keeps of its keyword hit.
HIT_FIELDS = ["source", "rank_value", "chunk_index"]


def blend_books(
    keyword_hits: DataFrame, candidates: DataFrame, mode: str = "intended", limit: int | None = None
) -> DataFrame:
    """``query_id, book_id, chunk_id, score`` from keyword rank and best chunk.

    Books found by vectors only get the vector share. The keyword hit's own fields, as far as
    ``keyword_hits`` has them, stay on the row, so that nothing has to look the hit up again.
    """
    kept = [c for c in HIT_FIELDS if c in keyword_hits.columns]
    valued = keyword_hits.select("query_id", "book_id", *kept, keyword_value(mode).alias("_value"))
    normal = minmax_normalize(valued, "query_id", "_value", "_keyword").drop("_value")
    best = best_chunks(candidates).select(
        "query_id", "book_id", F.col("score").alias("_vector"), "chunk_id"
    )
    blended = F.lit(K.KEYWORD_WEIGHT) * F.coalesce("_keyword", F.lit(0.0)) + F.lit(
        1 - K.KEYWORD_WEIGHT
    ) * F.coalesce("_vector", F.lit(0.0))
    rows = normal.join(best, ["query_id", "book_id"], "full").select(
        "query_id", "book_id", "chunk_id", F.round(blended, 6).alias("score"), *kept
    )
    if limit is not None:
        rows = top_per_key(rows, ["query_id"], [F.col("score").desc(), F.col("book_id")], limit)
    return rows


def hybrid_books(
    keyword_hits: DataFrame,
    candidates: DataFrame,
    chunks: DataFrame,
    books: DataFrame,
    snippets: DataFrame | None = None,
    mode: str = "intended",
    limit: int | None = None,
    texts: DataFrame | None = None,
    terms: DataFrame | None = None,
) -> DataFrame:
    """One row per (query, book), see :func:`blend_books`, with names and text.

    ``keyword_hits`` is the tiered search result, ``candidates`` the merged chunk scores.
    Text comes from the best chunk, else from the keyword hit: cut here from the searched
    ``texts`` with the queries' ``terms``, or given as ``snippets`` (``query_id, book_id,
    snippet``).
    """
    rows = blend_books(keyword_hits, candidates, mode, limit)
    if limit is not None:
        # a few rows per query, which pick their texts and names
        rows = measured(rows)
        chunks, books = named_by(chunks, rows, "chunk_id"), named_by(books, rows, "book_id")
        if texts is not None:
            texts = named_by(texts, rows, "book_id", "chunk_index")
    bodies = chunks.select("chunk_id", F.col("text").alias("_text"))
    named = books.select("book_id", display_title().alias("title"), "author", "format")
    if texts is not None:
        # only rows without a chunk look for the text of their hit
        bare = F.when(F.col("chunk_id").isNull(), F.col("source")).alias("source")
        rows = rows.select(*[bare if c == "source" else c for c in rows.columns])
        rows = with_snippets(rows, books, texts, terms, "_snippet")
    elif snippets is not None:
        cut = snippets.select("query_id", "book_id", F.col("snippet").alias("_snippet"))
        rows = rows.join(cut, ["query_id", "book_id"], "left")
    else:
        rows = rows.withColumn("_snippet", F.lit(None).cast("string"))
    rows = rows.drop(*HIT_FIELDS).join(named, "book_id").join(bodies, "chunk_id", "left")
    short = F.substr("_text", F.lit(1), F.lit(K.SNIPPET_CHARS))
    return (
        rows.withColumn("snippet", F.coalesce(short, "_snippet", F.lit("")))
        .withColumn("full_text", F.coalesce("_text", "_snippet", F.lit("")))
        .drop("_text", "_snippet")
    )


# --- chunk level ----------------------------------------------------------------------------


def gated_chunks(
    candidates: DataFrame,
    keyword_hits: DataFrame,
    chunks: DataFrame,
    hints: DataFrame | None = None,
    mode: str = "intended",
) -> DataFrame:
    """Blended score of every candidate chunk that passes the quality gate.

    Hinted chunks pass at once; others must be content and reach the pattern gate. The
    gate depends on the chunk alone, so it is evaluated on distinct chunks. Without stored
    ``hints`` the candidates' own texts are scored, once for the hint and the gate.
    """
    candidates = durable(candidates)
    needed = candidates.select("chunk_id").distinct()
    texts = chunks.select("chunk_id", "chunk_index", "text").join(needed, "chunk_id", "left_semi")
    if hints is None:
        texts = once(texts, _score=pattern_score(F.col("text")))
        hinted = (F.col("_score") > K.HINT_STORE) & (F.col("_score") >= K.HINT_MATCH)
        texts = texts.withColumn("is_hinted", F.coalesce(hinted, F.lit(False)))
        good = (F.col("_score") >= K.QUALITY_GATE) & is_content(F.col("text"))
    else:
        texts, good = hint_lookup(texts, hints), good_text(F.col("text"))
    judged = keep_where(texts, "_passes", F.col("is_hinted") | good, lambda passes: passes)
    passed = candidates.join(judged.select("chunk_id", "chunk_index", "is_hinted"), "chunk_id")
    valued = keyword_hits.select("query_id", "book_id", keyword_value(mode).alias("_value"))
    if mode == "reference":
        bounds = valued.groupBy("query_id").agg(
            F.min("_value").alias("_low"), F.max("_value").alias("_high")
        )
        rows = passed.join(valued, ["query_id", "book_id"], "left").join(bounds, "query_id", "left")
        low, high = F.coalesce("_low", F.lit(0.0)), F.coalesce("_high", F.lit(1.0))
        span = F.greatest(high - low, F.lit(K.RANGE_FLOOR))
        rows = rows.withColumn("_keyword", (F.coalesce("_value", F.lit(0.0)) - low) / span)
    else:
        normal = minmax_normalize(valued, "query_id", "_value", "_keyword").drop("_value")
        rows = passed.join(normal, ["query_id", "book_id"], "left")
    blended = (
        F.lit(K.KEYWORD_WEIGHT) * F.coalesce("_keyword", F.lit(0.0))
        + F.lit(1 - K.KEYWORD_WEIGHT) * F.col("score")
        + F.when(F.col("is_hinted"), F.lit(K.HINT_BOOST)).otherwise(F.lit(0.0))
    )
    return rows.select(
        "query_id", "book_id", "chunk_id", "chunk_index", "is_hinted",
        F.round(blended, 6).alias("score"),
    )


def suppress_adjacent(ranked: DataFrame, radius: int) -> DataFrame:
    """Drop hits within ``radius`` chunks of a better accepted hit of the same book.

    ``ranked`` holds the top list of each query (``rank``), so the array that is walked
    has as many entries as that list. Suppressed hits suppress nothing.
    """
    listed = ranked.groupBy("query_id").agg(
        F.array_sort(
            F.collect_list(F.struct("rank", "score", "book_id", "chunk_id", "chunk_index", "is_hinted"))
        ).alias("_hits")
    )

    def step(taken: Column, hit: Column) -> Column:
        near = F.exists(
            taken,
            lambda t: (t["book_id"] == hit["book_id"])
            & (F.abs(t["chunk_index"] - hit["chunk_index"]) <= radius),
        )
        return F.when(near, taken).otherwise(F.concat(taken, F.array(hit)))

    none = F.filter("_hits", lambda h: F.lit(False))
    return listed.select("query_id", F.inline(F.aggregate("_hits", none, step)))


def hybrid_chunks(
    candidates: DataFrame,
    keyword_hits: DataFrame,
    chunks: DataFrame,
    hints: DataFrame | None,
    books: DataFrame,
    limit: int = K.CHUNK_RESULTS,
    radius: int = 1,
    mode: str = "intended",
) -> DataFrame:
    """Best chunks per query with neighbouring text, near-duplicates by place removed."""
    gated = gated_chunks(candidates, keyword_hits, chunks, hints, mode)
    order = [F.col("score").desc(), F.col("chunk_id")]
    # a few rows per query, read for their neighbours, texts and names
    top = measured(suppress_adjacent(top_per_key(gated, ["query_id"], order, limit), radius))
    hits = top.withColumn("hit_id", F.struct("query_id", "chunk_id"))
    wide = chunk_windows(hits, chunks, radius).select(
        F.col("hit_id")["query_id"].alias("query_id"),
        F.col("hit_id")["chunk_id"].alias("chunk_id"),
        F.col("text").alias("full_text"),
    )
    own = named_by(chunks, top, "chunk_id").select(
        "chunk_id", F.substr("text", F.lit(1), F.lit(K.SNIPPET_CHARS)).alias("snippet")
    )
    named = named_by(books, top, "book_id").select(
        "book_id", display_title().alias("title"), "author", "format"
    )
    return (
        top.join(wide, ["query_id", "chunk_id"])
        .join(own, "chunk_id")
        .join(named, "book_id")
        .select(
            "query_id", "rank", "book_id", "chunk_id", "chunk_index", "score", "is_hinted",
            "title", "author", "format", "snippet", "full_text",
        )
    )


def fallback_chunks(
    answered: DataFrame,
    scores: DataFrame,
    texts: DataFrame,
    limit: int = K.CHUNK_RESULTS,
) -> DataFrame:
    """Keyword chunks for queries that got no chunk-level result.

    ``answered`` is ``query_id``; ``scores`` are bm25 scores over ``texts``. Chunks must pass
    the quality gate before the best ``limit`` are taken; each chunk is judged once, however
    many queries found it, and only its snippet leaves the task.
    """
    place = ["book_id", "chunk_index"]
    open_scores = durable(
        scores.join(answered.select("query_id").distinct(), "query_id", "left_anti")
    )
    wanted = open_scores.select(*place).distinct()
    judged = texts.select(*place, "text").join(wanted, place, "left_semi")
    passed = keep_where(judged, "_passes", good_text(F.col("text")), lambda passes: passes)
    short = F.substr("text", F.lit(1), F.lit(K.SNIPPET_CHARS)).alias("snippet")
    good = open_scores.join(passed.select(*place, short), place)
    clamped = F.greatest(
        F.lit(K.FALLBACK_LOW), F.least(F.lit(K.FALLBACK_HIGH), F.col("score") / F.lit(10.0))
    )
    order = [F.col("score").desc(), F.col("book_id"), F.col("chunk_index")]
    return top_per_key(good, ["query_id"], order, limit).select(
        "query_id", "rank", "book_id", "chunk_index", F.round(clamped, 6).alias("score"), "snippet"
    )


# --- end-user search --------------------------------------------------------------------------


def library_search(
    queries: DataFrame,
    keyword_hits: DataFrame,
    hybrid_hits: DataFrame,
    chunks: DataFrame,
) -> DataFrame:
    """Hybrid results if any vector exists, else keyword results; blank queries give none.

    Lists are ordered best first by ``score`` in both cases.
    """
    asked = queries.filter(strip(F.col("text")) != "").select("query_id")
    has_vectors = chunks.filter(F.col("embedding").isNotNull()).select("chunk_id").limit(1).count() > 0
    if has_vectors:
        rows = hybrid_hits.select("query_id", "book_id", "score")
    else:
        rows = keyword_hits.select("query_id", "book_id", F.col("rank_value").alias("score"))
    return rows.join(asked, "query_id", "left_semi")


def top_up(
    results: DataFrame, extra: DataFrame, queries: DataFrame, below: int = K.TOP_UP_BELOW
) -> DataFrame:
    """Add results of the open book to queries that found fewer than ``below`` books.

    ``results`` and ``extra`` are ``query_id, book_id, score``; books already found are not
    repeated and added ones come after them (``is_extra``).
    """
    counts = results.groupBy("query_id").agg(F.count("*").alias("_n"))
    short = (
        queries.select("query_id")
        .join(counts, "query_id", "left")
        .filter(F.coalesce("_n", F.lit(0)) < below)
        .select("query_id")
    )
    added = (
        extra.join(short, "query_id", "left_semi")
        .join(results.select("query_id", "book_id"), ["query_id", "book_id"], "left_anti")
        .select("query_id", "book_id", "score", F.lit(True).alias("is_extra"))
    )
    return results.select("query_id", "book_id", "score", F.lit(False).alias("is_extra")).unionByName(added)
