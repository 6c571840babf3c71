"""Brute-force cosine search of many queries over all chunk vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.ordering import top_per_key

# a query list up to this number is sent to every task as one matrix
INLINE_QUERIES = 4096


def similarities(pairs: DataFrame) -> DataFrame:
    """Cosine of ``left`` and ``right`` of each row, rounded to 6 places."""
    from foliant.functions.vectors import cosine

    return pairs.withColumn("similarity", F.round(cosine(F.col("left"), F.col("right")), 6))


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Rows scaled to length 1; vectors of another width or zero length become zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == width:
            out[i] = v
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def _batch_matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count == 0 and len(lengths) and (lengths == width).all():
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out = flat.reshape(-1, width)
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)
    return _matrix(column.to_pylist(), width)


def _best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the best ``k`` by score, then id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def vector_topk(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    scope: DataFrame | None = None,
    everywhere: DataFrame | None = None,
    inline: int = INLINE_QUERIES,
) -> DataFrame:
    """``query_id, book_id, chunk_id, similarity, rank`` of the nearest chunks per query.

    ``queries`` is ``query_id, vector``; ``chunks`` is ``chunk_id, book_id, embedding``.
    Chunks without a vector are left out. Every Arrow batch of chunks is multiplied with
    the query matrix and passes on at most ``k`` rows per query, so the shuffle carries
    top lists only. A query list that is too long for one matrix takes several passes.

    With ``scope`` (``query_id, book_id``) a query sees the books of its scope only, and
    nothing if there are none; the queries of ``everywhere`` (``query_id``) see all books.
    Each book then carries one bit per query that may see it, which meets its chunks by
    book and masks the product.
    """
    embedded = chunks.filter(F.col("embedding").isNotNull()).select("chunk_id", "book_id", "embedding")
    listed = queries.select("query_id", "vector")
    passes = -(-listed.count() // inline)
    partial = None
    for number in range(max(passes, 1)):
        mine = F.pmod(F.xxhash64("query_id"), F.lit(max(passes, 1))) == number
        block = sorted(listed.filter(mine).collect(), key=lambda r: r["query_id"])
        if scope is None:
            found = _multiply(embedded, block, k)
        else:
            open_ids = set()
            if everywhere is not None:
                open_ids = {r["query_id"] for r in everywhere.select("query_id").filter(mine).distinct().collect()}
            found = _multiply(_with_masks(embedded, scope, block, bool(open_ids)), block, k, open_ids)
        partial = found if partial is None else partial.unionByName(found)
    order = [F.col("similarity").desc(), F.col("chunk_id")]
    return top_per_key(partial, ["query_id"], order, k)


_TOP_DDL = "query_id bigint, book_id bigint, chunk_id bigint, similarity double"


def _with_masks(embedded: DataFrame, scope: DataFrame, block: list, keep_all: bool) -> DataFrame:
    """Add ``mask``: 64 queries to a number, one bit for each query that may see the book."""
    spark = embedded.sparkSession
    numbers = spark.createDataFrame(
        [(r["query_id"], i) for i, r in enumerate(block)], "query_id long, _at int"
    )
    seen = scope.select("query_id", "book_id").join(F.broadcast(numbers), "query_id")
    bit = F.expr("shiftleft(1L, _at % 64)")
    words = [
        F.coalesce(F.bit_or(F.when(F.floor(F.col("_at") / 64) == w, bit)), F.lit(0)).cast("long").alias(f"_w{w}")
        for w in range(max(1, -(-len(block) // 64)))
    ]
    masks = seen.groupBy("book_id").agg(*words)
    masks = masks.select("book_id", F.array(*[c for c in masks.columns if c != "book_id"]).alias("mask"))
    # a book that only the open queries see has no mask
    return embedded.join(masks, "book_id", "left" if keep_all else "inner")


def _seen(batch: pa.RecordBatch, query_ids: list, places: list[int], open_ids: set) -> np.ndarray:
    """Which rows of a batch each query may see."""
    rows = batch.column("mask").to_pylist()
    width = max((len(m) for m in rows if m is not None), default=-(-(max(places) + 1) // 64))
    flat = np.array([m if m is not None else [0] * width for m in rows], np.int64).reshape(-1, width)
    bits = np.unpackbits(flat.view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
    every = np.array([q in open_ids for q in query_ids])
    return bits[:, places].astype(bool) | every


def _score_batch(ids, books, matrix, query_ids, query_matrix, k, seen=None) -> pd.DataFrame:
    scores = np.round(matrix @ query_matrix.T, 6) + 0.0
    parts = []
    for j, query_id in enumerate(query_ids):
        if seen is None:
            best = _best_rows(scores[:, j], ids, k)
        else:
            mine = np.flatnonzero(seen[:, j])
            best = mine[_best_rows(scores[mine, j], ids[mine], k)]
        parts.append(
            pd.DataFrame(
                {
                    "query_id": query_id,
                    "book_id": books[best],
                    "chunk_id": ids[best],
                    "similarity": scores[best, j],
                }
            )
        )
    return pd.concat(parts) if parts else pd.DataFrame()


def _multiply(embedded: DataFrame, listed: list, k: int, open_ids: set | None = None) -> DataFrame:
    by_width: dict[int, list] = {}
    for place, row in enumerate(listed):
        by_width.setdefault(len(row["vector"]), []).append((place, row))
    blocks = [
        (
            [r["query_id"] for _, r in rows], [at for at, _ in rows],
            _matrix([r["vector"] for _, r in rows], width), width,
        )
        for width, rows in by_width.items()
    ]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
            books = batch.column("book_id").to_numpy(zero_copy_only=False)
            for query_ids, places, query_matrix, width in blocks:
                seen = None if open_ids is None else _seen(batch, query_ids, places, open_ids)
                matrix = _batch_matrix(batch.column("embedding"), width)
                best = _score_batch(ids, books, matrix, query_ids, query_matrix, k, seen)
                yield pa.RecordBatch.from_pandas(
                    best.astype({"query_id": "int64", "book_id": "int64", "chunk_id": "int64"}),
                    schema=_TOP_SCHEMA, preserve_index=False,
                )

    return embedded.mapInArrow(score, _TOP_DDL)


_TOP_SCHEMA = pa.schema(
    [
        ("query_id", pa.int64()),
        ("book_id", pa.int64()),
        ("chunk_id", pa.int64()),
        ("similarity", pa.float64()),
    ]
)
