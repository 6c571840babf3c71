"""Ranked lexical search with bag deduplication.

Texts are reduced to the words of the items, texts with equal word counts and equal length
factor are one class, each class is scored once, and its documents follow by ascending id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm.common import stored

#: Scores are fixed-point: parts of a thousand, of a billion, and of a hundred.
WEIGHT, GAIN, DAMP = 1000, 1_000_000_000, 12
FLAT, SLOPE = 75, 25


def _term_bytes() -> bytes:
    table = bytearray(range(256))
    for code in range(128):
        char = chr(code)
        table[code] = ord(char.lower() if char.isalnum() else " ")
    return bytes(table)


#: Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, which
#: in UTF-8 have no byte below 128; so cutting bytes gives the same runs as cutting characters.
TERM_BYTES = _term_bytes()


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split(b" ") if text else []


@dataclass(frozen=True)
class Block:
    """Items that are searched for together, and their vocabulary."""

    items: list[tuple[object, Counter]]
    places: dict[bytes, int]


def item_blocks(items: DataFrame, cells: int) -> Iterator[Block]:
    """Blocks of items by ascending id, of at most ``cells`` pairs of item and vocabulary term.

    Texts of one item id are one item. An item without terms is in no block; one with more
    terms than ``cells`` is a block of its own.
    """
    rows = items.select("item_id", F.col("text").cast("string").cast("binary").alias("text"))
    held, places = [], {}
    for item_id, terms in _whole_items(rows.orderBy("item_id").toLocalIterator()):
        more = sum(t not in places for t in terms)
        if held and (len(held) + 1) * (len(places) + more) > cells:
            yield Block(held, places)
            held, places = [], {}
        held.append((item_id, terms))
        for term in terms:
            places.setdefault(term, len(places))
    if held:
        yield Block(held, places)


def _whole_items(rows) -> Iterator[tuple[object, Counter]]:
    """Term counts of each item id; rows come by ascending id."""
    for item_id, texts in groupby(rows, key=lambda r: r["item_id"]):
        terms = Counter()
        for row in texts:
            terms.update(terms_of(row["text"]))
        terms.pop(b"", None)
        if terms:
            yield item_id, terms


BAGS = "row long, doc_id long, n long, bag binary"


def bags(docs: DataFrame, places: dict[bytes, int]) -> DataFrame:
    """Each text as its number of terms and its bag: places and counts of the wanted terms.

    A bag is a run of little-endian 32-bit numbers, first the places, ascending, then their
    counts. ``row`` numbers the rows; it holds once the result is written.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(places)

    def reduce_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = wanted.value.get
        for batch in batches:
            sizes, found = [], []
            for text in batch.column("text").cast(pa.binary()):
                terms = Counter(terms_of(text.as_py()))
                terms.pop(b"", None)
                sizes.append(terms.total())
                spots = sorted((p, c) for t, c in terms.items() if (p := find(t)) is not None)
                found.append(np.array(spots, "<u4").reshape(-1, 2).T.tobytes())
            columns = [batch.column("row"), batch.column("doc_id"), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(found, pa.binary())], ["row", "doc_id", "n", "bag"]
            )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(reduce_texts, BAGS)


def document_counts(bagged: DataFrame, n_places: int) -> np.ndarray:
    """Documents per place: one array per task, summed up in a second step."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_places, np.int64)
        for batch in batches:
            for bag in batch.column("bag"):
                half = np.frombuffer(bag.as_py(), "<u4")
                total[half[: len(half) // 2]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "df"])

    rows = bagged.select("bag").mapInArrow(count, "place long, df long")
    summed = rows.groupBy("place").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(n_places, np.int64)
    out[summed["place"].to_numpy(np.int64)] = summed["df"].to_numpy(np.int64)
    return out


def classes(bagged: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``class_id, doc_id, place, m, bag``: the first ``k`` documents of each class.

    Rows of a class share hash, length factor and the bag itself, so equal hashes of other
    bags stay apart. Each task passes on at most ``k`` rows of a class. The bag stands in
    the first row only.
    """
    factor = F.lit(100 - SLOPE) + F.expr(f"({SLOPE} * n * {n_docs}L) div {max(n_terms, 1)}L")
    # a text without any wanted term scores nothing
    rows = bagged.where(F.length("bag") > 0).select(
        "row", "doc_id", factor.alias("m"), F.xxhash64("bag").alias("_hash"), "bag"
    )
    one = ["_hash", "m", "bag"]
    inside = W.partitionBy(*one).orderBy(F.col("doc_id").asc_nulls_last(), "row")
    first = rows.withColumn("place", F.row_number().over(inside)).where(F.col("place") <= k)
    return first.select(
        F.first("row").over(inside).alias("class_id"), "doc_id", "row", "place", "m",
        F.when(F.col("place") == 1, F.col("bag")).alias("bag"),
    )


def best_classes(
    heads: DataFrame, block: Block, weights: np.ndarray, k: int
) -> DataFrame:
    """``item, class_id, score``: candidates for the ``k`` best classes of each item.

    ``heads`` has one row per class. A task keeps the ``k`` best it has seen of each item,
    ties by the least document id, then the least row.
    """
    counts = np.zeros((len(block.places), len(block.items)), np.int64)
    for j, (_, terms) in enumerate(block.items):
        for term, c in terms.items():
            counts[block.places[term], j] = c
    facts = heads.sparkSession.sparkContext.broadcast((weights, counts))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, by_item = facts.value
        n_items = by_item.shape[1]
        step = max(1, (1 << 21) // n_items)
        kept = [np.zeros((0, 3), np.int64)] * n_items  # score, document, class
        least = np.ones(n_items, np.int64)
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            m = batch.column("m").to_numpy()
            class_id = batch.column("class_id").to_numpy()
            doc = batch.column("doc_id").fill_null((1 << 63) - 1).to_numpy()
            scores = np.zeros((len(m), n_items), np.int64)
            for i, bag in enumerate(batch.column("bag")):
                place, tf = np.frombuffer(bag.as_py(), "<u4").reshape(2, -1).astype(np.int64)
                part = weight[place] * ((GAIN * tf) // (1000 * tf + DAMP * m[i]))
                scores[i] = part @ by_item[place]
            for j in np.flatnonzero((scores >= least).any(axis=0)):
                at = np.flatnonzero(scores[:, j] >= least[j])
                rows = np.concatenate([kept[j], np.stack([scores[at, j], doc[at], class_id[at]], 1)])
                kept[j] = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))][:k]
                if len(kept[j]) == k:
                    least[j] = max(kept[j][-1, 0], 1)
        rows = np.concatenate(kept)
        item = np.repeat(np.arange(n_items), [len(r) for r in kept])
        columns = [item, rows[:, 2], rows[:, 1], rows[:, 0]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns], ["item", "class_id", "first", "score"]
        )

    found = heads.select("class_id", "doc_id", "m", "bag").mapInArrow(
        score, "item long, class_id long, first long, score long"
    )
    order = [F.col("score").desc(), "first", "class_id"]
    place = F.row_number().over(W.partitionBy("item").orderBy(*order))
    return found.withColumn("_place", place).where(F.col("_place") <= k).drop("_place", "first")


def weights_of(df: np.ndarray, n_docs: int) -> np.ndarray:
    found = [math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df]
    return np.array(found, np.int64)


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 20, block_cells: int = 4 << 20
) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id, rank, doc_id, score``.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns of either are not
    looked at. Null and empty texts have no terms. Every row of ``docs`` is a document, so
    repeated rows are ranked one by one; rows of one item_id are one item, and a null item_id
    is an item. Equal scores go by ascending doc_id, a null one last. Items without terms,
    and all items where there is no document, have no rows. Items are searched for in blocks
    of ``block_cells`` pairs of item and term, so a longer list takes more passes and not more
    memory.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    out = None
    for block in item_blocks(items, block_cells):
        bagged = stored(bags(docs, block.places), "bags")
        total = bagged.agg(
            F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")
        ).first()
        df = document_counts(bagged, len(block.places))
        members = stored(classes(bagged, total["docs"], total["terms"], k), "classes")
        heads = members.where("place = 1")
        best = best_classes(heads, block, weights_of(df, total["docs"]), k)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row"]
        place = F.row_number().over(W.partitionBy("item").orderBy(*order))
        ranked = (
            best.join(members.select("class_id", "doc_id", "row"), "class_id")
            .withColumn("rank", place)
            .where(F.col("rank") <= k)
        )
        names = spark.createDataFrame(
            [(i, item_id) for i, (item_id, _) in enumerate(block.items)],
            f"item long, item_id {kind.simpleString()}",
        )
        rows = ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return items.select(
            "item_id", F.lit(1).alias("rank"), F.lit(1).cast("long").alias("doc_id"),
            F.lit(1).cast("long").alias("score"),
        ).where(F.lit(False))
    return out
