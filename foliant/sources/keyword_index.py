"""A stored keyword index: postings sorted by term, and what each book adds to the corpus.

An index is a list of generations. The first holds all books, each later one the books that
were indexed again or deleted since. A generation's files are written first and its line in
``head`` last, so readers see all of it or nothing, and a build that is run again after a
failure overwrites its own folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.keyword import Corpus, chunk_lengths, sized_postings
from foliant.session import measured

HEAD = "generation long"
#: Small row groups, so that a term's range selects few of them.
ROW_GROUP_BYTES = 4 << 20


@dataclass(frozen=True)
class KeywordIndex:
    """``postings``: term, book_id, chunk_index, tf, length, sorted by term in each file."""

    postings: DataFrame
    corpus: Corpus
    generations: int


def _head(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HEAD).parquet(f"{path}/head")


def _write(spark: SparkSession, path: str, number: int, chunks: DataFrame, books: DataFrame) -> None:
    place = ["book_id", "chunk_index"]
    lengths = chunk_lengths(chunks)
    own = (
        lengths.groupBy("book_id")
        .agg(F.count("*").alias("n_chunks"), F.sum("length").alias("n_words"))
    )
    stats = books.select("book_id").distinct().join(own, "book_id", "left").select(
        "book_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
        F.coalesce("n_words", F.lit(0)).alias("n_words"),
    )
    # the sample for the ranges reads what is written here; it would cut every text once more
    cut = measured(sized_postings(chunks))
    # the place is part of the range, so a term that stands everywhere spreads over many files
    (
        cut.repartitionByRange("term", *place)
        .sortWithinPartitions("term", *place)
        .write.mode("overwrite")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .parquet(f"{path}/postings/generation={number}")
    )
    stats.write.mode("overwrite").parquet(f"{path}/books/generation={number}")
    line = spark.createDataFrame([(number,)], HEAD).coalesce(1)
    line.write.mode("overwrite").parquet(f"{path}/head/part={number}")


def build_index(spark: SparkSession, path: str, chunks: DataFrame) -> None:
    """Index ``chunks`` (book_id, chunk_index, text) as the first generation."""
    _write(spark, path, 0, chunks, chunks)


def replace_in_index(spark: SparkSession, path: str, chunks: DataFrame, scope: DataFrame) -> None:
    """Index the books of ``scope`` (book_id) anew from ``chunks``; books without chunks go.

    The cost is that of the new books' postings; older ones are hidden, not rewritten, until
    :func:`compact_index`.
    """
    last = _head(spark, path).agg(F.max("generation")).first()[0]
    ids = scope.select("book_id").distinct()
    _write(spark, path, last + 1, chunks.join(ids, "book_id", "left_semi"), ids)


def _books(spark: SparkSession, path: str, generations: list[int]) -> DataFrame:
    """The latest numbers of each book and the generation they are from."""
    rows = None
    for number in generations:
        one = spark.read.parquet(f"{path}/books/generation={number}").withColumn(
            "generation", F.lit(number).cast("long")
        )
        rows = one if rows is None else rows.unionByName(one)
    if len(generations) == 1:
        return rows
    latest = rows.groupBy("book_id").agg(
        F.max_by(F.struct("n_chunks", "n_words", "generation"), "generation").alias("_last")
    )
    return latest.select("book_id", "_last.*")


def open_index(spark: SparkSession, path: str) -> KeywordIndex:
    """The index as of now. Only a changed index looks at which books changed."""
    generations = sorted(r["generation"] for r in _head(spark, path).select("generation").collect())
    rows = None
    for number in generations:
        one = spark.read.parquet(f"{path}/postings/generation={number}")
        one = one.withColumn("_generation", F.lit(number).cast("long"))
        rows = one if rows is None else rows.unionByName(one)
    books = _books(spark, path, generations)
    if len(generations) > 1:
        changed = books.filter("generation > 0").select(
            "book_id", F.col("generation").alias("_latest")
        )
        rows = rows.join(changed, "book_id", "left").filter(
            F.col("_generation") >= F.coalesce("_latest", F.lit(0))
        )
    total = books.agg(F.sum("n_chunks"), F.sum("n_words")).first()
    n_chunks = int(total[0] or 0)
    mean = int(total[1] or 0) / n_chunks if n_chunks else 0.0
    columns = ["term", "book_id", "chunk_index", "tf", "length"]
    return KeywordIndex(rows.select(*columns), Corpus(n_chunks, mean), len(generations))


def compact_index(spark: SparkSession, path: str, target: str) -> None:
    """Write the live postings of the index at ``path`` as one generation at ``target``."""
    index = open_index(spark, path)
    generations = sorted(r["generation"] for r in _head(spark, path).select("generation").collect())
    place = ["book_id", "chunk_index"]
    (
        index.postings.repartitionByRange("term", *place)
        .sortWithinPartitions("term", *place)
        .write.mode("overwrite")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .parquet(f"{target}/postings/generation=0")
    )
    books = _books(spark, path, generations).filter("n_chunks > 0")
    books.select("book_id", "n_chunks", "n_words").write.mode("overwrite").parquet(
        f"{target}/books/generation=0"
    )
    line = spark.createDataFrame([(0,)], HEAD).coalesce(1)
    line.write.mode("overwrite").parquet(f"{target}/head/part=0")
