"""Books found by name or keyword only bring text of their own."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import hybrid, keyword
from foliant.plans.registry import load_all
from tests.test_checks import FOLDER
from tests.conftest import rows


def test_snippets_of_hits(spark):
    hits = spark.createDataFrame(
        [(9, 1, "name", 100.0, None), (9, 2, "name", 50.0, None), (9, 3, "name", 40.0, None), (9, 4, "content", 2.0, 1)],
        "query_id long, book_id long, source string, rank_value double, chunk_index int",
    )
    books = spark.createDataFrame(
        [(i, f"{i}.epub", "T", "Ann", "epub") for i in (1, 2, 3, 4)], "book_id long, file_name string, title string, author string, format string"
    )
    chunks = spark.createDataFrame([(4, 0, "nothing"), (4, 1, "a stew of beef")], "book_id long, chunk_index int, text string")
    terms = spark.createDataFrame([(9, "stew")], "query_id long, prefix string")
    cut = keyword.hit_snippets(hits, books, chunks, terms)
    want = [(9, 1, "Filename: 1.epub"), (9, 2, "Title match"), (9, 3, "Author: Ann"), (9, 4, "...**stew** of beef")]
    assert rows(cut, "query_id", "book_id", "snippet") == want
    none = spark.createDataFrame([], "query_id long, book_id long, chunk_id long, score double")
    parts = chunks.withColumn("chunk_id", F.col("book_id") * 10 + F.col("chunk_index"))
    got = hybrid.hybrid_books(hits, none, parts, books, cut)
    assert rows(got, "query_id", "book_id", "full_text") == want


@pytest.mark.parametrize("name", ["hybrid_books"])
def test_no_book_without_text(spark, name):
    got = load_all()[name].run(spark, FOLDER)
    assert got.filter("chunk_id IS NULL").count() > 0
    assert got.filter("trim(snippet) = '' OR trim(full_text) = ''").count() == 0
