"""Books without a title or an author are found by name, in one pass or several."""

from foliant.operators import keyword
from tests.conftest import rows


def test_name_tiers_with_nulls_in_one_and_several_passes(spark):
    books = spark.createDataFrame(
        [(1, "stew.epub", None, None), (2, "b.epub", "Stew", None), (3, "c.epub", None, "Ann Stew"), (4, "d.epub", "x", "y")],
        "book_id long, file_name string, title string, author string",
    )
    queries = spark.createDataFrame([(1, "stew"), (2, "b.epub"), (3, "ann")], "query_id long, text string")
    want = rows(keyword.name_tiers(queries, books))
    assert [r[:2] for r in want] == [(1, 1), (1, 2), (1, 3), (2, 2), (3, 3)]
    assert rows(keyword.name_tiers(queries, books, per_pass=1)) == want
