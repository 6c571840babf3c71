"""Nested tables of contents."""

from pyspark.sql import functions as F

from foliant.operators import documents
from tests.conftest import rows


def tree(spark, html):
    got = documents.nav_tree(spark.createDataFrame([(1, html)], "doc_id long, html string"))
    return rows(got, "seq", "parent_seq", "depth", "title", "href")


def test_nested_lists(spark):
    html = """<nav epub:type="toc"><h1>x</h1><OL><li><a href="a.xhtml">One <b>1</b></a><ol><li><span>no link</span>
      <ol><li><a class="c" href='b'>Deep</a></li></ol></li><li><a href="c"></a></li></ol></li><li><a>Two</a></li></OL>
      <ol><li><a href="z">second list</a></li></ol></nav>"""
    assert tree(spark, html) == [
        (0, None, 1, "One 1", "a.xhtml"), (1, 0, 2, "Untitled", ""), (2, 1, 3, "Deep", "b"), (3, 0, 2, "", "c"), (4, None, 1, "Two", ""),
    ]


def test_which_nav_counts(spark):
    first = "<nav type='landmarks'><ol><li><a href='l'>L</a></li></ol></nav>"
    toc = "<nav type='toc'><ol><li><a href='t'>T</a></li></ol></nav>"
    assert [r[3] for r in tree(spark, first + toc)] == ["T"]
    assert [r[3] for r in tree(spark, first + "<nav epub:type='toc'>empty</nav>")] == ["L"]
    assert tree(spark, "<nav><ul><li><a href='x'>x</a></li></ul></nav>") == []
    assert tree(spark, "no nav") == [] and tree(spark, None) == []


def test_a_hundred_thousand_entries(spark):
    part = "<li><a href='x'>a</a><ol><li>b</li><li><a href='y'>c</a></li></ol></li>"
    html = "<nav><ol>" + part * 33_334 + "</ol></nav>"
    got = documents.nav_tree(spark.createDataFrame([(1, html)], "doc_id long, html string"))
    found = got.agg(F.count("*"), F.count("parent_seq"), F.sum(F.col("seq") - F.col("parent_seq"))).first()
    assert tuple(found) == (100_002, 66_668, 33_334 * 3)


def test_levels_may_be_skipped(spark):
    flat = [(1, i, level) for i, level in enumerate([3, 1, 4, 2, 4, 4, 3, 1])]
    got = documents.toc_tree(spark.createDataFrame(flat, "doc_id long, seq int, level int"))
    assert rows(got, "seq", "parent_seq") == [(0, None), (1, None), (2, 1), (3, 1), (4, 3), (5, 3), (6, 3), (7, None)]
