"""The stored keyword index: searches without text, range filters, replaced books."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import keyword
from foliant.plans.views import Library
from foliant.sources.keyword_index import build_index, compact_index, open_index, replace_in_index
from tests.conftest import rows

CHUNKS = "book_id long, chunk_index int, text string"
TEXTS = [
    (1, 0, "Venison stew with onion"), (1, 1, "more venison, Crème brûlée"), (2, 0, "beef and crème"),
    (3, 0, "what is the stewpot"), (3, 1, "..."), (4, 0, "a b c stew"),
]


@pytest.fixture
def terms(spark):
    return spark.createDataFrame([(1, "stew"), (1, "ven"), (2, "creme"), (3, "zzz")], "query_id long, prefix string")


def scores(terms, index, inline=512):
    got = keyword.bm25_stored(terms, index.postings, index.corpus, inline)
    return rows(got, "query_id", "book_id", "chunk_index", "score")


def test_search_equals_search_of_texts(spark, terms, tmp_path):
    chunks = spark.createDataFrame(TEXTS, CHUNKS)
    build_index(spark, str(tmp_path), chunks)
    index = open_index(spark, str(tmp_path))
    want = rows(keyword.bm25(terms, chunks), "query_id", "book_id", "chunk_index", "score")
    assert scores(terms, index) == want
    assert scores(terms, index, inline=0) == want
    nothing = terms.filter("query_id > 9")
    assert scores(nothing, index) == []


def test_prefixes_reach_the_scan_and_no_text_is_read(spark, terms, tmp_path):
    build_index(spark, str(tmp_path), spark.createDataFrame(TEXTS, CHUNKS))
    index = open_index(spark, str(tmp_path))
    plan = keyword.bm25_stored(terms, index.postings, index.corpus)._jdf.queryExecution().toString()
    assert "StringStartsWith(term,stew)" in plan and "StringStartsWith(term,ven)" in plan
    assert "text" not in plan.split("== Physical Plan ==")[1]


def test_files_hold_term_ranges(spark, tmp_path):
    many = spark.range(400).select(
        F.col("id").alias("book_id"), F.lit(0).alias("chunk_index"),
        F.concat(F.hex(F.xxhash64("id")), F.lit(" the")).alias("text"),
    )
    # these few rows would fit one file
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    build_index(spark, str(tmp_path), many)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    postings = spark.read.parquet(str(tmp_path / "postings"))
    files = postings.groupBy(F.input_file_name().alias("f")).agg(F.min("term").alias("lo"), F.max("term").alias("hi"))
    spans = sorted((r["lo"], r["hi"]) for r in files.collect())
    assert len(spans) > 1
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    # a term of every book isn't kept together
    assert postings.filter("term = 'the'").select(F.input_file_name()).distinct().count() > 1


def test_replaced_and_deleted_books(spark, terms, tmp_path):
    path = str(tmp_path / "a")
    build_index(spark, path, spark.createDataFrame(TEXTS, CHUNKS))
    fresh = spark.createDataFrame([(2, 0, "stew of beef"), (2, 1, "creme"), (7, 0, "venison"), (8, 0, "not in scope")], CHUNKS)
    scope = spark.createDataFrame([(2,), (4,), (7,), (2,)], "book_id long")
    replace_in_index(spark, path, fresh, scope)
    replace_in_index(spark, path, fresh.filter("book_id = 7"), scope.filter("book_id = 7"))
    now = [t for t in TEXTS if t[0] not in (2, 4)] + [(2, 0, "stew of beef"), (2, 1, "creme"), (7, 0, "venison")]
    want = rows(keyword.bm25(terms, spark.createDataFrame(now, CHUNKS)), "query_id", "book_id", "chunk_index", "score")
    index = open_index(spark, path)
    assert index.generations == 3 and index.corpus.chunks == len(now)
    assert scores(terms, index) == want
    compact_index(spark, path, str(tmp_path / "b"))
    small = open_index(spark, str(tmp_path / "b"))
    assert small.generations == 1 and scores(terms, small) == want


def test_a_build_that_stopped_early_is_not_seen(spark, terms, tmp_path):
    path = str(tmp_path)
    build_index(spark, path, spark.createDataFrame(TEXTS, CHUNKS))
    before = scores(terms, open_index(spark, path))
    # postings of the next generation were written, its line in the head was not
    spark.createDataFrame([("stew", 99, 0, 1, 1)], "term string, book_id long, chunk_index int, tf long, length int").write.parquet(f"{path}/postings/generation=1")
    assert scores(terms, open_index(spark, path)) == before
    replace_in_index(spark, path, spark.createDataFrame([(5, 0, "stew")], CHUNKS), spark.createDataFrame([(5,)], "book_id long"))
    assert {r[1] for r in scores(terms, open_index(spark, path))} == {1, 2, 3, 4, 5}


def test_kept_tables_follow_their_input(spark, tmp_path):
    def write(texts):
        data = [(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
        df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")

    write(["one", "two"])
    first = Library(spark, str(tmp_path))
    assert rows(first.text_chunk, "text") == [("one",), ("two",)]
    assert Library(spark, str(tmp_path)).text_chunk.inputFiles() == first.text_chunk.inputFiles()
    write(["three"])
    assert rows(Library(spark, str(tmp_path)).text_chunk, "text") == [("three",)]


def test_libraries_of_two_folders_stay_apart(spark, tmp_path):
    for name in "ab":
        spark.createDataFrame([("1", name)], "region string, r_name string").selectExpr(
            "CAST(1 AS INT) AS r_regionkey", "r_name"
        ).write.parquet(f"{tmp_path}/{name}/region.parquet")
    one, two = Library(spark, f"{tmp_path}/a"), Library(spark, f"{tmp_path}/b")
    assert rows(one.region, "r_name") == [("a",)]
    assert rows(two.collection_group, "name") == [("b",)]
    assert rows(one.collection_group, "name") == [("a",)]
