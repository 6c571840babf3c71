"""Steps of searches whose cost must follow the text, not its square or the number of readers."""

import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from foliant.functions.scoring import page_type
from foliant.operators import hybrid, keyword
from foliant.operators.matching import match_substrings
from foliant.plans import views
from foliant.plans.registry import load_all
from foliant.sources.keyword_index import build_index
from tests.conftest import rows

FOLDER = os.environ.get("FOLIANT_CHECK_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("others", [0, 500])
def test_long_text_is_cut_in_one_walk(spark, others):
    """Half a million characters; cutting each piece by its place took minutes."""
    text = F.concat(F.expr("array_join(transform(sequence(1, 100000), x -> hex(x * 7919)), ' ')"), F.lit(" é😀 tail"))
    texts = spark.range(1).select("id", F.lower(text).alias("t"))
    hit = spark.createDataFrame([(1, "é😀 t"), (2, "zzzz"), (3, "ai"), (4, "😀")], "needle_id long, needle string")
    more = spark.range(others).select((F.col("id") + 10).alias("needle_id"), F.concat(F.lit("zz"), F.hex("id")).alias("needle"))
    began = time.time()
    got = rows(match_substrings(texts, ["id"], "t", hit.union(more)), "needle_id")
    assert got == [(1,), (3,), (4,)]
    assert time.time() - began < 40


def test_postings_need_no_shuffle(spark):
    data = [(1, 0, "b a, B! é e"), (1, 1, ""), (2, 0, None), (2, 1, " . "), (2, 2, "x")]
    chunks = spark.createDataFrame(data, "book_id long, chunk_index int, text string")
    made = keyword.sized_postings(chunks)
    assert rows(made, "term", "book_id", "chunk_index", "tf", "length") == [
        ("a", 1, 0, 1, 5), ("b", 1, 0, 2, 5), ("e", 1, 0, 2, 5), ("x", 2, 2, 1, 1)
    ]
    assert "Exchange" not in made._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" not in keyword.build_postings(chunks)._jdf.queryExecution().sparkPlan().toString()


def test_gate_without_stored_hints_scores_texts_once(spark):
    recipe = "Tart\nServes 4\nIngredients:\n- 2 cups flour\nInstructions:\nPreheat and bake for 20 minutes"
    data = [(1, 1, 0, recipe), (2, 1, 1, "Simmer for 2 hours"), (3, 1, 2, "prose"), (4, 2, 0, "Index\n" + recipe), (5, 2, 1, None)]
    chunks = spark.createDataFrame(data, "chunk_id long, book_id long, chunk_index int, text string")
    found = chunks.select(F.lit(9).cast("long").alias("query_id"), "book_id", "chunk_id", F.lit(0.5).alias("score"))
    none = spark.createDataFrame([], "query_id long, book_id long, rank_value double")
    stored = hybrid.gated_chunks(found, none, chunks, hybrid.build_hints(chunks))
    assert rows(hybrid.gated_chunks(found, none, chunks)) == rows(stored)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_narrow_queries_write_no_whole_table(spark, monkeypatch):
    """Queries that need a few columns once don't have texts and vectors written first."""
    monkeypatch.setattr(views, "_KEPT_PATHS", {})
    for name in ("scoped_chunks", "hint_lookup", "cascade_delete"):
        assert load_all()[name].run(spark, FOLDER).limit(1).count() == 1
    made = {key[-1] for key in views._KEPT_PATHS}
    assert not made & {"chunk_vec", "cook_chunk", "index"}


def test_short_query_lists_search_the_texts_once(spark):
    """Counting the chunks of a prefix and summing up scores read the same written hits."""
    chunks = spark.createDataFrame([(1, 0, "beef stew"), (2, 0, "beef"), (3, 0, "none")], "book_id long, chunk_index int, text string")
    terms = spark.createDataFrame([(1, "beef"), (2, "st")], "query_id long, prefix string")
    scores = keyword.bm25(terms, chunks)
    assert scores.count() == 3
    assert "split" not in scores._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", ["fallback_chunks", "fallback_chunks_scoped"])
def test_cookbook_texts_are_searched_once(spark, monkeypatch, name):
    """The answered queries and the fallback start from the same scores."""
    asked, bm25 = [], keyword.bm25
    monkeypatch.setattr(keyword, "bm25", lambda *a, **k: asked.append(1) or bm25(*a, **k))
    load_all()[name].run(spark, FOLDER)
    assert len(asked) == 1


def test_one_walk_gives_words_and_lengths(spark):
    """Accents, words inside words and letters beyond the first plane."""
    data = [(1, 0, "The thing 𝐚the the. Thé é𝐚 x²the ÜBER-the"), (1, 1, None), (2, 0, ""), (2, 1, "roast Roasting ³roast")]
    chunks = spark.createDataFrame(data, "book_id long, chunk_index int, text string")
    asked = [(1, "the"), (1, "th"), (2, "roast"), (3, "a+b"), (2, "uber"), (2, "𝐚")]
    terms = spark.createDataFrame(asked, "query_id long, prefix string")
    scores = keyword.bm25(terms, chunks)
    assert rows(scores) == rows(keyword.bm25(terms, chunks, inline=1))
    assert "regexp" not in scores._jdf.queryExecution().optimizedPlan().toString()


def test_few_prefixes_are_counted_as_literals(spark, monkeypatch):
    """Same counts as the walk, which a few prefixes don't take."""
    data = [(1, 0, "The thing 𝐚the the. Thé é𝐚 x²the ÜBER-the über 😀the"), (1, 1, None), (2, 0, ""), (2, 1, "roast Roasting ³roast thethe")]
    chunks = spark.createDataFrame(data, "book_id long, chunk_index int, text string")
    asked = [(1, "the"), (1, "th"), (2, "roast"), (3, "a+b"), (2, "uber"), (2, "𝐚")]
    terms = spark.createDataFrame(asked, "query_id long, prefix string")
    low = chunks.select("book_id", "chunk_index", F.lower("text").alias("_low"))
    owners, prefixes = keyword._owners(terms.collect())
    few = rows(keyword._counted_starts(low, owners, prefixes).filter("book_id = 1 AND chunk_index = 0 OR book_id = 2"))
    many = rows(keyword._walked_words(low, owners, prefixes).filter("book_id = 1 AND chunk_index = 0 OR book_id = 2"))
    assert few == many
    monkeypatch.setattr(keyword, "_walked_words", None)
    assert keyword.bm25(terms, chunks).count() > 0


def test_leader_lines_are_counted_where_dots_are(spark):
    texts = ["a .... b\nc . . . d\ne ..... f", "a .... b\nc", "a\nb\nc", None]
    data = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    got = rows(data.select("i", page_type(F.col("text")).alias("kind")))
    assert got == [(0, "contents"), (1, "content"), (2, "content"), (3, "content")]


def test_top_lists_pick_their_texts_where_they_are_read(spark, tmp_path):
    """A table of texts is not shuffled for the neighbours and names of a few hits."""
    whole = spark.range(4000).select(
        F.col("id").alias("chunk_id"), F.floor(F.col("id") / 8).alias("book_id"), (F.col("id") % 8).cast("int").alias("chunk_index"),
        F.concat(F.lit("Preheat, bake, stir 2 cups of 20 minutes "), F.sha2(F.col("id").cast("string"), 512)).alias("text"),
    )
    whole.write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    books = chunks.select("book_id", F.col("text").alias("title"), F.col("text").alias("file_name"), F.lit("a").alias("author"), F.lit("f").alias("format"))
    found = chunks.filter("chunk_id % 1000 = 1").select(F.lit(9).cast("long").alias("query_id"), "book_id", "chunk_id", F.lit(0.5).alias("score"))
    hits = spark.createDataFrame([], "query_id long, book_id long, rank_value double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40000")
    try:
        made = hybrid.hybrid_chunks(found, hits, chunks, None, books.dropDuplicates(["book_id"]))
        plan = made._jdf.queryExecution().sparkPlan().toString()
        assert made.count() == 4
        named = hybrid.hybrid_books(hits, found, chunks, books.dropDuplicates(["book_id"]), limit=3)
        more = named._jdf.queryExecution().sparkPlan().toString()
        assert named.count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("LeftSemi, BuildRight") >= 2 and more.count("LeftSemi, BuildRight") >= 2


def test_range_sample_does_not_cut_texts_again(spark, tmp_path, monkeypatch):
    dealt, plain = [], DataFrame.repartitionByRange

    def seen(df, *columns):
        dealt.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, *columns)

    monkeypatch.setattr(DataFrame, "repartitionByRange", seen)
    chunks = spark.createDataFrame([(1, 0, "beef stew"), (2, 0, "beef")], "book_id long, chunk_index int, text string")
    build_index(spark, str(tmp_path), chunks)
    assert dealt and not any("text" in p for p in dealt)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_library_search_looks_up_no_texts(spark, monkeypatch):
    monkeypatch.setattr(hybrid, "hybrid_books", None)
    assert load_all()["library_search"].run(spark, FOLDER).columns == ["query_id", "book_id", "score"]
