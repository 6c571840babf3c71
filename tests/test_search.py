"""Search operators on small fixtures, every path against every other."""

import math

import pytest
from pyspark.sql import functions as F

from foliant import constants as K
from foliant.operators import catalog, collections, hybrid, keyword, prompts, vectors
from foliant.operators.matching import match_substrings
from tests.conftest import rows

TEXTS = [
    (1, 0, "the venison stew with venison and beef"),
    (1, 1, "sauces for venisons, hot and cold"),
    (2, 0, "beef and onions"),
    (3, 0, "plain prose about nothing"),
    (3, 1, "Crème brûlée and creme"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    df = spark.createDataFrame(TEXTS, "book_id long, chunk_index int, text string")
    return df.withColumn("chunk_id", F.col("book_id") * 10 + F.col("chunk_index"))


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(
        [(1, "find the VENISON"), (2, "beef crème"), (3, "what is the"), (4, "unicornsteak"), (5, " ")],
        "query_id long, text string",
    )


def _plain_bm25(prefixes):
    split = {(b, c): [w.strip(",").translate(str.maketrans(K.ACCENTED, K.PLAIN)) for w in t.lower().split()] for b, c, t in TEXTS}
    mean = sum(map(len, split.values())) / len(split)
    scores = {}
    for prefix in prefixes:
        found = {k: sum(w.startswith(prefix) for w in ws) for k, ws in split.items()}
        n = sum(f > 0 for f in found.values())
        idf = math.log((len(split) - n + 0.5) / (n + 0.5)) if n else 0
        idf = idf if idf > 0 else K.IDF_FLOOR
        for k, f in found.items():
            if f:
                damp = K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * len(split[k]) / mean)
                scores[k] = scores.get(k, 0) + idf * f * (K.BM25_K1 + 1) / (f + damp)
    return {k: round(v, 6) for k, v in scores.items()}


def test_bm25_paths_agree(spark, chunks, queries):
    terms = keyword.query_terms(queries)
    assert rows(terms) == [(1, "venison"), (2, "beef"), (2, "creme"), (3, "is"), (3, "the"), (3, "what"), (4, "unicornsteak")]
    scan = keyword.bm25(terms, chunks)
    postings = keyword.build_postings(chunks)
    indexed = keyword.bm25_indexed(terms, postings, keyword.chunk_lengths(chunks))
    forced = keyword.bm25(terms, chunks, inline=1)
    want = sorted(
        ((q, b, c, s) for q, p in [(1, ["venison"]), (2, ["beef", "creme"]), (3, ["what", "is", "the"])]
         for (b, c), s in _plain_bm25(p).items()), key=repr)
    for got in (scan, indexed, forced):
        assert rows(got, "query_id", "book_id", "chunk_index", "score") == want


def test_stemmed_terms_match_other_forms(spark, chunks):
    postings = keyword.stem_postings(keyword.build_postings(chunks))
    assert rows(postings.filter("term = 'onion'"), "book_id", "tf") == [(2, 1)]


def test_substring_paths_agree(spark, chunks):
    needles = spark.createDataFrame(
        [(1, "venison"), (2, "be"), (3, "o"), (4, "zzz"), (5, "and"), (6, "venison")], "needle_id long, needle string"
    )
    low = chunks.select("chunk_id", F.lower("text").alias("t"))
    want = sorted(
        ((b * 10 + c, i) for b, c, t in TEXTS for i, n in [(1, "venison"), (2, "be"), (3, "o"), (5, "and"), (6, "venison")] if n in t.lower()),
        key=repr,
    )
    assert rows(match_substrings(low, ["chunk_id"], "t", needles), "chunk_id", "needle_id") == want
    assert rows(match_substrings(low, ["chunk_id"], "t", needles, per_pass=2), "chunk_id", "needle_id") == want
    none = needles.filter("needle_id > 99")
    assert match_substrings(low, ["chunk_id"], "t", none).count() == 0


def test_many_needles_leave_the_scan_as_hits(spark):
    """Thousands of needles take the plan of a few, and only hits leave the task that read a text."""
    texts = spark.range(50).select("id", F.concat(F.lit("qzx tail "), F.hex("id"), F.lit(" end")).alias("t"))
    many = spark.range(3000).select(F.col("id").alias("needle_id"), F.concat(F.lit("zzz"), F.hex("id")).alias("needle"))
    hit = spark.createDataFrame([(9001, "tail 1"), (9002, "x"), (9003, "zx")], "needle_id long, needle string")
    got = match_substrings(texts, ["id"], "t", many.union(hit))
    assert rows(got.groupBy("needle_id").count()) == [(9001, 17), (9002, 50), (9003, 50)]
    shape = lambda df: [x.strip(" +-:*()0123456789").split(" ")[0] for x in df._jdf.queryExecution().sparkPlan().toString().splitlines()]
    # both are unions' parts of one shape
    assert shape(got).count("BroadcastHashJoin") == shape(match_substrings(texts, ["id"], "t", hit)).count("BroadcastHashJoin")
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan


def test_keyword_chunks_stay_in_scope(spark, chunks):
    words = spark.createDataFrame([(1, "venison"), (1, "beef"), (2, "unicornsteak"), (3, "x")], "query_id long, keyword string")
    scope = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "query_id long, book_id long")
    assert rows(keyword.keyword_chunks(words, chunks, scope), "query_id", "chunk_id") == [(1, 10), (1, 11)]
    empty = scope.filter("book_id > 5")
    assert keyword.keyword_chunks(words, chunks, empty).count() == 0


def _one_hot(direction, n=384):
    return [1.0 if i == direction % n else 0.0 for i in range(n)]


def test_vector_topk_paths_agree(spark):
    data = [(i, i % 3, _one_hot(i % 5)) for i in range(40)] + [(90, 0, None), (91, 1, [1.0, 0.0]), (92, 1, [0.0] * 384)]
    chunks = spark.createDataFrame(data, "chunk_id long, book_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, _one_hot(2)), (2, _one_hot(4)), (3, [3.0, 4.0])], "query_id long, vector array<float>")
    plain = rows(vectors.vector_topk(queries, chunks, 9))
    assert rows(vectors.vector_topk(queries, chunks, 9, inline=1)) == plain
    scope = spark.createDataFrame([(q, b) for q in (1, 2, 3) for b in (0, 1, 2)], "query_id long, book_id long")
    assert rows(vectors.vector_topk(queries, chunks, 9, scope).select(*vectors.vector_topk(queries, chunks, 9).columns)) == plain
    best = {r["chunk_id"] for r in vectors.vector_topk(queries, chunks, 8).filter("query_id = 1").collect()}
    assert best == {i for i in range(40) if i % 5 == 2}
    cut = {(r["chunk_id"], r["similarity"]) for r in vectors.vector_topk(queries, chunks, 1).filter("query_id = 3").collect()}
    assert cut == {(91, 0.6)}
    only = spark.createDataFrame([(1, 2)], "query_id long, book_id long")
    assert {r["book_id"] for r in vectors.vector_topk(queries, chunks, 50, only).collect()} == {2}


def test_tiers_and_modes(spark, chunks, queries):
    books = spark.createDataFrame(
        [(1, "game.epub", None, "M. Hank", "epub"), (2, "beef crème.pdf", "x", None, "pdf"), (3, "c.epub", "Unicornsteak", "unicornsteak", "epub")],
        "book_id long, file_name string, title string, author string, format string",
    )
    scores = keyword.bm25(keyword.query_terms(queries), chunks)
    hits = keyword.tiered_search(queries, books, scores)
    named = rows(hits.filter("source = 'name'"), "query_id", "book_id", "rank_value")
    assert named == [(2, 2, 100.0), (4, 3, 50.0)]
    assert hits.filter("query_id = 1").count() == 1
    literal = keyword.tiered_search(queries, books, scores, mode="reference")
    assert literal.filter("source = 'content' and rank_value > 0").count() == 0
    top = keyword.tiered_search(queries, books, scores, per_query=1)
    assert rows(top.filter("query_id = 2"), "book_id") == [(2,)]


def test_snippet_marks_hits(spark):
    words = " ".join(f"w{i}" for i in range(60)) + " Venison stew, venisons too " + " ".join(f"x{i}" for i in range(60))
    hits = spark.createDataFrame([(1, 1, 0, words), (2, 1, 0, "short beef")], "query_id long, book_id long, chunk_index int, text string")
    terms = spark.createDataFrame([(1, "venison"), (1, "stew"), (2, "beef")], "query_id long, prefix string")
    got = {r["query_id"]: r["snippet"] for r in keyword.snippets(hits, terms, width=5).collect()}
    assert got == {1: "...**Venison** **stew**, **venisons** too x0...", 2: "...**beef**"}


def test_blend_gate_suppression_and_fallback(spark):
    recipe = "Tart\nServes 4\nIngredients:\n- 2 cups flour\nInstructions:\nPreheat and bake for 20 minutes"
    data = [(1, 1, 0, recipe), (2, 1, 1, recipe), (3, 1, 2, recipe), (4, 1, 3, "plain prose"), (5, 2, 0, "Index\n" + recipe)]
    chunks = spark.createDataFrame(data, "chunk_id long, book_id long, chunk_index int, text string")
    cands = spark.createDataFrame([(9, 1, 1, 0.9), (9, 1, 2, 0.8), (9, 1, 3, 0.7), (9, 1, 4, 0.99), (9, 2, 5, 0.95)], "query_id long, book_id long, chunk_id long, score double")
    books = spark.createDataFrame([(1, "a.epub", "A", None, "epub"), (2, "b.epub", None, None, "epub")], "book_id long, file_name string, title string, author string, format string")
    none = spark.createDataFrame([], "query_id long, book_id long, rank_value double")
    hints = spark.createDataFrame([], "chunk_id long, score double, title string")
    got = hybrid.hybrid_chunks(cands, none, chunks, hints, books)
    # chunk 2 is next to 1 and goes; 3 is next to 2 only and stays
    assert rows(got, "chunk_id", "rank") == [(1, 1), (3, 3)]
    texts = {r["chunk_id"]: r["full_text"] for r in got.collect()}
    assert texts[1] == f"{recipe}\n\n{recipe}"
    built = hybrid.build_hints(chunks)
    assert rows(built, "chunk_id") == [(1,), (2,), (3,), (5,)]
    hinted = hybrid.hybrid_chunks(cands, none, chunks, built, books)
    assert (5,) in rows(hinted, "chunk_id")
    scores = spark.createDataFrame([(9, 1, 0, 2.0), (9, 2, 0, 50.0), (9, 1, 3, 90.0)], "query_id long, book_id long, chunk_index int, score double")
    back = hybrid.fallback_chunks(none, scores, chunks)
    assert rows(back, "book_id", "chunk_index", "score", "rank") == [(1, 0, 0.3, 1)]
    assert hybrid.fallback_chunks(got, scores, chunks).count() == 0


def test_book_level_blend(spark):
    chunks = spark.createDataFrame([(1, 1, 0, "t" * 1000), (2, 2, 0, "u")], "chunk_id long, book_id long, chunk_index int, text string")
    books = spark.createDataFrame([(i, f"{i}.epub", None, None, "epub") for i in (1, 2, 3)], "book_id long, file_name string, title string, author string, format string")
    hits = spark.createDataFrame([(9, 1, 100.0), (9, 3, 4.0)], "query_id long, book_id long, rank_value double")
    cands = spark.createDataFrame([(9, 1, 1, 0.5), (9, 2, 2, 0.9)], "query_id long, book_id long, chunk_id long, score double")
    got = {r["book_id"]: r for r in hybrid.hybrid_books(hits, cands, chunks, books).collect()}
    assert {b: r["score"] for b, r in got.items()} == {1: 0.7, 2: 0.54, 3: 0.0}
    assert (len(got[1]["snippet"]), len(got[1]["full_text"])) == (200, 1000)
    literal = {r["book_id"]: r["score"] for r in hybrid.hybrid_books(hits, cands, chunks, books, mode="reference").collect()}
    assert literal == {1: 0.3, 2: 0.54, 3: 0.4}


def test_corpus_stats_and_scopes(spark):
    membership = spark.createDataFrame([(1, 10, 0), (2, 10, 0), (3, 11, 0)], "book_id long, collection_id int, date_added long")
    groups = spark.createDataFrame([(10,), (11,), (12,)], "collection_id int")
    chunks = spark.createDataFrame(
        [(1, 1, [1.0]), (2, 1, [1.0]), (3, 1, None), (4, 2, [1.0]), (5, 2, [1.0]), (6, 3, None)], "chunk_id long, book_id long, embedding array<float>"
    )
    hints = spark.createDataFrame([(1, 0.8), (4, 0.55)], "chunk_id long, score double")
    stats = collections.corpus_stats(membership, groups, chunks, hints, chunks.select("book_id"))
    assert rows(stats, "collection_id", "chunks", "embedded_chunks", "hints") == [(10, 5, 4, 2), (11, 1, 0, 0), (12, 0, 0, 0)]
    assert rows(collections.corpus_status(stats)) == [(10, "no_match"), (11, "no_vectors"), (12, "not_indexed")]
    books = spark.createDataFrame([(i, f"/a/Sci{'-x' if i == 2 else ''}/{i}.pdf", None) for i in (1, 2, 3)], "book_id long, file_path string, date_last_opened long")
    scopes = spark.createDataFrame(
        [(1, "folder", None, "/a/Sci", False), (2, "collection", 12, None, False), (3, "collection", 12, None, True)],
        "scope_id long, kind string, collection_id int, folder string, cookbook boolean",
    )
    assert rows(catalog.scope_books(books, membership, scopes)) == [(1, 1), (1, 3)]
    assert rows(catalog.scope_fallback(books, membership, scopes)) == [(1, 1), (1, 3), (2, 1), (2, 2), (2, 3)]


def test_prompt_without_results(spark, queries):
    empty = spark.createDataFrame([], "query_id long, rank int, title string, full_text string, snippet string, book_id long")
    got = prompts.build_prompts(queries, empty).filter("query_id = 4").first()
    assert got["n_excerpts"] == 0
    assert got["prompt"].endswith("User question: unicornsteak<end_of_turn>\n<start_of_turn>model\n")


def test_combined_summaries_split_long_books(spark):
    sections = spark.createDataFrame([(1, i, f"s{i}") for i in range(3)], "book_id long, batch long, summary string")
    got = prompts.combined_summaries(sections)
    assert rows(got, "combined", "n_sections") == [("Section 1: s0\n\nSection 2: s1\n\nSection 3: s2", 3)]


def test_long_scope_lists_take_the_salted_path(spark, monkeypatch):
    books = spark.createDataFrame([(1, "/a/1.pdf", None), (2, "/a/2.pdf", 5)], "book_id long, file_path string, date_last_opened long")
    scopes = spark.createDataFrame([(1, "all"), (2, "recent"), (3, "all")], "scope_id long, kind string")
    plain = rows(catalog._library_wide(books, scopes), "scope_id", "book_id")
    monkeypatch.setattr(catalog, "INLINE_NEEDLES", 1)
    assert rows(catalog._library_wide(books, scopes), "scope_id", "book_id") == plain == [(1, 1), (1, 2), (2, 2), (3, 1), (3, 2)]


def test_stored_corpus_counts_on_every_path(spark):
    """A caller's corpus numbers are used however long the list of terms is."""
    chunks = spark.createDataFrame([(1, 0, "alpha beta beta"), (2, 0, "beta gamma")], "book_id long, chunk_index int, text string")
    terms = spark.createDataFrame([(1, "beta"), (1, "al")], "query_id long, prefix string")
    stored = keyword.corpus_of(keyword.chunk_lengths(chunks.union(chunks.withColumn("book_id", F.col("book_id") + 10))))
    short, long = (keyword.bm25(terms, chunks, stored, inline=n) for n in (512, 0))
    assert rows(short, "book_id", "score") == rows(long, "book_id", "score")
    assert rows(short, "score") != rows(keyword.bm25(terms, chunks), "score")
