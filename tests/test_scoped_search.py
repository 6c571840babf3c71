"""Searches that see only the books of their scope."""

import random

import numpy as np

from foliant.operators import catalog, vectors
from tests.conftest import rows


def test_masks_equal_plain_search(spark):
    rng = random.Random(2)
    vector = lambda: [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(6)]
    chunks = [(i, i % 7, vector()) for i in range(80)] + [(900, 1, None), (901, 1, [1.0, 2.0])]
    asked = [(1000 + q, vector()) for q in range(70)] + [(5, [1.0, 1.0])]
    scope = [(q, b) for q, _ in asked for b in range(7) if (q + b) % 3 == 0 and q % 10] + [(77, 1)]
    scope += scope[:5]
    everywhere = [(q,) for q, _ in asked if q % 10 == 0 and q % 20 == 0]
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    want = []
    for q, v in asked:
        free = (q,) in everywhere
        found = [
            (-(round(float(unit(e) @ unit(v)), 6) + 0.0 if len(e) == len(v) else 0.0), c, b)
            for c, b, e in chunks if e is not None and (free or (q, b) in scope)
        ]
        want += [(q, b, c, -s) for s, c, b in sorted(found)[:4]]
    df = spark.createDataFrame(chunks, "chunk_id long, book_id long, embedding array<float>")
    queries = spark.createDataFrame(asked, "query_id long, vector array<float>")
    pairs = spark.createDataFrame(scope, "query_id long, book_id long")
    free = spark.createDataFrame(everywhere, "query_id long")
    for inline in (4096, 20):
        got = vectors.vector_topk(queries, df, 4, pairs, free, inline)
        found = [(q, b, c, s + 0.0) for q, b, c, s in rows(got, "query_id", "book_id", "chunk_id", "similarity")]
        assert found == sorted(((q, b, c, s + 0.0) for q, b, c, s in want), key=repr)


def test_an_empty_scope_gives_nothing(spark):
    df = spark.createDataFrame([(1, 1, [1.0])], "chunk_id long, book_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "query_id long, vector array<float>")
    scope = spark.createDataFrame([(2, 1)], "query_id long, book_id long")
    none = spark.createDataFrame([], "query_id long")
    assert rows(vectors.vector_topk(queries, df, 3, scope, none), "query_id") == [(2,)]
    assert vectors.vector_topk(queries, df, 3, scope.limit(0), none).count() == 0
    assert vectors.vector_topk(queries.limit(0), df, 3, scope, none).count() == 0
    hits = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.5), (2, 9, 0.1), (3, 9, 0.1)], "query_id long, book_id long, score double")
    free = spark.createDataFrame([(3,), (3,)], "query_id long")
    assert rows(catalog.in_scope(hits, scope.union(scope), free)) == [(2, 1, 0.5), (3, 9, 0.1)]


def test_no_row_holds_two_vectors(spark):
    df = spark.createDataFrame([(1, 1, [1.0])], "chunk_id long, book_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<float>")
    scope = spark.createDataFrame([(1, 1)], "query_id long, book_id long")
    plan = vectors.vector_topk(queries, df, 3, scope)._jdf.queryExecution().optimizedPlan().toString()
    assert "vector" not in plan and "CartesianProduct" not in plan


def test_whole_libraries_stay_a_flag(spark):
    books = spark.createDataFrame([(i, f"/a/{i}.pdf", None) for i in range(5)], "book_id long, file_path string, date_last_opened long")
    members = spark.createDataFrame([(2, 7)], "book_id long, collection_id int")
    scopes = spark.createDataFrame(
        [(1, "all", None, None), (2, "collection", 7, None), (3, "recent", None, None)], "scope_id long, kind string, collection_id int, folder string"
    )
    some, whole = catalog.lazy_scope(books, members, scopes)
    assert rows(some, "scope_id", "book_id") == [(2, 2)] and rows(whole) == [(1,)]
