"""Batches of chunks where a chunk is missing or a text is empty, as their SQL has them."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from foliant.operators.chunking import pack_batches
from foliant.operators.ordering import running_totals
from foliant.plans.registry import load_all
from tests.conftest import rows

QUERY = load_all()["pack_batches"]


def _compared(spark, folder, texts, vec_ids):
    vectors = [(v, [0.5, 1.0], 0) for v in vec_ids]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(
        f"{folder}/embeddings.parquet"
    )
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = duck.execute(QUERY.check_sql()).fetchall()
    return rows(QUERY.run(spark, str(folder))), sorted(want, key=repr)


TEXTS = [(i, ("ab " * 200) * (i % 5) + "end") for i in range(12)]


@pytest.mark.parametrize("missing", [{0}, {3}, {5, 6, 7}, set(range(1, 19, 4))])
def test_books_end_at_their_first_missing_chunk(spark, tmp_path, missing):
    # twenty vectors whose ids leave room: chunks that fall between find none
    ids = [i + 50 if i in missing else i for i in range(20)]
    got, want = _compared(spark, tmp_path, TEXTS, ids)
    assert 0 < len(want) < sum(-(-len(t) // 600) for _, t in TEXTS)
    assert got == want


def test_empty_and_missing_texts_have_no_chunks(spark, tmp_path):
    texts = [*TEXTS[:4], (20, ""), (21, None), (22, " " * 700), (23, "x")]
    got, want = _compared(spark, tmp_path, texts, range(20))
    assert {r[0] for r in want} == {0, 1, 2, 3, 22, 23}
    assert got == want


def _walk(chunks, limit):
    """``(key, index, batch)`` of one key's chunks, ``(key, index, n_words)`` in their order."""
    out, batch, held = [], 0, 0
    for key, index, n in chunks:
        if out and held + n > limit:
            batch, held = batch + 1, 0
        held += n
        out.append((key, index, batch))
    return out


def test_unbroken_run_over_many_blocks(spark):
    rng = random.Random(3)
    whole, unbroken, data = [], [], []
    for key, size, gap in (("a", 9000, 8500), ("b", 40, 40), ("c", 30, 0), ("d", 20, 1)):
        chunks = [(key, i, rng.randrange(12)) for i in range(size) if i != gap]
        unbroken += _walk([c for c in chunks if c[1] < gap], 10)
        if key == "b":
            chunks = [(key, -2, 1), (key, -1, 1), *chunks]
        whole += _walk(chunks, 10)
        data += [(k, i, "w " * n) for k, i, n in chunks]
    df = spark.createDataFrame(data, "k string, chunk_index int, text string")
    got = pack_batches(df, "k", 10, 2, unbroken=True)
    assert rows(got, "k", "chunk_index", "batch") == sorted(unbroken, key=repr)
    # else nothing is left out
    assert rows(pack_batches(df, "k", 10, 2), "k", "chunk_index", "batch") == sorted(whole, key=repr)


def test_running_totals_are_summed_apart(spark):
    df = spark.createDataFrame([("x", i, i * i) for i in range(30)], "k string, at int, v int")
    got = running_totals(df, ["k"], "at", {"s": F.col("v"), "n": F.lit(1)}, block=7)
    assert got.columns == ["k", "at", "v", "s", "n"]
    assert rows(got, "at", "s", "n") == sorted(
        [(i, sum(j * j for j in range(i)), i) for i in range(30)], key=repr
    )
