"""Language identification: held-out accuracy, rejection, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm.language import LanguageParams, fit, held_out, identify, subwords, code_points, text_totals
from foliant.llm.queries import QUERIES

SOUNDS = {"aa": "kalemu nito pera", "bb": "schröd ungs weich", "cc": "été ouvrir ellement"}
SMALL = LanguageParams(sample=300, epochs=6, buckets=1 << 10)
SCHEMA = "doc_id long, text string, lang string, score string, source string"


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(1)
    rows = []
    for i in range(240):
        lang = rng.choice(list(SOUNDS))
        rows.append((i, " ".join(rng.choices(SOUNDS[lang].split(), k=rng.randrange(3, 60))), lang, "s", "x"))
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !?", "cc"), (903, "kalemu nito", None), (None, "weich ungs", None)]
    rows += [(*r, None, None) for r in odd] + [rows[0]] * 2 + [(905, "été " * 200_000, None, None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_learns_and_states_every_row(made):
    rows, docs = made
    got = identify(docs, SMALL).cache()
    assert got.columns == ["doc_id", "text", "lang", "source", "held_out", "lang_pred", "score", "rejected"]
    assert got.count() == len(rows)
    wrong = got.where("length(text) > 9 AND lang IS NOT NULL AND lang <> lang_pred").count()
    assert wrong == 0
    none = got.where("lang_pred = 'und'").select("doc_id", "score", "rejected").collect()
    assert sorted(map(tuple, none)) == [(900, 0.0, True), (901, 0.0, True), (902, 0.0, True)]
    assert got.where("doc_id = 905").first()["lang_pred"] == "cc"
    assert got.where("doc_id IS NULL").first()["lang_pred"] == "bb"
    assert got.where("score < 0 OR score > 1").count() == 0


def test_held_out_rows_teach_nothing(made):
    _, docs = made
    lies = docs.withColumn("lang", F.when(held_out(), "liar").otherwise(F.col("lang")))
    model = fit(lies.select("doc_id", "text", "lang"), SMALL)
    assert model.langs == ["aa", "bb", "cc"]
    same = fit(docs.select("doc_id", "text", "lang"), SMALL)
    assert (model.table == same.table).all() and model.threshold == same.threshold


def test_strange_texts_are_rejected(made, spark):
    _, docs = made
    more = docs.unionByName(spark.createDataFrame([(5000, "жжж ыыы щщщ", None, None, None)], SCHEMA))
    assert identify(more, SMALL).where("doc_id = 5000").first()["rejected"]


def test_nothing_labelled(spark):
    docs = spark.createDataFrame([(1, "abc", None, None, None)], SCHEMA)
    assert identify(docs, SMALL).select("lang_pred", "score", "rejected").collect() == [("und", 0.0, True)]
    assert identify(docs.limit(0), SMALL).collect() == []


def test_names_with_blanks_and_structs(made):
    _, docs = made
    odd = docs.withColumn("a b", F.struct("source", F.lit(1).alias("x y"))).withColumn("held_out", F.lit(3))
    got = identify(odd, SMALL)
    assert "a b" in got.columns and got.where("held_out").count() > 0


def test_subwords_are_letters_with_edges():
    params = LanguageParams()
    text = "ab c1d"
    seen = sorted((size, int(i)) for size, (at, _) in enumerate(subwords(code_points(text), params), 1) for i in at)
    letters = [c.isalpha() for c in text]
    want = [
        (n, i) for n in range(1, 5) for i in range(len(text) - n + 1)
        if all(letters[i + 1 : i + n - 1]) and (letters[i] or letters[i + n - 1])
    ]
    assert seen == want


def test_long_texts_are_read_whole(made):
    _, docs = made
    model = fit(docs.select("doc_id", "text", "lang"), SMALL)
    texts = ["kalemu nito été " * 300, None, "x", "ouvrir"]
    whole = text_totals(texts, model, SMALL)
    cut = text_totals(texts, model, LanguageParams(buckets=1 << 10, chunk_chars=100))
    assert (whole[1] == cut[1]).all() and np.allclose(whole[0], cut[0])


def test_held_out_accuracy_of_the_query(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op11_language_id"](spark, folder)
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    right = got.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")))
    assert right.first()[0] > 0.98
