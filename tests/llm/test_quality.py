import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from foliant.llm.quality import QualityParams, base_counts, clean_documents, fit, fit_threshold, quality_rules
from foliant.llm.queries import QUERIES


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_counts(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
TEXTS = [None, "", " \t\r\n\x0b\x0c", "a", "a b a b a b a", "x y z x y z", "é # ** $%&|<>\n\nb\nb\n b\nb", "\n".join(["same line of words here"] * 30), "a " * 200, "b\xa0c d \x1f \x85", "ab c a bc ab c"]


def test_counts(spark, docs):
    rows = list(enumerate(TEXTS)) + [(None, "p q r p q r p q"), (0, TEXTS[0])]
    got = base_counts(docs(rows)).select("doc_id", *NAMES).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *brute_counts(t)) for i, t in rows), key=repr)


def bucket(gram, n):
    h = xxhash.xxh64_intdigest(gram.encode(), seed=42)
    return (h - (1 << 64) if h >> 63 else h) % n


def test_whole_operator(spark, docs):
    good = [(i, " ".join(f"word{(i * 7 + k * k) % 90}" for k in range(60))) for i in range(20)]
    bad = [(100 + i, " ".join(f"JUNK{(i * 5 + k * 3) % 97}!!" for k in range(60))) for i in range(10)]
    rows = good + bad + [(200, "short"), (201, None), (None, good[0][1])]
    labels = [(i, 1, 0) for i in range(0, 20, 2)] + [(100 + i, 0, 0) for i in range(0, 10, 2)] + [(1, 1, 1), (3, None, None), (None, 1, 0)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    params = QualityParams(buckets=256)
    model = fit(docs(rows), marks, params)
    raw, target = Counter(), Counter()
    grams = lambda t: [g for w in words(t) for g in (w, " " + w[-3:])]
    for i, t in rows:
        raw.update(bucket(g, 256) for g in grams(t))
        if i is not None and i < 20 and i % 2 == 0:
            target.update(bucket(g, 256) for g in grams(t))
    n_raw, n_target = sum(raw.values()) + 256, sum(target.values()) + 256
    want = [math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw) for b in range(256)]
    assert model.ratios == pytest.approx(want, abs=1e-8)
    got = quality_rules(docs(rows), marks, params).collect()
    assert len(got) == len(rows)
    for r in got:
        g = grams(r.text)
        assert r.score == pytest.approx(sum(want[bucket(x, 256)] for x in g) / len(g) if g else 0.0, abs=1e-6)
        n, repeat = r.n_words, r.n_repeat_words
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert r.kept == (not r.base_failed and r.score >= model.threshold)
    assert {r.doc_id for r in got if r.kept} == {*range(20), None}
    clean = clean_documents(docs(rows), marks)
    assert clean.columns == docs(rows).columns


def test_without_rows_or_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules(docs([]), none).count() == 0
    (row,) = quality_rules(docs([(1, " ".join(f"w{i}" for i in range(70)))]), none).collect()
    assert row.kept


def test_every_label_counts(spark):
    """More trusted texts than a bounded sample held: with all texts trusted no ratio differs from 0."""
    docs = spark.range(9_000).selectExpr("id AS doc_id", "concat('word ', id % 7, ' tail') AS text")
    marks = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    assert set(fit(docs, marks, QualityParams(buckets=64)).ratios) == {0.0}


def test_threshold_is_the_exact_quantile_of_all_scores(spark):
    ids = spark.range(0, 40_000)
    scored = ids.selectExpr("id AS doc_id", "60L AS n_words", "IF(id % 20000 = 0, 60L, 0L) AS n_repeat_words", "CAST((id * 7919) % 20000 AS double) AS score")
    marks = ids.selectExpr("id AS doc_id", "IF(id < 20000, 1, 0) AS quality", "0 AS toxic")
    # base rule drops score 0 of both classes: 1..19999 remain; places 20 and 19800
    assert fit_threshold(scored, marks) == 20.0
    assert fit_threshold(scored.withColumn("score", F.when(F.col("doc_id") < 20_000, F.col("score")).otherwise(-1.0)), marks) == 9.5
    assert fit_threshold(scored, marks.where("quality = 0")) == -1e9


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op7_quality_rules"](spark, folder).collect()
    texts = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert {(r.doc_id, *(r[n] for n in NAMES)) for r in got} == {(d.doc_id, *brute_counts(d.text)) for d in texts}
    good = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").collect()}
    assert all(r.kept for r in got if r.doc_id in good and not r.base_failed)
