"""Ranked search against a plain scorer."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliant.llm import ranked
from foliant.llm.ranked import bags, classes, ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, score string, item_id string"


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def plain(docs, items, k=20):
    bagged = [(i, Counter(terms(t))) for i, t, *_ in docs]
    n_docs = sum(bool(b) for _, b in bagged)
    length = sum(b.total() for _, b in bagged)
    df = Counter(t for _, b in bagged for t in b)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        found = []
        for doc, bag in bagged:
            m = 75 + 25 * bag.total() * n_docs // max(length, 1)
            score = sum(
                c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
                for t, c in wanted.items() if t in bag
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        found.sort()
        out += [(item, i + 1, None if n else d, -s) for i, (s, n, d) in enumerate(found[:k])]
    return sorted(out, key=repr)


def made(seed=3, n=300):
    rng = random.Random(seed)
    words = ["Ab", "ab", "über", "x1", "İs", "the", "of", "a b", "zz"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(12))) + rng.choice(["", ".", "!\n"]) for _ in range(40)]
    docs = [(rng.randrange(10_000), rng.choice(texts), "s", "i") for _ in range(n)]
    docs += [(7, None, "s", "i"), (8, "", "s", "i"), (None, "ab zz", "s", "i"), (9, "ab " * 5000, "s", "i")]
    docs += [docs[0]] * 4
    items = [(i, " ".join(rng.choices(words, k=6))) for i in range(8)]
    return docs, items + [(90, None), (91, " .. "), (92, "nowhere"), (1, "zz zz"), (None, "über")]


@pytest.mark.parametrize("cells", [1, 40, 4 << 20])
def test_equals_plain_scores(spark, cells):
    docs, items = made()
    got = ranked_search(
        spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, "item_id long, text string"),
        block_cells=cells,
    )
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items)


def test_one_group_of_copies_fills_a_list_by_id(spark):
    docs = [(i, "same text", "s", "i") for i in range(200, 0, -1)] + [(0, "other", "s", "i")]
    items = spark.createDataFrame([(1, "same")], "item_id long, text string")
    got = ranked_search(spark.createDataFrame(docs, DOCS), items).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == list(range(1, 21))


def test_equal_hashes_of_other_bags_stay_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a a b", "", ""), (2, "b a a", "", ""), (3, "a b b", "", "")], DOCS)
    bagged = bags(docs, {b"a": 0, b"b": 1}).cache()
    monkeypatch.setattr(ranked.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    found = classes(bagged, 3, 9, 20).groupBy("class_id").agg(F.sort_array(F.collect_list("doc_id")).alias("d"))
    assert sorted(r["d"] for r in found.collect()) == [[1, 2], [3]]


def test_empty_tables(spark):
    docs, items = made(n=3)
    none = spark.createDataFrame([], DOCS)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert ranked_search(none, asked).collect() == []
    assert ranked_search(spark.createDataFrame(docs, DOCS), asked.limit(0)).collect() == []
