"""Phrase mining against plain counting, with big numbers and odd rows."""

from collections import Counter
from functools import lru_cache
import re

import pytest
from pyspark.sql import functions as F

from foliant.llm import phrases
from foliant.llm.phrases import PhraseParams, collocations, frequent_phrases

SCHEMA = "doc_id long, lang string, text string, size int"
SMALL = PhraseParams(least=4, per_lang=50, one_in=3, chunk_bytes=64)


def plain(rows, p):
    totals, counts = Counter(), Counter()
    for _, lang, text, _ in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, p.longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    found = {key: n for key, n in counts.items() if n >= p.least and len(key[1]) > 1}

    def inside(key):
        lang, w = key
        return any(
            other[0] == lang and len(other[1]) > len(w) and found[other] >= found[key]
            and any(other[1][i : i + len(w)] == w for i in range(len(other[1])))
            for other in found
        )

    out = {}
    for (lang, w), a in found.items():
        if inside((lang, w)):
            continue
        n = totals[lang]
        cuts = [
            (1000 * a * n // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))
        ]
        score, k = min(cuts)
        row = (" ".join(w), a, counts[lang, w[:k]], counts[lang, w[k:]], n, score)
        out.setdefault(lang, []).append(row)
    rows = []
    for lang, listed in out.items():
        listed.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        rows += [(lang, i + 1, *r) for i, r in enumerate(listed[: p.per_lang])]
    return sorted(rows)


@lru_cache
def corpus():
    import random

    rng = random.Random(5)
    words = ["a", "B", "ça", "dé", "e f", "g-h"]
    rows = []
    for i in range(60):
        text = "".join(
            rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b"])
            for _ in range(rng.randrange(40))
        )
        rows.append((i, rng.choice(["en", "fr", None]), text, 1))
    rows += [(100, "en", None, 2), (101, None, "", 2), (102, "en", ".,;", 2), (None, "xx", "a a a a a a a", 3)]
    rows += [rows[3]] * 3 + [(104, "fr", "to be " * 400, 1)]
    return rows


@pytest.mark.parametrize("chunk", [64, 4 << 20])
def test_equals_plain_counts(spark, chunk):
    p = PhraseParams(least=4, per_lang=30, one_in=3, chunk_bytes=chunk)
    got = collocations(spark.createDataFrame(corpus(), SCHEMA), p)
    assert sorted(map(tuple, got.collect())) == plain(corpus(), p)


def test_a_blind_sample_fails_and_is_mended(spark):
    """Phrases that the sample can't propose are found by further passes."""
    docs = spark.createDataFrame([(i, "en", "w x y z v", 1) for i in range(9)], SCHEMA)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(9)) == 0
    assert docs.where(drawn).count() < 4
    p = PhraseParams(least=8, one_in=9, caution=9.0)
    found, failures = frequent_phrases(docs, p)
    assert failures[0] > 0 and failures[-1] == 0 and len(failures) > 2
    assert found.where("size = 5").select("phrase", "f").collect() == [("w x y z v", 9)]


def test_numbers_beyond_64_bits(spark, monkeypatch):
    big = 10**14
    rows = [("en", 0, "", 0, 9 * big), ("en", 1, "a", 1, big + 1), ("en", 1, "b", 2, big - 1), ("en", 2, "a b", 3, big - 7)]
    found = spark.createDataFrame(rows, phrases.COUNTS)
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *_: (found, [0]))
    (row,) = collocations(found, SMALL).collect()
    assert row["score"] == 1000 * (big - 7) * 9 * big // ((big + 1) * (big - 1))


def test_shared_bits_change_nothing(spark):
    p = PhraseParams(least=4, per_lang=30, one_in=3, filter_bits=6)
    got = collocations(spark.createDataFrame(corpus(), SCHEMA), p)
    assert sorted(map(tuple, got.collect())) == plain(corpus(), p)


def test_equal_hashes_keep_words_apart(monkeypatch):
    monkeypatch.setattr(phrases, "mixed", lambda h: h * 0)
    words = phrases.Words(b"aa bb aa\ncc")
    assert [words.vocabulary[i] for i in words.ids] == [b"aa", b"bb", b"aa", b"cc"]
    import numpy as np

    names, _, counts = words.phrases(np.arange(3), np.zeros(4, np.uint64), 1)
    assert dict(zip(names, counts)) == {b"aa": 2, b"bb": 1}


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], SCHEMA), SMALL).collect() == []
