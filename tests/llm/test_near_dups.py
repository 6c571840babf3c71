import random
import re

import numpy as np

from foliant.llm.near_dups import NearParams, Shingler, components, near_groups, one_per_group, super_min_hash


def brute(rows):
    """Component and set size per row, by comparing all pairs."""
    sets = []
    for _, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {}
    for g, (i, _) in zip(group, rows):
        low[g] = min(low.get(g, i), i)
    return {(i, len(s), low[g], low[g] == i) for g, s, (i, _) in zip(group, sets, rows)}


def planted(seed, groups=12, copies=9, words=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                text[r.randrange(words)] = r.choice(vocabulary)
            rows.append(" ".join(text))
    r.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def test_against_all_pairs(spark, docs):
    rows = planted(1) + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "A b c"), (1004, "a B  c"), (1005, "a b"), (1006, "Ä b c"), (1007, "ä b c")]
    got = {tuple(r) for r in near_groups(docs(rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()}
    assert got == brute(rows)


def test_small_blocks(spark, docs):
    """Large buckets are compared block by block."""
    rows = planted(2, groups=2, copies=60)
    got = {tuple(r) for r in near_groups(docs(rows), NearParams(block=7)).select("doc_id", "n_shingles", "component_id", "kept").collect()}
    assert got == brute(rows)


def test_edge_rows(spark, docs):
    rows = [(5, "one two three four five six"), (5, "one two three four five six"), (None, "one two three four five six"), (8, "ONE two three four five six"), (9, None)]
    got = sorted((tuple(r) for r in near_groups(docs(rows)).select("doc_id", "component_id", "kept").collect()), key=repr)
    assert got == [(5, 5, True), (5, 5, True), (8, 5, False), (9, 9, True), (None, None, True)]
    kept = one_per_group(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [5, 9, None]
    assert near_groups(docs([])).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_signatures_estimate_likeness():
    r = np.random.default_rng(3)
    for n in (8, 300):
        found = []
        for _ in range(200):
            x = r.integers(0, 2**63, n).astype(np.uint64)
            c = n // 2
            a, b = super_min_hash([x[: c + c // 2], np.concatenate([x[:c], x[c + c // 2 :]])], 128)
            found.append((a == b).mean())
        union = n
        assert abs(np.mean(found) - c / union) < 0.02
        assert np.std(found) < np.sqrt(c / union * (1 - c / union) / 128) * 1.1
    assert len(Shingler(5)("")) == 0 and len(Shingler(5)("a b c d e f")) == 2


def test_a_group_around_one_text_costs_few_pairs(spark, docs, monkeypatch):
    """Copies that aren't linked with each other, only with the text they were made from."""
    from foliant.llm import near_dups

    r = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = [(500, " ".join(base))]
    for i in range(300):
        text = list(base)
        for at in r.sample(range(5, 95), 2):
            text[at] = f"x{i}-{at}"
        rows.append((i, " ".join(text)))
    asked = []
    plain = near_dups._confirmed
    monkeypatch.setattr(near_dups, "_confirmed", lambda p, *a: asked.append(p.count()) or plain(p, *a))
    got = near_groups(docs(rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert {tuple(x) for x in got} == brute(rows)
    assert sum(asked) < 6 * len(rows)


def test_repeated_ids_and_clashing_names(spark, docs):
    from pyspark.sql import functions as F

    text = "a b c d e f g h"
    rows = [(1, text), (1, "zz other text that is near to nothing"), (3, text), (3, text), (4, "zz other"), (None, text)]
    table = docs(rows).withColumn("_id", F.lit(1)).withColumn("_again", F.lit("x")).withColumn("gone", F.lit(2)).withColumn("top", F.col("doc_id"))
    kept = one_per_group(table)
    assert kept.columns == table.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted([(1, text), (1, rows[1][1]), (4, "zz other"), (None, text)], key=repr)


def test_links_through_a_repeated_id_stay_apart(spark, docs):
    one, two = "a b c d e f g h i", "k l m n o p q r s"
    rows = [(7, one), (7, two), (8, one), (9, two)]
    got = sorted((r.doc_id, r.component_id) for r in near_groups(docs(rows)).collect())
    assert got == [(7, 7), (7, 7), (8, 7), (9, 7)]
    assert one_per_group(docs(rows)).count() == 2


def test_tables_on_the_way_are_removed(spark, docs):
    import os

    from foliant.session import checkpoint_dir

    base = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(base))
    got = near_groups(docs([(1, "a b c d e f"), (2, "a b c d e f")]))
    assert len(set(os.listdir(base)) - before) == 1
    assert got.count() == 2


def test_likely_pairs_without_a_link_leave_no_rows(spark, docs, monkeypatch):
    """Copies of one text that are alike, but mostly not linked, cost no row per pair."""
    from foliant.llm import near_dups

    r = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(200):
        text = list(base)
        for at in r.sample(range(5, 95), 2):
            text[at] = f"x{i}-{at}"
        rows.append((i, " ".join(text)))
    made, plain = [], near_dups.stored

    def counted(df, name, *args):
        table = plain(df, name, *args)
        if name in ("proposed", "confirmed"):
            made.append(table.count())
        return table

    monkeypatch.setattr(near_dups, "stored", counted)
    got = near_groups(docs(rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert {tuple(x) for x in got} == brute(rows)
    assert made and sum(made) < 40 * len(rows)  # of 19,900 pairs


def test_rows_without_a_mark_are_not_shuffled(spark, docs, monkeypatch):
    from foliant.llm import near_dups

    made, plain = [], near_dups._flagged
    monkeypatch.setattr(near_dups, "_flagged", lambda *a: made.append(plain(*a)) or made[-1])
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(9))) for i in range(300)]
    rows += [(400, rows[3][1]), (401, rows[4][1]), (5, rows[5][1]), (None, rows[6][1]), (402, None)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = one_per_group(docs(rows))
        got = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [*range(300), 402] and kept.count() == 302
    # the two copies, the row that stands twice, and hardly a stranger
    assert 4 <= made[-1].where("_may").count() <= 8
