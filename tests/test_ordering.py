"""Order-dependent helpers against plain Python, with one key holding most rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from foliant.operators import changes, chunking, ordering
from foliant.operators.ordering import (
    first_per_key,
    greedy_groups,
    neighbor,
    running_total,
    top_per_key,
    with_position,
)
from tests.conftest import rows


def _skewed(n=600, seed=1):
    rng = random.Random(seed)
    out, counts = [], {}
    for _ in range(n):
        key = rng.choice(["hot", "hot", "hot", "a", "b"])
        counts[key] = counts.get(key, -1) + 1
        out.append((key, counts[key], rng.randint(0, 9)))
    return out


def test_running_total_over_blocks(spark):
    data = _skewed()
    df = spark.createDataFrame(data, "k string, at int, v int")
    got = running_total(df, ["k"], "at", F.col("v"), "before", block=7)
    want = [
        (k, at, sum(v2 for k2, a2, v2 in data if k2 == k and a2 < at)) for k, at, _ in data
    ]
    assert rows(got, "k", "at", "before") == sorted(want, key=repr)


def test_neighbor_crosses_blocks(spark):
    data = _skewed()
    df = spark.createDataFrame(data, "k string, at int, v int")
    block = F.floor(F.col("at") / 5)
    for ahead in (False, True):
        got = neighbor(df, ["k"], ["at"], "v", "other", block, ahead)
        by = {(k, at): v for k, at, v in data}
        want = [(k, at, by.get((k, at + (1 if ahead else -1)))) for k, at, _ in data]
        assert rows(got, "k", "at", "other") == sorted(want, key=repr)


def test_positions_restart_within_key(spark):
    data = _skewed()
    df = spark.createDataFrame(data, "k string, at int, v int").repartition(5)
    got = with_position(df, [F.col("v").desc(), F.col("at")], "place", within=["k"])
    want = []
    for key in ("hot", "a", "b"):
        mine = sorted((r for r in data if r[0] == key), key=lambda r: (-r[2], r[1]))
        want += [(k, at, i + 1) for i, (k, at, _) in enumerate(mine)]
    assert rows(got, "k", "at", "place") == sorted(want, key=repr)
    whole = with_position(df, [F.col("k"), F.col("at")], "place")
    assert sorted(r["place"] for r in whole.collect()) == list(range(1, len(data) + 1))


def _greedy(los, his, limit):
    start, group, out = None, -1, []
    for lo, hi in zip(los, his):
        opens = start is None or hi - start > limit
        if opens:
            start, group = lo, group + 1
        out.append((group, opens))
    return out


def test_greedy_groups_match_a_plain_walk(spark):
    rng = random.Random(3)
    data, want = [], []
    for key, n in (("hot", 500), ("b", 40), ("c", 1)):
        at, los = 0, []
        for _ in range(n):
            at += rng.choice([1, 1, 2, 3, 30])
            los.append(at)
        for i, (group, opens) in enumerate(_greedy(los, los, 10)):
            want.append((key, i, group, opens))
        data += [(key, i, lo) for i, lo in enumerate(los)]
    df = spark.createDataFrame(data, "k string, at int, lo long")
    for span, fan in ((1, 2), (1, 3), (2, 4), (5, 256), (1000, 2)):
        got = greedy_groups(df, ["k"], "at", "lo", "lo", 10, span, "g", "opens", fan)
        assert rows(got, "k", "at", "g", "opens") == sorted(want, key=repr)


def test_composed_steps_equal_one_walk():
    """Composition is associative, and equal to walking all rows of the parts in one go."""
    rng = random.Random(9)
    for _ in range(300):
        limit, width = 10.0, 10.0 * rng.choice([1, 2, 4])
        los = np.cumsum([rng.choice([0.0, 1.0, 2.0, 9.0, 40.0]) for _ in range(rng.randrange(1, 60))])
        his = np.maximum.accumulate(los + [rng.choice([0.0, 0.0, 3.0, 15.0]) for _ in los])
        blocks = np.floor(los / width)
        parts = [ordering._block_steps(los[blocks == b], his[blocks == b], limit, width) for b in np.unique(blocks)]
        cut = rng.randrange(1, len(parts) + 1)
        halves = [ordering._composed(p, limit) for p in (parts[:cut], parts[cut:]) if p]
        # what is open lies before the first block
        start = blocks[0] * width - rng.choice([1.0, 3.0, 9.0, 30.0, np.inf])
        opened, n = start, 0
        for lo, hi in zip(los, his):
            if hi - opened > limit:
                opened, n = lo, n + 1
        for whole in (ordering._composed(parts, limit), ordering._composed(halves, limit)):
            assert [float(v[0]) for v in ordering._step(whole, np.array([start]), limit)] == [opened, n]


def test_pack_batches_oversize_chunk_stands_alone(spark):
    sizes = [3, 4, 4, 50, 1, 9, 1, 2, 2, 8, 3]
    data = [("x", i, " ".join(["w"] * n)) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(data, "k string, chunk_index int, text string")
    want, batch, held = [], 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > 10:
            batch, held = batch + 1, 0
        held += n
        want.append((i, batch))
    for span in (1, 64):
        got = chunking.pack_batches(df, "k", 10, span)
        assert rows(got, "chunk_index", "batch") == sorted(want, key=repr)


def test_top_and_first_per_key(spark):
    df = spark.createDataFrame(
        [("a", 3, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", 9, "w")], "k string, n int, v string"
    )
    assert rows(first_per_key(df, ["k"], ["n"]), "k", "v") == [("a", "y"), ("b", "w")]
    top = top_per_key(df, ["k"], [F.col("n").desc()], 2)
    assert rows(top, "k", "n", "rank") == [("a", 2, 2), ("a", 3, 1), ("b", 9, 1)]


def test_debounce_throttle_and_repeats(spark):
    data = [
        (1, "u", "2024-01-01 00:00:00.0", "a"),
        (2, "u", "2024-01-01 00:00:00.2", "a"),
        (3, "u", "2024-01-01 00:00:00.4", "b"),
        (4, "u", "2024-01-01 00:00:00.9", "b"),
        (5, "u", "2024-01-01 05:00:00.0", "a"),
        (6, "v", "2024-01-01 00:00:00.1", "a"),
    ]
    df = spark.createDataFrame(data, "event_id long, u string, t string, v string")
    df = df.withColumn("ts", F.to_timestamp_ntz("t"))
    assert rows(changes.debounce_last(df, "u", 0.3), "event_id") == [(3,), (4,), (5,), (6,)]
    assert rows(changes.throttle(df, "u", 0.3), "event_id") == [(1,), (3,), (4,), (5,), (6,)]
    assert rows(changes.drop_repeats(df, "u", "v"), "event_id") == [(1,), (3,), (5,), (6,)]
