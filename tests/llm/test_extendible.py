from collections import defaultdict

from foliant.llm.extendible import shards


def check(rows, limit):
    by = defaultdict(list)
    for r in rows:
        assert len(r.shard) == r.shard_depth
        by[r.shard].append(r)
    names = sorted(by)
    assert all(not b.startswith(a) for a, b in zip(names, names[1:]))  # a prefix code
    for own in by.values():
        total = sum(r.text_bytes for r in own)
        assert all(r.shard_bytes == total for r in own)
        assert total <= limit or len(own) == 1
    # only buckets that were too large are split: a pair of siblings never fits together
    for name in names:
        if name:
            assert sum(r.text_bytes for n, own in by.items() if n.startswith(name[:-1]) for r in own) > limit


def test_shards(spark, docs):
    rows = [(i, "é" * (i % 40)) for i in range(300)] + [(None, "x" * 30)] * 3 + [(7, "y" * 40)] * 50 + [(9, None), (11, "z" * 999)]
    got = shards(docs(rows), 100).collect()
    assert len(got) == len(rows) and sum(r.text_bytes for r in got) == sum(len((t or "").encode()) for _, t in rows)
    check(got, 100)
    one = shards(docs(rows), 1 << 30).collect()
    assert {r.shard for r in one} == {""}
    assert shards(docs([]), 10).count() == 0
