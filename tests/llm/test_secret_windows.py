"""Keys inside long runs and beside base spans."""

import random
import string

import pytest

from foliant.llm.secret_scan import ScanParams, base_spans, candidates, find_secrets, redact, train, views

ALPHABET = string.ascii_letters + string.digits


@pytest.fixture(scope="module")
def net(spark):
    rows = [(i, f"some prose about gardens, rivers and several accounts number {i}, token = \"{i:040x}\" and more") for i in range(60)]
    return train(spark.createDataFrame(rows, "doc_id long, text string"), ScanParams(rounds=8, examples=1200, documents=200))


def test_views_cover_a_run():
    p = ScanParams()
    for n in [1, 16, 47, 48, 49, 60, 61, 200, 1001]:
        spans = list(views(5, 5 + n, p))
        assert spans[0][0] == 5 and spans[-1][1] == 5 + n and all(0 < b - a <= p.inside for a, b in spans)
        for at in range(5, 5 + max(1, n - 35)):
            assert any(a <= at and min(at + 36, 5 + n) <= b for a, b in spans)


def test_remainders_of_base_spans():
    hexes = "0123456789abcdef01234567"
    text = f"see Xy{hexes}QzWvT8 and /a/{hexes}/b"
    at = text.index(hexes)
    far = text.rindex(hexes)
    assert candidates(text, base_spans(text)) == [(at - 2, at), (at + 24, at + 30), (far - 3, far), (far + 24, far + 26)]


def test_key_in_the_middle_of_a_run(spark, docs, net):
    r = random.Random(3)
    keys = ["".join(r.choices(ALPHABET, k=32)) for _ in range(50)]
    paths = [f"open /api/accounts/{k}/a-long-resource-name/details now" for k in keys]
    plain = [f"open /api/accounts/spring-report-{i}/a-long-resource-name/details now" for i in range(50)]
    found = {x.doc_id: x.spans for x in find_secrets(docs(list(enumerate(paths + plain))), net).collect()}
    assert sum(bool(found[i]) for i in range(50)) >= 45
    assert sum(bool(found[i]) for i in range(50, 100)) <= 5


def test_rest_of_a_key_is_masked(spark, docs, net):
    r = random.Random(4)
    key = ["QxT7" + "".join(r.choices("0123456789abcdef", k=24)) + "ZkW9" + "".join(r.choices(ALPHABET, k=16)) for _ in range(40)]
    clean = {x.doc_id: x.text for x in redact(docs([(i, f"the key {k} is here") for i, k in enumerate(key)]), net).collect()}
    assert sum(k[-16:] not in clean[i] for i, k in enumerate(key)) >= 36
