import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm.prefix_hash import PrefixHash, codes, common_extension, equal_spans, fingerprints, likeness
from foliant.llm.queries import QUERIES


@settings(max_examples=60, deadline=None)
@given(st.text("abü😀", max_size=40), st.text("abü😀", max_size=40), st.data())
def test_spans(s, t, data):
    x, y = PrefixHash(codes(s)), PrefixHash(codes(t))
    a, b = data.draw(st.integers(0, len(s))), data.draw(st.integers(0, len(t)))
    n = 0
    while a + n < len(s) and b + n < len(t) and s[a + n] == t[b + n]:
        n += 1
    assert common_extension(x, a, y, b) == n
    k = data.draw(st.integers(0, min(len(s) - a, len(t) - b)))
    assert equal_spans(x, a, y, b, k) == (s[a : a + k] == t[b : b + k])


def check(rows, texts):
    texts = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, (doc_id, text) in enumerate(texts):
        text, after = text or "", texts[(i + 1) % len(texts)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(want, key=repr) == sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=repr)


def test_edge_cases(spark, docs):
    texts = [(None, "no id here at all"), (1, ""), (2, None), (3, "x" * 30), (3, "x" * 30), (4, "é😀" * 50), (9, "one two three four five six seven"), (-5, "b")]
    got = fingerprints(docs(texts)).collect()
    check(got, texts)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints(docs([])).count() == 0
    (one,) = fingerprints(docs([(1, "abcdef")])).collect()
    assert one.near_next == 1 and one.common_next == 6


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = QUERIES["op5_prefix_fingerprints"](spark, folder).collect()
    texts = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, texts)
    by_text = {}
    for r in rows:
        text = dict(texts)[r.doc_id] or ""
        assert by_text.setdefault(r.fingerprint, text) == text
        assert likeness(r.fingerprint, r.edited_fingerprint) == r.near_edited
    long = [r for r in rows if r.n_chars > 400]
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)
