import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foliant.llm.packing import PackParams, WordTokenizer, pack
from foliant.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
SMALL = PackParams(length=16, windows=2, gap=1)


def reference(text):
    ids = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, 1], "<u4")


def check(pieces, docs, length, slack):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in docs}
    for i, text in docs:
        own, want = sorted(by_doc[i], key=lambda r: r.start), reference(text)
        at = 0
        for r in own:
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want)
            assert r.ids == want[at : at + r.length].tobytes()
            at += r.length
        assert at == len(want)
    short = 0
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        short += at < length - slack
    return short


def test_pieces_cover_every_text(spark, docs):
    texts = [(1, None), (2, ""), (3, "a b c"), (4, "word " * 100), (None, "no id"), (6, "Σ ß é <|endoftext|> x\x1fy")]
    texts += [(10 + i, f"text number {i} " * (i % 7)) for i in range(40)]
    got = pack(docs(texts).repartition(3), PATH, SMALL).collect()
    assert check(got, texts, 16, 1) <= 1


def test_empty_and_repeated(spark, docs):
    assert pack(docs([]), PATH, SMALL).count() == 0
    got = pack(docs([(1, "x y"), (1, "x y")]), PATH, SMALL).collect()
    assert sum(r.length for r in got) == 2 * len(reference("x y"))


def test_words_equal_the_tokenizer():
    texts = ["it's 12's  <|startoftext|>a", "́ͅx ́y", "a" * 5000, "ΑΣ Σ\tΣΑ İ", "don't\x0bstop now 　z"]
    for ids, text in zip(WordTokenizer(PATH, memory=2).encode(texts), texts, strict=True):
        assert np.append(ids, 1).astype("<u4").tolist() == reference(text).tolist()


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query(spark, folder):
    rows = QUERIES["op10_pack_windows"](spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    by_doc = defaultdict(dict)
    for r in rows:
        by_doc[r.doc_id][r.start] = r
    for d in docs:
        want = reference(d.text)
        assert all(zlib.crc32(want[s : s + r.length].tobytes()) == r.ids_crc32 for s, r in by_doc[d.doc_id].items())
        assert sum(r.length for r in by_doc[d.doc_id].values()) == len(want)
    used = sum(r.length for r in rows)
    assert used / (2048 * len({r.sequence_id for r in rows})) > 0.95
