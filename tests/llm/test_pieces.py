import hashlib
import itertools

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from foliant.llm.pieces import SPACE, Listed, Vocabulary, best_mixes, count_best, n_best, n_best_texts, token_counts
from foliant.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", "the hathandhation of", "  two  spaces ", "日本語 😀x", "tab\tnew\nline\r\n", " a", "été ñandú Straße", "aaaaaaaaaaaa", "\x00\x1f", "x" * 300]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(PATH)


@pytest.fixture(scope="module")
def unigram():
    """The tokenizers library's unigram segmentation over the same pieces and scores."""
    from tokenizers import models

    own = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return models.Unigram([(own.id_to_piece(i), own.get_score(i)) for i in range(own.get_piece_size())], own.unk_id(), True)


def test_counts_equal_the_library(vocabulary, unigram):
    for text in TEXTS:
        for segment in vocabulary.segments(text):
            want = [t.id for t in unigram.tokenize(segment)]
            assert count_best(vocabulary, segment)[1] == len(want)
            (_, path), *_ = n_best(vocabulary, segment, 1)
            assert sum(s for s, _ in n_best(vocabulary, segment, 1)) == pytest.approx(count_best(vocabulary, segment)[0])
            assert len(path) <= len(segment)


def all_paths(v, segment):
    arcs = v.arcs(segment)

    def back(end):
        if end == 0:
            yield 0.0
        for size, score, _ in arcs[end]:
            for s in back(end - size):
                yield s + score

    return sorted(back(len(segment)), reverse=True)


@pytest.mark.parametrize("segment", ["▁the", "▁hathan", "▁été", "▁▁▁a", "▁日x", "aaaaaa"])
@pytest.mark.parametrize("n", [1, 3, 8])
def test_n_best_is_exact(vocabulary, segment, n):
    got = n_best(vocabulary, segment, n)
    assert [s for s, _ in got] == all_paths(vocabulary, segment)[:n]
    assert len({tuple(p) for _, p in got}) == len(got)


def test_n_best_equals_the_library(vocabulary):
    raw = open(PATH, "rb").read()
    # a second trainer_spec with model_type UNIGRAM makes the library read the same pieces so
    own = sentencepiece.SentencePieceProcessor(model_proto=raw + b"\x12\x02\x18\x01")
    for word in ("the", "hathandhation", "Straße"):
        want = own.nbest_encode_as_pieces(word, 4)
        paths = n_best(vocabulary, SPACE + word, 4)
        score = lambda pieces: sum(own.get_score(own.piece_to_id(p)) for p in pieces)
        assert [score(p) for p in want] == [s for s, _ in paths]


def test_mixes():
    none = [np.zeros(0, "<u4")]
    lists = [Listed([5.0, 4.0, 1.0], none * 3, ""), Listed([2.0], none, ""), Listed([3.0, 2.5], none * 2, ""), Listed([9.0, 8.0, 7.5], none * 3, "")]
    want = sorted(sum(x.scores[0] - s for x, s in zip(lists, pick)) for pick in itertools.product(*[x.scores for x in lists]))
    for n in (1, 2, 4, 6):
        assert [loss for loss, _ in best_mixes(lists, n)] == want[:n]


def test_tables(spark, docs):
    rows = list(enumerate(TEXTS)) + [(None, None), (3, TEXTS[3])]
    counts = token_counts(docs(rows), PATH).collect()
    lists = n_best_texts(docs(rows), PATH, 3, with_ids=True).collect()
    assert len(counts) == len(lists) == len(rows)
    by_text = {i: t or "" for i, t in rows}
    for c, r in zip(sorted(counts, key=repr), sorted(lists, key=repr), strict=True):
        text = by_text[r.doc_id]
        assert (c.doc_id, c.n_chars) == (r.doc_id, r.n_chars) == (r.doc_id, len(text))
        assert c.n_tokens == r.n_pieces[0] and c.score == r.scores[0]
        assert r.scores == sorted(r.scores, reverse=True) and len(set(r.ids_sha256)) == r.n_best
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [hashlib.sha256(x).hexdigest() for x in r.ids] == r.ids_sha256
    assert token_counts(docs([]), PATH).count() == n_best_texts(docs([]), PATH).count() == 0


def test_queries(spark):
    folder = "/root/testdata/sf0.001"
    counts = {r.doc_id: r for r in QUERIES["op6_token_counts"](spark, folder).collect()}
    for r in QUERIES["op4_n_best_pieces"](spark, folder).collect():
        assert r.n_pieces[0] == counts[r.doc_id].n_tokens and r.scores[0] == counts[r.doc_id].score
    for d in spark.read.parquet(f"{folder}/documents.parquet").collect():
        assert counts[d.doc_id].n_chars == len(d.text or "")


def test_few_segments_are_searched(spark, vocabulary, monkeypatch):
    """Only segments that may leave their best path go through the n-best search."""
    import pyarrow as pa

    from foliant.llm import pieces

    class Rows:
        def mapInArrow(self, run, _):
            return run

    asked, plain = [], pieces.n_best
    monkeypatch.setattr(pieces, "n_best", lambda v, s, n: asked.append(s) or plain(v, s, n))
    monkeypatch.setattr(pieces, "_texts", lambda _: Rows())
    monkeypatch.setattr(pieces, "_KEPT", {})
    text = " ".join(f"hathand{i}ation" for i in range(200)) + " 日x été"
    batch = pa.record_batch([pa.array([1]), pa.array([text])], names=["doc_id", "text"])
    (got,) = n_best_texts(None, PATH, 4, with_ids=True)(iter([batch]))
    assert len(asked) <= 3
    whole = plain(vocabulary, SPACE + text.replace(" ", SPACE), 4)
    assert got.column("scores")[0].as_py() == [score for score, _ in whole]
    assert got.column("ids")[0][0].as_py() == vocabulary.ids(SPACE + text.replace(" ", SPACE), whole[0][1]).tobytes()
