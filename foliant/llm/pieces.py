"""Unigram segmentation over a piece vocabulary: best counts and n-best lists.

Scores, byte fallback and ties follow the unigram segmentation of the SentencePiece library: a
path's score is the sum of its pieces' scores, a character without a piece of its own
costs the least score less 10, and of equal paths the one whose last piece starts first wins.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import whole_text

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")


class Vocabulary:
    """Pieces with scores from a SentencePiece model file, in an Aho-Corasick automaton."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.machine, self.names, self.single, self.bytes = ahocorasick.Automaton(), {}, set(), {}
        scores, joined = [], False
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)):
                scores.append(score := model.get_score(i))
                self.names[i] = piece
                joined |= bool(re.search(f"[^{SPACE}]{SPACE}", piece))
                if len(piece) == 1:
                    self.single.add(piece)
                if not model.is_unused(i):
                    self.machine.add_word(piece, (len(piece), score, i))
        self.machine.make_automaton()
        self.unknown = min(scores) - 10
        self.raw = {i: p.encode() for i, p in self.names.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.unknown_id = model.unk_id()
        self.raw[self.unknown_id] = b""
        self.cuts = not joined

    def segments(self, text: str) -> list[str]:
        """The text in its normal form, cut before every run of spaces.

        Every path has a boundary at such a cut, since no piece has a space after another
        character; a vocabulary with such a piece gets one segment. A space stands before
        the text.
        """
        if not text:
            return []
        if self.cuts and text[0] != " " and "  " not in text and SPACE not in text:
            return [SPACE + word for word in text.split(" ")]
        normal = SPACE + text.replace(" ", SPACE)
        return SEGMENT.findall(normal) if self.cuts else [normal]

    def arcs(self, segment: str) -> list[list[tuple[int, float, int]]]:
        """Per end, the arcs (length, score, id) that end there, longest first."""
        found: list[list] = [[] for _ in range(len(segment) + 1)]
        for end, arc in self.machine.iter(segment):
            found[end + 1].append(arc)
        for end, c in enumerate(segment, 1):
            if c not in self.single:
                found[end].append((1, self.unknown, self.unknown_id))
        return found

    def ids(self, segment: str, path: list[tuple[int, int]]) -> np.ndarray:
        """Ids of a path (start, id), with unknown characters as their bytes."""
        out: list[int] = []
        for start, i in path:
            if i == self.unknown_id and self.bytes:
                out += [self.bytes[b] for b in segment[start].encode()]
            else:
                out.append(i)
        return np.array(out, "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the leading space goes."""
        raw = b"".join([self.raw.get(i, b"") for i in ids.tolist()])
        return raw.decode("utf-8", "replace").replace(SPACE, " ")


def count_best(v: Vocabulary, segment: str) -> tuple[float, int, int]:
    """(score, tokens, unknown characters) of the best path, without building it."""
    n = len(segment)
    best, count, strange = [0.0] + [-np.inf] * n, [0] * (n + 1), [0] * (n + 1)
    if v.single.issuperset(segment):  # every character has a piece: matches come by end, longest first
        for end, (size, score, _) in v.machine.iter(segment):
            if (total := best[end + 1 - size] + score) > best[end + 1]:
                best[end + 1], count[end + 1] = total, count[end + 1 - size] + 1
        return best[n], count[n], 0
    for end, arcs in enumerate(v.arcs(segment)):
        for size, score, i in arcs:
            start = end - size
            if (total := best[start] + score) > best[end]:
                best[end] = total
                unknown = i == v.unknown_id
                tokens = len(segment[start].encode()) if unknown and v.bytes else 1
                count[end], strange[end] = count[start] + tokens, strange[start] + unknown
    return best[n], count[n], strange[n]


def n_best(v: Vocabulary, segment: str, n: int) -> list[tuple[float, list[tuple[int, int]]]]:
    """The ``n`` best paths with their scores, best first.

    The forward pass gives the best score from the start to every place. The backward
    search extends paths from the end; a partial path's score plus the forward score of
    its place is exactly what its best completion reaches, so complete paths leave the
    queue in order. Of equal scores the path that has come further goes first, then the
    one that entered first. A place is left at most ``n`` times.
    """
    arcs, size = v.arcs(segment), len(segment)
    forward = [0.0] + [-np.inf] * size
    for end in range(1, size + 1):
        forward[end] = max([forward[end - length] + score for length, score, _ in arcs[end]])
    # (less its full score, place, order of entry, path so far as nested tuples, score so far)
    queue: list[tuple] = [(-forward[size], size, 0, None, 0.0)]
    left, out, entered = [0] * (size + 1), [], 0
    while queue and len(out) < n:
        _, place, _, path, score = heapq.heappop(queue)
        if place == 0:
            steps = []
            while path:
                *step, path = path
                steps.append(tuple(step))
            out.append((score, steps))
            continue
        if left[place] == n:
            continue
        left[place] += 1
        for length, s, i in arcs[place]:
            start, entered = place - length, entered + 1
            heapq.heappush(queue, (-(forward[start] + s + score), start, entered, (start, i, path), s + score))
    return out


class Remembered:
    """Results of a function of segments, at most ``memory`` of them."""

    def __init__(self, work: Callable, memory: int):
        self.work, self.memory, self.known = work, memory, {}

    def __call__(self, segments: list[str]) -> list:
        if len(self.known) > self.memory:
            self.known.clear()
        known = self.known
        for s in set(segments).difference(known):
            known[s] = self.work(s)
        return [known[s] for s in segments]


_KEPT: dict[tuple, tuple[Vocabulary, Remembered]] = {}


def kept(path: str, make: Callable, n: int, memory: int) -> tuple[Vocabulary, Remembered]:
    """A vocabulary and what ``make(vocabulary, n)`` remembers; both outlast a task in its worker."""
    if (path, n, memory) not in _KEPT:
        v = next((v for (p, *_), (v, _) in _KEPT.items() if p == path), None) or Vocabulary(path)
        _KEPT[path, n, memory] = v, Remembered(make(v, n), memory)
    return _KEPT[path, n, memory]


COUNTS = "doc_id long, n_chars long, n_tokens long, n_unknown long, score double"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_chars, n_tokens, n_unknown, score) for every row of ``docs``.

    Counts the tokens of the best segmentation of the whole text, without making them.
    Null and empty texts have no tokens and score 0; repeated rows and null doc_ids are
    counted like any other; an empty table gives no rows. Scores are summed in 64 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, count = kept(model, lambda v, _: lambda s: count_best(v, s), 0, 500_000)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                found = count(v.segments(text))
                sums = [sum(x) for x in zip(*found, strict=True)] or [0.0, 0, 0]
                rows.append((len(text), sums[1], sums[2], float(sums[0])))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.int64()] * 3 + [pa.float64()]
            yield pa.record_batch(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=[c.split()[0] for c in COUNTS.split(", ")],
            )

    return _texts(docs).mapInArrow(run, COUNTS)


@dataclass(frozen=True)
class Listed:
    """The n-best list of a segment: scores, losses against the best, ids, decoded text."""

    scores: list[float]
    ids: list[np.ndarray]
    text: str


def lister(v: Vocabulary, n: int) -> Callable[[str], Listed]:
    def make(segment: str) -> Listed:
        paths = n_best(v, segment, n)
        ids = [v.ids(segment, p) for _, p in paths]
        return Listed([s for s, _ in paths], ids, v.decode(ids[0]))

    return make


def best_and_loss(v: Vocabulary, segment: str) -> tuple[float, float, bytes, bytes]:
    """(score, loss of the second best path, ids, bytes of their pieces) of the best path.

    The forward pass of :func:`n_best` with two scores a place; it tells which segments of a
    text can leave their best path at all. The loss is infinite if there is no other path.
    """
    n = len(segment)
    best, second, back = [0.0] + [-np.inf] * n, [-np.inf] * (n + 1), [None] * (n + 1)
    known = v.single.issuperset(segment)  # matches come by end, longest first
    steps = v.machine.iter(segment) if known else ((end - 1, arc) for end, arcs in enumerate(v.arcs(segment)) for arc in arcs)
    for end, arc in steps:
        end += 1
        start = end - arc[0]
        if (total := best[start] + arc[1]) > best[end]:
            other = second[start] + arc[1]
            second[end] = best[end] if best[end] > other else other
            best[end], back[end] = total, arc
        elif total > second[end]:
            second[end] = total
    ids, end = [], n
    while end:
        length, _, i = back[end]
        end -= length
        ids.append(i if known else (end, i))
    ids.reverse()
    if not known:
        ids = v.ids(segment, ids).tolist()
    return best[n], best[n] - second[n], array("I", ids).tobytes(), b"".join([v.raw[i] for i in ids])


def first_passes(v: Vocabulary, _: int) -> Callable[[str], tuple[float, float, bytes, bytes]]:
    return lambda segment: best_and_loss(v, segment)


def best_mixes(listed: list[Listed], n: int) -> list[tuple[float, dict[int, int]]]:
    """The ``n`` least losses of a text, each with the segments that leave their best path.

    Only the n - 1 segments with the least first loss can take part. Ties go to earlier
    segments, then to lower ranks.
    """
    losses = [(x.scores[0] - x.scores[1], k) for k, x in enumerate(listed) if len(x.scores) > 1]
    mixes: list[tuple[float, tuple]] = [(0.0, ())]
    for _, k in sorted(heapq.nsmallest(n - 1, losses), key=lambda x: x[1]):
        x = listed[k]
        more = [(loss + x.scores[0] - s, (*mix, (k, r))) for loss, mix in mixes for r, s in enumerate(x.scores[1:], 1)]
        mixes = heapq.nsmallest(n, mixes + more)
    return [(loss, dict(mix)) for loss, mix in mixes]


NBEST = (
    "doc_id long, n_chars long, n_best long, scores array<double>, n_pieces array<long>,"
    " ids_sha256 array<string>, decoded_sha256 string"
)


def n_best_texts(docs: DataFrame, model: str, n: int = 4, with_ids: bool = False) -> DataFrame:
    """The ``n`` best segmentations of every row's whole text, and the decoded best one.

    Returns doc_id, n_chars, n_best (fewer than ``n`` if the text has no more paths), and
    per rank score, number of ids and SHA-256 of the ids (little-endian 32-bit), and the
    SHA-256 of the decoded text; with ``with_ids`` also the ids as binary. The lattice of a
    text falls into the lattices of its segments, whose lists are combined exactly. Null
    and empty texts have one segmentation without ids. Decoding gives the text back, but
    for the character U+2581, which becomes a space. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, firsts = kept(model, first_passes, n, 300_000)
        _, lists = kept(model, lister, n, 20_000)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                segments = v.segments(text)
                totals, losses, best, decoded = zip(*firsts(segments), strict=True) if segments else ((),) * 4
                total = sum(totals)
                # the only segments that leave their best path in any of the n best of the text
                least = heapq.nsmallest(n - 1, zip(losses, range(len(segments)), strict=True))
                close = sorted(k for loss, k in least if loss < np.inf)
                listed = lists([segments[k] for k in close])
                ranks = []
                for loss, mix in best_mixes(listed, n):
                    own = list(best)
                    for k, r in mix.items():
                        own[close[k]] = listed[k].ids[r].tobytes()
                    raw = b"".join(own)
                    ranks.append((float(total - loss), len(raw) // 4, hashlib.sha256(raw).hexdigest(), raw))
                decoded = b"".join(decoded).decode("utf-8", "replace").replace(SPACE, " ")[1:]
                scores, sizes, shas, raws = (list(c) for c in zip(*ranks, strict=True))
                rows.append((len(text), len(ranks), scores, sizes, shas, hashlib.sha256(decoded.encode()).hexdigest(), raws))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.string(), pa.list_(pa.binary())]
            arrays = [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
            names = [c.split()[0] for c in f"{NBEST}, ids array<binary>".split(", ")]
            size = len(names) if with_ids else len(names) - 1
            yield pa.record_batch(arrays[:size], names=names[:size])

    return _texts(docs).mapInArrow(run, f"{NBEST}, ids array<binary>" if with_ids else NBEST)
