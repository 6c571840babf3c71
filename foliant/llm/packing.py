"""Bounded-space online packing of tokenised texts into sequences of one length."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import stored, whole_text

WORD = re.compile(r"[^\x20\t-\r]+")
PIECES = (
    "sequence_id long, open boolean, part long, doc_id long, start long, length long,"
    " doc_tokens long, offset long, ids binary"
)


@dataclass(frozen=True)
class PackParams:
    """Production parameters.

    ``windows``: open windows per partition. ``gap``: a window with at most this much room
    is emitted padded; one with more is filled with a cut of the incoming text first.
    ``merged``: partitions whose leftover windows are merged by one task.
    """

    length: int = 2048
    windows: int = 16
    gap: int = 8
    merged: int = 8
    end_id: int = 1


#: The tokenizer's own pattern (a fixed value), spelled out for characters below U+0100.
_LETTERS, _NUMBERS, _BLANKS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", " \\t-\\r\x85\xa0"
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+")


class WordTokenizer:
    """Token ids by words, remembering at most ``memory`` words.

    The vocabulary never joins characters across blanks, so a text's ids are those of its
    words one after another, and each new word goes through the tokenizer once. Texts
    below U+0100 without the marks of special tokens are in normal form already; they are
    lowered and cut by the tokenizer's own pattern, so that words share their pieces.
    """

    def __init__(self, path: str, memory: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memory = Tokenizer.from_file(path), memory
        own = json.loads(Path(path).read_text())
        steps = [(own.get(k) or {}).get("type") for k in ("normalizer", "pre_tokenizer", "model")]
        self.cuts = steps == ["Sequence", "Sequence", "BPE"] and [
            x["type"] for x in own["normalizer"]["normalizers"] + own["pre_tokenizer"]["pretokenizers"]
        ] == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]
        if self.cuts:
            bare = own | {"normalizer": None, "added_tokens": []}
            bare["pre_tokenizer"] = own["pre_tokenizer"]["pretokenizers"][1]
            self.bare = Tokenizer.from_str(json.dumps(bare))
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.flat, self.starts = array("I"), array("q", [0])

    def _learn(self, words: list[str], plain: bool) -> None:
        if plain:
            encoded = self.bare.encode_batch_fast(words, add_special_tokens=False)
        else:
            encoded = self.tokenizer.encode_batch(words, add_special_tokens=False)
        for w, e in zip(words, encoded, strict=True):
            self.places[w] = len(self.starts) - 1
            self.flat.extend(e.ids)
            self.starts.append(len(self.flat))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.places) > self.memory:
            self.clear()
        lists: list[list[str]] = []
        for text in texts:
            plain = self.cuts and "<|" not in text and (text.isascii() or max(text) < "\u0100")
            # a word of another text is remembered apart from a piece that looks the same
            found = PIECE.findall(text.lower()) if plain else [f" {w}" for w in WORD.findall(text)]
            new = list(dict.fromkeys(w for w in found if w not in self.places))
            if new:
                self._learn(new, plain)
            lists.append(found)
        words = list(chain.from_iterable(lists))
        at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        starts = np.array(self.starts, np.int64)
        begin, sizes = starts[at], starts[at + 1] - starts[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = np.frombuffer(self.flat, "<u4") if len(self.flat) else np.zeros(0, "<u4")
        ids = flat[np.repeat(begin - (ends - sizes), sizes) + np.arange(total)]
        del flat
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, lists)])]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


_KNOWN: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    """One tokenizer per worker process, so that its words outlast a task."""
    if path not in _KNOWN:
        _KNOWN[path] = WordTokenizer(path)
    return _KNOWN[path]


class Packer:
    """A fixed number of open windows; full ones leave through ``done``."""

    def __init__(self, params: PackParams, first_id: int, part: int):
        self.p, self.next, self.part = params, first_id, part
        self.open: list[list] = []  # [room, pieces]
        self.done: list[tuple] = []

    def emit(self, window: list, still_open: bool = False) -> None:
        offset = 0
        for doc_id, start, doc_tokens, ids in window[1]:
            self.done.append(
                (self.next, still_open, self.part, doc_id, start, len(ids), doc_tokens, offset, ids.tobytes())
            )
            offset += len(ids)
        self.next += 1

    def add(self, doc_id, start: int, doc_tokens: int, ids: np.ndarray) -> None:
        """Place a piece: best fit, else a new window, else close the fullest one."""
        while len(ids):
            piece = lambda n: (doc_id, start, doc_tokens, ids[:n])  # noqa: E731, B023
            if len(ids) >= self.p.length:
                self.emit([0, [piece(self.p.length)]])
                start, ids = start + self.p.length, ids[self.p.length :]
                continue
            fits = [w for w in self.open if w[0] >= len(ids)]
            if fits or len(self.open) < self.p.windows:
                if fits:
                    window = min(fits, key=lambda w: w[0])
                else:
                    self.open.append(window := [self.p.length, []])
                window[1].append(piece(len(ids)))
                window[0] -= len(ids)
                if not window[0]:
                    self.close(window)
                return
            fullest = min(self.open, key=lambda w: w[0])
            if (room := fullest[0]) > self.p.gap:
                fullest[1].append(piece(room))
                start, ids = start + room, ids[room:]
            self.close(fullest)

    def close(self, window: list) -> None:
        self.open = [w for w in self.open if w is not window]
        self.emit(window)

    def leave(self) -> None:
        """Hand on the windows that are still open."""
        for window in self.open:
            self.emit(window, True)
        self.open = []

    def merge(self) -> None:
        """Fill the open windows from one another; only the last one keeps room."""
        pieces = [x for w in sorted(self.open, key=lambda w: w[0]) for x in w[1]]
        window, self.open = [self.p.length, []], []
        for doc_id, start, doc_tokens, ids in pieces:
            while len(ids):
                n = min(window[0], len(ids))
                window[1].append((doc_id, start, doc_tokens, ids[:n]))
                window[0] -= n
                start, ids = start + n, ids[n:]
                if not window[0]:
                    self.emit(window)
                    window = [self.p.length, []]
        if window[1]:
            self.emit(window)


def _first_id(part: int, merging: bool) -> int:
    return (2 * part + merging) << 32


def pack(docs: DataFrame, tokenizer: str, params: PackParams = PackParams()) -> DataFrame:
    """Pack all rows of ``docs`` (doc_id, text, others) into sequences of ``length`` tokens.

    Returns one row per piece: sequence_id, doc_id, start, length, doc_tokens, offset and
    ids (little-endian 32-bit). Every id of every row lies in exactly one piece. A null or
    empty text is a document of the end id alone; a null doc_id is kept; repeated rows are
    packed each; texts longer than a sequence are cut. An empty table gives no rows.

    Texts are packed where they are read, without a shuffle. The leftover windows of
    ``merged`` partitions, at most ``windows`` each, meet in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        words, packer = tokenizer_at(tokenizer), Packer(params, _first_id(part, False), part)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                some = texts.slice(at, 256).to_pylist()
                for doc_id, tokens in zip(ids[at : at + 256], words.encode(some), strict=True):
                    tokens = np.append(tokens, np.array([params.end_id], "<u4")).astype("<u4")
                    packer.add(doc_id, 0, len(tokens), tokens)
                yield from _batches(packer)
        packer.leave()
        yield from _batches(packer)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    placed = stored(own.mapInArrow(run, PIECES), "packed", ["open"])

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(params, _first_id(int(key[0]), True), int(key[0]))
        rows = rows.sort_values(["sequence_id", "offset"])
        for r in rows.itertuples():
            packer.add(None if pd.isna(r.doc_id) else r.doc_id, r.start, r.doc_tokens, np.frombuffer(r.ids, "<u4"))
        packer.merge()
        out = pd.DataFrame(packer.done, columns=[c.split()[0] for c in PIECES.split(", ")])
        return out.astype({"doc_id": "Int64"})

    group = F.floor(F.col("part") / params.merged)
    merged = placed.where("open").groupBy(group).applyInPandas(merge, PIECES)
    return placed.where("not open").unionByName(merged).drop("open", "part")


_SCHEMA = pa.schema(
    [("sequence_id", pa.int64()), ("open", pa.bool_()), ("part", pa.int64()), ("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("start", "length", "doc_tokens", "offset")]
    + [("ids", pa.binary())]
)


def _batches(packer: Packer) -> Iterator[pa.RecordBatch]:
    if packer.done:
        columns = zip(*packer.done, strict=True)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)
        packer.done = []
