"""Phrase collocations by Toivonen mining.

A sample proposes phrases. One pass over all texts counts the proposals together with their
negative border (phrases that aren't proposed although both their parts are). That pass adds
up hashes, which can only count too much; the next one counts what may be frequent by its
words, exactly, and with it what lies behind border phrases that turned out frequent. Such
failures of the sample move the border, and further passes count behind it, until none is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm.common import stored

#: Characters that end a piece; space and tab stand between words.
ENDS = b".,;:!?\n\x0b\x0c\r"
#: Language of rows without one.
UNKNOWN = "und"


@dataclass(frozen=True)
class PhraseParams:
    """``least``: occurrences of a candidate. ``one_in``: share of documents in the sample.

    ``caution``: a phrase is proposed from this share of its expected count in the sample on;
    lower values mean fewer failures and a longer border. ``filter_bits``: the set of proposals
    travels to the tasks as a bit map of at most 2**filter_bits bits, 16 for each phrase below
    that. Bits that stand for several phrases make a pass count more, never less or otherwise.
    """

    least: int = 100
    longest: int = 5
    per_lang: int = 2000
    one_in: int = 8
    caution: float = 0.5
    filter_bits: int = 27
    chunk_bytes: int = 1 << 20


# --- inside a task ----------------------------------------------------------------------


def _folding() -> bytes:
    table = bytearray(range(256))
    for upper in range(ord("A"), ord("Z") + 1):
        table[upper] = upper + 32
    for end in ENDS:
        table[end] = ord("\n")
    table[ord("\t")] = ord(" ")
    return bytes(table)


FOLDING = _folding()
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number equal keys; the first place of each number."""
    codes, found = pd.factorize(keys)
    first = np.empty(len(found), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, first


class Words:
    """The words of folded text: numbers, hashes and the piece that each stands in."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        inside = (raw != 32) & (raw != 10)
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.starts, ends = edges[::2], edges[1::2]
        self.piece = np.cumsum(raw == 10, dtype=np.int32)[self.starts]
        sizes = (ends - self.starts).astype(np.int32)
        self.ids, self.hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.vocabulary: list[bytes] = []
        if not len(sizes):
            return
        letters = raw[inside]
        first = np.cumsum(sizes, dtype=np.int32) - sizes
        place = np.arange(len(letters), dtype=np.int32) - np.repeat(first, sizes)
        powers = np.multiply.accumulate(np.full(sizes.max(), _STEP))
        self.hashes = mixed(np.add.reduceat((letters + np.uint64(1)) * powers[place], first))
        self.ids, seen = _numbered(self.hashes)
        twin = seen[self.ids]
        # equal hashes must be equal words
        same = (sizes == sizes[twin]).all() and (
            letters == letters[np.repeat(first[twin], sizes) + place]
        ).all()
        if not same:
            numbers: dict[bytes, int] = {}
            pairs = zip(self.starts, ends)
            self.ids = np.array([numbers.setdefault(data[s:e], len(numbers)) for s, e in pairs])
            self.vocabulary = list(numbers)
        else:
            self.vocabulary = [data[s:e] for s, e in zip(self.starts[seen], ends[seen])]

    def phrases(self, at: np.ndarray, hashes: np.ndarray, size: int):
        """Texts, first places and counts of the phrases of ``size`` words that start ``at``."""
        codes, seen = _numbered(hashes[at])
        twin = at[seen][codes]
        if not all((self.ids[at + j] == self.ids[twin + j]).all() for j in range(size)):
            rows = np.stack([self.ids[at + j] for j in range(size)], axis=1)
            _, seen, codes = np.unique(rows, axis=0, return_index=True, return_inverse=True)
            codes = codes.reshape(-1)
        first = at[seen]
        names = zip(*[[self.vocabulary[i] for i in self.ids[first + j]] for j in range(size)])
        return [b" ".join(n) for n in names], first, np.bincount(codes, minlength=len(seen))


@dataclass(frozen=True)
class Members:
    """A set of phrase hashes as a bit map; may say yes to others, never no to its own."""

    bits: int
    map: np.ndarray

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        spot = hashes >> np.uint64(64 - self.bits)
        return (self.map[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)


@dataclass(frozen=True)
class Rule:
    """Which phrases a pass counts; it looks at a phrase's words alone, so counts are whole.

    Counted are phrases whose first and last size - 1 words are ``known``. With ``fresh``, only
    those of which one part is fresh. With ``settled``, phrases whose parts are both settled
    only if they are known themselves. ``words``: single words and their total, too.
    """

    known: Members | None = None
    fresh: Members | None = None
    settled: Members | None = None
    words: bool = False


def _by_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, found = pd.factorize(hashes)
    return found, np.bincount(codes, minlength=len(found))


def _tally(data: bytes, stop: int, lang: str, longest: int, rule: Rule, named: bool) -> Iterator[tuple]:
    """Counts of one chunk: size, phrase texts (None unless ``named``), hashes and counts.

    Phrases start before byte ``stop``. Size 0 is the number of words.
    """
    words = Words(data)
    n = int(np.searchsorted(words.starts, stop))
    seed = mixed(np.frombuffer(lang.encode().ljust(8, b"\0")[:8], np.uint64) + np.uint64(len(lang)))
    none = np.zeros(0, bool)
    known, fresh, settled = (
        (lambda h, m=m: m.holds(h)) if m is not None else (lambda h: none)
        for m in (rule.known, rule.fresh, rule.settled)
    )

    def counted(at: np.ndarray, hashes: np.ndarray, size: int) -> tuple:
        if not named:
            return size, None, *_by_hash(mixed(hashes[at] + seed))
        names, first, counts = words.phrases(at, hashes, size)
        return size, names, mixed(hashes[first] + seed), counts

    hashes, own = words.hashes, mixed(words.hashes + seed)
    inside = known(own)
    if rule.words:
        if named:
            yield 0, [b""], np.zeros(1, np.uint64), np.array([n])
        # words that can't be frequent need no name
        at = np.flatnonzero(inside[:n]) if named else np.arange(n)
        if len(at):
            yield counted(at, hashes, 1)
    if rule.known is None or len(words.ids) < 2:
        return
    new, done = fresh(own), settled(own)
    for size in range(2, longest + 1):
        last = len(words.ids) - size + 1
        if last <= 0:
            return
        hashes = hashes[:last] * _STEP + words.hashes[size - 1 :]
        border = inside[:last] & inside[1 : last + 1]
        border &= words.piece[:last] == words.piece[size - 1 :]
        spots = np.flatnonzero(border)
        own = mixed(hashes[spots] + seed)
        member = known(own)
        wanted = np.ones(len(spots), bool)
        if rule.fresh is not None:
            wanted = new[spots] | new[spots + 1]
        if rule.settled is not None:
            wanted &= member | ~(done[spots] & done[spots + 1])
        at = spots[wanted & (spots < n)]
        if len(at):
            yield counted(at, hashes, size)

        def spread(values: np.ndarray) -> np.ndarray:
            full = np.zeros(last, bool)
            if len(values):
                full[spots] = values
            return full

        inside, new, done = spread(member), spread(fresh(own)), spread(settled(own))


def _chunks(texts: Iterable[bytes], most: int, longest: int) -> Iterator[tuple[bytes, int]]:
    """Folded texts in runs of about ``most`` bytes, each with the byte where its phrases end.

    A longer text is cut between words; the words behind the cut that a phrase may reach
    into are repeated.
    """
    reach = re.compile(rb"(?:[ \n]*[^ \n]+){0,%d}" % (longest - 1))
    gap = re.compile(rb"[ \n]")
    held, size = [], 0
    for text in texts:
        text = text.translate(FOLDING)
        while len(text) > most:
            cut = gap.search(text, most)
            if cut is None:
                break
            yield text[: reach.match(text, cut.start()).end()], cut.start()
            text = text[cut.start() :]
        held.append(text)
        size += len(text) + 1
        if size >= most:
            yield b"\n".join(held), size
            held, size = [], 0
    if held:
        yield b"\n".join(held), size


# --- passes -----------------------------------------------------------------------------

COUNTS = "lang string, size int, phrase string, h long, f long"


def _counts(docs: DataFrame, params: PhraseParams, rule: Rule, named: bool) -> DataFrame:
    """Counts of every chunk of ``docs`` (lang, text), to be added up."""
    shared = docs.sparkSession.sparkContext.broadcast(rule)
    longest, most = params.longest, params.chunk_bytes
    schema = COUNTS if named else "h long, size int, f long"
    columns = [c.split()[0] for c in schema.split(", ")]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            langs = batch.column("lang").dictionary_encode()
            codes = np.asarray(langs.indices)
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                rows = (texts[i].as_py() for i in np.flatnonzero(codes == code))
                for data, stop in _chunks(rows, most, longest):
                    for size, names, h, f in _tally(data, stop, lang, longest, shared.value, named):
                        made = {
                            "size": pa.array(np.full(len(h), size, np.int32)),
                            "h": pa.array(h.view(np.int64)),
                            "f": pa.array(f.astype(np.int64)),
                        }
                        if named:
                            made["lang"] = pa.array([lang]).take(pa.array(np.zeros(len(h), np.int32)))
                            made["phrase"] = pa.array(names, pa.binary()).cast(pa.string())
                        yield pa.RecordBatch.from_arrays([made[c] for c in columns], columns)

    return docs.mapInArrow(tally, schema)


def count_hashes(docs: DataFrame, params: PhraseParams, rule: Rule) -> DataFrame:
    """``h, size, f`` by phrase hash; phrases of one hash are counted together."""
    return _counts(docs, params, rule, False).groupBy("h", "size").agg(F.sum("f").alias("f"))


def count_phrases(docs: DataFrame, params: PhraseParams, rule: Rule) -> DataFrame:
    """``lang, size, phrase, h, f`` by words; size 0 holds the number of words."""
    counts = _counts(docs, params, rule, True)
    return counts.groupBy("lang", "size", "phrase").agg(F.max("h").alias("h"), F.sum("f").alias("f"))


def members(phrases: DataFrame, params: PhraseParams) -> Members:
    """The bit map of ``phrases``; the driver gets at most 2**filter_bits / 64 rows."""
    bits = min(params.filter_bits, max(10, (16 * phrases.count()).bit_length()))
    spots = phrases.select(F.shiftrightunsigned("h", 64 - bits).alias("spot"))
    bit = F.expr("shiftleft(1L, CAST(spot & 63 AS INT))")
    rows = (
        spots.groupBy(F.shiftright("spot", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toPandas()
    )
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return Members(bits, table)


def proposals(sample: DataFrame, least: int, params: PhraseParams) -> DataFrame:
    """Hashes (h) of the phrases that stand in ``sample`` at least ``least`` times, by length."""
    rule, found = Rule(words=True), None
    for size in range(1, params.longest + 1):
        counts = count_hashes(sample, params, rule).where((F.col("f") >= least) & (F.col("size") == size))
        new = stored(counts.select("h"), "proposals")
        found = new if found is None else found.union(new)
        if size == params.longest or new.isEmpty():
            return found
        rule = Rule(members(found, params), members(new, params))


def frequent_phrases(
    docs: DataFrame, params: PhraseParams = PhraseParams()
) -> tuple[DataFrame, list[int]]:
    """``lang, size, phrase, h, f`` of every phrase with ``least`` occurrences; size 0: all words.

    Also the number of border failures that each further pass starts from (the last is 0).
    """
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.col("text").cast("string").alias("text"),
        (F.pmod(F.xxhash64("doc_id"), F.lit(params.one_in)) == 0).alias("_drawn"),
    ).where("text IS NOT NULL")
    drawn = stored(rows.where("_drawn").drop("_drawn"), "phrase-sample")
    lower = max(2, int(np.ceil(params.caution * params.least / params.one_in)))
    sampled = members(proposals(drawn, lower, params), params)
    rows, frequent = rows.drop("_drawn"), F.col("f") >= params.least
    counts = count_hashes(rows, params, Rule(sampled, words=True))
    likely = stored(counts.where(frequent).select("h"), "likely")
    rule = Rule(members(likely, params), settled=sampled, words=True)
    counts = count_phrases(rows, params, rule)
    found = stored(counts.where(frequent | (F.col("size") == 0)), "phrases")
    missed = found.where("size > 0").join(likely, "h", "left_anti")
    known, failures = likely, []
    while True:
        # a phrase of full length has nothing behind it
        open_ends = missed.where(F.col("size") < params.longest)
        failures.append(open_ends.count())
        if not failures[-1]:
            return found, failures
        known = known.union(missed.select("h"))
        rule = Rule(members(known, params), members(open_ends, params))
        # a shared bit may make a pass count a phrase again, to the same number
        again = count_phrases(rows, params, rule).where(frequent).join(found, ["lang", "phrase"], "left_anti")
        missed = stored(again.select(*found.columns), "phrases")
        found = found.unionByName(missed)


# --- scores -----------------------------------------------------------------------------


def collocations(docs: DataFrame, params: PhraseParams = PhraseParams()) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``docs`` has doc_id, lang, text and any others. A null text has no words, a null language
    is ``und``, repeated rows count as often as they stand there, an empty table gives no
    rows. Ties of score and count are broken by the phrase's bytes.
    """
    found, _ = frequent_phrases(docs, params)
    totals = found.where("size = 0").select("lang", F.col("f").alias("n"))
    counts = found.where("size > 0").select("lang", "phrase", F.col("f"))
    whole = found.where("size > 1").select(
        "lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("_w")
    )
    join = lambda a, b: F.array_join(F.slice("_w", a, b), " ")
    # f of a longer candidate is at most a, so equal counts pass on from length to length
    longer = whole.where("size > 2").select(
        "lang", "a", F.explode(F.array(
            join(F.lit(1), F.col("size") - 1), join(F.lit(2), F.col("size") - 1)
        )).alias("phrase"),
    )
    kept = whole.join(longer, ["lang", "phrase", "a"], "left_anti")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "k",
        join(F.lit(1), F.col("k")).alias("_left"),
        join(F.col("k") + 1, F.col("size") - F.col("k")).alias("_right"),
    )
    part = lambda side, name: counts.select(
        "lang", F.col("phrase").alias(side), F.col("f").alias(name)
    )
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    scored = (
        cuts.join(part("_left", "l"), ["lang", "_left"])
        .join(part("_right", "r"), ["lang", "_right"])
        .join(totals, "lang")
        .withColumn("_over", 1000 * wide("a") * wide("n"))
        .withColumn("_under", wide("l") * wide("r"))
        .withColumn("score", F.expr("_over div _under"))
    )
    best = scored.groupBy("lang", "phrase", "a", "n").agg(
        F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("_cut")
    )
    rows = best.select("lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    place = F.row_number().over(W.partitionBy("lang").orderBy(*order))
    top = rows.withColumn("rank", place).where(F.col("rank") <= params.per_lang)
    return top.select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
