"""Fingerprints from prefix polynomial hashes, span equality and longest common extensions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import whole_text

#: Two primes below 2**31, so that a product of two residues fits 64 bits, and their bases.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)


@dataclass(frozen=True)
class PrintParams:
    """``span``: code points of a hashed span; ``kept``: least span hashes in a fingerprint."""

    span: int = 12
    kept: int = 64


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


class Powers:
    """Powers of the bases and of their inverses, grown as texts need them."""

    def __init__(self) -> None:
        self.up = [np.ones(1, np.uint64) for _ in PRIMES]
        self.down = [np.ones(1, np.uint64) for _ in PRIMES]

    def grow(self, n: int) -> None:
        for k, (p, base) in enumerate(zip(PRIMES, BASES, strict=True)):
            for table, step in ((self.up, base), (self.down, pow(base, p - 2, p))):
                while len(table[k]) < n:
                    more = table[k] * np.uint64(pow(step, len(table[k]), p)) % np.uint64(p)
                    table[k] = np.concatenate([table[k], more])


POWERS = Powers()


class PrefixHash:
    """Prefix arrays of a text: the sum of character times power of the base, modulo each prime.

    The sum over a span, times the inverse power of its start, is the hash of the span
    wherever it stands.
    """

    def __init__(self, chars: np.ndarray):
        self.n = len(chars)
        POWERS.grow(self.n + 1)
        self.sums = []
        for k, p in enumerate(PRIMES):
            terms = (chars + np.uint64(1)) * POWERS.up[k][: self.n] % np.uint64(p)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            self.sums.append(sums % np.uint64(p))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans [start, end)."""
        parts = []
        for k, p in enumerate(PRIMES):
            s = self.sums[k]
            difference = (s[ends] + np.uint64(p) - s[starts]) % np.uint64(p)
            parts.append(difference * POWERS.down[k][starts] % np.uint64(p))
        return parts[0] << np.uint64(31) | parts[1]

    def span(self, a: int, b: int) -> int:
        out = 0
        for k, p in enumerate(PRIMES):
            d = (int(self.sums[k][b]) - int(self.sums[k][a])) % p
            out = out << 31 | d * int(POWERS.down[k][a]) % p
        return out


def equal_spans(x: PrefixHash, a: int, y: PrefixHash, b: int, n: int) -> bool:
    """Whether x[a:a+n] equals y[b:b+n]."""
    return x.span(a, a + n) == y.span(b, b + n)


def common_extension(x: PrefixHash, a: int, y: PrefixHash, b: int) -> int:
    """The longest n with x[a:a+n] equal to y[b:b+n], by binary search."""
    lo, hi = 0, min(x.n - a, y.n - b)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if equal_spans(x, a, y, b, mid) else (lo, mid - 1)
    return lo


def _scatter(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def least_spans(x: PrefixHash, p: PrintParams) -> np.ndarray:
    """The least ``kept`` scattered hashes among a text's distinct spans, sorted.

    A text shorter than a span is its own only span; an empty one has none.
    """
    if not x.n:
        return np.zeros(0, np.uint64)
    n = min(p.span, x.n)
    starts = np.arange(x.n - n + 1)
    h = _scatter(x.spans(starts, starts + n))
    if len(h) > 8 * p.kept:  # most values can't be among the least; all are taken if too few remain
        few = np.unique(h[h <= np.partition(h, 4 * p.kept)[4 * p.kept]])
        if len(few) >= p.kept:
            return few[: p.kept]
    return np.unique(h)[: p.kept]


def fingerprint(x: PrefixHash, least: np.ndarray) -> str:
    """Length, hash of the whole text, then the least span hashes, in hex."""
    return f"{x.n:x}:{x.span(0, x.n):016x}:" + "".join(f"{v:016x}" for v in least.tolist())


def likeness(a: str, b: str, kept: int = PrintParams.kept) -> float:
    """Estimated share of common spans among all spans of two texts, from fingerprints alone.

    Equal fingerprints, also two of empty texts, give 1; one empty text gives 0.
    """
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rsplit(":", 1)[1]), ">u8") for f in (a, b))
    union = np.union1d(x, y)[:kept]
    both = np.intersect1d(x, y, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union)) if len(union) else 0.0


PRINTS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double, common_edited long, common_next long"
)


def fingerprints(docs: DataFrame, params: PrintParams = PrintParams()) -> DataFrame:
    """Fingerprint every text and its edited text, and compare both with the next text.

    ``docs`` has doc_id, text and others. The edited text replaces the last floor(n / 2)
    code points by as many first ones (or all) of the next document by doc_id, the last
    one's successor being the first. common_edited and common_next are the lengths of the
    common beginnings, found by binary search over the prefix arrays. Null texts are
    empty; rows that repeat a doc_id follow one another by text; rows with a null doc_id
    come first. A single row is its own successor. An empty table gives no rows.

    Documents are cut into ranges of doc_id and sorted, so a successor is the next row. Of
    each range only the first document is read once more, as the last row of the range before.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = own.select("doc_id").agg(
        F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n)
    ).first()[0]
    cuts = sorted(set(cuts or []))  # at most one bound per partition
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def range_of(ids):
        place = np.searchsorted(bounds, ids.fillna(np.iinfo(np.int64).min).astype("int64"), side="left")
        return ids.__class__(place.astype("int32"))

    ranged = own.withColumn("range", range_of("doc_id"))
    ids = own.select("doc_id").withColumn("range", range_of("doc_id"))
    least = ids.groupBy("range").agg(
        F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("has_null")
    )
    # per range its first doc_id, null before all others; one row per range
    firsts = {r["range"]: None if r["has_null"] else r["least"] for r in least.collect()}
    order = sorted(firsts)
    back = dict(zip(order, [*order[-1:], *order[:-1]], strict=True))
    head = F.col("doc_id").isin([i for i in firsts.values() if i is not None])
    if None in firsts.values():
        head = head | F.col("doc_id").isNull()
    first_text = ranged.where(head).groupBy("range").agg(
        F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text")).alias("first")
    )
    backs = spark.createDataFrame(sorted(back.items()), "range int, back int")
    edge = first_text.join(F.broadcast(backs), "range")  # at most one row per partition
    both = ranged.select("range", "doc_id", "text", F.lit(False).alias("edge")).union(
        edge.select("back", F.lit(None).cast("long"), "first.text", F.lit(True))
    )
    dealt = both.repartitionByRange(n, "range").sortWithinPartitions("range", "edge", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                part, doc_id, text, is_edge = (c[i].as_py() for c in batch.columns)
                now = Printed(doc_id, text, params)
                if held is not None:
                    rows.append(_compare(held, now, params))
                held = None if is_edge else now
            if rows:
                names = [c.split()[0] for c in PRINTS.split(", ")]
                kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.int64(), pa.int64()]
                columns = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return dealt.mapInArrow(run, PRINTS)


class Printed:
    """A text with its prefix arrays and fingerprint."""

    def __init__(self, doc_id, text: str, p: PrintParams):
        self.doc_id, self.chars = doc_id, codes(text)
        self.prefix = PrefixHash(self.chars)
        self.print = fingerprint(self.prefix, least_spans(self.prefix, p))


def _compare(own: Printed, following: Printed, p: PrintParams) -> tuple:
    n, half = len(own.chars), len(own.chars) // 2
    edited = np.concatenate([own.chars[: n - half], following.chars[:half]])
    e = PrefixHash(edited)
    edited_print = fingerprint(e, least_spans(e, p))
    sha = hashlib.sha256(edited.astype("<u4").tobytes().decode("utf-32-le").encode()).hexdigest()
    return (
        own.doc_id, n, sha, own.print, edited_print, likeness(own.print, edited_print, p.kept),
        likeness(own.print, following.print, p.kept), common_extension(own.prefix, 0, e, 0),
        common_extension(own.prefix, 0, following.prefix, 0),
    )
