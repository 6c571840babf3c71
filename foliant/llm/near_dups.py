"""Near-duplicate groups: SuperMinHash signatures, banding, verification, components.

Documents with equal shingle sets form a class; everything after that runs on one
representative per class. Bands propose pairs, the full sets confirm them, and links are
joined into components by alternating star contractions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import beside_extreme, salted_lookup, scratch, stored, whole_text


@dataclass(frozen=True)
class NearParams:
    """Production parameters: shingle width, link threshold in percent, signature shape.

    Two sets of similarity 0.75 share none of 32 bands of four with probability 5e-6.
    ``doubt`` is the estimate below which a proposed pair isn't confirmed on full sets;
    it lies four standard deviations under the threshold. ``block``: most members of a
    bucket that one task compares at a time. ``pivots``: bucket pivots that a member is compared
    with before everything else. ``filter_bits``: size of the filter on texts.
    """

    width: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    doubt: float = 0.58
    block: int = 512
    pivots: int = 3
    filter_bits: int = 1 << 24

    @property
    def size(self) -> int:
        return self.bands * self.rows


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts; remembers hashes of words."""

    def __init__(self, width: int, memory: int = 400_000):
        self.width, self.memory, self.words = width, memory, {}
        self.factors = _mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # bytes: A-Z only, and exactly the six blanks
        if not words:
            return np.zeros(0, np.uint64)
        known = self.words
        if len(known) > self.memory:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.width, len(h))
        total = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            total += _mix(h[k : k + len(total)]) * self.factors[k]
        return np.unique(_mix(total))


def super_min_hash(sets: list[np.ndarray], size: int) -> np.ndarray:
    """SuperMinHash signatures (one row of 64-bit values per set); empty sets give the maximum.

    Each element carries a random permutation of the places and a random fraction per
    rank; place p keeps the least (rank, fraction) of all elements. The permutation is
    start + rank * odd step modulo a power of two, with start and step drawn by element,
    so at every rank an element falls on every place alike. Ranks are taken in order over
    all elements of the sets that still need them, and a set stops as soon as no place
    can improve: its worst value lies below the next rank.
    """
    if size & (size - 1):
        raise ValueError("the signature size must be a power of two")
    going = np.flatnonzero([len(s) > 0 for s in sets])
    out = np.full((len(sets), size), np.iinfo(np.uint64).max, np.uint64)
    best = out[going]
    counts = np.array([len(sets[i]) for i in going], np.int64)
    seed = np.concatenate([sets[i] for i in going]) if len(going) else np.zeros(0, np.uint64)
    drawn = _mix(seed + np.uint64(0x9E3779B97F4A7C15))
    mask = np.uint64(size - 1)
    place, step = drawn & mask, (drawn >> np.uint64(20) & mask) | np.uint64(1)
    for rank in range(size):
        if not len(going):
            break
        base = np.repeat(np.arange(len(going), dtype=np.uint64) * np.uint64(size), counts)
        seed = seed * np.uint64(0xD1342543DE82EF95) + np.uint64(0x9E3779B97F4A7C15)
        value = np.uint64(rank) << np.uint64(32) | ((seed ^ (seed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32))
        np.minimum.at(best.reshape(-1), (base + place).astype(np.int64), value)
        more = best.max(axis=1) >= np.uint64(rank + 1) << np.uint64(32)
        if not more.all():
            out[going[~more]] = best[~more]
            rows = np.repeat(more, counts)
            going, best, counts = going[more], best[more], counts[more]
            seed, place, step = seed[rows], place[rows], step[rows]
        place = (place + step) & mask
    out[going] = best
    return out


_SKETCH = "doc_id long, text_key binary, n_shingles long, set_key binary, signature binary"


def sketches(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """Per row of ``docs``: set size, a key equal for equal sets, and the signature.

    A text without words has an empty set, a null key and a null signature. Signatures
    are stored as 32 bits per place, which leaves equal values equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(params.width)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sets = [shingles(t) for t in part.column(2).to_pylist()]
                full = _mix(super_min_hash(sets, params.size)).astype("<u4")
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                signs = [row.tobytes() if len(s) else None for s, row in zip(sets, full, strict=True)]
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())],
                    names=["doc_id", "text_key", "n_shingles", "set_key", "signature"],
                )

    return _ids_texts(docs).mapInArrow(run, _SKETCH)


def text_key(text: str | Column = "text") -> Column:
    """Tells texts apart, so that rows which share a doc_id don't share a name."""
    return F.unhex(F.md5(whole_text(text)))


def _ids_texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"),
        whole_text("text").alias("text"),
    )


def _buckets(reps: DataFrame, params: NearParams) -> DataFrame:
    """(bucket, rep, pivot, members) for the bands that at least two representatives share.

    The pivot of a bucket is the member that shares most bands with most others. In a group
    of copies that is the text they were made from, which is linked even with copies that
    aren't linked with each other; so stars around pivots leave few members apart. Counts
    and pivots are partial aggregates; each is written, so the joins stand between two plain
    shuffles and Spark can split a bucket of any size.
    """
    size = 4 * params.rows
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(params.bands - 1)),
        lambda i: F.xxhash64(i, F.substring("signature", i * size + 1, F.lit(size))),
    )
    rows = reps.select("rep", F.explode(keys).alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("members"))
    shared = stored(rows.join(stored(counts.where("members > 1"), "shared-bands"), "bucket"), "shared")
    degrees = shared.groupBy("rep").agg(F.sum("members").alias("degree"))
    pivots = (
        shared.join(degrees, "rep").groupBy("bucket")
        .agg(F.max_by("rep", F.struct("degree", -F.col("rep"))).alias("pivot"))
    )
    return shared.join(stored(pivots, "pivots"), "bucket")


def _stars(buckets: DataFrame, params: NearParams) -> DataFrame:
    """Pairs (a, b) of each member with the pivots that it shares most buckets with."""
    beside = buckets.where("rep <> pivot").groupBy("rep", "pivot").agg(F.count("*").alias("n"))
    nearest = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "pivot"))), 1, params.pivots)
    chosen = beside.groupBy("rep").agg(nearest.alias("near"))  # at most one entry per band
    first = chosen.select(F.explode("near.pivot").alias("x"), F.col("rep").alias("y"))
    twos = buckets.where("members = 2 AND rep <> pivot").select(F.col("pivot").alias("x"), F.col("rep").alias("y"))
    both = first.union(twos)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _likely(pairs: DataFrame, reps: DataFrame, params: NearParams) -> DataFrame:
    """Pairs (a, b) whose signatures agree in at least the doubtful share of places."""
    sign = lambda name: reps.select(F.col("rep").alias(name), F.col("signature").alias(f"s{name}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                agree = _matrix(batch.column("sa"), params) == _matrix(batch.column("sb"), params)
                keep = agree.mean(axis=1) >= params.doubt
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    signed = pairs.join(sign("b"), "b").join(sign("a"), "a").select("a", "b", "sa", "sb")
    return signed.mapInArrow(check, "a long, b long").distinct()


def _matrix(signatures: pa.Array, params: NearParams) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), "<u4").reshape(-1, params.size)


def _among(texts: DataFrame, ids: DataFrame, params: NearParams) -> DataFrame:
    """``texts`` without most of those whose doc_id isn't in ``ids``, so that few are shuffled.

    It lets every wanted text pass; the join after it is exact.
    """
    return _flagged(texts, ids, params).where("_may").select(*texts.columns)


def _flagged(texts: DataFrame, ids: DataFrame, params: NearParams) -> DataFrame:
    """Add ``_may``: false only where a doc_id (long) is surely not in ``ids``; null ones aren't.

    A bitmap over hashed ids, 4 KB per bucket of 32,768 bits and 2 MB in all whatever the
    number of ids, is broadcast.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(params.filter_bits)) + 1
    bits = ids.groupBy(F.bitmap_bucket_number(place("doc_id")).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place("doc_id"))).alias("_bits")
    )
    at = F.bitmap_bit_position(place("doc_id"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10)
    found = F.expr("shiftright(cast(_byte AS int), cast(_at & 7 AS int)) & 1") == 1
    named = texts.withColumn("_bucket", F.bitmap_bucket_number(place("doc_id")))
    joined = named.join(F.broadcast(bits), "_bucket", "left").withColumns({"_byte": byte, "_at": at})
    may = F.col("doc_id").isNotNull() & F.coalesce(found, F.lit(False))
    return joined.select(*texts.columns, may.alias("_may"))


def _full_sets(wanted_reps: DataFrame, docs: DataFrame, reps: DataFrame, params: NearParams) -> DataFrame:
    """(id, shingles): the whole shingle sets of the representatives in ``wanted_reps`` (rep)."""
    ids = stored(reps.select("rep", "at.doc_id", "at.text_key").join(wanted_reps, "rep"), "pair-ids")
    # a text that stands in many rows under one id is passed on once by each task
    wanted = _among(_ids_texts(docs), ids, params).groupBy("doc_id", "text_key").agg(F.first("text").alias("text"))
    named = wanted.join(ids, ["doc_id", "text_key"]).select("rep", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(params.width)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [shingles(t).tobytes() for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(found, pa.binary())], names=["id", "shingles"])

    return stored(named.mapInArrow(sets, "id long, shingles binary"), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, params: NearParams) -> DataFrame:
    """The pairs (a, b) of representatives whose full sets reach the threshold."""
    open_reps = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    full = _full_sets(open_reps, docs, reps, params)
    first = pairs.join(full.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = first.join(full.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= params.percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links`` (a, b).

    Alternates the large-star and small-star contractions until only stars are left: every
    node stands below one other, which stands below none. Each step is a salted minimum per
    node, written to the shared folder.
    """
    node = lambda x, y: [F.col(x).alias("u"), F.col(y).alias("v")]
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not _only_stars(edges):
        both = edges.union(edges.select(*node("v", "u")))
        large = beside_extreme(both, "u", "v", "m").where("v > u").select(
            F.col("v").alias("u"), F.least("m", "u").alias("v")
        )
        large = stored(large.where("u <> v").distinct(), "large-star")
        small = beside_extreme(large, "u", "v", "m")
        edges = stored(
            small.select(F.col("u"), F.col("m").alias("v"))
            .union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct(),
            "small-star",
        )
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    )


def _only_stars(edges: DataFrame) -> bool:
    """Whether each ``u`` has one ``v`` and no ``v`` is a ``u``; edges go from larger to smaller."""
    below = edges.groupBy("u").agg(F.count("*").alias("n"))
    tops = edges.select("v").distinct()
    odd = below.join(tops, below["u"] == tops["v"], "left").where("n > 1 OR v IS NOT NULL")
    return odd.isEmpty()


def _labelled(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """Add ``label``, the component so far, to rows with ``rep``."""
    return rows.join(comps, rows["rep"] == comps["node"], "left").select(
        *rows.columns, F.coalesce("component", "rep").alias("label")
    )


_PLACE = "pivot long, i int, j int, rep long, label long, out boolean"
_GROUP = ["pivot", "i", "j"]


def _proposals(buckets: DataFrame, reps: DataFrame, comps: DataFrame, params: NearParams) -> DataFrame:
    """The members that have a likely partner of another label, by group and block.

    A group is all members of the buckets of one pivot, so a pair that shares many bands meets
    once. Buckets of two were settled by their star; a group whose members all have one label
    proposes nothing. In the others, members outside the pivot's label stand against all
    members, ``block`` by ``block``, so a task holds two blocks however large the group is,
    and rows are repeated once per block of the other side.
    """
    members = buckets.where("members > 2").select("pivot", "rep").distinct()
    rows = stored(_labelled(members, comps), "group-labels")
    mixed = rows.groupBy("pivot").agg(
        F.min("label").alias("lo"),
        F.max("label").alias("hi"),
        F.max(F.when(F.col("rep") == F.col("pivot"), F.col("label"))).alias("main"),
        F.count("*").alias("members"),
    )
    marked = stored(rows.join(stored(mixed.where("lo <> hi").drop("lo", "hi"), "mixed"), "pivot"), "marked")
    outside = marked.where("label <> main")
    n_blocks = lambda n: F.ceil(F.col(n) / params.block).cast("int")
    apart = stored(outside.groupBy("pivot").agg(F.count("*").alias("_n")), "apart")
    facing = apart.select("pivot", n_blocks("_n").alias("rows_of"))
    at = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    left = outside.join(facing, "pivot").withColumn("columns_of", n_blocks("members")).select(
        "pivot", at("rows_of").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("columns_of") - 1)).alias("j"), "rep", "label",
        F.lit(True).alias("out"),
    )
    right = marked.join(facing, "pivot").withColumn("columns_of", n_blocks("members")).select(
        "pivot", F.explode(F.sequence(F.lit(0), F.col("rows_of") - 1)).alias("i"),
        at("columns_of").alias("j"), "rep", "label", F.lit(False).alias("out"),
    )
    signed = left.union(right).join(reps.select("rep", "signature"), "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, groups in _whole_groups(batches):
            label, out = rows.column("label").to_numpy(), rows.column("out").to_numpy()
            signs, keep = _matrix(rows.column("signature"), params), np.zeros(rows.num_rows, bool)
            for lo, hi in groups:
                y = lo + np.flatnonzero(~out[lo:hi])
                for x in lo + np.flatnonzero(out[lo:hi]):
                    near = y[_like(signs, x, y, label) >= params.doubt]
                    keep[near] = True
                    keep[x] |= len(near) > 0
            if keep.any():
                yield from rows.filter(pa.array(keep)).select(_COLUMNS).to_batches()

    dealt = signed.select(*_COLUMNS, "signature").repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    return dealt.mapInArrow(run, _PLACE)


_COLUMNS = [c.split()[0] for c in _PLACE.split(", ")]


def _like(signs: np.ndarray, x: int, y: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The estimated likeness of row ``x`` to the rows ``y``; -1 within a label."""
    return np.where(label[y] == label[x], -1.0, (signs[y] == signs[x]).mean(axis=1))


def _links(proposed: DataFrame, docs: DataFrame, reps: DataFrame, params: NearParams) -> DataFrame:
    """Links (a, b) that full sets confirm between the labels of proposed members.

    Sets are compared where the blocks meet, and of the links of a block only those leave the
    task that join two labels which the block hasn't joined yet: at most one per member.
    """
    full = _full_sets(proposed.select("rep").distinct(), docs, reps, params)
    known = full.join(reps.select(F.col("rep").alias("id"), "signature"), "id")
    both = proposed.join(known, proposed["rep"] == known["id"]).select(*_COLUMNS, "signature", "shingles")

    def linked(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(y) for y in others])
        every = np.concatenate(others)
        found = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every
        shared = np.add.reduceat(found.astype(np.int64), np.cumsum(sizes) - sizes)
        return 100 * shared >= params.percent * (len(x) + sizes - shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, groups in _whole_groups(batches):
            rep, label, out = (rows.column(c).to_numpy() for c in ("rep", "label", "out"))
            signs = _matrix(rows.column("signature"), params)
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows.column("shingles")]
            pairs = []
            for lo, hi in groups:
                joined: dict[int, int] = {}

                def root(k: int, joined: dict[int, int] = joined) -> int:
                    while k in joined:
                        k = joined[k]
                    return k

                y = lo + np.flatnonzero(~out[lo:hi])
                for x in lo + np.flatnonzero(out[lo:hi]):
                    like = _like(signs, x, y, label)
                    near = np.flatnonzero(like >= params.doubt)
                    near = y[near[np.argsort(-like[near], kind="stable")]]
                    # the likeliest first: a link to a label settles all others to it
                    for part in (near[:4], near[4:64], near[64:]):
                        part = [k for k in part if root(label[k]) != root(label[x])]
                        if not part:
                            continue
                        for k in np.array(part)[linked(sets[x], [sets[k] for k in part])]:
                            one, two = root(label[x]), root(label[k])
                            if one != two:
                                joined[max(one, two)] = min(one, two)
                                pairs.append((min(rep[x], rep[k]), max(rep[x], rep[k])))
            if pairs:
                a, b = zip(*pairs, strict=True)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = both.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of whole groups with the rows at which each begins and ends.

    Rows come sorted by group; the last group of a batch waits for the next one.
    """
    held = None
    for batch in _and_end(batches):
        rows = pa.Table.from_batches([x for x in (held, batch) if x is not None] or [pa.record_batch({k: [] for k in _GROUP})])
        rows = rows.combine_chunks()
        if not rows.num_rows:
            continue
        group = np.stack([rows.column(k).to_numpy() for k in _GROUP], axis=1)
        ends = (np.flatnonzero(np.any(group[1:] != group[:-1], axis=1)) + 1).tolist()
        ends += [rows.num_rows] if batch is None else []
        rest = rows.slice(ends[-1] if ends else 0).combine_chunks()
        held = rest.to_batches()[0] if rest.num_rows else None
        if ends:
            yield rows.slice(0, ends[-1]), list(zip([0, *ends], ends))


def _and_end(batches: Iterator) -> Iterator:
    """The batches, then None."""
    yield from batches
    yield None


def _grouped(docs: DataFrame, params: NearParams) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, n_shingles, and ``top``, the doc_id and text_key of
    the row that stands for its group; null for rows without words or doc_id.

    Pairs are confirmed in two rounds: members against the pivots of their buckets, and the
    pairs of buckets of two; then every likely pair of one pivot's buckets whose labels still
    differ. Links within a label can't change a component and are skipped.
    """
    own = stored(sketches(docs, params), "sketches")
    worded = own.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = worded.groupBy("set_key").agg(
        F.min(F.struct("doc_id", "text_key")).alias("at"), F.first("signature").alias("signature")
    )
    # numbered once and written: a class keeps its number whatever ids its rows share
    reps = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    buckets = stored(_buckets(reps, params), "buckets")
    tried = stored(_likely(stored(_stars(buckets, params), "stars"), reps, params), "pairs")
    comps = stored(components(_confirmed(tried, docs, reps, params)), "labels")
    proposed = stored(_proposals(buckets, reps, comps, params), "proposed")
    if not proposed.isEmpty():
        new = stored(_links(proposed, docs, reps, params), "confirmed")
        if not new.isEmpty():
            old = comps.select(F.col("node").alias("a"), F.col("component").alias("b"))
            comps = stored(components(old.union(new)), "labels")
    grouped = stored(_labelled(reps.select("set_key", "rep", "at"), comps), "class-labels")
    tops = grouped.groupBy("label").agg(F.min("at").alias("top"))
    named = salted_lookup(grouped.select("set_key", "rep", "label"), "label", "rep", tops)
    rows = worded.select("doc_id", "text_key", "n_shingles", "set_key")
    found = salted_lookup(rows, "set_key", "doc_id", named.select("set_key", "top"))
    alone = own.where("set_key IS NULL OR doc_id IS NULL")
    columns = ["doc_id", "text_key", "n_shingles"]
    none = F.lit(None).cast(found.schema["top"].dataType)
    return found.select(*columns, "top").union(alone.select(*columns, none.alias("top")))


def near_groups(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, others): doc_id, n_shingles, component_id, kept.

    Links join documents whose sets have 100 * intersection >= percent * union. A text
    without words, or null, has an empty set and stands alone. A row with a null doc_id
    is in no group: its component_id is null and it is kept. Rows that repeat a doc_id
    are judged by their own texts: other texts under one id are other members. An empty
    table gives no rows. Tables made on the way are removed.
    """
    with scratch(docs.sparkSession, "near-groups") as keep:
        component = F.coalesce("top.doc_id", "doc_id")
        return keep(
            _grouped(docs, params).select(
                "doc_id", "n_shingles", component.alias("component_id"),
                F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
            )
        )


def one_per_group(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """The rows of ``docs`` that are kept, one per group, with their own columns.

    The row with the least doc_id stands for its group, that with the least hash of the text
    if several texts share the id; of rows equal in both one stays. Rows without words or
    with a null doc_id all stay, and so does a text under a repeated id that is near to
    no other.
    """
    names = docs.columns
    with scratch(docs.sparkSession, "one-per-group") as keep:
        rows = _grouped(docs, params).where("top IS NOT NULL")
        is_top = (F.col("doc_id") == F.col("top.doc_id")) & (F.col("text_key") == F.col("top.text_key"))
        marks = rows.groupBy("doc_id", "text_key").agg(
            F.max(~is_top).alias("gone"), (F.count("*") > 1).alias("again")
        )
        marks = keep(marks.where("gone OR again"))
    packed = F.struct(*[docs[c] for c in names]).alias("_row")
    # most rows are in no mark, which their ids tell where they are read
    rows = _flagged(docs.select(packed, F.col("doc_id").cast("long").alias("doc_id")), marks, params)
    clear = rows.where("NOT _may").select("_row.*")
    key = rows.where("_may").select("_row", "doc_id", text_key(F.col("_row.text")).alias("_key"))
    same = (key["doc_id"] == marks["doc_id"]) & (key["_key"] == marks["text_key"])
    seen = key.join(marks, same, "left").select("_row", key["doc_id"], "_key", "gone", "again")
    left = seen.where(~F.coalesce("gone", F.lit(False)))
    once = left.where(~F.coalesce("again", F.lit(False))).select("_row.*")
    several = left.where("again").groupBy("doc_id", "_key").agg(F.first("_row").alias("_row"))
    return clear.union(once).union(several.select("_row.*"))
