"""Sharding by extendible hashing: a directory of hash prefixes, split only where too large."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import stored, whole_text

#: Bits of each of the two hashes of a row: the key's, then the row's own.
BITS = 60
#: Bits that one pass over the sizes resolves.
STEP = 4


def _hash(value: Column) -> Column:
    """The first 60 bits of a value's MD5."""
    return F.conv(F.substring(F.md5(value), 1, BITS // 4), 16, 10).cast("long")


def _prefix(depth: int) -> list[Column]:
    """The first ``depth`` bits of a row, as a value of either hash."""
    upper = F.shiftright("h1", BITS - min(depth, BITS))
    lower = F.shiftright("h2", BITS - (depth - BITS)) if depth > BITS else F.lit(0).cast("long")
    return [upper.alias("p1"), lower.alias("p2")]


def shards(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_bytes, shard, shard_depth, shard_bytes) for every row of ``docs``.

    A row's shard is the shortest prefix of its hash bits whose rows hold at most
    ``limit`` bytes of UTF-8 text together; ``shard`` has the bits as 0 and 1. The first
    60 bits are the key's hash. Rows that repeat a key, or have none, are told apart by 60
    more bits from their number, so copies of one row also spread. A row that alone
    exceeds the limit has a shard of its own at full depth. Null texts have no bytes; an
    empty table gives no rows.

    Rows of key, size and hashes are written once; texts are not shuffled. Each pass sums
    the sizes of the buckets that are still too large at the next four bits, as partial
    aggregates, and places the rows of those that fit.
    """
    sizes = docs.select(
        F.col(key), F.octet_length(whole_text(text)).cast("long").alias("text_bytes"),
        _hash(F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias("h1"),
        F.monotonically_increasing_id().cast("string").alias("_row"),
    )
    rows = stored(sizes.withColumn("h2", _hash(F.col("_row"))).drop("_row"), "sizes")
    depth, placed = 0, []
    while not rows.isEmpty():
        end = depth + STEP
        last = end == 2 * BITS
        leaves = rows.groupBy(*_prefix(end)).agg(F.sum("text_bytes").alias("leaf"))
        # at most 16 leaves stand below one bucket, so these windows are small
        sums = []
        for d in range(depth if depth == 0 else depth + 1, end + 1):
            cut = end - d
            above = [
                F.shiftright("p1", max(0, cut - max(0, end - BITS))) if end - cut < BITS else F.col("p1"),
                F.shiftright("p2", min(cut, max(0, end - BITS))) if end > BITS else F.col("p2"),
            ]
            sums.append((d, F.sum("leaf").over(Window.partitionBy(*above))))
        fits = F.coalesce(
            *[
                F.when((total <= limit) | F.lit(last and d == end), F.struct(F.lit(d).alias("shard_depth"), total.alias("shard_bytes")))
                for d, total in sums
            ]
        )
        directory = stored(leaves.select("p1", "p2", fits.alias("fits")), "directory")
        named = rows.select("*", *_prefix(end)).join(directory, ["p1", "p2"]).drop("p1", "p2")
        named = stored(named.withColumn("_open", F.col("fits").isNull()), "buckets", ["_open"])
        placed.append(named.where("not _open").select(key, "text_bytes", "h1", "h2", "fits.*"))
        rows = named.where("_open").select(*rows.columns)
        depth = end
    if not placed:
        return docs.select(key).limit(0).selectExpr(key, "0L text_bytes", "'' shard", "0 shard_depth", "0L shard_bytes")
    upper = F.expr(f"lpad(bin(shiftright(h1, {BITS} - least(shard_depth, {BITS}))), least(shard_depth, {BITS}), '0')")
    lower = F.expr(f"lpad(bin(shiftright(h2, {2 * BITS} - shard_depth)), shard_depth - {BITS}, '0')")
    bits = F.when(F.col("shard_depth") > BITS, F.concat(upper, lower)).otherwise(upper)
    whole = reduce(DataFrame.union, placed)
    return whole.select(key, "text_bytes", bits.alias("shard"), "shard_depth", "shard_bytes")
