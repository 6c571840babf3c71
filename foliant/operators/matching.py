"""Substring matching of many needles against many texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

# needles up to this number are compared as literals inside the scan
INLINE_NEEDLES = 512


def small_rows(df: DataFrame, most: int) -> list[Row] | None:
    """The rows of ``df`` if there are at most ``most``, else None; reads ``most + 1`` rows."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def keep_where(df: DataFrame, name: str, value: Column, test) -> DataFrame:
    """Add ``name`` and keep the rows whose value passes ``test``.

    As a filter inside a generator the value is computed once per row. A plain filter on
    a computed column would be pushed down and repeat the computation.
    """
    made = df.withColumn(name, value)
    kept = F.explode(F.filter(F.array(name), test)).alias(name)
    return made.select(*[c for c in made.columns if c != name], kept)


def named_by(facts: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """The rows of ``facts`` that ``rows`` name by ``keys``.

    Against a short measured list they are picked where they are read, so no table is shuffled
    for a few lookups.
    """
    return facts.join(rows.select(*keys), list(keys), "left_semi")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps use several times; a generator keeps them computed once."""
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(made)))


#: Needles that one pass looks for; their pieces are broadcast.
NEEDLES_A_PASS = 100_000
#: Needle lists up to this number are looked for in a text themselves, before anything is cut.
TESTED_NEEDLES = 128
#: One text in so many tells which pieces are rare.
SAMPLED_TEXTS = 64


def _pieces(text: Column, size: int) -> Column:
    """Distinct pieces of ``size`` characters.

    One regex walk with a lookahead. Cutting each piece by its place would walk from the start
    of the text again for every character. A piece that begins inside a surrogate pair is one
    more place to look in vain.
    """
    cut = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), 1)
    return F.when(F.length(text) >= size, F.array_distinct(cut))


def _parts(needle: Column) -> Column:
    """Where a needle may wait; one of one or two characters is its own piece."""
    return F.when(F.length(needle) < 3, F.array(needle)).otherwise(_pieces(needle, 3))


def _text_pieces(text: str, needles: DataFrame) -> Column | None:
    """The pieces of a text at which ``needles`` may wait; None without needles.

    A short list is tested in the text, and only needles that it holds are cut. For a longer
    one the text itself is cut.
    """
    listed = small_rows(needles.select("needle").distinct(), TESTED_NEEDLES)
    if listed is None:
        sizes = needles.select(F.least(F.length("needle"), F.lit(3)).alias("n")).distinct()
        cuts = sorted(r["n"] for r in sizes.collect())  # at most three lines
        none = F.array().cast("array<string>")
        return F.concat(*[F.coalesce(_pieces(F.col(text), n), none) for n in cuts])
    if not listed:
        return None
    known = F.array(*[F.lit(r["needle"]) for r in listed])
    held = F.filter(known, lambda needle: F.contains(F.col(text), needle))
    return F.array_distinct(F.flatten(F.transform(held, _parts)))


def _picked(needles: DataFrame, rows: DataFrame, text: str, cut: Column) -> DataFrame:
    """Add ``_piece`` to each needle: its piece that stands in fewest texts, by a sample of them.

    The sample decides how many texts are looked at in vain, never what is found.
    """
    pieces = needles.select("needle_id", "needle", F.explode(_parts(F.col("needle"))).alias("_piece"))
    drawn = rows.filter(F.pmod(F.xxhash64(text), F.lit(SAMPLED_TEXTS)) == 0)
    seen = drawn.select(F.explode(cut).alias("_piece"))
    common = seen.join(F.broadcast(pieces.select("_piece").distinct()), "_piece", "left_semi")
    counts = common.groupBy("_piece").agg(F.count("*").alias("_n"))
    weighed = pieces.join(counts, "_piece", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return weighed.groupBy("needle_id", "needle").agg(
        F.min_by("_piece", F.struct("_n", "_piece")).alias("_piece")
    )


def match_substrings(
    rows: DataFrame,
    keys: Sequence[str],
    text: str,
    needles: DataFrame,
    per_pass: int = NEEDLES_A_PASS,
) -> DataFrame:
    """``keys, needle_id, needle`` for every row whose ``text`` contains a needle.

    ``text`` must be lower-cased; ``needles`` is ``needle_id bigint, needle``, lower-cased
    and not empty. Each needle waits at its rarest piece. A text's pieces meet the waiting
    needles where the text is read; only hits leave the task. A list of more than ``per_pass``
    needles takes several passes.
    """
    keys = list(keys)
    wanted = needles.select(F.col("needle_id").cast("bigint"), "needle").distinct()
    pieces = _text_pieces(text, wanted)
    if pieces is None:
        return rows.join(wanted, F.lit(False)).select(*keys, "needle_id", "needle")
    passes = -(-wanted.count() // per_pass)
    cut = rows.select(*keys, text, F.explode(pieces).alias("_piece"))
    found = None
    for number in range(passes):
        mine = wanted.filter(F.pmod(F.xxhash64("needle_id", "needle"), F.lit(passes)) == number)
        waiting = F.broadcast(_picked(mine, rows, text, pieces))
        hits = cut.join(waiting, "_piece").filter(F.contains(F.col(text), F.col("needle")))
        part = hits.select(*keys, "needle_id", "needle")
        found = part if found is None else found.unionByName(part)
    return found
