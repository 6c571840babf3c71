"""Order-dependent building blocks that keep working when one key holds most rows.

A window over ``partitionBy(key)`` sends a whole key to one task. The helpers here
cut each key into blocks of its order column, work inside a block, and carry a
small per-block summary (one row per block) from one block to the next.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from foliant.session import durable


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    name: str,
    block: int = 4096,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over earlier rows of the same key.

    ``order`` is an integer column, unique within the key.
    """
    return running_totals(df, keys, order, {name: value}, block)


def running_totals(
    df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, Column], block: int = 4096
) -> DataFrame:
    """As :func:`running_total` for several values, by name, in one pass."""
    keys, names = list(keys), list(values)
    rows = df.withColumns({f"_value_{n}": value.cast("bigint") for n, value in values.items()})
    rows = rows.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    blocks = rows.groupBy(*keys, "_block").agg(*[F.sum(f"_value_{n}").alias(f"_total_{n}") for n in names])
    before = W.rowsBetween(W.unboundedPreceding, -1)
    earlier_blocks = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    inside = before.partitionBy(*keys, "_block").orderBy(order)

    def total(column: str, rows_before: WindowSpec) -> Column:
        return F.coalesce(F.sum(column).over(rows_before), F.lit(0))

    carried = blocks.select(
        *keys, "_block", *[total(f"_total_{n}", earlier_blocks).alias(f"_carried_{n}") for n in names]
    )
    summed = rows.withColumns({f"_inside_{n}": total(f"_value_{n}", inside) for n in names})
    placed = summed.join(carried, [*keys, "_block"]).withColumns(
        {n: F.col(f"_carried_{n}") + F.col(f"_inside_{n}") for n in names}
    )
    parts = [f"_{part}_{n}" for part in ("value", "inside", "carried") for n in names]
    return placed.drop("_block", *parts)


def neighbor(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    block: Column,
    ahead: bool = False,
) -> DataFrame:
    """Add ``name``: ``value`` of the previous (or next) row of the same key.

    ``block`` must not decrease along ``order``.
    """
    keys = list(keys)
    place = F.struct(*order)
    rows = df.withColumn("_block", block)
    shift, edge = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    inside = W.partitionBy(*keys, "_block").orderBy(*order)
    edges = rows.groupBy(*keys, "_block").agg(edge(F.struct(value), place).alias("_edge"))
    carried = edges.select(
        *keys,
        "_block",
        shift("_edge").over(W.partitionBy(*keys).orderBy("_block")).alias("_carried"),
    )
    return (
        rows.withColumn("_inside", shift(F.struct(value)).over(inside))
        .join(carried, [*keys, "_block"])
        .withColumn(name, F.coalesce("_inside", "_carried").getField(value))
        .drop("_block", "_inside", "_carried")
    )


def with_position(
    df: DataFrame, order: Sequence[Column], name: str, within: Sequence[str] = ()
) -> DataFrame:
    """Add ``name``: the 1-based place of each row in a total order.

    Rows are range-sorted over all tasks and written once; places follow from the
    row count of each range. With ``within``, counting restarts for each key.
    """
    within = list(within)
    spot = "_spot"
    ordered = durable(
        df.orderBy(*[F.col(c) for c in within], *order).withColumn(
            spot, F.monotonically_increasing_id()
        )
    )
    ordered = ordered.withColumn("_range", F.shiftright(spot, 33))
    ranges = ordered.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row per range, so this unpartitioned window stays small
    starts = ranges.select(
        "_range",
        F.coalesce(
            F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_start"),
    )
    placed = ordered.join(starts, "_range").withColumn(
        name, F.col("_start") + F.col(spot).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    )
    placed = placed.drop("_range", "_start", spot)
    if not within:
        return placed
    first = placed.groupBy(*within).agg(F.min(name).alias("_first"))
    return (
        placed.join(first, within).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first")
    )


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank"
) -> DataFrame:
    """The first ``k`` rows per key with their rank.

    The filter on ``row_number`` lets Spark keep only ``k`` rows per key and task
    before the shuffle (WindowGroupLimit), so a hot key moves ``k`` rows per task.
    """
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, place).filter(F.col(name) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key by ``order``, as a partial aggregate rather than a window."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


# --- greedy walks -----------------------------------------------------------------------
#
# What a walk does to a run of rows is a step function: from the ``lo`` of the row that opened
# the last group before the run to the same fact behind it, with the number of groups opened.
# ``reach`` holds the upper ends of the steps (largest ``hi`` of a run of entry rows), ``exit``
# and ``n`` what a walk through that entry leaves. Where no step is reached nothing changes.
# Such functions compose associatively, so they are combined in levels and handed back down.

#: Blocks that make a block of the next level.
FAN = 256

_NUMBERS = T.ArrayType(T.DoubleType())
_STEPS = T.StructType([T.StructField(name, _NUMBERS) for name in ("reach", "exit", "n")])
_PLACES = T.StructType([T.StructField(name, _NUMBERS) for name in ("opened", "before")])


def _next_rows(lo: np.ndarray, hi: np.ndarray, limit: float) -> np.ndarray:
    """Index of the first later row whose ``hi`` lies more than ``limit`` above ``lo``."""
    found = np.searchsorted(hi, lo + limit, side="right")
    return np.maximum(found, np.arange(len(lo)) + 1)


def _merged(reach: np.ndarray, leave: np.ndarray, n: np.ndarray) -> tuple:
    ends = np.append((leave[1:] != leave[:-1]) | (n[1:] != n[:-1]), True)
    return reach[ends], leave[ends], n[ends]


def _block_steps(lo: np.ndarray, hi: np.ndarray, limit: float, width: float) -> tuple:
    """The step function of one block of rows."""
    size = len(lo)
    jump = np.append(_next_rows(lo, hi, limit), size)
    last, n = np.arange(size + 1), np.append(np.ones(size), 0)
    # pointer doubling: where the walk from each row ends, and after how many rows
    while (jump[:-1] < size).any():
        last = np.where(jump < size, last[jump], last)
        n = n + n[jump]
        jump = jump[jump]
    edge = np.floor(lo[0] / width) * width + limit
    entries = min(1 + int(np.searchsorted(hi, edge, side="left")), size)
    return _merged(hi[:entries], lo[last[:entries]], n[:entries])


def _step(steps: tuple, opened: np.ndarray, limit: float) -> tuple:
    """Apply a step function to several ``opened`` values: new values and groups opened."""
    reach, leave, n = steps
    at = np.searchsorted(reach, opened + limit, side="right")
    met = at < len(reach)
    at = np.minimum(at, len(reach) - 1)
    return np.where(met, leave[at], opened), np.where(met, n[at], 0)


def _composed(parts: list[tuple], limit: float) -> tuple:
    """First ``parts[0]``, then the others, as one step function."""
    reach, leave, n = parts[0]
    for part in parts[1:]:
        moved, more = _step(part, leave, limit)
        # entries beyond the last step so far fall through to the next part
        tail = part[0] > reach[-1]
        reach = np.append(reach, part[0][tail])
        leave, n = np.append(moved, part[1][tail]), np.append(n + more, part[2][tail])
        reach, leave, n = _merged(reach, leave, n)
    return reach, leave, n


def _places(parts: list[tuple], opened: float, before: float, limit: float) -> tuple:
    """What is open, and how many groups there were, when each part begins."""
    seen, counts = [], []
    for part in parts:
        seen.append(opened)
        counts.append(before)
        moved, more = _step(part, np.array([opened]), limit)
        opened, before = moved[0], before + more[0]
    return seen, counts


def _mark_block(lo: np.ndarray, hi: np.ndarray, opened: float, limit: float) -> np.ndarray:
    follow = _next_rows(lo, hi, limit)
    flag = np.zeros(len(lo), dtype=bool)
    at = int(np.searchsorted(hi, opened + limit, side="right"))
    while at < len(lo):
        flag[at] = True
        at = int(follow[at])
    return flag


def _frame(rows: list[tuple], kind: T.StructType) -> pd.DataFrame:
    return pd.DataFrame([[list(v) for v in row] for row in rows], columns=kind.names)


def greedy_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    lo: str,
    hi: str,
    limit: float,
    span: int,
    name: str,
    opens: str,
    fan: int = FAN,
) -> DataFrame:
    """Number the groups of a greedy left-to-right walk along each key.

    A row opens a new group when its ``hi`` exceeds the ``lo`` of the row that opened
    the current group by more than ``limit``. ``lo`` and ``hi`` never decrease along
    ``order``, which is unique within the key. Adds ``name`` (0-based group) and ``opens``
    (does the row open it).

    The walk is sequential, so each key is cut into blocks ``limit * span`` wide, each summed
    up as a step function. ``fan`` neighbouring functions are composed into one, level by level
    up to one per key; then each level tells the one below what is open where its blocks
    begin, and the rows of all blocks are marked at once. A task holds one block of rows or
    ``fan`` functions, however many rows a key has.
    """
    keys = list(keys)
    limit, width = float(limit), float(limit) * span

    @F.pandas_udf(_STEPS)
    def steps(lows: pd.Series, highs: pd.Series) -> pd.DataFrame:
        return _frame([_block_steps(a, b, limit, width) for a, b in zip(lows, highs)], _STEPS)

    @F.pandas_udf(_STEPS)
    def compose(reaches: pd.Series, exits: pd.Series, counts: pd.Series) -> pd.DataFrame:
        rows = zip(reaches, exits, counts)
        return _frame([_composed(list(zip(*parts)), limit) for parts in rows], _STEPS)

    @F.pandas_udf(_PLACES)
    def walk(
        reaches: pd.Series, exits: pd.Series, counts: pd.Series, opened: pd.Series, before: pd.Series
    ) -> pd.DataFrame:
        rows = zip(reaches, exits, counts, opened, before)
        found = [_places(list(zip(r, e, n)), at, b, limit) for r, e, n, at, b in rows]
        return _frame(found, _PLACES)

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def mark(lows: pd.Series, highs: pd.Series, opened: pd.Series) -> pd.Series:
        rows = zip(lows, highs, opened)
        return pd.Series([_mark_block(low, high, start, limit) for low, high, start in rows])

    block = F.floor(F.col(lo) / F.lit(width)).cast("bigint").alias("_block")
    row = F.struct(
        F.col(order).alias("at"), F.col(lo).cast("double").alias("lo"), F.col(hi).cast("double").alias("hi")
    )
    grouped = (
        df.select(*keys, block, row.alias("_row"))
        .groupBy(*keys, "_block")
        .agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    )
    # written once: the blocks are read for their functions and again for their rows
    blocks = durable(grouped.withColumn("_steps", steps("_rows.lo", "_rows.hi")))
    ends = blocks.agg(F.min("_block"), F.max("_block")).first()
    first, last = (0, 0) if ends[0] is None else ends
    level = blocks.select(*keys, (F.col("_block") - first).alias("_at"), "_steps")
    levels, reach = [], last - first
    while True:
        upper = (
            level.groupBy(*keys, F.floor(F.col("_at") / F.lit(fan)).alias("_up"))
            .agg(F.sort_array(F.collect_list(F.struct("_at", "_steps"))).alias("_parts"))
        )
        levels.append(upper)
        reach //= fan
        if reach == 0:
            break
        parts = "_parts._steps"
        level = upper.select(
            *keys, F.col("_up").alias("_at"),
            compose(f"{parts}.reach", f"{parts}.exit", f"{parts}.n").alias("_steps"),
        )
    entry = None
    for upper in reversed(levels):
        if entry is None:
            met = upper.select(
                "*", F.lit(float("-inf")).alias("_opened"), F.lit(0.0).alias("_before")
            )
        else:
            met = upper.join(entry.withColumnRenamed("_at", "_up"), [*keys, "_up"])
        parts = "_parts._steps"
        found = walk(f"{parts}.reach", f"{parts}.exit", f"{parts}.n", "_opened", "_before")
        placed = met.select(*keys, F.col("_parts._at").alias("_ats"), found.alias("_found"))
        entry = placed.select(
            *keys,
            F.inline(
                F.arrays_zip(
                    F.col("_ats").alias("_at"), F.col("_found.opened").alias("_opened"),
                    F.col("_found.before").alias("_before"),
                )
            ),
        )
    entry = entry.withColumn("_block", F.col("_at") + first).drop("_at")
    marked = blocks.join(entry, [*keys, "_block"]).select(
        *keys, "_before", F.col("_rows.at").alias("_at"),
        mark("_rows.lo", "_rows.hi", "_opened").alias("_flags"),
    )
    rows = marked.select(
        *keys, "_before",
        F.inline(F.arrays_zip(
            F.col("_at").alias(order), F.col("_flags").alias(opens), _running(F.col("_flags")).alias("_local")
        )),
    )
    number = (F.col("_before").cast("bigint") + F.col("_local") - 1).alias(name)
    return df.join(rows.select(*keys, order, opens, number), [*keys, order])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _running(flags: pd.Series) -> pd.Series:
    return flags.map(lambda f: np.cumsum(np.asarray(f, dtype=bool)))
