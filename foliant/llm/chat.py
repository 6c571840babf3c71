"""Chat formatting by rendering successive prefixes of a conversation with a black box."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
#: A template gets the turns and the place of the first one in its conversation.
Template = Callable[[Turns, int], str]

#: Strings with a meaning in the markup; in texts a backslash parts their first two characters.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]")
SENTINEL = ""
BLOCK = 64


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROLS:
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def marked_turns(turns: Turns, first: int) -> str:
    """The standard template: role in a header, text escaped, an end mark after each turn."""
    return "".join(f"<|{escape(role)}|>\n{escape(text)}</s>\n" for role, text in turns)


def parse_marked(formatted: str) -> Turns:
    """The turns of a text in the standard template."""
    found = re.findall(r"<\|(.*?)\|>\n(.*?)</s>\n", formatted, flags=re.S)
    return [(unescape(role), unescape(text)) for role, text in found]


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by binary search over equal slices."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def locate(turns: Turns, first: int, render: Template) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """Render the prefixes of ``turns`` and compare neighbours.

    Returns the whole output, the span of each turn, the span of each text, and whether
    some prefix's output isn't a prefix of the next one, so that the template rewrites
    history (spans then start at the first difference). A text's place is found by
    rendering its turn once more with a sentinel for the text.
    """
    before, spans, texts, rewrites = "", [], [], False
    for k, (role, text) in enumerate(turns):
        now = render(turns[: k + 1], first)
        start = _common(before, now)
        rewrites |= start < len(before)
        spans.append((start, len(now)))
        probe = render([*turns[:k], (role, SENTINEL)], first)
        at = probe.rfind(SENTINEL)
        size = len(now) - len(probe) + 1
        texts.append((at, at + size) if at >= 0 and size >= 0 else (len(now), len(now)))
        before = now
    return before, spans, texts, rewrites


FORMATTED = (
    "conv_id long, block long, formatted string, roles array<string>,"
    " turn_spans array<array<int>>, text_spans array<array<int>>, loss_spans array<array<int>>,"
    " rewrites boolean"
)
_FORMATTED = pa.schema(
    [("conv_id", pa.int64()), ("block", pa.int64()), ("formatted", pa.string()), ("roles", pa.list_(pa.string()))]
    + [(c, pa.list_(pa.list_(pa.int32()))) for c in ("turn_spans", "text_spans", "loss_spans")]
    + [("rewrites", pa.bool_())]
)


def format_chats(
    turns: DataFrame, render: Template = marked_turns, trained: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """Format conversations given as rows (conv_id, turn, role, text, others).

    Returns one row per block of up to 64 turns, blocks of a conversation in order:
    conv_id, block, formatted, roles, the spans of turns and texts in ``formatted``,
    loss_spans (texts of the trained roles) and rewrites. The output of a conversation is
    its blocks one after another. A block is compared with its successor by rendering the
    turns on both sides of the seam.

    Null roles and texts are empty, rows without a turn come first, ties are ordered by
    role and text, repeated rows stay; rows with a null conv_id form one conversation.
    An empty table gives no rows. A conversation streams through one task, since its order
    is what is formatted; memory holds one block.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, block, held, seam, out = None, 0, [], None, []

        def close() -> None:
            if held:
                text, spans, texts, rewrites = locate(held, block * BLOCK, render)
                if seam is not None:
                    alone = render([seam], block * BLOCK - 1)
                    rewrites |= not render([seam, held[0]], block * BLOCK - 1).startswith(alone)
                loss = [s for s, (role, _) in zip(texts, held, strict=True) if role in trained]
                out.append((conv, block, text, [r for r, _ in held], spans, texts, loss, rewrites))

        for batch in batches:
            for c, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if c != conv or len(held) == BLOCK:
                    close()
                    block, seam = (block + 1, held[-1]) if c == conv else (0, None)
                    conv, held = c, []
                held.append((role, text))
            yield from _rows(out, _FORMATTED)
            out = []
        close()
        yield from _rows(out, _FORMATTED)

    return dealt.mapInArrow(run, FORMATTED)


def _rows(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        columns = zip(*rows, strict=True)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"
_DIGESTS = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.bool_())]
)


def chat_digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the blocks of the standard template.

    Blocks follow one another as ``format_chats`` made them; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []

        def close() -> None:
            if state:
                conv, n, turns, chars, loss, size, rewrites = state
                out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, rewrites))

        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] == 0:
                    close()
                    state = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                for role, text in parse_marked(r["formatted"]):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for a, b in r["loss_spans"]:
                    text = unescape(r["formatted"][a:b])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(r["formatted"])
                state[6] |= r["rewrites"]
            yield from _rows(out, _DIGESTS)
            out = []
        close()
        yield from _rows(out, _DIGESTS)

    return formatted.mapInArrow(run, DIGESTS)
