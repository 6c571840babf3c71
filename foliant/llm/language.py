"""Language identification: averaged hashed subword embeddings under a linear softmax.

Trained by stochastic gradient descent in numpy on a bounded sample of labelled texts, with a
temperature and a rejection threshold from texts that the training left out.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Answer where nothing can be told.
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    """Production parameters.

    ``sample``: most labelled rows that the model is fitted on, shared evenly by the languages,
    those with the smallest hash. Of each row ``spans`` stretches of at most ``span_chars``
    characters are looked at in training; predictions read whole texts. ``reject_share``: share
    of the right answers of the calibration rows that may be rejected.
    """

    sample: int = 8_000
    spans: int = 4
    span_chars: int = 240
    buckets: int = 1 << 14
    dims: int = 16
    longest: int = 4
    epochs: int = 3
    batch: int = 64
    rate: float = 0.5
    calibration_one_in: int = 5
    reject_share: float = 0.01
    chunk_chars: int = 1 << 20


# --- subwords ---------------------------------------------------------------------------


@functools.cache
def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points; lone surrogates stay as they are."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


_STEP = np.uint32(0x01000193)


def subwords(points: np.ndarray, params: LanguageParams) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and buckets of the subwords of 1 to ``longest`` characters.

    A subword is a run of letters, or one with the word's edge before or behind it; every
    other character counts as an edge.
    """
    letter = letter_table()[points]
    shown = np.where(letter, points, np.uint32(32))
    out, h, run = [], np.zeros(len(points), np.uint32), np.ones(len(points), bool)
    for size in range(1, params.longest + 1):
        last = len(points) - size + 1
        if last <= 0:
            break
        h = (h[:last] ^ shown[size - 1 :]) * _STEP
        if size > 2:  # characters between the first and the last are letters
            run = run[:last] & letter[size - 2 : size - 2 + last]
        ends = letter[:last] | letter[size - 1 :]
        at = np.flatnonzero(ends & run[:last])
        mixed = h[at] + np.uint32(size)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out.append((at, ((mixed ^ (mixed >> np.uint32(12))) % np.uint32(params.buckets)).astype(np.int32)))
    return out


# --- model ------------------------------------------------------------------------------


@dataclass(frozen=True)
class LanguageModel:
    """``table`` holds each bucket's embedding times the softmax weights, one column a language."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, totals: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Calibrated, from summed table rows and numbers of subwords."""
        logits = totals / np.maximum(n, 1)[:, None] + self.bias
        return _softmax(logits / self.temperature)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _counts(texts: list[str], params: LanguageParams) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and their shares of each text."""
    out = []
    for text in texts:
        found = [b for _, b in subwords(code_points(text), params)]
        buckets, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int32), return_counts=True)
        out.append((buckets, n / max(n.sum(), 1)))
    return out


def _train(rows, labels: np.ndarray, n_langs: int, params: LanguageParams):
    """Embeddings, weights and bias by stochastic gradient descent on the cross entropy."""
    rng = np.random.default_rng(7)
    table = rng.normal(0, 1 / params.dims, (params.buckets, params.dims))
    weights, bias = rng.normal(0, 0.1, (params.dims, n_langs)), np.zeros(n_langs)
    steps = params.epochs * -(-len(rows) // params.batch)
    done = 0
    for _ in range(params.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), params.batch):
            picked = order[at : at + params.batch]
            used = np.unique(np.concatenate([rows[i][0] for i in picked]))
            share = np.zeros((len(picked), len(used)))
            for j, i in enumerate(picked):
                share[j, np.searchsorted(used, rows[i][0])] = rows[i][1]
            hidden = share @ table[used]
            error = _softmax(hidden @ weights + bias)
            error[np.arange(len(picked)), labels[picked]] -= 1
            rate = params.rate * (1 - done / steps)
            back = error @ weights.T
            weights -= rate * hidden.T @ error / len(picked)
            bias -= rate * error.mean(axis=0)
            # an embedding moves by its share of each text, not by the batch's mean
            table[used] -= rate * params.dims * share.T @ back
            done += 1
    return table @ weights, bias


def _calibrate(logits: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """The temperature of least cross entropy, and the quantile of the right answers' scores."""
    if not len(labels):
        return 1.0, 0.0
    grid = np.geomspace(0.05, 20, 121)
    at = np.arange(len(labels))
    losses = [-np.log(_softmax(logits / t)[at, labels] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    found = _softmax(logits / temperature)
    right = found.max(axis=1)[found.argmax(axis=1) == labels]
    return temperature, float(np.quantile(right, share)) if len(right) else 0.0


def held_out(doc_id: str = "doc_id"):
    """Rows that no model learns from; a null id counts as the empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == 2


def training_spans(docs: DataFrame, params: LanguageParams) -> tuple[list[str], DataFrame]:
    """The labelled languages and the stretches that the model is fitted on."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = sorted(r["lang"] for r in known.select("lang").distinct().limit(params.sample).collect())
    each = max(1, params.sample // max(len(langs), 1))
    # equal texts are drawn once; texts are read again only for the drawn hashes
    marked = known.withColumn("_mark", F.xxhash64("text"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("_mark"))
    drawn = (
        marked.select("lang", "_mark").distinct()
        .withColumn("_place", place)
        .where(F.col("_place") <= each)
        .select(F.col("lang").alias("_lang"), F.col("_mark").alias("_drawn"))
    )
    same = (F.col("lang") == F.col("_lang")) & (F.col("_mark") == F.col("_drawn"))
    drawn = marked.join(F.broadcast(drawn), same).select("lang", "_mark", "text")
    # stretches of a few words up to the full length, at places that the hash gives
    n = F.length("text")
    seed = lambda i: F.xxhash64("_mark", i)
    width = lambda i: F.when(i % 2 == 0, params.span_chars).otherwise(
        F.pmod(seed(-i), F.lit(params.span_chars - 11)) + 12
    )
    start = lambda i: F.pmod(seed(i), F.greatest(n - width(i), F.lit(0)) + 1) + 1
    spans = F.transform(
        F.sequence(F.lit(1), F.lit(params.spans)),
        lambda i: F.substr("text", start(i).cast("int"), width(i).cast("int")),
    )
    part = F.pmod(F.xxhash64("_mark", F.lit("part")), F.lit(params.calibration_one_in)) == 0
    rows = drawn.select("lang", "_mark", spans.alias("spans"), part.alias("aside"))
    return langs, rows.groupBy("lang", "_mark").agg(
        F.first("spans").alias("spans"), F.first("aside").alias("aside")
    )


def fit(docs: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel | None:
    """The model, or None where nothing is labelled."""
    langs, spans = training_spans(docs, params)
    if not langs:
        return None
    rows = spans.orderBy("lang", "_mark").toPandas()
    number = {lang: i for i, lang in enumerate(langs)}
    known = rows.explode("spans").dropna(subset="spans")
    labels = known["lang"].map(number).to_numpy(np.int64)
    shares = _counts(list(known["spans"]), params)
    full = np.array([len(b) > 0 for b, _ in shares])
    aside = known["aside"].to_numpy(bool)
    if not (full & ~aside).any():
        aside = np.zeros(len(aside), bool)
    train = np.flatnonzero(full & ~aside)
    if not len(train):
        return None
    table, bias = _train([shares[i] for i in train], labels[train], len(langs), params)
    apart = np.flatnonzero(full & aside)
    logits = np.array([shares[i][1] @ table[shares[i][0]] + bias for i in apart]).reshape(-1, len(langs))
    temperature, threshold = _calibrate(logits, labels[apart], params.reject_share)
    return LanguageModel(langs, table, bias, temperature, threshold)


# --- prediction -------------------------------------------------------------------------


def _pieces(texts: list[str | None], most: int, reach: int) -> Iterator[tuple[int, str, int]]:
    """Row, stretch and own length; stretches overlap by ``reach`` characters behind the own."""
    for row, text in enumerate(texts):
        for at in range(0, len(text or ""), most):
            yield row, text[at : at + most + reach], min(most, len(text) - at)


def text_totals(texts: list[str | None], model: LanguageModel, params: LanguageParams):
    """Summed table rows, numbers of subwords of each text, over its whole length."""
    k = len(model.langs)
    totals, n = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)

    def add(held: list[tuple[int, np.ndarray, int]]) -> None:
        # an edge behind each stretch keeps subwords inside it
        edge = np.full(params.longest, 32, np.uint32)
        points = np.concatenate([p for _, x, _ in held for p in (x, edge)])
        sizes = np.array([len(x) + len(edge) for _, x, _ in held])
        owner = np.repeat(np.array([row for row, _, _ in held]), sizes)
        own = np.concatenate([np.arange(s) < most for s, (_, _, most) in zip(sizes, held)])
        for at, buckets in subwords(points, params):
            mine = own[at]
            rows, buckets = owner[at[mine]], buckets[mine]
            n[:] += np.bincount(rows, minlength=len(texts))
            for j in range(k):
                totals[:, j] += np.bincount(rows, model.table[buckets, j], len(texts))

    held, size = [], 0
    for row, stretch, own in _pieces(texts, params.chunk_chars, params.longest - 1):
        points = code_points(stretch)
        # lower-casing may lengthen a text; only where it does not, the own length holds
        held.append((row, points, own if own < len(stretch) else len(points)))
        size += len(points)
        if size >= params.chunk_chars:
            add(held)
            held, size = [], 0
    if held:
        add(held)
    return totals, n


def identify(docs: DataFrame, params: LanguageParams = LanguageParams()) -> DataFrame:
    """Add ``held_out, lang_pred, score, rejected`` to ``docs`` (doc_id, text, lang, others).

    Columns of these names give way. The model learns from rows with text and lang that are
    not held out; a prediction looks at the text alone. ``lang_pred`` is a learned language,
    or ``und`` with score 0 for a null text, one without a letter, and where nothing is
    labelled. ``rejected`` marks answers below the calibrated threshold and ``und``. Repeated
    rows get equal answers, ties go to the first language, an empty table gives no rows.
    """
    rows = docs.drop("held_out", "lang_pred", "score", "rejected")
    model = fit(rows.select("doc_id", "text", F.col("lang").cast("string").alias("lang")), params)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = rows.select(
        F.struct(*[rows[c] for c in rows.columns]).alias("_row"),
        held_out().alias("held_out"), F.col("text").cast("string").alias("_text"),
    )
    fields = (
        T.StructType([packed.schema["_row"], packed.schema["held_out"]])
        .add("lang_pred", T.StringType())
        .add("score", T.DoubleType())
        .add("rejected", T.BooleanType())
    )

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            answers = _answers(batch.column("_text").to_pylist(), known, params)
            columns = [batch.column("_row"), batch.column("held_out"), *answers]
            names = ["_row", "held_out", "lang_pred", "score", "rejected"]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = packed.mapInArrow(predict, fields)
    return out.select("_row.*", "held_out", "lang_pred", "score", "rejected")


def _answers(texts, model: LanguageModel | None, params: LanguageParams) -> list[pa.Array]:
    if model is None:
        none = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        return [pa.array(none[0], pa.string()), pa.array(none[1], pa.float64()), pa.array(none[2], pa.bool_())]
    totals, n = text_totals(texts, model, params)
    found = model.probabilities(totals, n)
    best = found.argmax(axis=1)
    score = np.where(n > 0, found[np.arange(len(texts)), best], 0.0)
    names = [model.langs[b] if m else UNKNOWN for b, m in zip(best, n)]
    rejected = (n == 0) | (score < model.threshold)
    return [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
