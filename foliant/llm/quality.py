"""Quality rules: base counts per text and a hashed n-gram log-likelihood ratio.

Every step is a DataFrame expression; nothing runs in Python on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import BLANKS, stored, whole_text, words_of
from foliant.operators.ordering import with_position

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityParams:
    """Production parameters; counts and thresholds cover every text and every label."""

    buckets: int = 1 << 14
    smoothing: float = 1.0
    good_share: float = 0.001
    bad_share: float = 0.99


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``words`` and the base counts.

    A null text has no words. Lines are cut at ``\\n`` and count when they have a word.
    A word is repeated when any three-word window over it stands in the text twice or more.
    """
    one = df.withColumn("_text", whole_text(text)).withColumn("words", words_of(F.col("_text")))
    bare = F.col("_text")
    for symbol in SYMBOLS:
        bare = F.replace(bare, F.lit(symbol), F.lit(""))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    two = one.select(
        *[c for c in one.columns if c != "_text"],
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.octet_length("_text") - F.octet_length(bare)).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.sort_array(_marked_windows("words")).alias("_windows"),
    )
    three = two.select(
        *[c for c in two.columns if c not in ("_lines", "_windows")],
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.array_sort(_suspects("words", "_windows")).alias("_named"),
    )
    # a generator, so that filters on the counts aren't pushed below and evaluated per element
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    repeated = _covered("_named").cast("long").alias("n_repeat_words")
    rest = [c for c in three.columns if c not in [*counts, "_named"]]
    return three.select(*rest, F.inline(F.array(F.struct(*counts, repeated))))


#: Bits of a marked window that hold its place; a row's text has fewer words than 2**26.
PLACE = 26


def _marked_windows(words: str) -> Column:
    """Per three-word window one long: the upper bits of its hash, then its place."""
    opening = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return F.transform(
        opening,
        lambda w, i: F.shiftleft(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)), PLACE)
        .bitwiseOR(i.cast("long")),
    )


def _suspects(words: str, windows: str) -> Column:
    """Windows (w, i) whose hash bits stand beside equal ones; ``windows`` is sorted."""
    bits = lambda x: F.shiftright(x, PLACE)
    maybe = F.filter(
        windows,
        lambda x, i: (bits(x) == bits(F.get(windows, i + 1)))
        | (bits(x) == bits(F.get(windows, i - 1))),
    )
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")
    return F.transform(
        maybe,
        lambda x: F.struct(
            F.concat_ws(" ", *[F.get(words, place(x) + k) for k in range(3)]).alias("w"),
            place(x).alias("i"),
        ),
    )


def _covered(named: str) -> Column:
    """Number of positions under windows that occur again; ``named`` is sorted by (w, i).

    Comparing the strings of neighbours makes the count exact whatever the hashes did.
    """
    again = F.filter(
        named,
        lambda x, i: (x["w"] == F.get(named, i + 1)["w"]) | (x["w"] == F.get(named, i - 1)["w"]),
    )
    return F.size(
        F.array_distinct(
            F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        )
    )


def bucket_of(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def ending(word: Column) -> Column:
    """The last three characters of a word, marked so that it differs from a whole word."""
    return F.concat(F.lit(" "), F.substring(word, -3, 3))


@dataclass(frozen=True)
class QualityModel:
    """Log ratio per bucket and the least score that is kept."""

    ratios: list[float]
    threshold: float

    def score(self, words: str) -> Column:
        """Mean log ratio of a text's n-grams; 0 without words."""
        table = F.split(F.lit(",".join(map(repr, self.ratios))), ",").cast("array<double>")
        ratio = lambda gram: F.get(table, bucket_of(gram, len(self.ratios)))
        total = F.aggregate(
            words, F.lit(0.0), lambda acc, w: acc + (ratio(w) + ratio(ending(w)))
        )
        return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(total / (2.0 * F.size(words)))


def labelled(labels: DataFrame) -> DataFrame:
    """The ids of both classes with ``_good``: the trusted target and the rejects.

    A document is trusted when some row calls it good and none calls it bad or toxic.
    """
    seen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").alias("_labelled"))
        .agg(
            F.min("quality").alias("q"),
            F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("t"),
        )
    )
    known = seen.where(((F.col("q") == 1) & (F.col("t") == 0)) | (F.col("q") == 0))
    return known.select("_labelled", (F.col("q") == 1).alias("_good"))


def fit_ratios(
    docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()
) -> QualityModel:
    """Multinomials of all trusted texts and of all texts over hashed n-grams; no threshold yet.

    ``docs`` has doc_id and text. The driver gets one row per bucket. With no labelled text
    every ratio is 0.
    """
    # as many labels as texts need: they are dealt out with the texts, not sent to every task
    marks = labelled(labels).where("_good").hint("merge")
    flagged = docs.join(marks, docs["doc_id"] == marks["_labelled"], "left")
    grams = (
        flagged.select(
            F.coalesce(F.col("_good"), F.lit(False)).cast("int").alias("good"),
            F.explode(words_of(whole_text("text"))).alias("word"),
        )
        .select("good", F.stack(F.lit(2), "word", ending(F.col("word"))).alias("gram"))
    )
    rows = (
        grams.groupBy(bucket_of(F.col("gram"), params.buckets).alias("bucket"))
        .agg(F.count("*").alias("raw"), F.sum("good").alias("target"))
        .collect()  # one row per bucket
    )
    raw, target = [params.smoothing] * params.buckets, [params.smoothing] * params.buckets
    for r in rows:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    n_raw, n_target = math.fsum(raw), math.fsum(target)
    if n_target == params.smoothing * params.buckets:
        return QualityModel([0.0] * params.buckets, -1.0)
    ratios = [
        round(math.log(t / n_target) - math.log(r / n_raw), 9)
        for t, r in zip(target, raw, strict=True)
    ]
    return QualityModel(ratios, -1e9)


def fit_threshold(scored: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> float:
    """The least score that is kept, from every labelled row of ``scored`` that passes the base rule.

    ``scored`` has doc_id, n_words, n_repeat_words and score. The threshold is the
    ``good_share`` quantile of the trusted scores when it lies below the ``bad_share`` quantile
    of the rejected ones, else the middle between the two. The scores are sorted in ranges over
    all tasks, so the quantiles are exact and two rows reach the driver.
    """
    marks = labelled(labels)
    own = scored.where(~base_failed()).join(marks, scored["doc_id"] == marks["_labelled"])
    placed = with_position(own.select("_good", "score"), [F.col("score")], "_place", ["_good"])
    sizes = {r["_good"]: r["count"] for r in placed.groupBy("_good").count().collect()}
    if True not in sizes:
        return -1e9
    share = {True: params.good_share, False: params.bad_share}
    wanted = F.lit(False)
    for good, n in sizes.items():
        place = math.floor((n - 1) * share[good]) + 1
        wanted |= (F.col("_good") == good) & (F.col("_place") == place)
    cut = {r["_good"]: r["score"] for r in placed.where(wanted).collect()}
    return (cut[True] + min(cut[True], cut.get(False, cut[True]))) / 2


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> QualityModel:
    """The ratios of :func:`fit_ratios` with the threshold of :func:`fit_threshold`."""
    model = fit_ratios(docs, labels, params)
    if not any(model.ratios):
        return model
    scored = base_counts(docs).withColumn("score", model.score("words")).drop("words")
    return QualityModel(model.ratios, fit_threshold(scored, labels, params))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    params: QualityParams = QualityParams(),
    keep_text: bool = True,
) -> DataFrame:
    """Base counts, score and verdict for every row of ``docs`` (doc_id, text, others).

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score
    and kept; columns of these names in ``docs`` give way. Null or empty texts fail the
    base rule. Repeated rows are judged row by row and count as often as they stand in the
    raw corpus. An empty table gives no rows. The scored rows are written once, for the
    threshold and the verdicts; without ``keep_text`` the text isn't among them.
    """
    model = fit_ratios(docs, labels, params)
    own = ["words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    own += ["base_failed", "score", "kept"]
    scored = base_counts(docs.drop(*own)).withColumn("score", model.score("words"))
    scored = stored(scored.drop("words", *([] if keep_text else ["text"])), "quality-scores")
    # without any trusted text all ratios are 0 and all is kept
    threshold = fit_threshold(scored, labels, params) if any(model.ratios) else model.threshold
    return scored.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold))
    )


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    key, names = "_quality_row", docs.columns
    packed = docs.select("doc_id", "text", F.struct(*[docs[c] for c in names]).alias(key))
    return quality_rules(packed, labels, keep_text=False).where("kept").select(f"{key}.*")
