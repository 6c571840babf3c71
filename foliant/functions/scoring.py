"""Weighted pattern score, page type and title guess for a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant import constants as K
from foliant.functions.text import strip, word_count


def _matches(text: Column, pattern: str, weight: float, most: int) -> Column:
    found = F.regexp_count(text, F.lit(pattern))
    return F.least(found, F.lit(most)).cast("double") * F.lit(weight)


def _distinct_words(text: Column, wanted: list[str], weight: float, most: int) -> Column:
    found = F.lit(0)
    for word in wanted:
        found = found + F.contains(text, F.lit(word)).cast("int")
    return F.least(found, F.lit(most)).cast("double") * F.lit(weight)


def _score_lowered(low: Column) -> Column:
    total = F.lit(0.0)
    for pattern in K.QUANTITY_PATTERNS:
        total = total + _matches(low, pattern, K.QUANTITY_WEIGHT, K.QUANTITY_MAX)
    total = total + _distinct_words(
        low, K.INSTRUCTION_WORDS, K.INSTRUCTION_WEIGHT, K.INSTRUCTION_MAX
    )
    total = total + _matches(low, K.TIME_PATTERN, K.TIME_WEIGHT, K.TIME_MAX)
    total = total + _matches(
        low, K.TEMPERATURE_PATTERN, K.TEMPERATURE_WEIGHT, K.TEMPERATURE_MAX
    )
    total = total + _distinct_words(low, K.HEADER_WORDS, K.HEADER_WEIGHT, K.HEADER_MAX)
    return F.round(F.least(total, F.lit(1.0)), 6)


def pattern_score(text: Column) -> Column:
    """How much a text looks like a recipe, 0 to 1 (rounded to 6 places).

    The lower-cased text is bound once as the element of a one-element array; some forty
    tests then read it without lower-casing it again.
    """
    return F.get(F.transform(F.array(F.lower(text)), _score_lowered), F.lit(0))


def page_type(text: Column) -> Column:
    """``blank``, ``front_matter``, ``index``, ``contents``, ``numbers`` or ``content``."""
    first = F.lower(F.regexp_extract(text, r"(?dm)^[ \t]*([^ \t\n][^\n]*?)[ \t]*$", 1))
    dotted = F.contains(text, F.lit("....")) | F.contains(text, F.lit(". . ."))
    # lines are walked only where a text has dots at all
    leaders = F.when(dotted, F.regexp_count(text, F.lit(r"(?dm)^.*(?:\.{4}|\. \. \.).*$")))
    digits = F.regexp_count(text, F.lit(r"\p{N}")) / F.length(text)
    return (
        F.when(~F.rlike(text, F.lit(r"[^ \t\n]")), "blank")
        .when(
            (F.length(first) < K.FRONT_MATTER_CHARS)
            & F.rlike(first, F.lit("|".join(K.FRONT_MATTER))),
            "front_matter",
        )
        .when(F.regexp_count(text, F.lit(K.INDEX_LINE_PATTERN)) >= K.INDEX_LINES, "index")
        .when(leaders >= K.LEADER_LINES, "contents")
        .when(
            F.contains(F.lower(text), F.lit("see also")) & (digits > K.DIGIT_SHARE), "numbers"
        )
        .otherwise("content")
    )


def is_content(text: Column) -> Column:
    return page_type(text) == "content"


def guess_title(text: Column) -> Column:
    """The first of the first three non-empty lines that could be a title, else NULL."""
    lines = F.filter(F.transform(F.split(text, "\r?\n|\r", -1), strip), lambda line: line != "")
    fits = F.filter(
        F.slice(lines, 1, 3),
        lambda line: word_count(line).between(2, 12) & ~F.contains(line, F.lit(":")),
    )
    return F.get(fits, F.lit(0))


def summary_intent(text: Column) -> Column:
    low = F.lower(text)
    asked = F.lit(False)
    for phrase in K.SUMMARY_PHRASES:
        asked = asked | F.contains(low, F.lit(phrase))
    return F.coalesce(asked, F.lit(False))
