"""Structured records out of free text answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant import constants as K
from foliant.functions.text import strip, strip_spaces
from foliant.operators.matching import once

_SPLIT = r"(?im)(?=^\s*recipe\s+\d+\s*[:.\-—])"


def _after_colon(line: Column) -> Column:
    """Text after the first colon; NULL without one."""
    return F.when(
        F.contains(line, F.lit(":")), strip_spaces(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1))
    )


def _without_bullet(line: Column) -> Column:
    marks = "".join("\\" + b if b in "-*" else b for b in K.BULLETS)
    return strip_spaces(F.regexp_replace(line, rf"^(?:[{marks}]|\p{{N}}{{0,3}}[.)])", ""))


def answer_blocks(answers: DataFrame) -> DataFrame:
    """``block, lines`` of every record block of an answer, lines trimmed, beside its other columns.

    Text before the first ``Recipe <n>:`` header is dropped.
    """
    rest = [c for c in answers.columns if c != "text"]
    blocks = F.transform(
        F.filter(
            F.split("text", _SPLIT, -1), lambda b: F.rlike(b, F.lit(K.RECORD_HEADER_PATTERN))
        ),
        strip,
    )
    rows = answers.select(*rest, F.posexplode(blocks).alias("block", "_block"))
    lines = F.transform(F.split("_block", "\n", -1), strip_spaces)
    return rows.select(*rest, "block", lines.alias("lines"))


def _kind(line: Column, line_no: Column) -> Column:
    low = F.lower(line)

    def starts(*prefixes: str) -> Column:
        test = F.lit(False)
        for prefix in prefixes:
            test = test | F.startswith(low, F.lit(prefix))
        return test

    return (
        F.when(line_no == 0, "title")
        .when(line == "", "blank")
        .when(starts("from:"), "from")
        .when(starts("excerpt") & F.contains(low, F.lit(":")), "excerpt")
        .when(starts("ingredient"), "ingredients")
        .when(starts("instruction", "method", "direction", "steps"), "instructions")
        .when(starts("notes"), "notes")
        .when(starts("completeness"), "completeness")
        .otherwise("body")
    )


def _last(kind: str, value) -> Column:
    """Value of the last line of a kind."""
    found = F.filter("_marked", lambda x: x["kind"] == kind)
    return value(F.try_element_at(found, F.lit(-1))["line"])


def _section(kind: str, of_header=None) -> Column:
    """Lines between each header of a kind and the next header of any, as marked entries.

    With ``of_header`` the header comes first, holding that value of its line.
    """

    def part(header: Column, j: Column) -> Column:
        end = F.coalesce(F.get("_headers", j + 1)["at"], F.size("_marked"))
        inside = F.slice("_marked", header["at"] + 2, F.greatest(end - header["at"] - 1, F.lit(0)))
        if of_header is not None:
            line = of_header(header["line"])
            own = F.struct(header["at"].alias("at"), line.alias("line"), F.lit("body").alias("kind"))
            inside = F.concat(F.array(own), inside)
        return F.when(header["kind"] == kind, inside).otherwise(F.slice("_marked", 1, 0))

    return F.flatten(F.transform("_headers", part))


def _lines(entries: Column, *kinds: str) -> Column:
    return F.transform(F.filter(entries, lambda x: x["kind"].isin(*kinds)), lambda x: x["line"])


def _filled(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def records_of(answers: DataFrame) -> DataFrame:
    """Fields of every record block, beside the answer's other columns; a block is one row throughout.

    A header (ingredients, instructions, notes) opens a section up to the next one, so
    sections are slices of the block's line array.
    """
    blocks = answer_blocks(answers)
    marked = F.transform(
        "lines", lambda x, i: F.struct(i.alias("at"), x.alias("line"), _kind(x, i).alias("kind"))
    )
    headers = F.filter("_marked", lambda x: x["kind"].isin("ingredients", "instructions", "notes"))
    rows = once(once(blocks, _marked=marked).drop("lines"), _headers=headers)
    first = F.coalesce(F.get("_headers", F.lit(0))["at"], F.size("_marked"))
    number = lambda line: F.nullif(F.regexp_extract(line, K.EXCERPT_PATTERN, 1), F.lit(""))
    numbers = F.filter(
        F.transform(_lines(F.col("_marked"), "excerpt"), number), lambda n: n.isNotNull()
    )
    ingredients = F.transform(_lines(_section("ingredients"), "body"), _without_bullet)
    fields = once(
        rows,
        title=_after_colon(F.get("_marked", F.lit(0))["line"]),
        _from=_last("from", _after_colon),
        _excerpt=F.try_element_at(numbers, F.lit(-1)),
        completeness=_last("completeness", _after_colon),
        preamble=F.array_join(_lines(F.slice("_marked", 1, first), "body"), " "),
        _ingredients=_filled(ingredients),
        instructions=strip(F.array_join(_lines(_section("instructions"), "body", "blank"), "\n")),
        notes=F.array_join(_filled(_lines(_section("notes", _after_colon), "body")), " "),
    )
    return fields.select(
        *[c for c in answers.columns if c != "text"], "block", "title", "_from", "_excerpt", "completeness", "preamble",
        F.array_join("_ingredients", "\n").alias("ingredients"),
        F.size("_ingredients").alias("n_ingredients"), "instructions", "notes",
    )


def parse_blocks(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Records of each answer whose source is known.

    ``sources`` is ``response_id, excerpt_index, book_id, book_title, author``. A record
    needs a title, a source (by excerpt number, else by title) and at least one ingredient
    or instruction. An answer meets the list of its sources first; that join is the only
    shuffle, and all else happens inside the answer's row.
    """
    fields = ["book_id", "book_title", "author"]
    listed = sources.groupBy("response_id").agg(
        F.array_sort(F.collect_list(F.struct("excerpt_index", *fields))).alias("_sources")
    )
    records = records_of(answers.select("response_id", "text").join(listed, "response_id"))
    records = records.filter(F.col("title") != "").filter(
        (F.col("n_ingredients") > 0) | (F.col("instructions") != "")
    )
    number = F.expr("try_cast(_excerpt AS bigint)")
    by_number = F.filter("_sources", lambda s: s["excerpt_index"] == number)
    by_title = F.filter("_sources", lambda s: F.lower(s["book_title"]) == F.lower("_from"))
    first = lambda found: F.get(found, F.lit(0))
    found = once(records, _source=F.coalesce(first(by_number), first(by_title))).filter("_source IS NOT NULL")
    return found.select(
        "response_id", "block", "title",
        F.nullif("preamble", F.lit("")).alias("preamble"),
        "ingredients", "n_ingredients", "instructions",
        F.nullif("notes", F.lit("")).alias("notes"),
        F.nullif("completeness", F.lit("")).alias("completeness"),
        *[F.col("_source")[f].alias(f) for f in fields],
    )
