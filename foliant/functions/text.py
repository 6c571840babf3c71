"""Text rules as column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant import constants as K

BLANKS = " \t\n\r\f"
_GAP = r"[ \t\n\r\f]+"
_ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def strip_spaces(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t"))


def null_if_blank(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def words(text: Column) -> Column:
    """Pieces between spaces; newlines stay inside a piece."""
    return F.array_remove(F.split(text, " ", -1), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), K.ACCENTED, K.PLAIN)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, accents removed."""
    return F.array_remove(F.split(fold(text), r"[^\p{L}\p{N}]+", -1), "")


def _decode_numbered(text: Column) -> Column:
    """Replace ``&#n;`` by the character with that code."""

    def piece(part: Column, at: Column) -> Column:
        written = F.regexp_extract(part, r"^(\d+);", 1)
        code = F.regexp_extract(written, r"^0*(\d{1,7})$", 1)
        number = F.try_to_number(code, F.lit("9999999")).cast("int")
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        usable = (at > 0) & (code != "") & (number > 0) & (number < 0x110000)
        surrogate = number.between(0xD800, 0xDFFF)
        rest = F.substr(part, F.length(written) + 2)
        return F.when(usable & ~surrogate, F.concat(char, rest)).when(
            at > 0, F.concat(F.lit("&#"), part)
        ).otherwise(part)

    decoded = F.array_join(F.transform(F.split(text, "&#", -1), piece), "")
    return F.when(F.contains(text, F.lit("&#")), decoded).otherwise(text)


def html_to_text(html: Column) -> Column:
    text = F.regexp_replace(html, r"(?is)<style[^>]*>.*?</style>", "")
    text = F.regexp_replace(text, r"(?is)<script[^>]*>.*?</script>", "")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    for name, char in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    text = _decode_numbered(text)
    return strip(F.regexp_replace(text, _GAP, " "))


def escape_html(text: Column) -> Column:
    for char, name in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]:
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def body_content(html: Column, last_close: bool = True) -> Column:
    """Text between ``<body …>`` and the last (or first) ``</body>``; all of it if absent."""
    pattern = r"(?is)<body[^>]*>(.*)</body>" if last_close else r"(?is)<body[^>]*>(.*?)</body>"
    return F.when(F.rlike(html, F.lit(pattern)), F.regexp_extract(html, pattern, 1)).otherwise(html)


def file_format(path: Column) -> Column:
    """One of the supported formats by file extension, else NULL."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(extension.isin(K.FORMATS), extension)


def parent_folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def contains_folded(text: Column, needle: Column) -> Column:
    """Case-insensitive substring test; NULL text never matches."""
    return F.coalesce(F.contains(F.lower(text), F.lower(needle)), F.lit(False))


def fit_to_budget(text: Column, max_words: int, least: int = 50, tries: int = 4) -> Column:
    """Cut to three quarters (not below ``least`` characters) until short enough.

    A cut keeps the start of the text, so the whole loop is a choice among the
    ``tries + 1`` possible lengths.
    """
    lengths = [F.length(text)]
    for _ in range(tries):
        cut = F.greatest(F.lit(least), F.floor(lengths[-1] * F.lit(3) / F.lit(4)).cast("int"))
        lengths.append(F.least(cut, lengths[-1]))
    result = F.substr(text, F.lit(1), lengths[-1])
    for length in reversed(lengths[:-1]):
        kept = F.substr(text, F.lit(1), length)
        result = F.when(word_count(kept) <= max_words, kept).otherwise(result)
    return result


def marker_spans(text: Column) -> Column:
    """Pieces between ``**`` marks; odd ones are highlighted."""
    return F.split(text, r"\*\*", -1)


def join_path(base: Column, path: Column) -> Column:
    """``base + path`` with ``.`` and ``..`` parts resolved."""
    parts = F.array_remove(F.split(F.concat(base, path), "/", -1), "")
    step = lambda done, part: (
        F.when((part == "..") & (F.size(done) > 0), F.slice(done, 1, F.size(done) - 1))
        .when(part == ".", done)
        .otherwise(F.concat(done, F.array(part)))
    )
    start = F.array().cast("array<string>")
    return F.array_join(F.aggregate(parts, start, step), "/")


def is_relative(link: Column) -> Column:
    skipped = [F.startswith(link, F.lit(p)) for p in ("http", "data:", "/", "#")]
    return ~(skipped[0] | skipped[1] | skipped[2] | skipped[3])


def rewrite_links(html: Column, base: Column) -> Column:
    """Resolve relative ``src`` and ``href`` values against the chapter's folder."""
    # every piece after the first starts with one attribute
    pieces = F.split(html, r"(?i)(?=(?:src|href)=[\"'])", -1)
    pattern = r"(?is)^((?:src|href)=[\"'])([^\"'#][^\"']*?)([\"'])(.*)$"

    def piece(part: Column) -> Column:
        link = F.regexp_extract(part, pattern, 2)
        fixed = F.concat(
            F.regexp_extract(part, pattern, 1),
            join_path(base, link),
            F.regexp_extract(part, pattern, 3),
            F.regexp_extract(part, pattern, 4),
        )
        return F.when((link != "") & is_relative(link), fixed).otherwise(part)

    return F.when(base == "", html).otherwise(F.array_join(F.transform(pieces, piece), ""))
