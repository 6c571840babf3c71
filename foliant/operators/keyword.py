"""Keyword index over chunks, bm25 ranking, tiered search and snippets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant import constants as K
from foliant.functions.porter import stem
from foliant.functions.text import contains_folded, fold, strip, tokens
from foliant.operators.catalog import display_title
from foliant.operators.matching import INLINE_NEEDLES, match_substrings, once, small_rows
from foliant.operators.ordering import top_per_key
from foliant.session import durable

# --- query terms ------------------------------------------------------------------------


def _not_number(word: Column) -> Column:
    return ~F.rlike(word, F.lit(r"^\p{N}+$"))


def salient_keywords(text: Column) -> Column:
    """Words worth matching literally: 3 letters or more, no filler, no numbers."""
    pieces = F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1)
    stop = F.array(*[F.lit(w) for w in K.KEYWORD_STOP_WORDS])
    return F.filter(
        pieces,
        lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w) & _not_number(w),
    )


def match_terms(text: Column) -> Column:
    """Distinct prefix terms of a query, letters and digits only.

    A query of nothing but filler keeps all its words.
    """
    raw = F.array_remove(F.split(F.lower(strip(text)), r"[ \t\n\r\f]+", -1), "")
    stop = F.array(*[F.lit(w) for w in K.MATCH_STOP_WORDS])
    kept = F.filter(
        raw, lambda w: ~F.array_contains(stop, w) & (F.length(w) > 1) & _not_number(w)
    )
    chosen = F.when(F.size(kept) > 0, kept).otherwise(raw)
    return F.array_distinct(F.flatten(F.transform(chosen, tokens)))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(match_terms(F.col("text"))).alias("prefix"))


def keywords(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.posexplode(salient_keywords(F.col("text"))).alias("seq", "keyword"))


# --- index ------------------------------------------------------------------------------


def build_postings(chunks: DataFrame) -> DataFrame:
    """``term, book_id, chunk_index, tf`` of every chunk.

    A chunk lies in one row, so its sorted tokens are counted there and nothing is shuffled.
    """
    return sized_postings(chunks).drop("length")


def sized_postings(chunks: DataFrame) -> DataFrame:
    """As :func:`build_postings`, with the chunk's ``length`` in tokens on every row."""
    place = ["book_id", "chunk_index"]
    cut = once(chunks.select(*place, "text"), _tokens=F.sort_array(tokens(F.col("text")))).drop("text")
    n = F.size("_tokens")
    opens = F.filter(
        F.sequence(F.lit(0), n),
        lambda i: (i == 0) | (i == n) | (F.get("_tokens", i) != F.get("_tokens", i - 1)),
    )
    runs = once(cut.filter(n > 0), _opens=opens)
    counted = F.transform(
        F.slice("_opens", 1, F.size("_opens") - 1),
        lambda at, j: F.struct(
            F.get("_tokens", at).alias("term"),
            (F.get("_opens", j + 1) - at).cast("bigint").alias("tf"),
        ),
    )
    rows = runs.select(*place, F.size("_tokens").alias("length"), F.inline(counted))
    return rows.select("term", *place, "tf", "length")


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    words = F.regexp_count(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"))
    return chunks.select("book_id", "chunk_index", words.alias("length"))


def stem_postings(postings: DataFrame) -> DataFrame:
    """Postings under the stem of each term; only distinct words are stemmed in Python."""

    def stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["stem"] = batch["term"].map(stem)
            yield batch

    vocabulary = postings.select("term").distinct().mapInPandas(stems, "term string, stem string")
    return (
        postings.join(vocabulary, "term")
        .groupBy(F.col("stem").alias("term"), "book_id", "chunk_index")
        .agg(F.sum("tf").alias("tf"))
    )


def stem_terms(terms: DataFrame) -> DataFrame:
    @F.pandas_udf("string")
    def stemmed(words: pd.Series) -> pd.Series:
        return words.map(stem)

    return terms.select("query_id", stemmed("prefix").alias("prefix")).distinct()


# --- ranking ----------------------------------------------------------------------------


def _prefix_key(term: Column) -> Column:
    return F.substr(term, F.lit(1), F.lit(2))


def expand_prefixes(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """``query_id, prefix, term``: the vocabulary words behind each prefix term.

    Prefixes meet the distinct words on their first two characters (one for one-letter
    prefixes) and are compared in full afterwards.
    """
    words = postings.select("term").distinct()
    keyed = words.select(
        "term", F.explode(F.array_distinct(F.array(F.substr("term", F.lit(1), F.lit(1)), _prefix_key(F.col("term"))))).alias("_key")
    )
    wanted = terms.select("query_id", "prefix", _prefix_key(F.col("prefix")).alias("_key"))
    return (
        keyed.join(wanted, "_key")
        .filter(F.startswith("term", F.col("prefix")))
        .select("query_id", "prefix", "term")
    )


@dataclass(frozen=True)
class Corpus:
    """The two numbers of a chunk collection that bm25 needs; kept with a stored index."""

    chunks: int
    mean_length: float


def corpus_of(lengths: DataFrame) -> Corpus:
    row = lengths.agg(F.count("*"), F.coalesce(F.avg("length"), F.lit(0.0))).first()
    return Corpus(int(row[0]), float(row[1]))


def _weigh(hits: DataFrame, corpus: Corpus, bounded: bool = False) -> DataFrame:
    """bm25 of ``query_id, prefix, book_id, chunk_index, f, length`` rows.

    ``hits`` is already partitioned by (query, chunk), so the sum needs no shuffle. The count
    of matching chunks reads the same columns and therefore the same shuffle. ``bounded``
    says that the number of (query, prefix) pairs was checked, so their weights may be
    broadcast and frequent prefixes are not gathered by key.
    """
    n_all, mean = F.lit(corpus.chunks), F.lit(corpus.mean_length)
    matched = F.count_if((F.col("f") > 0) & (F.col("length") > 0))
    found = hits.groupBy("query_id", "prefix").agg(matched.alias("n"))
    idf = F.log((n_all - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf <= 0, F.lit(K.IDF_FLOOR)).otherwise(idf)
    weights = found.select("query_id", "prefix", idf.alias("idf"))
    if bounded:
        weights = F.broadcast(weights)
    k1, b = F.lit(K.BM25_K1), F.lit(K.BM25_B)
    damp = k1 * (F.lit(1.0) - b + b * F.col("length") / mean)
    part = F.col("idf") * F.col("f") * (k1 + 1) / (F.col("f") + damp)
    return (
        hits.join(weights, ["query_id", "prefix"])
        .groupBy("query_id", "book_id", "chunk_index")
        .agg(F.round(F.sum(part), 6).alias("score"))
    )


def bm25_indexed(
    terms: DataFrame, postings: DataFrame, lengths: DataFrame, corpus: Corpus | None = None
) -> DataFrame:
    """``query_id, book_id, chunk_index, score`` from an index.

    Terms are OR-ed prefixes; a prefix counts all words it starts. ``lengths`` is
    ``book_id, chunk_index, length``. Scores are rounded to 6 places.
    """
    place = ["book_id", "chunk_index"]
    hits = (
        expand_prefixes(terms, postings)
        .join(postings, "term")
        .groupBy("query_id", "prefix", *place)
        .agg(F.sum("tf").alias("f"))
        .join(lengths, place)
        .repartition("query_id", *place)
    )
    return _weigh(hits, corpus or corpus_of(lengths))


def _owners(listed: list) -> tuple[Column, list[str]]:
    """Each prefix with the queries that ask for it, as one literal array."""
    by_prefix: dict[str, list[int]] = {}
    for row in listed:
        by_prefix.setdefault(row["prefix"], []).append(row["query_id"])
    kind = "array<struct<prefix:string,queries:array<bigint>>>"
    entries = [
        F.struct(
            F.lit(prefix).alias("prefix"),
            F.array(*[F.lit(q).cast("bigint") for q in ids]).alias("queries"),
        )
        for prefix, ids in by_prefix.items()
    ]
    return (F.array(*entries) if entries else F.array()).cast(kind), list(by_prefix)


def bm25_stored(
    terms: DataFrame, postings: DataFrame, corpus: Corpus, inline: int = INLINE_NEEDLES
) -> DataFrame:
    """As :func:`bm25_indexed` from stored postings that carry chunk lengths; reads no text.

    ``postings`` is ``term, book_id, chunk_index, tf, length``, sorted by term in its files. A
    list of up to ``inline`` prefixes becomes a filter that the scan applies to its term
    ranges; a longer one is joined to the vocabulary.
    """
    place = ["book_id", "chunk_index"]
    listed = small_rows(terms.select("query_id", "prefix").distinct(), inline)
    if listed is None:
        hits = expand_prefixes(terms, postings).join(postings, "term")
    else:
        owners, prefixes = _owners(listed)
        wanted = F.lit(False)
        for prefix in prefixes:
            wanted = wanted | F.startswith("term", F.lit(prefix))
        mine = F.filter(owners, lambda o: F.startswith(F.col("term"), o["prefix"]))
        hits = (
            postings.filter(wanted)
            .select(*place, "tf", "length", F.inline(mine))
            .select(F.explode("queries").alias("query_id"), "prefix", *place, "tf", "length")
        )
    counted = hits.groupBy("query_id", "prefix", *place).agg(
        F.sum("tf").alias("f"), F.first("length").alias("length")
    )
    return _weigh(counted.repartition("query_id", *place), corpus, bounded=listed is not None)


def bm25(
    terms: DataFrame,
    chunks: DataFrame,
    corpus: Corpus | None = None,
    inline: int = INLINE_NEEDLES,
) -> DataFrame:
    """As :func:`bm25_indexed`, straight from ``book_id, chunk_index, text``.

    A short list of prefixes is looked for inside the scan, a few as literals and more in one walk
    from word to word. The rows found are written once, for the numbers of the corpus, the counts
    and the sums. A longer list goes through postings.
    """
    place = ["book_id", "chunk_index"]
    listed = small_rows(terms.select("query_id", "prefix").distinct(), inline)
    if listed is None:
        return bm25_indexed(terms, build_postings(chunks), chunk_lengths(chunks), corpus)
    owners, prefixes = _owners(listed)
    low = once(chunks.select(*place, "text"), _low=F.lower(F.col("text"))).drop("text")
    if len(prefixes) <= COUNTED_PREFIXES:
        scanned = _counted_starts(low, owners, prefixes)
    else:
        scanned = _walked_words(low, owners, prefixes)
    hit = F.filter("_counted", lambda c: c["f"] > 0).alias("_found")
    found = scanned.select(*place, "length", hit)
    # counting and summing would each search the texts again
    found = durable(found)
    hits = (
        found.select(*place, "length", F.inline("_found"))
        .select(F.explode("queries").alias("query_id"), "prefix", *place, "f", "length")
        .repartition("query_id", *place)
    )
    return _weigh(hits, corpus or corpus_of(found), bounded=True)


#: Up to this number, each prefix is searched as a literal, which costs less than a look at every word.
COUNTED_PREFIXES = 64

_WORD = r"[\p{L}\p{N}]"
_FAR_LETTER = "\U00010000"


def _starts(text: str, prefix: str) -> Column:
    """How often a prefix begins a word of a folded text; few texts hold it, so that is asked first.

    The literal comes first, so that only its places look back. A letter beyond the first plane in
    the look-behind makes it step by characters, not by halves of surrogate pairs.
    """
    literal = re.escape(prefix)
    pattern = rf"{literal}(?<![\p{{L}}\p{{N}}{_FAR_LETTER}]{literal})"
    counted = F.regexp_count(text, F.lit(pattern))
    return F.when(F.contains(text, F.lit(prefix)), counted).otherwise(F.lit(0))


def _counted_starts(low: DataFrame, owners: Column, prefixes: list[str]) -> DataFrame:
    """``length`` and ``_counted`` (prefix, queries, f) of texts ``_low``, one search per prefix."""
    place = ["book_id", "chunk_index"]
    # plain ASCII has no accents
    plain = F.octet_length("_low") == F.length("_low")
    low = once(low, _plain=F.when(plain, F.col("_low")).otherwise(fold("_low"))).drop("_low")
    counts = [_starts("_plain", p) for p in prefixes]
    counts = F.array(*counts) if counts else F.array().cast("array<int>")
    counted = F.transform(
        F.arrays_zip(owners.alias("o"), counts.alias("f")),
        lambda x: F.struct(
            x["o"]["prefix"].alias("prefix"), x["o"]["queries"].alias("queries"), x["f"].alias("f")
        ),
    )
    length = F.regexp_count("_plain", F.lit(r"[a-z0-9\p{L}\p{N}]++")).alias("length")
    return low.select(*place, length, counted.alias("_counted"))


def _walked_words(low: DataFrame, owners: Column, prefixes: list[str]) -> DataFrame:
    """As :func:`_counted_starts`; one walk counts the words and picks those behind a prefix."""
    place = ["book_id", "chunk_index"]
    walked = F.regexp_extract_all("_low", F.lit(_word_or_nothing(prefixes)), F.lit(1))
    walked = once(low, _walked=walked).drop("_low")
    scanned = walked.select(
        *place,
        F.array_size("_walked").alias("length"),
        F.transform(F.array_remove("_walked", ""), fold).alias("_words"),
    )
    counted = F.transform(
        owners,
        lambda o: F.struct(
            o["prefix"].alias("prefix"),
            o["queries"].alias("queries"),
            F.size(F.filter(F.col("_words"), lambda w: F.startswith(w, o["prefix"]))).alias("f"),
        ),
    )
    return scanned.select(*place, "length", counted.alias("_counted"))


def _written(prefix: str) -> str:
    """Pattern of a prefix in lower-cased text; prefixes have no accents, words may."""
    accents: dict[str, str] = {}
    for accented, plain in zip(K.ACCENTED, K.PLAIN, strict=True):
        accents[plain] = accents.get(plain, "") + accented
    return "".join(f"[{c}{accents[c]}]" if c in accents else re.escape(c) for c in prefix)


def _word_or_nothing(prefixes: list[str]) -> str:
    """Pattern of a lower-cased word, whose first group is the word if it begins with a prefix.

    A walk from word to word stands at the beginning of a word each time. Only the words that
    are found have to be folded.
    """
    if not prefixes:
        return rf"(\z.)|{_WORD}++"
    return rf"((?:{'|'.join(map(_written, prefixes))}){_WORD}*+)|{_WORD}++"


def rank_chunks(scores: DataFrame, k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("book_id"), F.col("chunk_index")]
    return top_per_key(scores, ["query_id"], order, k)


def best_per_book(scores: DataFrame) -> DataFrame:
    """Best chunk of each (query, book), earliest on ties."""
    return scores.groupBy("query_id", "book_id").agg(
        F.max("score").alias("score"),
        F.max_by("chunk_index", F.struct("score", -F.col("chunk_index"))).alias("chunk_index"),
    )


def name_tiers(queries: DataFrame, books: DataFrame, **options: int) -> DataFrame:
    """Books whose file name, title or author contains the whole query text."""
    text = F.lower(strip(F.col("text")))
    wanted = queries.select(F.col("query_id").alias("needle_id"), text.alias("needle"))
    wanted = wanted.filter(F.col("needle") != "")
    names = F.lower(F.concat_ws("\n", "file_name", "title", "author"))
    fields = ["book_id", "file_name", "title", "author"]
    named = books.select(*fields, names.alias("_names"))
    found = match_substrings(named, fields, "_names", wanted, **options)
    tier = (
        F.when(contains_folded(F.col("file_name"), F.col("needle")), K.TIER_FILE)
        .when(contains_folded(F.col("title"), F.col("needle")), K.TIER_TITLE)
        .when(contains_folded(F.col("author"), F.col("needle")), K.TIER_AUTHOR)
    )
    tiers = found.select(F.col("needle_id").alias("query_id"), "book_id", tier.alias("tier"))
    return tiers.filter(F.col("tier").isNotNull())


def tiered_search(
    queries: DataFrame,
    books: DataFrame,
    scores: DataFrame,
    mode: str = "intended",
    per_query: int | None = None,
) -> DataFrame:
    """One row per (query, book): a name tier if there is one, else the best content score.

    ``mode='intended'`` ranks content scores below the tiers, best first;
    ``mode='reference'`` keeps content scores negated (more negative is better) and sorts
    by plain descending rank.
    """
    tiers = name_tiers(queries, books)
    content = best_per_book(scores).join(tiers, ["query_id", "book_id"], "left_anti")
    signed = F.col("score") if mode == "intended" else -F.col("score")
    rows = tiers.select(
        "query_id", "book_id", F.lit("name").alias("source"), F.col("tier").alias("rank_value"),
        F.lit(None).cast("int").alias("chunk_index"),
    ).unionByName(
        content.select(
            "query_id", "book_id", F.lit("content").alias("source"),
            signed.alias("rank_value"), F.col("chunk_index").cast("int").alias("chunk_index"),
        )
    )
    named = rows.join(
        books.select("book_id", display_title().alias("title"), "author", "format"), "book_id"
    )
    if per_query is None:
        return named
    # content scores may pass 40, so tiers go first explicitly
    first = F.when((F.lit(mode) == "intended") & (F.col("source") == "content"), 1).otherwise(0)
    order = [first, F.col("rank_value").desc(), F.col("book_id")]
    return top_per_key(named, ["query_id"], order, per_query)


def chunk_search(
    scores: DataFrame, scope: DataFrame, chunks: DataFrame, limit: int
) -> DataFrame:
    """Best chunks of the books in scope with their full text.

    ``scope`` is ``query_id, book_id``; it is applied before the cut to ``limit``.
    """
    scoped = scores.join(scope, ["query_id", "book_id"], "left_semi")
    return rank_chunks(scoped, limit).join(
        chunks.select("book_id", "chunk_index", "text"), ["book_id", "chunk_index"]
    )


def keyword_chunks(
    keywords: DataFrame, chunks: DataFrame, scope: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """``query_id, book_id, chunk_id, chunk_index`` of chunks whose text contains a keyword.

    ``keywords`` is ``query_id, keyword``; ``scope`` is ``query_id, book_id`` (None: all
    books). Only matching chunks are shuffled to meet their scope.
    """
    clean = keywords.select(
        F.col("query_id").alias("needle_id"), F.lower(F.trim("keyword")).alias("needle")
    ).filter(F.length("needle") >= 2)
    rows = chunks.select("chunk_id", "book_id", "chunk_index", F.lower("text").alias("_low"))
    found = match_substrings(rows, ["chunk_id", "book_id", "chunk_index"], "_low", clean)
    found = found.select(
        F.col("needle_id").alias("query_id"), "chunk_id", "book_id", "chunk_index"
    ).distinct()
    if scope is not None:
        found = found.join(scope, ["query_id", "book_id"], "left_semi")
    if limit is None:
        return found
    return top_per_key(found, ["query_id"], [F.col("book_id"), F.col("chunk_index")], limit)


# --- snippets ---------------------------------------------------------------------------


def _window_start(places: Column, n_prefixes: Column, width: int) -> Column:
    """First token of the window that covers most distinct prefixes, the earliest on ties.

    ``places`` lists hit tokens (``at``, ``p``: number of the prefix). One walk from the last
    to the first knows where each prefix comes next, so a window's prefixes are those that
    come before its end.
    """
    far = 1 << 30
    start = F.struct(
        F.array_repeat(F.lit(far), n_prefixes).alias("next"), F.lit(-1).alias("at"), F.lit(0).alias("n")
    )

    def step(state: Column, place: Column) -> Column:
        known = F.transform(
            state["next"], lambda x, j: F.when(j == place["p"], place["at"]).otherwise(x)
        )
        covered = F.size(
            F.filter(
                state["next"],
                lambda x, j: (j != place["p"]) & (x < place["at"] + width),
            )
        ) + 1
        better = covered >= state["n"]
        return F.struct(
            known.alias("next"),
            F.when(better, place["at"]).otherwise(state["at"]).alias("at"),
            F.when(better, covered).otherwise(state["n"]).alias("n"),
        )

    return F.aggregate(F.reverse(places), start, step, lambda state: state["at"])


def snippet_windows(df: DataFrame, width: int = K.SNIPPET_TOKENS) -> DataFrame:
    """Add ``snippet`` to rows with ``text`` and ``_prefixes``; NULL without a hit.

    The snippet is the best window of ``width`` tokens with hits marked by ``**`` and ``...``
    where the text goes on. A token counts for the first of its prefixes.
    """
    word = r"[\p{L}\p{N}]+"
    own = [c for c in df.columns if c not in ("_prefixes", "snippet")]
    cut = once(
        df,
        _tokens=F.regexp_extract_all("text", F.lit(word), 0),
        _gaps=F.split("text", word, -1),
    )
    first = lambda t: F.get(F.filter("_prefixes", lambda p: F.startswith(t, p)), F.lit(0))
    hit = once(cut, _hits=F.transform(F.transform("_tokens", fold), first))
    places = F.filter(
        F.transform(
            "_hits",
            lambda h, i: F.struct(
                i.alias("at"), (F.array_position("_prefixes", h) - 1).cast("int").alias("p")
            ),
        ),
        lambda x: x["p"].isNotNull() & (x["p"] >= 0),
    )
    begun = once(hit, _start=_window_start(places, F.size("_prefixes"), width))
    n = F.size("_tokens")
    last = F.least(F.col("_start") + width, n) - 1

    def shown(i: Column) -> Column:
        gap = F.when(i == F.col("_start"), "").otherwise(F.get("_gaps", i))
        mark = F.when(F.get("_hits", i).isNotNull(), "**").otherwise("")
        return F.concat(gap, mark, F.get("_tokens", i), mark)

    snippet = F.concat(
        F.when(F.col("_start") > 0, "...").otherwise(""),
        F.array_join(F.transform(F.sequence(F.col("_start"), last), shown), ""),
        F.when(last < n - 1, "...").otherwise(""),
    )
    return begun.select(*own, F.when(F.col("_start") >= 0, snippet).alias("snippet"))


def prefix_lists(terms: DataFrame) -> DataFrame:
    """``query_id, _prefixes``: the sorted prefix terms of each query."""
    return terms.groupBy("query_id").agg(F.sort_array(F.collect_set("prefix")).alias("_prefixes"))


def snippets(hits: DataFrame, terms: DataFrame, width: int = K.SNIPPET_TOKENS) -> DataFrame:
    """Add ``snippet`` to ``query_id, book_id, chunk_index, text`` rows."""
    return snippet_windows(hits.join(prefix_lists(terms), "query_id"), width)


def name_reason() -> Column:
    """What a name match says about itself."""
    return (
        F.when(F.col("rank_value") == K.TIER_FILE, F.concat(F.lit("Filename: "), "file_name"))
        .when(F.col("rank_value") == K.TIER_TITLE, F.lit("Title match"))
        .otherwise(F.concat(F.lit("Author: "), F.coalesce("author", F.lit(""))))
    )


def with_snippets(
    hits: DataFrame, books: DataFrame, chunks: DataFrame, terms: DataFrame, name: str = "snippet"
) -> DataFrame:
    """Add ``name`` to tiered search results (``query_id, book_id, source, rank_value, chunk_index``).

    A name match says what matched; a content match shows its best chunk's window. Rows
    without a source get NULL.
    """
    texts = chunks.select("book_id", "chunk_index", "text")
    content = F.when(F.col("source") == "content", F.col("chunk_index"))
    rows = hits.withColumn("_at", content).join(
        texts.select(F.col("book_id").alias("_book"), F.col("chunk_index").alias("_chunk"), "text"),
        (F.col("book_id") == F.col("_book")) & (F.col("_at") == F.col("_chunk")),
        "left",
    ).drop("_book", "_chunk", "_at")
    cut = snippet_windows(rows.join(prefix_lists(terms), "query_id", "left")).drop("text")
    fields = books.select("book_id", "file_name", *([] if "author" in hits.columns else ["author"]))
    reason = F.when(F.col("source") == "name", name_reason())
    return cut.join(fields, "book_id", "left").select(
        *hits.columns, F.coalesce("snippet", reason).alias(name)
    )


def hit_snippets(hits: DataFrame, books: DataFrame, chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """``query_id, book_id, snippet`` of tiered search results."""
    return with_snippets(hits, books, chunks, terms).select("query_id", "book_id", "snippet")
