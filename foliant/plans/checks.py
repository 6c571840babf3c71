"""Views used by the checking SQL only (DuckDB dialect)."""

from __future__ import annotations

import re

from foliant import constants as K


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def value_list(values: list[str]) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


BLANKS = "concat(' ', chr(9), chr(10), chr(13), chr(12))"
SPACES = "concat(' ', chr(9))"


def toks(text: str) -> str:
    folded = f"translate(lower({text}), '{K.ACCENTED}', '{K.PLAIN}')"
    return f"list_filter(string_split_regex({folded}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def n_words(text: str) -> str:
    return f"len(list_filter(string_split({text}, ' '), lambda w: w <> ''))"


def plain_text(html: str) -> str:
    text = f"regexp_replace({html}, '(?is)<style[^>]*>.*?</style>', '', 'g')"
    text = f"regexp_replace({text}, '(?is)<script[^>]*>.*?</script>', '', 'g')"
    text = f"regexp_replace({text}, '<[^>]+>', ' ', 'g')"
    for name, char in [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')]:
        text = f"replace({text}, '{name}', '{char}')"
    return f"trim(regexp_replace({text}, '[ \\t\\n\\r\\f]+', ' ', 'g'), {BLANKS})"


def _match_sum(text: str, pattern: str, weight: float, most: int) -> str:
    found = f"len(regexp_extract_all({text}, {quoted(pattern)}))"
    return f"CAST(least({found}, {most}) AS DOUBLE) * CAST({weight} AS DOUBLE)"


def _word_sum(text: str, words: list[str], weight: float, most: int) -> str:
    found = f"len(list_filter({value_list(words)}, lambda w: contains({text}, w)))"
    return f"CAST(least({found}, {most}) AS DOUBLE) * CAST({weight} AS DOUBLE)"


def score(text: str) -> str:
    low = f"lower({text})"
    parts = [_match_sum(low, p, K.QUANTITY_WEIGHT, K.QUANTITY_MAX) for p in K.QUANTITY_PATTERNS]
    parts += [
        _word_sum(low, K.INSTRUCTION_WORDS, K.INSTRUCTION_WEIGHT, K.INSTRUCTION_MAX),
        _match_sum(low, K.TIME_PATTERN, K.TIME_WEIGHT, K.TIME_MAX),
        _match_sum(low, K.TEMPERATURE_PATTERN, K.TEMPERATURE_WEIGHT, K.TEMPERATURE_MAX),
        _word_sum(low, K.HEADER_WORDS, K.HEADER_WEIGHT, K.HEADER_MAX),
    ]
    return f"round(least({' + '.join(parts)}, CAST(1 AS DOUBLE)), 6)"


def kept_lines(text: str) -> str:
    trimmed = f"list_transform(string_split({text}, chr(10)), lambda l: trim(l, {SPACES}))"
    return f"list_filter({trimmed}, lambda l: l <> '')"


def page_kind(text: str) -> str:
    lines = kept_lines(text)
    first = f"lower(({lines})[1])"
    markers = f"len(list_filter({value_list(K.FRONT_MATTER)}, lambda m: contains({first}, m))) > 0"
    leaders = f"len(list_filter({lines}, lambda l: contains(l, '....') OR contains(l, '. . .')))"
    digits = f"CAST(length(regexp_replace({text}, '\\P{{N}}', '', 'g')) AS DOUBLE) / length({text})"
    index = f"len(regexp_extract_all({text}, {quoted(K.INDEX_LINE_PATTERN)}))"
    return f"""CASE WHEN len({lines}) = 0 THEN 'blank'
  WHEN length({first}) < {K.FRONT_MATTER_CHARS} AND {markers} THEN 'front_matter'
  WHEN {index} >= {K.INDEX_LINES} THEN 'index' WHEN {leaders} >= {K.LEADER_LINES} THEN 'contents'
  WHEN {digits} > {K.DIGIT_SHARE} AND contains(lower({text}), 'see also') THEN 'numbers' ELSE 'content' END"""


def title_guess(text: str) -> str:
    lines = (
        f"list_filter(list_transform(regexp_split_to_array({text}, '\\r?\\n|\\r'), "
        f"lambda l: trim(l, {BLANKS})), lambda l: l <> '')"
    )
    return (
        f"list_filter(({lines})[1:3], lambda l: {n_words('l')} BETWEEN 2 AND 12 "
        "AND NOT contains(l, ':'))[1]"
    )


def sort_key(position: str) -> str:
    pdf = f"CAST({position} ->> '$.pdf.pageIndex' AS DOUBLE)"
    y = f"CAST({position} ->> '$.pdf.bounds[1]' AS DOUBLE)"
    chapter = f"CAST({position} ->> '$.reflowable.chapterIndex' AS DOUBLE)"
    offset = f"CAST({position} ->> '$.reflowable.startOffset' AS DOUBLE)"
    return (
        f"round(coalesce({pdf} + CASE WHEN json_array_length({position}, '$.pdf.bounds') >= 4 "
        f"THEN 1.0 - {y} / 1000.0 ELSE 0 END, {chapter} * 1000000 + {offset}, 0), 6)"
    )


def _cut_length(text: str, at: str, size: int) -> str:
    window = f"substr({text}, {at}, {size})"
    rest = f"length({text}) - ({at}) + 1"
    return f"""CASE WHEN {rest} <= {size} THEN {rest} WHEN contains({window}, ' ')
  THEN {size} - strpos(reverse({window}), ' ') + 1 ELSE {size} END"""


_MATCH_WORDS = f"""list_filter(string_split_regex(lower(trim(text, {BLANKS})), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"""

CHECK_VIEWS = {
    "text_chunk": f"""
SELECT doc_id AS book_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS chunk_index, text FROM (
  WITH RECURSIVE piece AS (
    SELECT doc_id, 0 AS n, CAST(1 AS BIGINT) AS pos, CAST({_cut_length('text', '1', K.INDEX_CHUNK_CHARS)} AS BIGINT) AS len FROM documents WHERE length(text) > 0
    UNION ALL SELECT p.doc_id, p.n + 1, p.pos + p.len, CAST({_cut_length('d.text', 'p.pos + p.len', K.INDEX_CHUNK_CHARS)} AS BIGINT)
    FROM piece p JOIN documents d ON d.doc_id = p.doc_id WHERE p.pos + p.len <= length(d.text))
  SELECT p.doc_id, p.n, trim(substr(d.text, p.pos, p.len), {BLANKS}) AS text FROM piece p JOIN documents d ON d.doc_id = p.doc_id) c WHERE text <> ''""",
    "posting": f"""
SELECT term, book_id, chunk_index, count(*) AS tf FROM (
  SELECT book_id, chunk_index, unnest({toks('text')}) AS term FROM text_chunk) t GROUP BY term, book_id, chunk_index""",
    "text_length": f"""
SELECT book_id, chunk_index, len({toks('text')}) AS length FROM text_chunk""",
    "asked_term": f"""
SELECT DISTINCT query_id, unnest(flatten(list_transform(CASE WHEN len(kept) > 0 THEN kept ELSE raw END, lambda w: {toks('w')}))) AS prefix FROM (
  SELECT query_id, raw, list_filter(raw, lambda w: NOT list_contains({value_list(K.MATCH_STOP_WORDS)}, w) AND length(w) > 1 AND NOT regexp_matches(w, '^\\p{{N}}+$')) AS kept
  FROM (SELECT query_id, {_MATCH_WORDS} AS raw FROM query) r) k""",
    "any_asked_term": f"""
SELECT DISTINCT query_id, unnest(flatten(list_transform(CASE WHEN len(kept) > 0 THEN kept ELSE raw END, lambda w: {toks('w')}))) AS prefix FROM (
  SELECT query_id, raw, list_filter(raw, lambda w: NOT list_contains({value_list(K.MATCH_STOP_WORDS)}, w) AND length(w) > 1 AND NOT regexp_matches(w, '^\\p{{N}}+$')) AS kept
  FROM (SELECT query_id, {_MATCH_WORDS} AS raw FROM asked) r) k""",
    "text_score": f"""
SELECT h.query_id, h.book_id, h.chunk_index, round(sum(w.idf * h.f * {K.BM25_K1 + 1} / (h.f + {K.BM25_K1} * (1 - {K.BM25_B} + {K.BM25_B} * l.length / s.mean))), 6) AS score
FROM (SELECT t.query_id, t.prefix, p.book_id, p.chunk_index, CAST(sum(p.tf) AS DOUBLE) AS f FROM asked_term t JOIN posting p ON starts_with(p.term, t.prefix) GROUP BY ALL) h
JOIN (SELECT query_id, prefix, CASE WHEN idf <= 0 THEN {K.IDF_FLOOR} ELSE idf END AS idf FROM (
    SELECT t.query_id, t.prefix, ln(((SELECT count(*) FROM text_length) - count(DISTINCT (p.book_id, p.chunk_index)) + 0.5::DOUBLE) / (count(DISTINCT (p.book_id, p.chunk_index)) + 0.5::DOUBLE)) AS idf
    FROM asked_term t JOIN posting p ON starts_with(p.term, t.prefix) GROUP BY t.query_id, t.prefix) i) w ON w.query_id = h.query_id AND w.prefix = h.prefix
JOIN text_length l ON l.book_id = h.book_id AND l.chunk_index = h.chunk_index, (SELECT avg(length) AS mean FROM text_length) s
GROUP BY h.query_id, h.book_id, h.chunk_index""",
    # the same over cookbook chunks
    "cook_posting": f"""
SELECT term, book_id, chunk_index, count(*) AS tf FROM (
  SELECT book_id, chunk_index, unnest({toks('text')}) AS term FROM cook_chunk) t GROUP BY term, book_id, chunk_index""",
    "cook_length": f"""
SELECT book_id, chunk_index, len({toks('text')}) AS length FROM cook_chunk""",
    "cook_score": f"""
SELECT h.query_id, h.book_id, h.chunk_index, round(sum(w.idf * h.f * {K.BM25_K1 + 1} / (h.f + {K.BM25_K1} * (1 - {K.BM25_B} + {K.BM25_B} * l.length / s.mean))), 6) AS score
FROM (SELECT t.query_id, t.prefix, p.book_id, p.chunk_index, CAST(sum(p.tf) AS DOUBLE) AS f FROM asked_term t JOIN cook_posting p ON starts_with(p.term, t.prefix) GROUP BY ALL) h
JOIN (SELECT query_id, prefix, CASE WHEN idf <= 0 THEN {K.IDF_FLOOR} ELSE idf END AS idf FROM (
    SELECT t.query_id, t.prefix, ln(((SELECT count(*) FROM cook_length) - count(DISTINCT (p.book_id, p.chunk_index)) + 0.5::DOUBLE) / (count(DISTINCT (p.book_id, p.chunk_index)) + 0.5::DOUBLE)) AS idf
    FROM asked_term t JOIN cook_posting p ON starts_with(p.term, t.prefix) GROUP BY t.query_id, t.prefix) i) w ON w.query_id = h.query_id AND w.prefix = h.prefix
JOIN cook_length l ON l.book_id = h.book_id AND l.chunk_index = h.chunk_index, (SELECT avg(length) AS mean FROM cook_length) s
GROUP BY h.query_id, h.book_id, h.chunk_index""",
    "name_tier": f"""
SELECT query_id, book_id, tier FROM (SELECT q.query_id, b.book_id, CASE WHEN contains(lower(b.file_name), q.needle) THEN {K.TIER_FILE}
    WHEN contains(lower(b.title), q.needle) THEN {K.TIER_TITLE} WHEN contains(lower(b.author), q.needle) THEN {K.TIER_AUTHOR} END AS tier
  FROM (SELECT query_id, lower(trim(text, {BLANKS})) AS needle FROM query) q, book b WHERE q.needle <> '') t WHERE tier IS NOT NULL""",
    "tier_hit": """
SELECT h.query_id, h.book_id, h.source, h.rank_value, h.chunk_index, coalesce(b.title, b.file_name) AS title, b.author, b.format FROM (
  SELECT query_id, book_id, 'name' AS source, tier AS rank_value, NULL AS chunk_index FROM name_tier
  UNION ALL SELECT query_id, book_id, 'content', max(score), first(chunk_index ORDER BY score DESC, chunk_index) FROM text_score s
    WHERE NOT EXISTS (SELECT 1 FROM name_tier n WHERE n.query_id = s.query_id AND n.book_id = s.book_id) GROUP BY query_id, book_id) h
  JOIN book b ON b.book_id = h.book_id""",
    "cook_hit": """
SELECT h.query_id, h.book_id, h.rank_value FROM (
  SELECT query_id, book_id, tier AS rank_value FROM name_tier
  UNION ALL SELECT query_id, book_id, max(score) FROM cook_score s
    WHERE NOT EXISTS (SELECT 1 FROM name_tier n WHERE n.query_id = s.query_id AND n.book_id = s.book_id) GROUP BY query_id, book_id) h
  JOIN book b ON b.book_id = h.book_id""",
    "asked_keyword": f"""
SELECT query_id, CAST(pos - 1 AS BIGINT) AS seq, kept[pos] AS keyword FROM (SELECT query_id, kept, unnest(range(1, len(kept) + 1)) AS pos FROM (
  SELECT query_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3 AND NOT list_contains({value_list(K.KEYWORD_STOP_WORDS)}, w)
    AND NOT regexp_matches(w, '^\\p{{N}}+$')) AS kept FROM asked) k) p""",
    "keyword_list": """
SELECT query_id, list(DISTINCT keyword) AS words FROM asked_keyword WHERE query_id < 1000 GROUP BY query_id""",
    "keyword_hit": """
SELECT w.query_id, c.book_id, c.chunk_id, c.chunk_index FROM chunk_vec c, keyword_list w
WHERE len(list_filter(w.words, lambda k: contains(lower(c.text), k))) > 0""",
    "vector_hit": """
SELECT query_id, book_id, chunk_id, similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM (
    SELECT q.query_id, c.book_id, c.chunk_id, round(list_cosine_similarity(CAST(q.vector AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS similarity
    FROM query q, chunk_vec c WHERE c.embedding IS NOT NULL) s) r WHERE rank <= 50""",
    "candidate": f"""
SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.book_id, k.book_id) AS book_id, coalesce(v.chunk_id, k.chunk_id) AS chunk_id,
  round(CASE WHEN v.similarity IS NULL THEN {K.KEYWORD_BASE} ELSE v.similarity + CASE WHEN k.chunk_id IS NULL THEN 0 ELSE {K.KEYWORD_BOOST} END END, 6) AS score
FROM vector_hit v FULL JOIN keyword_hit k
  ON k.query_id = v.query_id AND k.chunk_id = v.chunk_id""",
    "help_listed": """
SELECT t.book_id, t.seq, first(e.name ORDER BY e.entry_index) AS name FROM help_toc t
JOIN help_entry e ON e.book_id = t.book_id AND ends_with(e.name, t.path) GROUP BY t.book_id, t.seq""",
    "help_bare": """
SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY CASE WHEN book_id IN (SELECT book_id FROM help_toc) THEN entry_index END, name, entry_index) - 1 AS seq, name
FROM help_entry WHERE book_id NOT IN (SELECT book_id FROM help_listed) AND regexp_matches(name, '(?i)\\.html?$') AND NOT starts_with(name, '/#')""",
    "best_candidate": """
SELECT query_id, book_id, max(score) AS score, first(chunk_id ORDER BY score DESC, chunk_id) AS chunk_id FROM candidate GROUP BY query_id, book_id""",
    "tier_norm": f"""
SELECT query_id, book_id, round((rank_value - min(rank_value) OVER w) / greatest(max(rank_value) OVER w - min(rank_value) OVER w, {K.RANGE_FLOOR}), 6) AS keyword
FROM tier_hit WINDOW w AS (PARTITION BY query_id)""",
    "book_hit": f"""
SELECT query_id, book_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, book_id) AS rank FROM (
  SELECT coalesce(k.query_id, v.query_id) AS query_id, coalesce(k.book_id, v.book_id) AS book_id, v.chunk_id,
    round({K.KEYWORD_WEIGHT} * coalesce(k.keyword, 0) + {1 - K.KEYWORD_WEIGHT} * coalesce(v.score, 0), 6) AS score
  FROM tier_norm k FULL JOIN best_candidate v ON v.query_id = k.query_id AND v.book_id = k.book_id) s""",
    # windows of the searched chunks: tokens with the text before them, and the first prefix they start with
    "snippet_token": f"""
SELECT query_id, book_id, chunk_index, len(toks) AS n, i, gaps[i] AS gap, toks[i] AS tok,
  list_filter(prefixes, lambda p: starts_with(translate(lower(toks[i]), '{K.ACCENTED}', '{K.PLAIN}'), p))[1] AS hit
FROM (SELECT *, unnest(range(1, len(toks) + 1)) AS i FROM (
  SELECT s.query_id, s.book_id, s.chunk_index, a.prefixes, regexp_extract_all(c.text, '[\\p{{L}}\\p{{N}}]+') AS toks,
    string_split_regex(c.text, '[\\p{{L}}\\p{{N}}]+') AS gaps
  FROM text_score s JOIN text_chunk c ON c.book_id = s.book_id AND c.chunk_index = s.chunk_index
  JOIN (SELECT query_id, list_sort(list(prefix)) AS prefixes FROM asked_term GROUP BY query_id) a ON a.query_id = s.query_id) t) u""",
    "snippet_start": f"""
SELECT query_id, book_id, chunk_index, i AS start FROM (
  SELECT a.query_id, a.book_id, a.chunk_index, a.i, count(DISTINCT b.hit) AS covered FROM snippet_token a JOIN snippet_token b
    ON b.query_id = a.query_id AND b.book_id = a.book_id AND b.chunk_index = a.chunk_index AND b.i >= a.i AND b.i < a.i + {K.SNIPPET_TOKENS}
  WHERE a.hit IS NOT NULL AND b.hit IS NOT NULL GROUP BY a.query_id, a.book_id, a.chunk_index, a.i) w
QUALIFY row_number() OVER (PARTITION BY query_id, book_id, chunk_index ORDER BY covered DESC, i) = 1""",
    "chunk_snippet": f"""
SELECT t.query_id, t.book_id, t.chunk_index, CASE WHEN s.start > 1 THEN '...' ELSE '' END
  || string_agg(CASE WHEN t.i = s.start THEN '' ELSE t.gap END || CASE WHEN t.hit IS NULL THEN t.tok ELSE '**' || t.tok || '**' END, '' ORDER BY t.i)
  || CASE WHEN t.n >= s.start + {K.SNIPPET_TOKENS} THEN '...' ELSE '' END AS snippet
FROM snippet_token t JOIN snippet_start s ON s.query_id = t.query_id AND s.book_id = t.book_id AND s.chunk_index = t.chunk_index
WHERE t.i >= s.start AND t.i < s.start + {K.SNIPPET_TOKENS} GROUP BY t.query_id, t.book_id, t.chunk_index, t.n, s.start""",
    # a name match says what matched, a content match shows its window
    "tier_snippet": f"""
SELECT t.*, CASE WHEN t.source = 'content' THEN s.snippet WHEN t.rank_value = {K.TIER_FILE} THEN 'Filename: ' || b.file_name
  WHEN t.rank_value = {K.TIER_TITLE} THEN 'Title match' ELSE 'Author: ' || coalesce(b.author, '') END AS snippet
FROM tier_hit t JOIN book b ON b.book_id = t.book_id
LEFT JOIN chunk_snippet s ON s.query_id = t.query_id AND s.book_id = t.book_id AND s.chunk_index = t.chunk_index""",
    "book_result": f"""
SELECT h.query_id, h.book_id, h.chunk_id, h.score, h.rank, coalesce(b.title, b.file_name) AS title, b.author, b.format,
  coalesce(substr(c.text, 1, {K.SNIPPET_CHARS}), t.snippet) AS snippet, coalesce(c.text, t.snippet) AS full_text
FROM book_hit h JOIN book b ON b.book_id = h.book_id LEFT JOIN chunk_vec c ON c.chunk_id = h.chunk_id
LEFT JOIN tier_snippet t ON t.query_id = h.query_id AND t.book_id = h.book_id""",
    "hint": f"""
SELECT chunk_id, score, title FROM (SELECT chunk_id, {score('text')} AS score, {title_guess('text')} AS title FROM cook_chunk) s WHERE score > {K.HINT_STORE}""",
    "cook_vector": """
SELECT query_id, book_id, chunk_id, similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM (
    SELECT q.query_id, c.book_id, c.chunk_id, round(list_cosine_similarity(CAST(q.vector AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS similarity
    FROM query q, cook_chunk c WHERE c.embedding IS NOT NULL) s) r WHERE rank <= 36""",
    "cook_keyword": """
SELECT w.query_id, c.book_id, c.chunk_id, c.chunk_index FROM cook_chunk c, keyword_list w
WHERE len(list_filter(w.words, lambda k: contains(lower(c.text), k))) > 0""",
    "cook_candidate": f"""
SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.book_id, k.book_id) AS book_id, coalesce(v.chunk_id, k.chunk_id) AS chunk_id,
  round(CASE WHEN v.similarity IS NULL THEN {K.KEYWORD_BASE} ELSE v.similarity + CASE WHEN k.chunk_id IS NULL THEN 0 ELSE {K.KEYWORD_BOOST} END END, 6) AS score
FROM cook_vector v FULL JOIN cook_keyword k ON k.query_id = v.query_id AND k.chunk_id = v.chunk_id""",
    "cook_norm": f"""
SELECT query_id, book_id, round((rank_value - min(rank_value) OVER w) / greatest(max(rank_value) OVER w - min(rank_value) OVER w, {K.RANGE_FLOOR}), 6) AS keyword
FROM cook_hit WINDOW w AS (PARTITION BY query_id)""",
    "gated": f"""
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT c.query_id, c.book_id, c.chunk_id, t.chunk_index, t.is_hinted,
    round({K.KEYWORD_WEIGHT} * coalesce(n.keyword, 0) + {1 - K.KEYWORD_WEIGHT} * c.score + CASE WHEN t.is_hinted THEN {K.HINT_BOOST} ELSE 0 END, 6) AS score
  FROM cook_candidate c JOIN (SELECT x.chunk_id, x.chunk_index, h.chunk_id IS NOT NULL AS is_hinted,
      h.chunk_id IS NOT NULL OR ({page_kind('x.text')} = 'content' AND {score('x.text')} >= {K.QUALITY_GATE}) AS passes
    FROM cook_chunk x LEFT JOIN hint h ON h.chunk_id = x.chunk_id AND h.score >= {K.HINT_MATCH}) t ON t.chunk_id = c.chunk_id AND t.passes
  LEFT JOIN cook_norm n ON n.query_id = c.query_id AND n.book_id = c.book_id) s""",
    # walk down each top list, carrying the accepted chunks
    "accepted": f"""
WITH RECURSIVE walk AS (
  SELECT query_id, CAST(0 AS BIGINT) AS pos, CAST([] AS STRUCT(book_id BIGINT, chunk_index BIGINT, chunk_id BIGINT)[]) AS taken FROM (SELECT DISTINCT query_id FROM gated) q
  UNION ALL SELECT w.query_id, w.pos + 1, CASE WHEN len(list_filter(w.taken, lambda t: t.book_id = g.book_id AND abs(t.chunk_index - g.chunk_index) <= 1)) > 0 THEN w.taken
    ELSE list_append(w.taken, CAST({{'book_id': g.book_id, 'chunk_index': g.chunk_index, 'chunk_id': g.chunk_id}} AS STRUCT(book_id BIGINT, chunk_index BIGINT, chunk_id BIGINT))) END
  FROM walk w JOIN gated g ON g.query_id = w.query_id AND g.rank = w.pos + 1 AND g.rank <= {K.CHUNK_RESULTS}),
final AS (SELECT query_id, unnest(taken) AS hit FROM (SELECT query_id, taken, row_number() OVER (PARTITION BY query_id ORDER BY pos DESC) AS n FROM walk) w WHERE n = 1)
SELECT g.* FROM final f JOIN gated g ON g.query_id = f.query_id AND g.chunk_id = f.hit.chunk_id""",
}

#: Books of each scope, written out.
SCOPED = """SELECT s.scope_id, b.book_id FROM scope s, book b WHERE s.kind = 'all' OR s.kind = 'recent' AND b.date_last_opened IS NOT NULL
      OR s.kind = 'folder' AND starts_with(b.file_path, regexp_replace(s.folder, '/+$', '') || '/')
      OR s.kind = 'collection' AND EXISTS (SELECT 1 FROM book_collection m WHERE m.book_id = b.book_id AND m.collection_id = s.collection_id)"""

# the searches again, each query over the books of its scope
_BY_BOOK = ["keyword_hit", "tier_hit", "cook_keyword", "cook_hit", "cook_score"]
_NEAREST = {"vector_hit": ("chunk_vec", 50), "cook_vector": ("cook_chunk", 36)}
_BLENDED = ["candidate", "best_candidate", "tier_norm", "book_hit", "cook_candidate", "cook_norm", "gated", "accepted"]
_SCOPES = {
    "in": """SELECT q.query_id, s.book_id FROM query_scope q JOIN ({0}) s ON s.scope_id = q.scope_id""".format(SCOPED),
    "open": "SELECT query_id, book_id FROM open_book",
}
_NAMES = re.compile(rf"\b({'|'.join([*_BY_BOOK, *_NEAREST, *_BLENDED])})\b")

for _mark, _seen in _SCOPES.items():
    CHECK_VIEWS[f"{_mark}_seen"] = _seen
    for _name in _BY_BOOK:
        CHECK_VIEWS[f"{_mark}_{_name}"] = f"""
SELECT x.* FROM {_name} x JOIN {_mark}_seen i ON i.query_id = x.query_id AND i.book_id = x.book_id"""
    for _name, (_chunks, _most) in _NEAREST.items():
        CHECK_VIEWS[f"{_mark}_{_name}"] = f"""
SELECT query_id, book_id, chunk_id, similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM (
    SELECT q.query_id, c.book_id, c.chunk_id, round(list_cosine_similarity(CAST(q.vector AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS similarity
    FROM query q JOIN {_mark}_seen i ON i.query_id = q.query_id JOIN {_chunks} c ON c.book_id = i.book_id WHERE c.embedding IS NOT NULL) s) r WHERE rank <= {_most}"""
    for _name in _BLENDED:
        CHECK_VIEWS[f"{_mark}_{_name}"] = _NAMES.sub(rf"{_mark}_\1", CHECK_VIEWS[_name])
