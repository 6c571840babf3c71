"""The thin queries over whole tables and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLE[build.__name__] = sql
        return build

    return add


@query()
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from foliant.llm.quality import quality_rules

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality_rules(docs, table(spark, folder, "labels"), keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "score", "kept",
    )


@query()
def op10_pack_windows(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from foliant.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    return pack(table(spark, folder, "documents"), path).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


@query(
    """
WITH RECURSIVE
doc AS (
    SELECT doc_id, list_filter(
        string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
shingle AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
    FROM doc),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both
    FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (
    SELECT a, b FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b
    WHERE 100 * n_both >= 75 * (p.n + q.n - n_both)),
reach(a, b) AS (
    SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles,
    least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
    least(d.doc_id, coalesce(m, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN size s ON s.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
"""
)
def op9_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    from foliant.llm.near_dups import near_groups

    return near_groups(table(spark, folder, "documents").select("doc_id", "text"))


@query(
    """
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
    SELECT *, length(replace(replace(replace(replace(replace(replace(replace(role || text,
        '\\', '\\\\'), '<|', '<\\|'), '|>', '|\\>'), '<s>', '<\\s>'), '</s>', '<\\/s>'),
        '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]')) + 10 AS size FROM turns)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
        AS loss_sha256,
    sum(size)::BIGINT AS formatted_chars, false AS rewrites
FROM sized GROUP BY conv_id
"""
)
def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    from foliant.llm.chat import chat_digests, format_chats

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id long, turn long, role string, text string",
    )
    own = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(format_chats(own.unionByName(extra)))


@query()
def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from foliant.llm.secret_scan import find_secrets

    found = find_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"),
    )


@query(
    """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top
    FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
        lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            (((('0x' || substr(sha1(html), (5 * i + 1)::BIGINT, 5))::BIGINT >> s) & 31) + 1)::BIGINT, 1)), '')),
        '') AS payload_digest,
    CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM p
"""
)
def op3_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    from foliant.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query()
def op5_prefix_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    from foliant.llm.prefix_hash import fingerprints

    return fingerprints(table(spark, folder, "documents").select("doc_id", "text"))


@query()
def op4_n_best_pieces(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from foliant.llm.pieces import n_best_texts

    path = public_tokenizers.path("piece_bpe_32k.model")
    return n_best_texts(table(spark, folder, "documents"), path)


@query()
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from foliant.llm.pieces import token_counts

    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


#: Byte limit of a shard in the registered query.
SHARD_BYTES = 4 << 20


@query(
    f"""
WITH d AS (
    SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS text_bytes,
        ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
node AS (
    SELECT depth, h >> (60 - depth) AS p, sum(text_bytes)::BIGINT AS n
    FROM d, range(0, 41) t(depth) GROUP BY ALL HAVING n <= {SHARD_BYTES}),
own AS (
    SELECT d.doc_id, text_bytes, h, min(depth) AS depth FROM d
    JOIN node ON p = h >> (60 - depth) GROUP BY ALL)
SELECT doc_id, text_bytes, lpad(bin(h >> (60 - own.depth)), own.depth::INT, '0') AS shard,
    own.depth::INT AS shard_depth, n AS shard_bytes
FROM own JOIN node ON node.depth = own.depth AND p = h >> (60 - own.depth)
"""
)
def op8_extendible_shards(spark: SparkSession, folder: str) -> DataFrame:
    from foliant.llm.extendible import shards

    return shards(table(spark, folder, "documents").select("doc_id", "text"), SHARD_BYTES)


@query()
def op11_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from foliant.llm.language import identify

    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query(
    """
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, text FROM documents),
piece AS (
    SELECT id, lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM d),
words AS (SELECT lang, list_filter(string_split_regex(p, '[ \\x09]+'), lambda w: w <> '') AS w FROM piece),
gram AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) t(k))),
f AS (SELECT lang, k AS size, phrase, count(*)::HUGEINT AS f FROM gram GROUP BY ALL HAVING f >= 100),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
kept AS (
    SELECT * FROM cand c WHERE NOT EXISTS (
        SELECT 1 FROM cand x WHERE x.lang = c.lang AND x.size > c.size AND 100 * x.a >= 100 * c.a
            AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))),
cut AS (
    SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:], ' ') AS q
    FROM kept, range(1, 5) t(k) WHERE k < size),
scored AS (
    SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, n, (1000 * a * n) // (x.f * y.f) AS score,
        row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000 * a * n) // (x.f * y.f), k) AS nr
    FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = c.p JOIN f y ON y.lang = c.lang AND y.phrase = c.q
    JOIN n ON n.lang = c.lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
    a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM scored WHERE nr = 1 QUALIFY rank <= 2000
"""
)
def op12_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    from foliant.llm.phrases import collocations

    return collocations(table(spark, folder, "documents").select("doc_id", "lang", "text"))


#: Code points that end a term.
_GAPS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def _terms_sql(text: str) -> str:
    low = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({low}, '{_GAPS}')"


@query(
    f"""
WITH term AS (SELECT doc_id, unnest({_terms_sql("text")}) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM term GROUP BY ALL),
size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM size),
weight AS (
    SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM tf, total GROUP BY t, docs),
m AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM size, total),
asked AS (SELECT item_id, unnest({_terms_sql("text")}) AS t FROM benchmark),
wanted AS (SELECT item_id, t, count(*) AS c FROM asked GROUP BY ALL),
hit AS (
    SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM wanted JOIN tf USING (t) JOIN weight USING (t) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank,
    doc_id, score
FROM hit WHERE score > 0 QUALIFY rank <= 20
"""
)
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    from foliant.llm.ranked import ranked_search

    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
