"""Library-shaped views over the raw tables, as SQL text for two engines.

``{...}`` marks the few places where dialects differ; see ``DIALECTS``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.chunking import chunk_chars
from foliant.session import checkpoint_dir
from foliant.sources.keyword_index import KeywordIndex, build_index, open_index
from foliant.sources.tables import read_table

RAW = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

DIALECTS = {
    "spark": {
        # an empty text has no slices; a sequence from 0 to -1 would count down
        "slices": "LATERAL VIEW explode(CASE WHEN d.text <> '' THEN sequence(0, CAST(ceil(length(d.text) / 600.0) AS INT) - 1) END) s AS i",
        "three": "LATERAL VIEW explode(sequence(1, 3)) s AS i",
        "lines": "LATERAL VIEW posexplode(split(d.text, '\\n', -1)) s AS i, line",
        "int_div": "div",
        "global": "",
        "sitemap": '<OBJECT type="text/sitemap"><param name="Name" value="$2"><param name="Local" value="$1"><param name="X" value="y"></OBJECT><object type="text/sitemap"><param name="Local" value="$1"></object>',
    },
    "duckdb": {
        "slices": ", range(0, CAST(ceil(length(d.text) / 600.0) AS BIGINT)) s(i)",
        "three": ", range(1, 4) s(i)",
        "lines": ", LATERAL (SELECT unnest(range(0, len(string_split(d.text, chr(10))))) AS i, "
        "unnest(string_split(d.text, chr(10))) AS line) s",
        "int_div": "//",
        "n_embeddings": "(SELECT count(*) FROM embeddings)",
        "global": ", 'g'",
        "sitemap": '<OBJECT type="text/sitemap"><param name="Name" value="\\2"><param name="Local" value="\\1"><param name="X" value="y"></OBJECT><object type="text/sitemap"><param name="Local" value="\\1"></object>',
    },
}

_SLICES = """SELECT d.doc_id * 100000 + i AS chunk_id, d.doc_id AS book_id, CAST(i AS INT) AS chunk_index,
    substr(d.text, CAST(i AS INT) * 600 + 1, 600) AS text, (d.doc_id * 31 + i) % {n_embeddings} AS vec_id FROM documents d {slices}"""

VIEWS = {
    # books of the catalog: one per document
    "book": """
SELECT doc_id AS book_id,
  concat('/library/', source, '/', lang, '/book_', CAST(doc_id AS STRING), '.', fmt) AS file_path,
  concat('book_', CAST(doc_id AS STRING), '.', fmt) AS file_name,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE split_part(text, chr(10), 1) END AS title,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE concat('Author ', CAST(doc_id % 37 AS STRING)) END AS author,
  fmt AS format, n_chars AS file_size, CAST(n_chars AS INT) % 500 + 10 AS page_count, lang AS language,
  1704067200 + doc_id * 60 AS date_added,
  CASE WHEN doc_id % 3 = 0 THEN 1706745600 + (doc_id * 7919) % 86400 END AS date_last_opened,
  doc_id % 4 <> 1 AS full_text_indexed, doc_id % 5 <> 2 AS embedding_indexed
FROM (SELECT *, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'epub' WHEN 2 THEN 'chm'
        WHEN 3 THEN 'mobi' WHEN 4 THEN 'azw3' ELSE 'fb2' END AS fmt FROM documents) d""",
    # lines of a document serve as its pages or parts
    "book_page": """
SELECT d.doc_id AS book_id, CAST(i AS INT) AS page_index, line AS text FROM documents d {lines}""",
    "book_part": """
SELECT p.book_id, p.page_index AS part_index, CASE p.book_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'epub' WHEN 2 THEN 'chm'
    WHEN 3 THEN 'mobi' WHEN 4 THEN 'azw3' ELSE 'fb2' END AS format, concat('ch', CAST(p.page_index AS STRING), '.xhtml') AS href, p.text
FROM book_page p""",
    # ten pages make a book of chapters
    "spine_item": """
SELECT page_id {int_div} 10 AS book_id, CAST(page_id % 10 AS INT) AS spine_index,
  concat('Text/p', CAST(page_id % 3 AS STRING), '/ch', CAST(page_id AS STRING), '.xhtml') AS href,
  concat('<html><head><link rel="stylesheet" href="../css/s', CAST(page_id % 4 AS STRING), '.css">',
    '<link rel="stylesheet" href="/site.css"></head><body class="c"><img src="../../img/./p', CAST(page_id AS STRING),
    '.png"><a href="http://example.org/a">x</a><a href="#top">t</a><a href="../../../out.html">o</a>',
    replace(html, '<a href="/', '<a href="../nav/'), '</body></html>') AS html
FROM pages""",
    # headings of several levels around the page text
    "outline_page": """
SELECT page_id, CASE page_id % 4
  WHEN 0 THEN html
  WHEN 1 THEN concat(replace(replace(html, '<h1>', '<H2 id="a">'), '</h1>', '</H2>'), '<h3>low</h3>')
  WHEN 2 THEN concat('<h2> </h2><h3>One <b>', CAST(page_id AS STRING), '</b></h3><h3>Two</h3>', replace(replace(html, '<h1>', '<p>'), '</h1>', '</p>'))
  ELSE concat(html, '<h1 class="x">', chr(10), 'Last ', CAST(page_id AS STRING), '</h1><h2>no</h2>') END AS html
FROM pages""",
    # some pages name a publisher and a number
    "meta_page": """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN html ELSE replace(html, '<head>', concat('<head><meta name="publisher" content="House ', CAST(page_id % 7 AS STRING), ' "><META class="n" name="isbn" content="978-',
  CAST(page_id AS STRING), CASE page_id % 3 WHEN 1 THEN '' ELSE '-X' END, '">')) END AS html FROM pages""",
    "collection_group": """
SELECT r_regionkey AS group_id, r_name AS name, r_regionkey * 10 AS sort_order FROM region""",
    "collection": """
SELECT n_nationkey AS collection_id, n_name AS name,
  CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE n_regionkey END AS group_id, n_nationkey * 10 AS sort_order,
  CASE WHEN n_nationkey % 5 = 0 THEN 'cookbook' ELSE 'default' END AS collection_type FROM nation""",
    "book_collection": """
SELECT book_id, collection_id, min(date_added) AS date_added FROM (
  SELECT doc_id AS book_id, CAST(doc_id % 24 AS INT) AS collection_id, 1704067200 + doc_id * 61 AS date_added FROM documents
  UNION ALL SELECT doc_id, CAST((doc_id * 7 + 3) % 24 AS INT), 1704067200 + (doc_id * 7919) % 100000 FROM documents) m
GROUP BY book_id, collection_id""",
    # slices of every document, with the number of the vector they should have
    "chunk_slice": _SLICES,
    # slices of every document with a vector, some not embedded yet
    "chunk_vec": """
SELECT c.chunk_id, c.book_id, c.chunk_index, c.text, CASE WHEN c.chunk_id % 9 = 4 THEN NULL ELSE e.embedding END AS embedding
FROM (""" + _SLICES + """) c
  JOIN embeddings e ON e.vec_id = c.vec_id""",
    # cookbooks of eight chunks each: recipes, contents, index, preface, plain text
    "cook_chunk": """
SELECT r.chunk_id, r.book_id, r.chunk_index, r.text, CASE WHEN r.chunk_id % 9 = 4 THEN NULL ELSE e.embedding END AS embedding
FROM (SELECT doc_id AS chunk_id, doc_id {int_div} 8 AS book_id, CAST(doc_id % 8 AS INT) AS chunk_index, CASE doc_id % 8
  WHEN 0 THEN concat('Roast Dish ', CAST(doc_id AS STRING), chr(10), 'Serves 4. Cook time: ', CAST(doc_id % 50 + 5 AS STRING), ' minutes.', chr(10), 'Ingredients:', chr(10),
    '- ', CAST(doc_id % 9 + 1 AS STRING), ' cups flour', chr(10), '- 1/2 tsp salt', chr(10), '- 3 cloves garlic', chr(10), 'Instructions:', chr(10),
    'Preheat oven to 200 degrees C. Stir, bake and season.', chr(10), text)
  WHEN 1 THEN concat('Table of Contents', chr(10), 'Soups ........ 12', chr(10), 'Fish ........ 34', chr(10), 'Sweets ........ 99', chr(10), text)
  WHEN 2 THEN concat('Chocolate, dark, 47, 89', chr(10), 'Cinnamon, 12, 14', chr(10), 'Cumin, 23', chr(10), 'Eggplant, 134, 156', chr(10), text)
  WHEN 3 THEN concat('Preface', chr(10), 'I have always loved chocolate. ', text)
  WHEN 4 THEN concat('Simmer for ', CAST(doc_id % 3 + 1 AS STRING), ' hours with 2 tbsp oil', chr(10), text)
  WHEN 5 THEN '   '
  WHEN 6 THEN concat('Whisk 2 cups milk', chr(10), 'a . . . b', chr(10), 'c .... d', chr(10), text)
  ELSE text END AS text, doc_id % {n_embeddings} AS vec_id FROM documents) r
  JOIN embeddings e ON e.vec_id = r.vec_id""",
    "query": """
SELECT q.query_id, q.text, e.embedding AS vector FROM (
  SELECT CAST(0 AS BIGINT) AS query_id, 'find me the thing about nicht' AS text
  UNION ALL SELECT 1, 'show erble recipes' UNION ALL SELECT 2, 'book_12' UNION ALL SELECT 3, 'what is the'
  UNION ALL SELECT 4, 'zzzqqq 42 author 3' UNION ALL SELECT 5, 'roast dish with garlic'
  UNION ALL SELECT 6, 'simmer oil and chocolate' UNION ALL SELECT 7, '   ' UNION ALL SELECT 8, 'the' UNION ALL SELECT 9, 'Author 3') q
  JOIN embeddings e ON e.vec_id = q.query_id * 17""",
    "annotation": """
SELECT event_id AS annotation_id, event_id % 200 AS book_id,
  CASE event_id % 9 WHEN 0 THEN 'highlight' WHEN 1 THEN 'underline' WHEN 2 THEN 'strikethrough' WHEN 3 THEN 'freeText' WHEN 4 THEN 'comment'
    WHEN 5 THEN 'line' WHEN 6 THEN 'arrow' WHEN 7 THEN 'circle' ELSE 'square' END AS tool,
  CASE user_id % 6 WHEN 0 THEN 'yellow' WHEN 1 THEN 'red' WHEN 2 THEN 'green' WHEN 3 THEN 'blue' WHEN 4 THEN 'purple' ELSE 'orange' END AS color,
  CASE WHEN event_id % 13 = 0 THEN '{}'
    WHEN event_id % 9 >= 5 OR event_id % 2 = 0 THEN concat('{"pdf":{"pageIndex":', CAST(event_id % 97 AS STRING),
      CASE WHEN event_id % 5 = 0 THEN '' ELSE concat(',"bounds":[10,', CAST(CAST(floor(value) AS BIGINT) AS STRING), ',120,14]') END, '}}')
    ELSE concat('{"reflowable":{"chapterIndex":', CAST(event_id % 31 AS STRING), ',"startXPath":"/p[1]","startOffset":', CAST(CAST(floor(value) AS BIGINT) AS STRING),
      ',"endXPath":"/p[1]","endOffset":900,"selectedText":"t"}}') END AS position,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('note ', CAST(user_id AS STRING)) END AS note, ts AS date_created FROM events""",
    "reading_log": """
SELECT event_id, user_id, event_id % 200 AS book_id, ts, CASE event_id % 6
  WHEN 0 THEN concat('{"type":"pdf","pageIndex":', CAST(event_id % 97 AS STRING), '}')
  WHEN 1 THEN concat('{"type":"epub","spineIndex":', CAST(event_id % 31 AS STRING), ',"scrollFraction":0.5}')
  WHEN 2 THEN '{"type":"fb2","scrollFraction":0.25}' WHEN 3 THEN '{"type":"web"}'
  WHEN 4 THEN '{"type":"pdf"}' ELSE '{"type":"mobi","scrollFraction":0.75}' END AS position FROM events""",
    "file_event": """
SELECT event_id, ts, concat('/library/src', CAST(event_id % 20 AS STRING), '/en/book_', CAST(event_id % 400 AS STRING), '.',
  CASE (event_id % 400) % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'epub' WHEN 2 THEN 'chm' WHEN 3 THEN 'mobi' WHEN 4 THEN 'AZW3' WHEN 5 THEN 'fb2' ELSE 'txt' END) AS path,
  event_type <> 'error' AS file_exists FROM events""",
    # a listing that overlaps the catalog: known, moved and foreign files
    "listing": """
SELECT CASE WHEN book_id % 3 = 0 THEN file_path WHEN book_id % 3 = 1 THEN concat('/picked/', language, '/', file_name)
  ELSE concat('/picked/', format, '/notes_', CAST(book_id AS STRING), CASE WHEN book_id % 2 = 0 THEN '.TXT' ELSE '.EPUB' END) END AS path,
  book_id AS arrival, file_size FROM book""",
    "folder_entry": """
SELECT DISTINCT concat('/picked/', lang) AS folder, lang = 'en' AS is_full FROM documents""",
    # folders and collections to scope a search to
    "scope": """
SELECT CAST(0 AS BIGINT) AS scope_id, 'all' AS kind, CAST(NULL AS INT) AS collection_id, CAST(NULL AS STRING) AS folder, false AS cookbook
UNION ALL SELECT 1, 'recent', NULL, NULL, false
UNION ALL SELECT 100 + n_nationkey, 'collection', n_nationkey, NULL, n_nationkey % 5 = 0 FROM nation
UNION ALL SELECT 200 + CAST(substr(source, 4) AS BIGINT), 'folder', NULL, concat('/library/', source, '/'), false FROM (SELECT DISTINCT source FROM documents) s
UNION ALL SELECT 900, 'folder', NULL, '/library/src', false UNION ALL SELECT 901, 'collection', 24, NULL, true""",
    # what each query searches: all books, a collection, a folder, what was opened, or nothing
    "query_scope": """
SELECT query_id, CASE query_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 100 + query_id WHEN 2 THEN 200 + query_id WHEN 3 THEN 1 ELSE 901 END AS scope_id FROM query""",
    # the book that is open while a query is asked
    "open_book": """
SELECT query_id, query_id * 13 + 2 AS book_id FROM query WHERE query_id <> 6""",
    # answers with up to three records each
    "response": """
SELECT o_orderkey AS response_id, concat(' I found recipes.', chr(10), 'From: nowhere', chr(10), chr(10),
  '  Recipe 1: Stew ', CAST(o_orderkey AS STRING), chr(10), 'From: COOKBOOK ', CAST((o_custkey + 2) % 5 AS STRING), chr(10),
  'A short note', chr(10), 'on two lines', chr(10), 'INGREDIENTS (visible):', chr(10),
  '- ', CAST(o_custkey % 90 AS STRING), ' g beans', chr(10), '2) salt', chr(10), '1234. kept', chr(10), '-', chr(10), '• oil', chr(10), chr(10),
  'Instructions:', chr(10), 'Mix. ', chr(10), chr(10), 'Bake.', chr(10), 'Notes: ', o_orderpriority, chr(10), 'more', chr(10),
  'Completeness: ', CASE WHEN o_orderstatus = 'O' THEN 'complete recipe' ELSE 'partial recipe' END, chr(10),
  'recipe  2 - Pie', CASE WHEN o_orderkey % 2 = 0 THEN ': Apple Pie' ELSE '' END, chr(10), 'Excerpt: [excerpt 2]', chr(10), 'Method', chr(10), 'Roll: and bake', chr(10),
  'Recipe 3: Cake', chr(10), 'Excerpt: [excerpt ', CAST(o_orderkey % 5 AS STRING), ']', chr(10), 'From: Cookbook ', CAST(o_orderkey % 7 AS STRING), chr(10),
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('Ingredients', chr(10), '* eggs', chr(10)) END, 'Notes', chr(10), 'Completeness') AS text
FROM orders""",
    "source": """
SELECT o.o_orderkey AS response_id, CAST(i AS INT) AS excerpt_index, o.o_custkey + i AS book_id,
  concat('Cookbook ', CAST((o.o_custkey + i) % 5 AS STRING)) AS book_title,
  CASE WHEN o.o_custkey % 4 = 0 THEN NULL ELSE concat('Author ', CAST(o.o_custkey % 11 AS STRING)) END AS author
FROM orders o {three}""",
    "person": """
SELECT c_custkey AS person_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE split_part(c_name, '#', 1) END AS first_name,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS middle_name,
  CASE WHEN c_custkey % 5 IN (0, 1) THEN NULL ELSE split_part(c_name, '#', 2) END AS last_name FROM customer""",
    "locale": """
SELECT o_orderkey AS file_id, 1024 + (o_orderkey * 7) % 4096 AS lcid FROM orders""",
    "download": """
SELECT o_orderkey AS model_id, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS expected_bytes,
  o_custkey * 50 AS downloaded_bytes, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'downloading' ELSE 'pending' END AS status FROM orders""",
    # four orders make a drop; items are single ids, lists, or noise
    "payload": """
SELECT o_orderkey {int_div} 4 AS drop_id, CAST(o_orderkey % 4 AS INT) AS item_index, CASE o_orderkey % 4
  WHEN 0 THEN concat('BOOKS:', concat('0000000A-0000-4000-8000-', lpad(CAST(o_custkey AS STRING), 12, '0')), ',also-not-an-id,',
    concat('0000000a-0000-4000-8000-', lpad(CAST(o_custkey % 50 AS STRING), 12, '0')), ',', concat('0000000a-0000-4000-8000-', lpad(CAST(o_custkey AS STRING), 12, '0')))
  WHEN 1 THEN concat('0000000a-0000-4000-8000-', lpad(CAST(o_custkey % 50 AS STRING), 12, '0'))
  WHEN 2 THEN 'BOOKS:' ELSE concat('order-', CAST(o_orderkey AS STRING)) END AS payload FROM orders""",
    "selection": """
SELECT o_orderkey {int_div} 4 AS drop_id, concat('0000000a-0000-4000-8000-', lpad(CAST(o_custkey % 3 AS STRING), 12, '0')) AS id FROM orders""",
    "manifest": """
SELECT page_id {int_div} 10 AS book_id, concat('item', CAST(page_id AS STRING)) AS item_id, concat('Text', url, '.xhtml') AS href, 'application/xhtml+xml' AS media_type FROM pages""",
    "itemref": """
SELECT page_id {int_div} 10 AS book_id, CAST(9 - page_id % 10 AS INT) AS seq,
  concat('item', CAST(CASE WHEN page_id % 7 = 3 THEN page_id + 1 ELSE page_id END AS STRING)) AS item_id FROM pages""",
    # nav links of the pages written as sitemap objects
    "sitemap_page": """
SELECT page_id AS doc_id, regexp_replace(html, '<li><a href="([^"]*)">([^<]*)</a></li>', '{sitemap}'{global}) AS html FROM pages""",
    # the same links as nested contents, some with other lists before or behind them
    "toc_page": """
SELECT page_id AS doc_id, concat(CASE WHEN page_id % 3 = 0 THEN '<nav type="landmarks"><ol><li><a href="#l">Landmark</a></li></ol></nav>' ELSE '' END,
  replace(replace(replace(html, '<nav><ul>', CASE WHEN page_id % 2 = 0 THEN '<nav epub:type="toc"><h2>Contents</h2><ol>' ELSE '<nav><OL class="c">' END),
    '</ul></nav>', '</ol><ol><li><a href="#o">other list</a></li></ol></nav>'),
    '</a></li><li>', concat('</a>', CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '<ol><li><a href="#s">Sub</a></li><li>bare<OL><li><a class="k" href="#d">Deep <b>er</b></a></li></OL></li></ol>'
      WHEN 2 THEN '<ol><li><a href="#e"> </a></li></ol>' ELSE '<ol></ol>' END, '</li><li>'))) AS html FROM pages""",
    "asked": """
SELECT query_id, text FROM query UNION ALL SELECT 1000 + item_id, text FROM benchmark""",
    "tab": """
SELECT event_id AS tab_id, (event_id * 13) % 1700 AS book_id FROM events""",
    "help_entry": """
SELECT page_id {int_div} 10 AS book_id, CAST(page_id % 10 AS INT) AS entry_index,
  concat('/docs/', CAST(page_id % 4 AS STRING), '/topic', CAST(page_id % 3 AS STRING), '.htm') AS name FROM pages""",
    "help_toc": """
SELECT page_id {int_div} 10 AS book_id, CAST(page_id % 10 AS INT) AS seq, CASE page_id % 5 WHEN 0 THEN 'topic0.htm' WHEN 1 THEN '1/topic1.htm'
  WHEN 2 THEN 'pic2.htm' WHEN 3 THEN 'docs/3/topic0.htm' ELSE 'missing.htm' END AS path FROM pages""",
    "help_default": """
SELECT DISTINCT page_id {int_div} 10 AS book_id, CASE WHEN (page_id {int_div} 10) % 3 = 0 THEN 'none.htm' ELSE concat('topic', CAST((page_id {int_div} 10) % 3 AS STRING), '.htm') END AS topic FROM pages""",
    "text_selection": """
SELECT event_id AS selection_id, event_id % 200 AS book_id, CAST(event_id % 97 AS INT) AS first_page, CAST(event_id % 97 + user_id % 4 - 1 AS INT) AS last_page FROM events""",
}


def _fill(text: str, dialect: str) -> str:
    for mark, sql in DIALECTS[dialect].items():
        text = text.replace("{" + mark + "}", sql)
    return text


def _uses(text: str, known: dict[str, str]) -> list[str]:
    """Names of other views read by a view's text."""
    read = set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text)) | set(re.findall(r",\s*(\w+) [a-z]\b", text))
    return [n for n in known if n in read]


def for_duckdb(sql: str, more: dict[str, str] | None = None) -> str:
    """``sql`` with every view it reads, directly or not, put in front.

    ``more`` are further views that only the checking SQL uses.
    """
    known = {**VIEWS, **(more or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _uses(text, known):
            if name not in needed:
                visit(known[name])
                needed.append(name)

    visit(sql)
    parts = ", ".join(f"{n} AS ({_fill(known[n], 'duckdb').strip()})" for n in needed)
    return f"WITH {parts} {sql.strip()}" if needed else sql.strip()


#: Views that are written once and read by all queries, and the columns that spread their rows.
KEPT = {
    "book": ["book_id"],
    "text_chunk": ["book_id", "chunk_index"],
    "chunk_vec": ["chunk_id"],
    "cook_chunk": ["chunk_id"],
}

#: Packed bytes of documents that one file of a kept table takes.
FILE_BYTES = 8 << 20

#: Folder of each kept table, by application, input files and name.
_KEPT_PATHS: dict[tuple, str] = {}


def input_state(spark: SparkSession, folder: str) -> tuple:
    """Paths, sizes and times of the input files; a changed input makes new tables."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = listed.select("path", "length", F.unix_micros("modificationTime").alias("at"))
    return tuple(sorted(map(tuple, rows.collect())))


class Library:
    """The views as DataFrames over one folder of Parquet tables.

    What most searches start from (catalog, chunks, keyword index) is written once to the shared
    folder and read from there, with the names and sizes of the input files as its key.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}
        self._steps: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = read_table(self.spark, f"{self.folder}/{name}.parquet")
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in RAW:
            return self.table(name)
        if name == "index":
            return self._index()
        if name not in VIEWS and name not in KEPT:
            raise AttributeError(name)
        if name in KEPT and name not in self._made:
            self._made[name] = self._kept(name)
        if name not in self._made:
            self._made[name] = self.view(name)
        return self._made[name]

    def view(self, name: str) -> DataFrame:
        """The view itself, for queries that read it once; kept tables are neither made nor read."""
        text = VIEWS[name]
        for raw in RAW:
            if re.search(rf"\b(?:FROM|JOIN)\s+{raw}\b", text):
                # names are the session's, so a library of another folder may have taken them
                self.table(raw).createOrReplaceTempView(raw)
        for other in _uses(text, VIEWS):
            getattr(self, other).createOrReplaceTempView(other)
        if "{n_embeddings}" in text:
            # counted from the file footers, so that the plan holds a plain number
            text = text.replace("{n_embeddings}", str(self.table("embeddings").count()))
        return self.spark.sql(_fill(text, "spark"))

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What ``make`` gives, made at the first call; several steps of a query start from it."""
        if name not in self._steps:
            self._steps[name] = make()
        return self._steps[name]

    def _key(self, name: str) -> tuple:
        if not hasattr(self, "state"):
            self.state = input_state(self.spark, self.folder)
        return (self.spark.sparkContext.applicationId, self.state, name)

    def _files(self) -> int:
        """Files of a kept table: two for each core, more for large inputs."""
        self._key("")
        size = sum(length for path, length, _ in self.state if "/documents.parquet" in path)
        return max(2 * self.spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES))

    def _new_path(self, name: str) -> str:
        return f"{checkpoint_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def _kept(self, name: str) -> DataFrame:
        key = self._key(name)
        if key not in _KEPT_PATHS:
            if name == "text_chunk":
                docs = self.documents.select(F.col("doc_id").alias("book_id"), "text")
                df = chunk_chars(docs, "book_id")
            else:
                df = self.view(name)
            path = self._new_path(name)
            # a fixed number of files: adaptive planning would join them up by their packed size, and
            # a table of one file is searched by one task, however many cores wait
            df.repartition(self._files(), *KEPT[name]).write.parquet(path)
            _KEPT_PATHS[key] = path
        return read_table(self.spark, _KEPT_PATHS[key])

    def _index(self) -> KeywordIndex:
        """The keyword index of the documents' chunks."""
        key = self._key("index")
        if key not in _KEPT_PATHS:
            path = self._new_path("keyword-index")
            build_index(self.spark, path, self.text_chunk)
            _KEPT_PATHS[key] = path
        return open_index(self.spark, _KEPT_PATHS[key])
