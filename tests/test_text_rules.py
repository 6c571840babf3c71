"""Chunking, scoring, records and other text rules on small literal inputs."""

import pytest
from pyspark.sql import functions as F

from foliant import constants as K
from foliant.functions import positions, scoring, text
from foliant.functions.porter import stem
from foliant.operators import annotations, chunking, collections, documents, records
from tests.conftest import rows

RECIPE = """Tomato Tart
Serves 6. Prep time: 20 minutes. Cook time: 40 minutes.
Ingredients:
- 2 cups flour
- 1/2 tsp salt
- 3 cloves garlic
Instructions:
Preheat oven to 200 degrees C. Whisk the eggs, fold in the flour and bake for 40 minutes."""
PROSE = "Bread has a long history. It was eaten in Egypt and in Rome long before ovens were common."
CONTENTS = "Table of Contents\nSoups ........ 12\nFish ........ 34\nSweets ....... 99"
INDEX = "Apple, green, 47, 89\nBasil, 12, 14\nCumin, 23, 45\nDill, 134, 156\nEndive, 9"
PREFACE = "Preface\nI have always loved apples. This book is about them."


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column).first()[0]


def test_pattern_score_and_page_type(spark):
    t = F.col("t")
    assert one(spark, RECIPE, scoring.pattern_score(t)) >= 0.4
    assert one(spark, PROSE, scoring.pattern_score(t)) < 0.3
    assert one(spark, PREFACE, scoring.pattern_score(t)) < K.QUALITY_GATE
    kinds = {
        RECIPE: "content", PROSE: "content", CONTENTS: "front_matter", INDEX: "index",
        PREFACE: "front_matter", " \n\t": "blank",
        "a .... 1\nb . . . 2\nc .... 3": "contents", "12 34 56 see also 7 8 9": "numbers",
    }
    for value, kind in kinds.items():
        assert one(spark, value, scoring.page_type(t)) == kind, value
    assert one(spark, RECIPE, scoring.guess_title(t)) == "Tomato Tart"
    assert one(spark, "a: b c\nword\nlong: one", scoring.guess_title(t)) is None


def test_char_chunks_cut_after_last_space(spark):
    def plain(value, size):
        out, at = [], 0
        while at < len(value):
            end = min(at + size, len(value))
            cut = end
            if end < len(value) and " " in value[at:end]:
                cut = at + value[at:end].rindex(" ") + 1
            piece = value[at:cut].strip(" \t\n\r\f")
            if piece:
                out.append(piece)
            at = cut
        return out

    for value in ["", "abc", "aa bb cc dd ee", "x" * 25, "a \n  b" * 9, "äö ü" * 11, "no\nspace\nhere\nat all"]:
        for size in (1, 4, 7, 10, 100):
            got = one(spark, value, chunking.char_chunks(F.col("t"), size))
            assert got == plain(value, size), (value, size)


def test_word_chunks_prefer_late_sentence_end(spark):
    got = one(spark, "a b c. d e f g h. i j", chunking.word_chunks(F.col("t"), 4))
    assert got == ["a b c.", "d e f g", "h. i j"]
    assert one(spark, "a. b c d e f g h", chunking.word_chunks(F.col("t"), 4)) == ["a. b c d", "e f g h"]
    assert one(spark, "   ", chunking.word_chunks(F.col("t"), 4)) == []
    long = " ".join(f"w{i}." for i in range(1000))
    chunks = one(spark, long, chunking.word_chunks(F.col("t")))
    assert " ".join(chunks) == long
    assert max(len(c.split(" ")) for c in chunks) <= K.EMBED_CHUNK_WORDS


def test_chunk_windows_clamp_at_the_ends(spark):
    chunks = spark.createDataFrame([(1, i, f"c{i}") for i in range(7)], "book_id long, chunk_index int, text string")
    want = {(3, 1): "c2 c3 c4", (0, 2): "c0 c1 c2", (6, 2): "c4 c5 c6", (3, 5): "c0 c1 c2 c3 c4 c5 c6"}
    for (index, radius), expected in want.items():
        hits = spark.createDataFrame([(9, 1, index)], "hit_id long, book_id long, chunk_index int")
        got = chunking.chunk_windows(hits, chunks, radius).first()["text"]
        assert got.split("\n\n") == expected.split(" ")


def test_html_rules(spark):
    t = F.col("t")
    html = '<style>p{}</style><p>a&nbsp;b &amp; c&lt;d &#233;&#x;</p>\n<script>x</script> e'
    assert one(spark, html, text.html_to_text(t)) == "a b & c<d é&#x; e"
    assert one(spark, "<Body class=x>in</body> out</BODY>", text.body_content(t)) == "in</body> out"
    assert one(spark, "<body>in</body> out</body>", text.body_content(t, False)) == "in"
    assert one(spark, "plain", text.body_content(t)) == "plain"
    links = '<img src="../i/./a.png"><a href="#x">y</a><a HREF=\'http://h/z\'>z</a><a href="b.html">'
    assert one(spark, links, text.rewrite_links(t, F.lit("Text/"))) == (
        '<img src="i/a.png"><a href="#x">y</a><a HREF=\'http://h/z\'>z</a><a href="Text/b.html">'
    )
    assert one(spark, 'a<b>&"', text.escape_html(t)) == "a&lt;b&gt;&amp;&quot;"


@pytest.mark.parametrize(
    ("path", "fmt"),
    [("/a/b.EPUB", "epub"), ("/a/b.pdf", "pdf"), ("/a.pdf/b", None), ("/a/b.txt", None), ("/a/b.azw3", "azw3")],
)
def test_file_format(spark, path, fmt):
    assert one(spark, path, text.file_format(F.col("t"))) == fmt


def test_truncate_to_budget(spark):
    value = "w " * 600
    got = one(spark, value, text.fit_to_budget(F.col("t"), 480))
    assert got == value[:900]
    assert one(spark, "a " * 40, text.fit_to_budget(F.col("t"), 1)) == ("a " * 40)[:50]


def test_stemmer():
    want = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre",
        "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi",
        "relational": "relat", "rational": "ration", "hopefulness": "hope", "electrical": "electr",
        "adjustment": "adjust", "adoption": "adopt", "controll": "control", "rate": "rate", "sky": "sky",
    }
    assert {w: stem(w) for w in want} == want


def test_parse_blocks(spark):
    answer = """I found 2 recipes.

Recipe 1: Roast Loin
From: Game Book
Excerpt: [excerpt 1]
Ingredients (visible in excerpt):
- 1.5 kg loin
2) salt
Instructions (visible in excerpt):
Heat the oven.

Roast for 25 minutes.
Notes: Serve warm.
Completeness: complete recipe

Recipe 2: Stew
From: GAME BOOK
Ingredients:
• 1 kg shoulder
Instructions:
Brown: and braise.

Recipe 3: Mystery
From: Another Book
Excerpt: [excerpt 99]
Ingredients:
- 1 thing
"""
    answers = spark.createDataFrame(
        [(1, answer), (2, "I found a recipe but did not format it.")], "response_id long, text string"
    )
    sources = spark.createDataFrame(
        [(1, 1, 7, "Game Book", "M. Hank"), (1, 2, 8, "Other", None)],
        "response_id long, excerpt_index int, book_id long, book_title string, author string",
    )
    got = {r["title"]: r for r in records.parse_blocks(answers, sources).collect()}
    assert set(got) == {"Roast Loin", "Stew"}
    loin = got["Roast Loin"]
    assert loin["ingredients"] == "1.5 kg loin\nsalt"
    assert loin["instructions"] == "Heat the oven.\n\nRoast for 25 minutes."
    assert (loin["notes"], loin["completeness"], loin["author"]) == ("Serve warm.", "complete recipe", "M. Hank")
    assert (got["Stew"]["book_id"], got["Stew"]["instructions"]) == (7, "Brown: and braise.")


def test_id_payloads(spark):
    a, b, c = (f"0000000{x}-0000-4000-8000-000000000000" for x in "abc")
    data = [(1, 0, f"BOOKS:{a},junk,{b}"), (1, 1, a.upper()), (1, 2, "BOOKS:"), (1, 3, "junk"), (1, 4, c)]
    drops = spark.createDataFrame(data, "drop_id long, item_index int, payload string")
    found = collections.first_ids_of_payloads(drops)
    assert rows(found, "id", "item_index", "token_index") == [(a, 0, 0), (b, 0, 2), (c, 4, 0)]
    ids = spark.createDataFrame([(1, x) for x in (c, a, b)] + [(2, a)], "drop_id long, id string")
    assert rows(collections.encode_payloads(ids), "drop_id", "payload") == [(1, f"BOOKS:{a},{b},{c}"), (2, a)]
    many = spark.createDataFrame(
        [(1, f"{i:08x}-0000-4000-8000-000000000000") for i in range(1500)], "drop_id long, id string"
    )
    one_list = collections.encode_payloads(many)
    assert one_list.count() == 1
    back = collections.first_ids_of_payloads(one_list.withColumn("item_index", F.lit(0)))
    assert rows(back, "drop_id", "id") == rows(many, "drop_id", "id")


def test_positions(spark):
    t = F.col("t")
    pdf = '{"pdf":{"pageIndex":4,"bounds":[10,250,5,5]}}'
    flow = '{"reflowable":{"chapterIndex":2,"startXPath":"","startOffset":30,"endXPath":"","endOffset":40,"selectedText":""}}'
    assert one(spark, pdf, positions.annotation_sort_key(t)) == 4.75
    assert one(spark, '{"pdf":{"pageIndex":4}}', positions.annotation_sort_key(t)) == 4.0
    assert one(spark, flow, positions.annotation_sort_key(t)) == 2000030.0
    assert one(spark, "broken", positions.annotation_sort_key(t)) == 0.0
    assert one(spark, flow, positions.position_label(t)) == "Chapter 3"
    spans = spark.createDataFrame([(1, 2, 3, 5), (2, 2, 3, 2)], "selection_id long, book_id long, first_page int, last_page int")
    assert rows(annotations.split_by_page(spans), "selection_id", "page_index") == [(1, 3), (1, 4), (1, 5)]


def test_toc_tree_and_find(spark):
    flat = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 2), (1, 4, 1)], "doc_id long, seq int, level int")
    assert rows(documents.toc_tree(flat), "seq", "parent_seq") == [(0, None), (1, 0), (2, 1), (3, 0), (4, None)]
    chapters = spark.createDataFrame(
        [(1, 0, "Aa xaA"), (1, 1, "none"), (1, 2, "aaaa")], "book_id long, chapter_index int, text string"
    )
    got = documents.find_in_book(chapters, "AA", context=1)
    assert rows(got, "match_index", "label", "context") == [
        (0, "Ch. 1, match 1", "...Aa ..."), (1, "Ch. 1, match 2", "...xaA..."),
        (2, "Ch. 3, match 1", "...aaa..."), (3, "Ch. 3, match 2", "...aaa..."),
    ]


def test_help_books_without_contents(spark):
    files = [(1, 0, "/b.htm"), (1, 1, "/a.html"), (1, 2, "/#x.htm"), (2, 0, "/z.htm"), (2, 1, "/y.htm"), (3, 0, "/c.htm")]
    entries = spark.createDataFrame(files, "book_id long, entry_index int, name string")
    toc = spark.createDataFrame([(2, 0, "none.htm"), (3, 5, "c.htm")], "book_id long, seq int, path string")
    defaults = spark.createDataFrame([(1, "b.htm")], "book_id long, topic string")
    got = [tuple(r) for r in documents.toc_order(entries, toc, defaults).collect()]
    assert got == [(1, True, 1, "/b.htm"), (1, False, 0, "/a.html"), (2, False, 0, "/z.htm"), (2, False, 1, "/y.htm"), (3, False, 5, "/c.htm")]
