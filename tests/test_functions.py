"""Scalar functions on written cases."""

import html
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.functions import dates as D
from loomtext.functions import text as T
from loomtext.functions import urls as U
from loomtext.operators.chunks import split_at_punctuation


def results(spark, values, of, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", of("x").alias("y")).orderBy("i").collect()]


def check(spark, cases, of, kind="string"):
    assert dict(zip(cases, results(spark, list(cases), of, kind))) == cases


def test_words_split_as_python_does(spark):
    pick = random.Random(2)
    blanks = ["\t", "\x0b", "\x1c", "\x1f", " ", "\x85", "\xa0", " ", " ", " ", " ", " ", "　", "​", "᠎", "a", "é", "中"]
    texts = ["".join(pick.choice(blanks) for _ in range(12)) for _ in range(200)]
    assert results(spark, texts, T.word_count) == [len(t.split()) for t in texts]
    assert results(spark, texts, T.strip) == [t.strip() for t in texts]


def test_urls(spark):
    check(spark, {"https://a.b/x.pdf": "pdf", "https://a.b/x.pdf?y=1": "article", "https://www.youtube.com/@x": "youtube", "https://netflix.com/a/status/1": "twitter", "https://a/feed": "article", "https://a/feed?podcast": "podcast", "": "article"}, U.classify_url)
    check(spark, {"/a/b.PDF": "pdf", "x.md": "local_file", "x": None, "a.b/c": None, "x.exe": None}, U.classify_path)
    check(spark, {'"a b"': "a b", "r'c'": "c", "'d\"": "'d\"", "e": "e", ' r"f" ': "f"}, U.strip_quotes)
    check(spark, {"https://mobile.twitter.com/a/status/5?s=20&t=x": "https://x.com/a/status/5", "https://nitter.net/a/status/5": "https://x.com/a/status/5", "https://x.com/a?t=1&a=2": "https://x.com/a&a=2"}, U.canonical_post_url)
    check(spark, {"https://arxiv.org/html/2301.01234v3": "2301.01234v3", "arxiv.org/abs/math/0309136": None}, U.paper_id)
    check(spark, {"https://arxiv.org/abs/2301.01234": "https://arxiv.org/pdf/2301.01234", "other": "other"}, U.paper_pdf_url)


def test_strings(spark):
    check(spark, {"Héllo, Wörld_x  y": "héllo-wörld-x-y", "--": "untitled", "ﬁne": "fine", "a" * 79 + "- b": "a" * 79}, T.slugify)
    check(spark, {"short\none": "short one", "word " * 30: ("word " * 30)[:80].rsplit(" ", 1)[0] + "...", "x" * 90: "x" * 80 + "..."}, T.make_title)
    check(spark, {'a"b\\': 'a\\"b\\\\'}, T.escape_yaml)
    check(spark, {"pt-BR": "pt", "EN": "en", "chinese": None}, T.normalise_language)
    check(spark, {"": 1, "abcd" * 3: 3}, T.estimate_tokens)
    check(spark, {"https://a.b/c": True, " https://a https://b ": True, "see https://a": False, "": True}, T.is_link_only)
    check(spark, {"a\n\n\n\nb ![x](y) co-\nde": "a\n\nb  code"}, T.clean_body)
    check(spark, {"&lt;i&gt; &eacute;&#39;&amp;amp;": html.unescape("&lt;i&gt; &eacute;&#39;&amp;amp;")}, T.unescape_html)


def test_tables(spark):
    got = spark.range(1).select(T.table_markdown(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"), F.lit("2")))).alias("t")).first()["t"]
    assert got == "a | b\n--- | ---\n1 | 2"


def test_dates(spark):
    check(spark, {"2024-05-06": "2024-05-06", "2024-05-06T01:02:03": "2024-05-06", "2024/5/6": "2024-05-06", "6 May 2024": "2024-05-06", "May 6, 2024": "2024-05-06", "2024-13-99 or so": "2024-13-99", "x": "unknown"}, D.normalise_date)
    check(spark, {"20240506": "2024-05-06", "abcdefgh": "abcd-ef-gh", "": "unknown", "2024": "2024"}, D.upload_date)
    check(spark, {"D:20240506101112+00'00'": "2024-05-06", "20240506": "2024-05-06", "May": "unknown"}, D.pdf_date)
    check(spark, {"1:02:03": 3723, "62:03": 3723, "59.9": 59, "x": 0, "1:x": 0}, D.feed_duration)
    check(spark, {0: "0:00", 59: "0:59", 3599: "59:59", 3661: "1:01:01"}, D.format_duration, "int")
    check(spark, {"Mon, 06 May 2024 07:08:09 +0200": "2024-05-06", "6 May 2024 07:08:09 GMT": "2024-05-06", "Mon, 06 May 2024 23:30:00 -0100": "2024-05-07", "Mon, 06 May 2024 00:30 +0530": "2024-05-05", "06 May 2024 22:00:00 EST": "2024-05-07", "6 May 2024": "2024-05-06", "soon": "unknown"}, D.feed_date)
    check(spark, {"2024-05-06T07:08:09.000Z": "2024-05-06", "May 6, 2024 · 7:08 PM UTC": "2024-05-06", "December 6, 2024": "2024-12-06", "?": "unknown"}, D.post_date)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .。,，\n", max_size=300), st.integers(5, 60))
def test_chunks_put_together_give_the_text(text, size):
    wide = split_at_punctuation(text, size, 7)
    pieces = split_at_punctuation(text, size, 0)
    assert [p["chunk"][p["overlap"] :] for p in wide] == [p["chunk"] for p in pieces]
    assert "".join(p["chunk"] for p in pieces) == text
    assert all(len(p["chunk"]) <= size + 1 for p in pieces)


def test_chunks_cut_at_sentences():
    assert [p["chunk"] for p in split_at_punctuation("One two. Three four five", 12, 0)] == ["One two.", " Three four ", "five"]


