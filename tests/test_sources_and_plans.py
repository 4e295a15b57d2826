"""Readers on small written files, renderers byte by byte, pipelines end to end, connectors with recorded answers."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from loomtext import sql
from loomtext.plans import config, pipelines, render, sinks
from loomtext.sources import connectors, files, office, structured, subtitles, web
from loomtext.streaming import ingest

VTT = """WEBVTT
Kind: captions

NOTE a remark

00:00:01.000 --> 00:00:02.500 align:start
<c>Hello</c><00:00:01.500> there &amp; you

2
00:01:00.000 --> 00:01:01.000

01:02.000 --> 01:03.000
no hours

00:02:00.000 --> 00:02:01.000
Second
line"""
SRT = "1\n00:00:01,500 --> 00:00:02,000\n<i>One</i>\n\n2\n00:00:03,000 --> 00:00:04,000\nTwo\r\n"


def test_subtitles(spark):
    df = spark.createDataFrame([("v", "a.vtt", VTT), ("s", "b.SRT", SRT)], "doc_id string, path string, text string")
    got = [(r["doc_id"], r["start_seconds"], r["end_seconds"], r["text"]) for r in subtitles.parse_subtitles(df).orderBy("doc_id", "seq").collect()]
    assert got == [("s", 1.5, 2.0, "One"), ("s", 3.0, 4.0, "Two"), ("v", 1.0, 2.5, "Hello there & you"), ("v", 120.0, 121.0, "Second\nline")]


PAGE = """<html lang="en"><head><title>The &amp; Title</title><meta name="author" content="A. B."><meta property="article:published_time" content="2024-05-06T07:08:09"><script>var t="</p>";</script></head>
<body><nav><p>menu</p></nav><div class="ad">buy</div><article><h1>Head</h1><p>One two<br>three</p><img src="a.png" alt="x"><p><b>four<br><p>five &copy;</p><h2>Empty</h2><h3>Last</h3><p>""" + "word " * 30 + """</p><img src="data:x"><img src="s.svg"><img src="t.png" width="10"></article><footer><p>foot</p></footer></body></html>"""


def test_pages(spark):
    found = web.read_page(PAGE)
    assert (found["title"], found["author"], found["language"]) == ("The & Title", "A. B.", "en")
    assert [(s["heading"], s["level"]) for s in found["sections"]] == [("Head", 1), ("Last", 3)]
    assert found["sections"][0]["body"] == "One two three\n\nfour\n\nfive ©"
    df = spark.createDataFrame([(1, "http://a", PAGE), (2, "http://b", None), (3, "http://c", "<p>short")], "doc_id int, url string, html string")
    rows = {r["doc_id"]: r for r in pipelines.pages(df).collect()}
    assert rows[1]["error_type"] is None and rows[1]["publish_date"] == "2024-05-06"
    assert rows[1]["markdown"].startswith('---\ntitle: "The & Title"\nurl: "http://a"\nauthor: "A. B."\ndate: "2024-05-06"\nlanguage: "en"\nword_count: 38\ncontent_type: "article"\npolished: false\n---\n\n# The & Title\n\n> Author: A. B. | Date: 2024-05-06 | 38 words\n\n# Head\n\nOne two three')
    plan = pipelines.pages(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
    assert rows[2]["error_type"] == rows[3]["error_type"] == "ContentExtractionError" and rows[3]["title"] == "Untitled"
    assert [r["src"] for r in web.images_of(web.articles(df)).collect()] == ["a.png"]


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr><w:tr><w:tc>" + p("1") + "</w:tc><w:tc>" + p("2") + "</w:tc></w:tr></w:tbl>"
    return zipped({"word/document.xml": f"<w:document {w}><w:body>{p('intro')}{table}{p('Top', 'Heading1')}{p('x')}{p('y')}</w:body></w:document>", "docProps/core.xml": '<c xmlns:d="d"><d:title>T</d:title><d:creator>Me</d:creator><d:created>2024-05-06T00:00:00Z</d:created></c>'})


def pptx():
    n = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    shape = lambda text, kind="", lvl=0: f"<p:sp><p:nvSpPr><p:nvPr>{f'<p:ph type={chr(34)}{kind}{chr(34)}/>' if kind else ''}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:pPr lvl=\"{lvl}\"/><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>"
    return zipped({"ppt/slides/slide1.xml": f"<p:sld {n}>{shape('Start', 'title')}{shape('point')}{shape('deeper', '', 1)}</p:sld>", "ppt/slides/slide2.xml": f"<p:sld {n}></p:sld>", "ppt/slides/slide10.xml": f"<p:sld {n}>{shape('alone')}</p:sld>", "ppt/notesSlides/notesSlide1.xml": f"<p:n {n}><a:p><a:r><a:t>say</a:t></a:r></a:p><a:p><a:r><a:t>this</a:t></a:r></a:p></p:n>"})


MHTML = b"Subject: Sub ject\r\nMIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=B\r\n\r\n--B\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n<h1>H</h1><p>caf=C3=A9</p>\r\n--B--\r\n"
EPUB = {"META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<package><metadata><title>Book</title></metadata><manifest><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>', "o/a.xhtml": "<h1>Ch</h1><p>text</p>"}


def test_office_files(spark):
    rows = [("a.docx", docx()), ("b.pptx", pptx()), ("c.mhtml", MHTML), ("d.epub", zipped(EPUB)), ("e.csv", b"a,b\n1,2\n"), ("f.json", b'{"k": 1}'), ("g.zip", zipped({"x.csv": "q,r\n3,4"})), ("h.ppt", b"old"), ("i.docx", b"broken"), ("j.docx", None), ("k.xyz", b"")]
    df = spark.createDataFrame([(p, p, None if b is None else bytearray(b)) for p, b in rows], "doc_id string, path string, content binary")
    got = {r["doc_id"]: r for r in office.read_files(df).collect()}
    flat = {k: [(s["heading"], s["level"], s["body"]) for s in r["sections"]] for k, r in got.items()}
    assert flat["a.docx"] == [("", 2, "intro"), ("Top", 1, "x\n\ny"), ("", 2, "a | b\n--- | ---\n1 | 2")] and got["a.docx"]["title"] == "T"
    assert flat["b.pptx"] == [("Start", 2, "- point\n  - deeper\n> **Speaker Notes:** say\n> this"), ("Slide 3", 2, "- alone")]
    assert flat["c.mhtml"] == [("H", 1, "café")] and got["c.mhtml"]["title"] == "Sub ject"
    assert flat["d.epub"] == [("Ch", 1, "text")] and got["d.epub"]["title"] == "Book"
    assert flat["e.csv"] == [("", 2, "a | b\n--- | ---\n1 | 2")] and flat["g.zip"] == [("x.csv", 2, "q | r\n--- | ---\n3 | 4")]
    assert {k for k, r in got.items() if r["error_type"]} == {"h.ppt", "i.docx", "j.docx", "k.xyz"}


def test_local_files(spark, tmp_path):
    (tmp_path / "a.md").write_text('---\ntitle: "T"\nn: 1\nn: 2\n---\n# H\r\nbody\n')
    (tmp_path / "b.txt").write_text("PART ONE\ntext")
    (tmp_path / "c.html").write_text("<h2>Q</h2><p>r</p>")
    scanned = files.scan(spark, str(tmp_path))
    got = {(r["doc_id"].rpartition("/")[2], r["heading"], r["body"]) for r in files.local_sections(scanned).collect()}
    assert got == {("a.md", "H", "body"), ("b.txt", "PART ONE", "text"), ("c.html", "Q", "r")}
    (tmp_path / "d.md").write_bytes(b"---\ntitle: 'It' # so\nlang: fr\ndate: 2024-01-02\n---\nbad \xff byte")
    (tmp_path / "e f.ppt").write_bytes(b"old")
    docs = {r["doc_id"].rpartition("/")[2]: r for r in files.local_documents(files.scan(spark, str(tmp_path))).collect()}
    d = docs["d.md"]
    assert (d["title"], d["language"], d["publish_date"], d["sections"][0]["body"], d["word_count"], d["error_type"]) == ("It", "fr", "2024-01-02", "bad \ufffd byte", 3, None)
    assert docs["a.md"]["title"] == "T" and docs["b.txt"]["title"] == "PART ONE" and len(docs["b.txt"]["publish_date"]) == 10
    assert docs["e%20f.ppt"]["error_type"] == "LocalFileError" if "e%20f.ppt" in docs else docs["e f.ppt"]["error_type"] == "LocalFileError"
    made = {r["doc_id"].rpartition("/")[2]: r for r in pipelines.local_files(files.scan(spark, str(tmp_path))).collect()}
    assert 'content_type: "local_file"' in made["c.html"]["markdown"] and made["c.html"]["markdown"].endswith("## Q\n\nr\n")
    uris = spark.createDataFrame([("/a b/ü~*.md",)], "path string").select(files.file_uri().alias("u")).first()["u"]
    import pathlib

    assert uris == pathlib.PurePosixPath("/a b/ü~*.md").as_uri()
    meta = files.front_matter(spark.createDataFrame([("x", (tmp_path / "a.md").read_text())], "doc_id string, text string")).first()["meta"]
    assert meta == {"title": "T", "n": "2"}
    assert files.listing(spark, str(tmp_path)).count() == 5


RSS = """<rss><channel><title>Show</title><language>en</language>
<item><title>One</title><enclosure url="http://a/1.mp3" type="audio/mpeg"/><itunes:duration>1:02</itunes:duration><itunes:episode>7</itunes:episode><pubDate>Mon, 06 May 2024 07:08:09 GMT</pubDate></item>
<item><title>Two</title><enclosure url="http://a/2.pdf" type="application/pdf"/></item>
<item><title>Three</title><enclosure url="http://a/3.ogg" type=""/></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/1</id><title>A
  title</title><author><name>X</name></author><author><name>Y</name></author><summary> s  t </summary><published>2024-05-06T00:00:00Z</published><category term="cs.CL"/><arxiv:doi>10.1/x</arxiv:doi></entry></feed>"""


def test_structured(spark):
    feeds = spark.createDataFrame([("f", RSS)], "doc_id string, xml string")
    got = structured.feed_episodes(feeds, 10).orderBy("pos").collect()
    assert [(r["title"], r["audio_url"], r["duration"], r["episode_number"], r["publish_date"]) for r in got] == [("One", "http://a/1.mp3", 62, "7", "2024-05-06"), ("Three", "http://a/3.ogg", 0, None, "unknown")]
    assert structured.feed_episodes(feeds, 2).count() == 1  # the limit comes before the filter
    p = structured.papers(spark.createDataFrame([("p", ATOM), ("e", "<feed><entry><id>http://x/api/errors#1</id></entry></feed>")], "doc_id string, xml string"))
    rows = {r["doc_id"]: r for r in p.collect()}
    assert (rows["p"]["title"], rows["p"]["authors"], rows["p"]["abstract"], rows["p"]["doi"], rows["p"]["categories"]) == ("A title", ["X", "Y"], "s t", "10.1/x", ["cs.CL"])
    assert rows["e"]["error_type"] == "ArxivAPIError" and rows["p"]["error_type"] is None
    meta = spark.createDataFrame([("v", json.dumps({"id": "1", "title": None, "uploader": "U", "upload_date": "20240506", "subtitles": {"de": [], "en": []}, "automatic_captions": {"fr": []}}))], "doc_id string, json string")
    v = structured.video_info(meta).first()
    assert (v["title"], v["channel"], v["publish_date"], v["description"], v["chapters"]) == (None, "U", "2024-05-06", "", [])
    assert [(r["is_auto"], r["lang"]) for r in structured.tracks_of(meta).orderBy("is_auto", "pos").collect()] == [(False, "de"), (False, "en"), (True, "fr")]
    blocks = [("d", i, t, x) for i, (t, x) in enumerate([("header-one", "T"), ("ordered-list-item", "a"), ("image", "<img>"), ("ordered-list-item", "b"), ("unstyled", "p"), ("ordered-list-item", "c"), ("unordered-list-item", "u"), ("unstyled", " ")])]
    s = structured.block_sections(spark.createDataFrame(blocks, "doc_id string, pos int, type string, text string")).first()
    assert (s["heading"], s["level"], s["body"]) == ("T", 1, "1. a\n\n<img>\n\n2. b\n\np\n\n1. c\n\n• u")
    lines = spark.createDataFrame([("#HttpOnly_.x.com\tTRUE\t/\tTRUE\t0\ta\tb",), ("# c",), (".y.com\tTRUE\t/\tTRUE\t0\tq\tr",)], "value string")
    assert [(r["name"], r["secure"], r["http_only"]) for r in structured.cookies(lines).collect()] == [("a", True, True)]


def test_posts(spark):
    one = {"__typename": "Tweet", "user": {"screen_name": "h", "name": "H"}, "created_at": "2024-05-06T07:08:09.000Z", "text": "short", "note_tweet": {"note_tweet_results": {"result": {"text": "a longer note"}}}, "mediaDetails": [{"type": "photo", "media_url_https": "u"}, {"type": "video", "media_url_https": "v"}]}
    art = {"__typename": "Tweet", "user": {"screen_name": "h", "name": "H"}, "text": "see https://t.co/x", "article": {"title": "Art", "preview_text": "pre view", "rest_id": "9"}}
    link = {"user": {"screen_name": "h"}, "text": " https://t.co/x https://a.b/c "}
    rows = [("a", "https://twitter.com/h/status/1?s=2", json.dumps(one)), ("b", "https://x.com/h/status/2", json.dumps({"__typename": "TweetTombstone", "tombstone": {"text": {"text": "gone"}}})), ("c", "https://x.com/h/status/3", json.dumps(art)), ("d", "https://x.com/h/status/4", json.dumps(link)), ("e", "https://x.com/h/status/5", "{}"), ("f", "https://x.com/h/status/6", "no json")]
    schema = "doc_id string, url string, json string"
    answers = spark.createDataFrame(rows, schema)
    items = spark.createDataFrame([(k, u) for k, u, _ in rows], "doc_id string, url string")
    sections = "array<struct<seq:bigint,heading:string,level:int,body:string>>"
    linked = spark.createDataFrame([("d", "Linked page", [(0, "", 2, "from the page")])], f"doc_id string, title string, sections {sections}")
    got = {r["doc_id"]: r for r in pipelines.social(items, answers, linked=linked).collect()}
    assert (got["a"]["tweet_subtype"], got["a"]["body"], got["a"]["url"]) == ("note_tweet", "a longer note", "https://x.com/h/status/1")
    assert got["b"]["error_type"] == "TweetFetchError" and got["b"]["error_message"] == "Tweet deleted or unavailable: gone"
    assert (got["c"]["title"], got["c"]["tweet_subtype"], got["c"]["word_count"]) == ("Art", "x_article", 2) and [s["heading"] for s in got["c"]["sections"]] == ["Art", "Note"]
    assert (got["d"]["title"], got["d"]["body"], got["d"]["author_name"], got["d"]["tweet_subtype"]) == ("Linked page", "from the page", "h", "tweet")
    assert got["f"]["error_message"].startswith("All tweet fetch methods failed for https://x.com/h/status/6:\n  - Syndication: ") and "Nitter: no answer" in got["e"]["error_message"]
    assert got["a"]["markdown"] == '---\ntitle: "a longer note"\nurl: "https://x.com/h/status/1"\nauthor: "@h"\nauthor_name: "H"\ndate: "2024-05-06"\nword_count: 3\nis_thread: false\nthread_length: 1\ntweet_subtype: "note_tweet"\ncontent_type: "tweet"\npolished: false\n---\n\n# a longer note\n\n> Author: @h (H) | Date: 2024-05-06 | 3 words\n\na longer note\n'
    full = spark.createDataFrame([("c", None, None, [(0, "Head", 1, "whole text here")])], f"doc_id string, title string, note string, sections {sections}")
    whole = {r["doc_id"]: r for r in structured.posts(answers, full, cookies=True).collect()}["c"]
    assert (whole["title"], whole["word_count"], [s["heading"] for s in whole["sections"]]) == ("Art", 3, ["Head"])
    marked, images = structured.with_photo_markers(structured.posts(answers))
    mark = images.first()["position_marker"]
    assert images.count() == 1 and {r["doc_id"]: r for r in marked.collect()}["a"]["sections"][0]["body"] == f"a longer note\n\n{mark}"
    shown = pipelines.preview_posts(pipelines.social(items, answers)).where("doc_id = 'a'").first()
    assert (shown["author"], shown["preview"]) == ("@h", "a longer note")


EMBED = '<blockquote><p lang="en">hi &amp; <a href="x">bye</a><br>x</p>&mdash; Q <a href="u">May 6, 2024</a></blockquote>'


def test_cascade(spark):
    embedded = spark.createDataFrame([("e", "https://x.com/q/status/1", json.dumps({"author_name": "Q", "author_url": "https://twitter.com/q", "html": EMBED}))], "doc_id string, url string, json string")
    e = structured.embedded_posts(embedded).first()
    assert (e["author"], e["sections"][0]["body"], e["publish_date"], e["title"]) == ("@q", "hi &\nbye\nx", "2024-05-06", "hi & bye x")
    items = spark.createDataFrame([("e", "https://x.com/q/status/1"), ("t", "https://x.com/q/status/2"), ("x", "https://x.com/q/status/3")], "doc_id string, url string")
    page = '<div class="main-thread"><div class="timeline-item"><div class="tweet-content">one</div></div><div class="timeline-item"><div class="tweet-content">two</div></div></div>'
    pages = spark.createDataFrame([("t", "https://x.com/q/status/2", page), ("x", "https://x.com/q/status/3", "<p>none")], "doc_id string, url string, html string")
    none = spark.createDataFrame([("t", "https://x.com/q/status/2", "")], "doc_id string, url string, json string")
    got = {r["doc_id"]: r for r in pipelines.social(items, none, embedded, pages).collect()}
    assert got["e"]["body"] == "hi &\nbye\nx" and got["t"]["is_thread"] and got["t"]["thread_length"] == 2
    assert "*Thread (2 posts)*" in got["t"]["markdown"] and got["x"]["error_message"].endswith("Nitter: no post on the page")


def test_videos(spark):
    meta = [("v", json.dumps({"id": "v", "title": "T", "webpage_url": "http://v", "channel": "C", "upload_date": "20240506", "duration": 130, "language": "en", "chapters": [{"title": "A", "start_time": 0, "end_time": 60}, {"title": "B", "start_time": 60, "end_time": 90}, {"title": "End", "start_time": 600, "end_time": 700}]})), ("n", "{}"), ("h", json.dumps({"title": "Heard"}))]
    schema = "doc_id string, path string, text string, is_auto boolean"
    subs = spark.createDataFrame([("v", "a.en.vtt", VTT, True), ("v", "a.fr.vtt", VTT.replace("Hello", "Bonjour"), True)], schema)
    df = spark.createDataFrame(meta, "doc_id string, json string")
    asr = spark.createDataFrame([("h", 0, 0.0, 1.0, "heard it", "de"), ("v", 0, 0.0, 1.0, "not used", "de")], "doc_id string, seq bigint, start_seconds double, end_seconds double, text string, language string")
    got = {r["doc_id"]: r for r in pipelines.videos(df, subs, asr=asr).collect()}
    assert got["n"]["error_type"] == "NoSubtitlesError"
    assert got["v"]["markdown"] == '---\ntitle: "T"\nurl: "http://v"\nchannel: "C"\ndate: "2024-05-06"\nlanguage: "en"\nduration: "2:10"\nauto_generated: true\ncontent_type: "transcript"\npolished: false\n---\n\n# T\n\n> Channel: C | Date: 2024-05-06 | Duration: 2:10\n\n' + render.NOTICE_AUTO + "\n\n## A\n\nHello there & you\n\n## B\n\nSecond line\n\n## End\n\n*(No transcript for this section)*\n"
    assert got["h"]["markdown"].endswith(render.NOTICE_ASR + "\n\nheard it\n") and "whisper_transcribed: true" in got["h"]["markdown"] and got["h"]["sub_language"] == "de"
    forced = config.load(options={"subtitles": {"lang": "fr"}})
    assert "Bonjour" in {r["doc_id"]: r for r in pipelines.videos(df, subs, forced).collect()}["v"]["markdown"]
    first = {r["doc_id"]: r for r in pipelines.preview_videos(spark.createDataFrame([("p", json.dumps({"title": "P", "subtitles": {"live_chat": [], "en": []}, "automatic_captions": {f"l{i}": [] for i in range(12)}}))], "doc_id string, json string")).collect()}["p"]
    assert (first["manual"], len(first["auto"]), first["more_auto"], first["language"]) == (["en"], 10, True, "unknown")


def test_papers_and_podcasts(spark):
    text = "# Title\n\n" + "word " * 60 + "\n\n## Abstract\n\nown abstract\n\n## Part\n\n(1)\n\n## References\n\ngone"
    md = spark.createDataFrame([("p", text)], "doc_id string, text string")
    props = spark.createDataFrame([("p", json.dumps({"number_of_pages": 3, "author": "A, B, C, D", "creation_date": "D:20240506"}))], "doc_id string, json string")
    strip = config.load(options={"pdf": {"strip_references": True}})
    assert "gone" in pipelines.papers(md, props).first()["markdown"]
    r = pipelines.papers(md, props, cfg=strip).first()
    assert (r["title"], r["abstract"], r["has_math"], r["page_count"], r["error_type"]) == ("Title", "own abstract", True, 3, None)
    assert 'authors: "A, B, C, D"' in r["markdown"] and "> Authors: A, B, C et al. (4 authors) | Date: 2024-05-06 | 3 pages | 63 words" in r["markdown"]
    assert "gone" not in r["markdown"] and r["markdown"].count("own abstract") == 1 and render.NOTICE_MATH in r["markdown"]
    api = structured.papers(spark.createDataFrame([("p", ATOM)], "doc_id string, xml string"))
    assert pipelines.papers(md, props, api).first()["abstract"] == "s t"
    asr = spark.createDataFrame([("http://a/1.mp3", 0, 0.0, 1.0, "hello")], "audio_url string, seq bigint, start_seconds double, end_seconds double, text string")
    feeds = spark.createDataFrame([("f", RSS)], "doc_id string, xml string")
    got = {r["title"]: r for r in pipelines.podcasts(structured.feed_episodes(feeds), asr).collect()}
    assert got["One"]["markdown"].endswith(render.NOTICE_ASR + "\n\nhello\n") and got["Three"]["error_type"] == "WhisperError"
    assert "> Show: Show | Episode: 7 | Date: 2024-05-06 | Duration: 1:02" in got["One"]["markdown"]
    shown = pipelines.preview_podcasts(structured.feed_episodes(feeds)).first()
    assert (shown["feed"], shown["episodes"], shown["first"], shown["more"]) == ("Show", 2, ["One (1:02)", "Three (0:00)"], 0)
    told = pipelines.preview_papers(spark.createDataFrame([("p", "https://arxiv.org/abs/2301.00001"), ("q", "http://a/b.pdf")], "doc_id string, url string"), api).orderBy("doc_id").collect()
    assert (told[0]["authors"], told[0]["paper_id"], told[1]["title"]) == ("X, Y", "2301.00001", None)


def test_feeds_resolve(spark):
    urls = spark.createDataFrame([("http://rss",), ("http://tool",), ("http://none",)], "doc_id string")
    feeds = spark.createDataFrame([("http://rss", RSS), ("http://none", "no feed")], "doc_id string, xml string")
    lines = "\n".join([json.dumps({"title": "E1", "album": "Al", "url": "http://t/1", "duration": 61.5, "upload_date": "20240506"}), "not json", "", json.dumps({"channel": "Ch", "webpage_url": "http://t/2", "episode_number": 3})])
    tool = spark.createDataFrame([("http://tool", lines), ("http://rss", lines)], "doc_id string, text string")
    got = {(r["doc_id"], r["pos"]): r for r in structured.resolved_feeds(urls, feeds, tool).collect()}
    assert {k for k in got} == {("http://rss", 0), ("http://rss", 2), ("http://tool", 0), ("http://tool", 1), ("http://none", 0)}
    one, two = got["http://tool", 0], got["http://tool", 1]
    assert (one["title"], one["show_name"], one["audio_url"], one["duration"], one["publish_date"]) == ("E1", "Al", "http://t/1", 61, "2024-05-06")
    assert (two["title"], two["show_name"], two["audio_url"], two["episode_number"], two["publish_date"]) == ("Untitled Episode", "Ch", "http://t/2", "3", "unknown")
    assert got["http://none", 0]["audio_url"] == "http://none"
    entries = structured.playlist_entries(spark.createDataFrame([("u", '{"id": "a", "url": "x"}\n{"id": "b"}\n{"webpage_url": "w"}')], "doc_id string, text string"))
    assert [tuple(r) for r in entries.orderBy("n").collect()] == [("u", 0, "x", "a"), ("u", 2, "w", "")]


def test_extracted_xml_and_dom(spark):
    xml = '<doc><main><p>intro <hi>x</hi></p><head rend="h3">Top<b>lost</b></head><list><item>gone</item></list><p>a</p><graphic src="http://i/1.png" alt="A"/><graphic src="data:"/><head>Empty</head></main></doc>'
    rows = spark.createDataFrame([(1, xml), (2, "broken <"), (3, None)], "doc_id int, xml string")
    got = {r["doc_id"]: r for r in web.extracted(rows, images=True).collect()}
    first = got[1]["sections"]
    assert [(s["heading"], s["level"]) for s in first] == [("", 2), ("Top", 3)] and first[0]["body"] == "intro x"
    assert first[1]["body"] == "a\n\n" + got[1]["images"][0]["position_marker"] and got[2]["sections"] == got[3]["sections"] == []
    nodes = [("block", "longform-header-one", "T", "", 0, 0), ("img", "", "", "http://a.png", 10, 10), ("img", "", "", "http://b.png", 10, 90), ("img", "", "", "x.svg", 0, 0), ("block", "longform-ordered-list-item", " one ", "", 0, 0)]
    items = structured.dom_items(spark.createDataFrame([(1, i, *n) for i, n in enumerate(nodes)], "doc_id int, pos int, type string, cls string, text string, src string, width int, height int"))
    assert [r["type"] for r in items.orderBy("pos").collect()] == ["header-one", "image", "ordered-list-item"]
    body = structured.block_sections(items).first()
    assert body["heading"] == "T" and body["body"].endswith("\n\n1. one") and body["body"].startswith("<!--IMG:")


def test_pictures_of_papers(spark):
    from loomtext.operators import images

    docs = spark.createDataFrame([(1, "a ![x](p/1.png) b ![y](data:q) c ![z](gone.png) ![t](tiny.png)"), (2, "none")], "doc_id int, text string")
    pictures = spark.createDataFrame([(1, "p/1.png", bytearray(200)), (1, "q/1.png", bytearray(300)), (1, "tiny.png", bytearray(5))], "doc_id int, ref string, image_bytes binary")
    texts, found = images.markdown_images(docs, pictures)
    (one,) = found.collect()
    assert (one["source_label"], one["alt_text"], one["format"], len(one["image_bytes"])) == ("PDF figure 1", "x", "png", 200)
    assert {r["doc_id"]: r["text"] for r in texts.collect()} == {1: f"a {one['position_marker']} b  c  ", 2: "none"}
    withs = texts.select("doc_id", F.array(F.struct(F.lit(0).cast("bigint").alias("seq"), F.lit("").alias("heading"), F.lit(2).alias("level"), F.col("text").alias("body"))).alias("sections"))
    said = found.select("doc_id", "position_marker", F.lit("a plot").alias("description"))
    got = {r["doc_id"]: r["sections"][0]["body"] for r in images.with_descriptions(withs, said).collect()}
    assert got == {1: "a \n\n*Image:*\n\na plot\n\n b  c  ", 2: "none"}
    assert images.with_descriptions(withs, said.where("false")).where("doc_id = 1").first()["sections"][0]["body"] == f"a {images.UNAVAILABLE} b  c  "


def test_runner_keeps_every_item(spark):
    items = spark.createDataFrame([(0, "http://b", "article", 6), (1, "http://v", "youtube", 1), (2, "http://c.pdf", "pdf", 3), (3, "http://d", "article", 6)], "pos int, url string, content_type string, type_rank int")
    plan = lambda rows: rows.where("url != 'http://d'").select("doc_id", F.lit("T").alias("title"), F.concat(F.lit("md "), "url").alias("markdown"))
    cfg = config.load(options={"pdf": {"enabled": False}})
    got = [(r["pos"], r["markdown"], r["error_type"], r["error_message"]) for r in pipelines.run(items, {"article": plan, "pdf": plan}, cfg).collect()]
    assert got == [(1, None, "PipelineError", "this kind of content is switched off"), (2, None, "PipelineError", "this kind of content is switched off"), (0, "md http://b", None, None), (3, None, "PipelineError", "nothing was extracted")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("d", 0, "T x", "2024-05-06"), ("e", 1, "T x", "2024-05-06")], "doc_id string, pos int, title string, publish_date string")
    named = sinks.unique_paths(df.withColumn("folder", sinks.folder(stamp="20240506-0708")))
    assert sorted(r["path"] for r in named.collect()) == ["2024-05-06_t-x_20240506-0708", "2024-05-06_t-x_20240506-0708-2"]
    md = df.withColumn("markdown", F.lit("---\npolished: false\n---\n\nraw\n"))
    out = {r["doc_id"]: r["markdown"] for r in sinks.with_polish(md, spark.createDataFrame([("d", "fine")], "doc_id string, polished_body string")).collect()}
    assert out == {"d": "---\npolished: true\n---\n\nfine\n", "e": "---\npolished: false\n---\n\nraw\n"}
    named = md.select(F.col("doc_id").alias("path"), F.lit("article").alias("basename"), "markdown")
    out = str(tmp_path / "o")
    sinks.write_documents(named.where("path = 'd'"), out)
    sinks.write_documents(named, out)
    assert sorted(r["path"] for r in spark.read.parquet(out).collect()) == ["d", "e"]
    kinds = spark.createDataFrame([("d", "p", "youtube", "raw"), ("e", "q", "article", "art")], "doc_id string, path string, content_type string, markdown string")
    both = {(r["path"], r["basename"]): r["markdown"] for r in sinks.with_raw(kinds, spark.createDataFrame([("d", "better")], "doc_id string, markdown string")).collect()}
    assert both == {("p", "transcript"): "better", ("p", "transcript.unpolished"): "raw", ("q", "article"): "art"}
    stored = spark.createDataFrame([("f", "article.md", "A"), ("g", "tweet.unpolished.md", "T"), ("archive", "x.md", "X")], "folder string, name string, markdown string")
    assert [tuple(r) for r in sinks.backfill(stored).collect()] == [("f", "article", "batch-process/f.md", "A"), ("g", "tweet", None, None)]
    names = spark.createDataFrame([("f", "tweet.md"), ("f", "article.md"), ("g", "other.md"), ("archive", "tweet.md")], "folder string, name string")
    assert [tuple(r) for r in sinks.detect_basenames(names).collect()] == [("f", "article"), ("g", "transcript")]


def test_connectors(spark):
    answers = connectors.Recorded({"u1": connectors.Answer(200, b"ok"), "u2": connectors.Answer(503), "u3": connectors.Answer(404)})
    rows = {r["doc_id"]: r for r in connectors.fetched(spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u3")], "doc_id int, url string"), answers).collect()}
    assert bytes(rows[1]["content"]) == b"ok" and (rows[2]["error_message"], rows[3]["error_type"]) == ("HTTP 503", "NetworkError")
    waits, tries = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise connectors.Retry()
        return "done"

    assert connectors.with_retries(call, 3, 2, waits.append) == "done" and waits == [1, 2]
    now = [0.0]
    limit = connectors.Limiter(100, 10, 1.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(3):
        limit.record(limit.acquire(40), 40)
    assert abs(now[0] - 60.1) < 1e-6
    assert connectors.tool_verdict("ERROR: Video unavailable") == "VideoUnavailableError" and connectors.verdict(429) == "retry"


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"network": {"retries": 5}, "vision": {"max_images": 3, "unknown": 1}, "llm": {"rate_limit": {"rpm": 7}}, "urls": ["u"]}))
    c = config.load(str(tmp_path / "c.json"), {"vision": {"max_images": 4}})
    assert (c.network.retries, c.vision.max_images, c.text.paragraph_gap_seconds, c.llm.rate_limit.rpm, c.llm.rate_limit.tpm, c.urls) == (5, 4, 4.0, 7, 150_000, ("u",))
    (tmp_path / "old.json").write_text(json.dumps({"retries": 5, "no_whisper": True, "cookie_args": ["--cookies-from-browser", "x"], "urls": "u", "whisper_model": "m", "other": 1}))
    old = config.load(str(tmp_path / "old.json"))
    assert (old.network.retries, old.whisper.enabled, old.auth.cookies_from_browser, old.urls, old.whisper.model) == (5, False, "x", ("u",), "m")
    assert config.cookie_args(old) == ["--cookies-from-browser", "x"] and config.cookie_args(c) == []
    (tmp_path / "cookies.txt").write_text("")
    assert config.cookie_args(c, str(tmp_path / "cookies.txt")) == ["--cookies", str(tmp_path / "cookies.txt")]
    assert config._made(config.Config, json.loads(config.template())) == config.Config()


class Echo:
    """A language model that answers in capitals."""

    def complete(self, system, user, image=None, media_type=None):
        if "fail" in user:
            raise connectors.Fatal("no")
        return (f"{media_type} {len(image)}" if image is not None else user.upper()), 1, 1


class Says:
    def transcribe(self, audio, language):
        return [(0.0, 1.0, " " + audio.decode() + " "), (1.0, 2.0, " ")], language or "xx"


class Layout:
    def convert(self, content, pages):
        if not content:
            raise ValueError("empty")
        return content.decode() + f" {pages}", "{}", {"b.png": b"1", "a.png": b"2"}


def test_models_and_tools(spark):
    work = spark.createDataFrame([(1, 0, "hi"), (1, 1, "fail"), (2, 0, "Rate Limit hit")], "doc_id int, chunk_no int, message string")
    got = {(r["doc_id"], r["chunk_no"]): (r["answer"], r["error_message"]) for r in connectors.answered(work, Echo(), "sys").collect()}
    assert got == {(1, 0): ("HI", None), (1, 1): (None, "no"), (2, 0): (None, "error pattern: rate limit")}
    images = spark.createDataFrame([(1, "m", bytearray(7), "image/png", "Label", "alt"), (1, "n", bytearray(1), "image/png", "fail", None)], "doc_id int, position_marker string, image_bytes binary, media_type string, source_label string, alt_text string")
    assert {r["position_marker"]: r["description"] for r in connectors.described(images, Echo()).collect()} == {"m": "image/png 7", "n": None}
    tool = connectors.RecordedTool({"u": '{"id": "1"}\n{"id": "2"}'}, {("u", "en", True): {"x.fr.vtt": "F", "x.en.srt": "S", "x.en.vtt": "V"}, ("u", "de", False): {"y.srt": "Y"}}, {"u": b"spoken"})
    items = spark.createDataFrame([(1, "u", "en-US"), (2, "w", None)], "doc_id int, url string, language string")
    meta = {r["doc_id"]: (r["json"], r["error_type"]) for r in connectors.video_metadata(items, tool).collect()}
    assert meta == {1: ('{"id": "1"}', None), 2: (None, "VideoUnavailableError")}
    tracks = spark.createDataFrame([(1, "u", "en", True), (2, "u", "de", False), (3, "u", "it", False), (4, "u", None, None)], "doc_id int, url string, lang string, is_auto boolean")
    assert {r["doc_id"]: (r["path"], r["error_type"]) for r in connectors.subtitle_files(tracks, tool).collect()} == {1: ("x.en.vtt", None), 2: ("y.srt", None), 3: (None, "NoSubtitlesError"), 4: (None, "NoSubtitlesError")}
    assert [(r["doc_id"], r["text"], r["language"]) for r in connectors.transcribed(items, tool, Says()).collect()] == [(1, "spoken", "en")]
    pdfs = spark.createDataFrame([(1, bytearray(b"x" * 300)), (2, bytearray(b"short")), (3, None)], "doc_id int, content binary")
    made = {r["doc_id"]: r for r in connectors.converted_pdfs(pdfs, Layout(), structured.page_range(2)).collect()}
    assert made[1]["text"].endswith(" 0,1") and [p["ref"] for p in made[1]["pictures"]] == ["a.png", "b.png"] and made[2]["error_type"] == made[3]["error_type"] == "PDFExtractionError"
    assert structured.page_range(0) is None
    pictures = connectors.Recorded({"i": connectors.Answer(200, b"img", "image/png"), "h": connectors.Answer(200, b"<p>", "text/html")})
    asked = spark.createDataFrame([(1, "i"), (2, "h"), (3, "none")], "doc_id int, url string")
    assert {r["doc_id"]: bytes(r["content"]) for r in connectors.fetched(asked, pictures, kind="image").collect()} == {1: b"img", 2: b"", 3: b""}
    latin = connectors.Recorded({"l": connectors.Answer(200, "é".encode("latin-1"), "text/html; charset=ISO-8859-1")})
    assert connectors.fetched(spark.createDataFrame([(1, "l")], "doc_id int, url string"), latin).first()["html"] == "é"
    assert connectors.headers("pdf", "u")["Accept"] == "application/pdf,*/*" and connectors.headers(url="u") == connectors.headers(url="u")
    assert connectors.tool_verdict("Join this channel") == "AuthRequiredError" and connectors.tool_verdict("odd") == "fatal" and connectors.tool_verdict("HTTP Error 429") == "retry"


def test_streams_and_sql(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([(1, "http://a", PAGE)], "doc_id int, url string, html string").write.parquet(str(src))
    stream = ingest.arriving(spark, str(src), "doc_id int, url string, html string")
    ingest.into_table(stream, lambda b: pipelines.pages(b).select("doc_id", "title"), str(out), str(tmp_path / "cp")).awaitTermination(60)
    assert [r["title"] for r in spark.read.parquet(f"{out}/batch=*").collect()] == ["The & Title"]
    events = spark.readStream.schema("event_id bigint, ts timestamp_ntz, user_id bigint, value double").parquet("/root/testdata/sf0.001/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for i, frame in enumerate((ingest.usage(events, "ts", "value", "1 day", "1 day"), ingest.first_seen(events, "ts", "user_id", late="40 days"), ingest.sessions(events, "ts", "user_id", "12 hours"))):
        q = frame.writeStream.format("memory").queryName(f"s{i}").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"q{i}")).start()
        q.awaitTermination(90)
        assert spark.sql(f"SELECT count(*) FROM s{i}").first()[0] > 0
    # Cues that come one file after another are compared with the last cue of the batch before.
    cues = tmp_path / "cues"
    schema = "doc_id string, seq bigint, text string"
    for i, rows in enumerate(([("a", 0, "x\ny"), ("b", 0, "q")], [("a", 1, "y\nz"), ("a", 2, "z")], [("a", 3, "z\nw\nw"), ("b", 1, None), ("b", 2, "q")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(cues / f"{i}"))
    rolled = tmp_path / "rolled"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(cues))
    ingest.rolling_lines(stream).writeStream.format("parquet").option("path", str(rolled)).option("checkpointLocation", str(tmp_path / "rl")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r["doc_id"], r["seq"], r["text"]) for r in spark.read.parquet(str(rolled)).collect()) == [("a", 0, "x y"), ("a", 1, "z"), ("a", 3, "w w"), ("b", 0, "q")]
    sql.register(spark)
    assert spark.sql("SELECT html_unescape('&lt;') AS a, nfkc('ﬁ') AS b").first() == ("<", "fi")
    assert spark.sql("SELECT count(*) FROM split_text('One two. Three four five', 12)").first()[0] == 3


def test_fetching(spark):
    """Connectors before the readers, with recorded answers."""
    from loomtext.sources import fetching

    answer = connectors.Answer
    long = "<article><p>" + "word " * 40 + "</p><img src='http://i/1.jpg'></article>"
    posts_at = lambda k: fetching.SYNDICATION + str(k)
    web_of = connectors.Recorded({
        "http://a": answer(200, long.encode()), "http://down": answer(500), fetching.PAPER_API + "2301.00001": answer(200, ATOM.encode(), "application/xml"), "https://arxiv.org/pdf/2301.00001": answer(200, b"%PDF", "application/pdf"), "http://feed/rss": answer(200, RSS.encode()),
        posts_at(1): answer(200, json.dumps({"user": {"screen_name": "h"}, "text": "https://t.co/x http://a"}).encode()), fetching.EMBED + "https%3A%2F%2Fx.com%2Fh%2Fstatus%2F2": answer(200, json.dumps({"author_name": "Q", "html": EMBED}).encode()),
        "https://nitter.privacydev.net/h/status/3": answer(200, b"<div class='main-tweet'><div class='tweet-content'>mirrored</div></div>"), "https://nitter.poast.org/h/status/3": answer(200, b"<p>busy"), "http://i/1.jpg": answer(200, b"x" * 6000, "image/jpeg"), "http://i/2.png": answer(200, b"small", "image/png"),
    })
    frame = lambda rows: spark.createDataFrame(rows, "doc_id int, url string")
    got = {r["doc_id"]: r for r in fetching.articles(frame([(1, "http://a"), (2, "http://down")]), web_of).collect()}
    assert got[1]["html"] == long and got[2]["error_type"] == "NetworkError"
    assert [r["title"] for r in fetching.papers(frame([(1, "https://arxiv.org/abs/2301.00001"), (2, "http://a")]), web_of).collect()] == ["A title"]
    assert bytes(fetching.pdf_files(frame([(1, "https://arxiv.org/abs/2301.00001")]), web_of).first()["content"]) == b"%PDF"
    vtt = {"v.en.vtt": VTT}
    tool = connectors.RecordedTool({"http://feed/tool": '{"title": "E", "url": "http://t/1"}', "http://y/playlist?l": '{"id": "q", "url": "x"}', "http://v": json.dumps({"title": "T", "language": "en", "subtitles": {"en": []}})}, {("http://v", "en", False): vtt})
    episodes = {(r["doc_id"], r["title"]) for r in fetching.feeds(frame([(1, "http://feed/rss"), (2, "http://feed/tool"), (3, "http://feed/none")]), web_of, tool).collect()}
    assert episodes == {("http://feed/rss", "One"), ("http://feed/rss", "Three"), ("http://feed/tool", "E"), ("http://feed/none", "Episode")}
    listed = spark.createDataFrame([(0, " http://y/playlist?l "), (1, "# no"), (2, ""), (3, "http://y/@gone"), (4, "https://www.youtube.com/watch?v=q")], "pos int, url string")
    assert [r["url"] for r in fetching.videos(listed, tool).orderBy("pos").collect()] == ["https://www.youtube.com/watch?v=q", "http://y/@gone"]
    meta, subs = fetching.subtitles(frame([(1, "http://v"), (2, "http://gone")]), tool)
    made = {r["doc_id"]: r for r in pipelines.videos(meta.where("json IS NOT NULL"), subs).collect()}
    assert "Hello there & you" in made[1]["markdown"] and {r["doc_id"]: r["error_type"] for r in meta.collect()} == {1: None, 2: "VideoUnavailableError"}
    items = frame([(1, "https://twitter.com/h/status/1?s=1"), (2, "https://x.com/h/status/2"), (3, "https://x.com/h/status/3"), (4, "https://x.com/h/status/4")])
    synd = fetching.syndicated(items, web_of)
    linked = fetching.linked_pages(synd.select("doc_id", F.get_json_object("json", "$.text").alias("text")), web_of)
    done = {r["doc_id"]: r for r in pipelines.social(items, synd, fetching.embedded(items, web_of), fetching.mirrored(items, web_of), linked=linked).collect()}
    assert done[1]["body"].startswith("word word") and done[2]["body"] == "hi &\nbye\nx" and done[3]["body"] == "mirrored" and done[4]["error_type"] == "TweetFetchError"
    pictures = spark.createDataFrame([(1, 0, "http://i/1.jpg"), (1, 1, "http://i/2.png"), (2, 0, "http://i/none")], "doc_id int, seq int, src string")
    assert [(r["src"], r["media_type"], r["format"]) for r in fetching.images(pictures, web_of).collect()] == [("http://i/1.jpg", "image/jpeg", "jpeg")]
    nodes = spark.createDataFrame([(1, 0, "block", "longform-header-one", "H", "", 0, 0), (1, 1, "block", "", "text", "", 0, 0)], "doc_id int, pos int, type string, cls string, text string, src string, width int, height int")
    r = fetching.rendered(items, nodes).first()
    assert (r["title"], r["sections"][0]["body"]) == ("H", "text")


def test_command_line(spark, tmp_path):
    from loomtext import __main__ as cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("---\ntitle: [not, text]\nauthor: null\n---\n# H\nbody")
    (tmp_path / "in" / "b.txt").write_text("plain words")
    (tmp_path / "in" / "c.ppt").write_text("old")
    given = [str(tmp_path / "in"), "https://x.com/h/status/1", "-o", str(tmp_path / "out"), "--no-whisper", "--max-pages", "3", "--service", "web=tests.test_runs_of_all_kinds:Web"]
    args = config.parser().parse_args(given)
    cfg = config.load(options=config.overrides(args))
    assert (cfg.whisper.enabled, cfg.pdf.max_pages, cfg.output.dir, cfg.output.overwrite, cfg.network.retries) == (False, 3, str(tmp_path / "out"), False, 3)
    shown = {r["url"].rpartition("/")[2]: (r["content_type"], r["format"]) for r in cli.main([*given, "--dry-run"], spark).collect()}
    assert shown == {"a.md": ("local_file", ".md"), "b.txt": ("local_file", ".txt"), "c.ppt": ("local_file", ".ppt"), "1": ("twitter", None)}
    done = {r["url"].rpartition("/")[2]: r for r in cli.main(given, spark).collect()}
    assert done["a.md"]["title"] == "['not', 'text']" and done["b.txt"]["title"] == "b" and done["c.ppt"]["error_type"] == "LocalFileError" and done["1"]["error_type"] == "TweetFetchError"
    cli.main([*given, "--overwrite"], spark)
    out = tmp_path / "out" / "output"
    kept = {p.parent.name: p.read_text() for p in out.rglob("document.md")}
    assert len(kept) == 2 and any("plain words" in text for text in kept.values())
    assert {p.stem: p.read_text() for p in (out / "batch-process").iterdir()} == kept
    for p in (out / "batch-process").iterdir():
        p.unlink()
    assert {r["file"].partition("/")[0] for r in cli.main([*given, "--backfill-batch"], spark).collect()} == {"batch-process"}
    assert {p.stem: p.read_text() for p in (out / "batch-process").iterdir()} == kept
