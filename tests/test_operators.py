"""Operators on cues, sections, chunks and images, against direct readings of their rules."""

import random

from pyspark.sql import functions as F

from loomtext.operators import chunks, cues, images, relational, sections


def cue_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, seq bigint, start_seconds double, end_seconds double, text string")


def test_clean_and_rolling_lines(spark):
    df = cue_rows(spark, [("a", 0, 0.0, 1.0, " one  two \nthree"), ("a", 1, 1.0, 2.0, "three\nfour\nfour"), ("a", 2, 2.0, 3.0, "three\nfour"), ("a", 3, 3.0, 4.0, " \t"), ("b", 0, 0.0, 1.0, "three")])
    clean = cues.clean_cues(df)
    assert [r["text"] for r in clean.orderBy("doc_id", "seq").collect()] == ["one two\nthree", "three\nfour\nfour", "three\nfour", "three"]
    rolled = cues.drop_rolling_lines(clean).orderBy("doc_id", "seq").collect()
    assert [(r["doc_id"], r["text"]) for r in rolled] == [("a", "one two three"), ("a", "four four"), ("b", "three")]


def plain_paragraphs(rows, gap, sentences):
    out, now, ends, last = [], [], 0, None
    for _, _, start, end, text in rows:
        if now and last is not None and start - last > gap:
            out.append(now)
            now, ends = [], 0
        now.append(text)
        last = end
        ends += text.rstrip()[-1:] in tuple(".!?。！？")
        if ends >= sentences:
            out.append(now)
            now, ends = [], 0
    return [" ".join(p) for p in [*out, now] if p]


def test_paragraphs_equal_a_plain_loop(spark):
    pick = random.Random(6)
    rows, want = [], {}
    for d in range(60):
        at, mine = 0.0, []
        for s in range(pick.randrange(1, 40)):
            at += pick.choice([0.5, 1, 4, 4.5, 9])
            mine.append((f"d{d}", s, at, at + 0.5, pick.choice(["go", "stop.", "ok? ", "and"])))
        rows += mine
        want[f"d{d}"] = "\n\n".join(plain_paragraphs(mine, 4.0, 3))
    got = {r["doc_id"]: r["body"] for r in cues.cues_to_text(cue_rows(spark, rows), sentences=3).collect()}
    assert got == want
    cjk = cue_rows(spark, [("c", 0, 0.0, 1.0, "漢字"), ("c", 1, 1.0, 2.0, "かな。")])
    assert cues.cues_to_text(cjk).first()["body"] == "漢字かな。"


def plain_alignment(cue_starts, starts):
    at, out = 0, []
    for s in cue_starts:
        while at + 1 < len(starts) and starts[at + 1] <= s:
            at += 1
        out.append(at)
    return out


def test_alignment_equals_a_moving_pointer(spark):
    pick = random.Random(8)
    rows, chapters, want = [], [], {}
    for d in range(60):
        starts = [float(pick.randrange(20)) for _ in range(pick.randrange(0, 5))]
        times = [float(pick.randrange(20)) for _ in range(pick.randrange(1, 12))]
        rows += [(f"d{d}", i, t, t + 1, "x") for i, t in enumerate(times)]
        chapters += [(f"d{d}", i, "t", s, s) for i, s in enumerate(starts)]
        want[f"d{d}"] = plain_alignment(times, starts)
    table = spark.createDataFrame(chapters, "doc_id string, idx int, title string, start_seconds double, end_seconds double")
    got = {}
    for r in cues.align_to_chapters(cue_rows(spark, rows), table).orderBy("doc_id", "seq").collect():
        got.setdefault(r["doc_id"], []).append(r["chapter_idx"])
    assert got == want


def test_track_choice(spark):
    rows = [("a", "en", False, 0, "de"), ("a", "en", False, 1, "en-US"), ("a", "en", True, 0, "en"), ("b", None, True, 0, "live_chat"), ("b", None, True, 1, "fr"), ("c", "en", True, 0, "en")]
    df = spark.createDataFrame(rows, "doc_id string, declared string, is_auto boolean, pos int, lang string")
    pick = lambda **how: {r["doc_id"]: (r["lang"], r["is_auto"]) for r in cues.select_track(df, **how).collect()}
    assert pick() == {"a": ("en-US", False), "b": ("fr", True), "c": ("en", True)}
    assert pick(prefer_auto=True)["a"] == ("en", True)
    assert pick(forced="de") == {"a": ("de", False), "b": (None, None), "c": (None, None)}
    assert {r["doc_id"]: r["error_type"] for r in cues.select_track(df, forced="fr").collect()} == {"a": "NoSubtitlesError", "b": None, "c": "NoSubtitlesError"}
    none = cues.without_tracks(spark.createDataFrame([("a",), ("z",)], "doc_id string"), df).first()
    assert (none["doc_id"], none["error_type"]) == ("z", "NoSubtitlesError")


def test_sections(spark):
    text = "before\n# Top\nbody a\n\n\n\nbody b\n## Sub\n```\n# in code\n```\n### Empty\n## References\nlost\n## More\nalso lost"
    docs = spark.createDataFrame([(1, text), (2, "plain"), (3, "")], "doc_id bigint, text string")
    got = [(r["doc_id"], r["heading"], r["level"], r["body"]) for r in sections.exploded(docs, sections.without_references(sections.markdown("text"))).orderBy("doc_id", "seq").collect()]
    assert got == [(1, "", 2, "before"), (1, "Top", 2, "body a\n\nbody b"), (1, "Sub", 3, "```"), (1, "in code", 2, "```"), (1, "Empty", 4, ""), (2, "", 2, "plain")]
    assert sections.markdown_sections(docs).count() == 8
    assert "Exchange" not in sections.markdown_sections(docs)._jdf.queryExecution().executedPlan().toString()
    two = [(r["heading"], r["body"]) for r in sections.converter_sections(docs.where("doc_id = 1")).orderBy("seq").collect()]
    assert two == [("", "before\nbody a\n\n\n\nbody b"), ("Sub", "```\n# in code\n```\n### Empty"), ("References", "lost"), ("More", "also lost")]
    caps = spark.createDataFrame([(1, "INTRO: A\nx\nPart one:\ny\n")], "doc_id bigint, text string")
    assert [(r["heading"], r["body"]) for r in sections.text_sections(caps).orderBy("seq").collect()] == [("INTRO: A", "x"), ("Part one", "y")]


def test_section_arrays(spark):
    rows = [(1, [(0, "", 2, "one two"), (1, "Abstract", 2, "short"), (2, "Next", 2, "three"), (3, " ABSTRACT ", 2, "again")]), (2, [])]
    df = spark.createDataFrame(rows, "doc_id int, s array<struct<seq:bigint,heading:string,level:int,body:string>>")
    s = sections
    got = {r["doc_id"]: r for r in df.select("doc_id", s.first_heading("s").alias("h"), s.body_text("s").alias("t"), s.words("s", True).alias("w"), s.abstract("s").alias("a"), F.transform(s.without_abstract("s"), lambda x: x["seq"]).alias("left")).collect()}
    assert (got[1]["h"], got[1]["t"], got[1]["w"], got[1]["a"], got[1]["left"]) == ("Abstract", "one two\n\nAbstract\n\nshort\n\nNext\n\nthree\n\n ABSTRACT \n\nagain", 8, "short", [0, 2, 3])
    assert (got[2]["h"], got[2]["t"], got[2]["w"], got[2]["a"], got[2]["left"]) == ("Untitled", "", 0, "", [])


def plain_sections(text):
    """Direct reading of Markdown sections."""
    import re

    found, heading, level, body = [], "", 2, []
    for line in [*text.split("\n"), None]:
        m = re.match(r"^(#{1,6})\s+(.+)$", line) if line is not None else None
        if line is None or m:
            found.append([heading, level, re.sub(r"\n{3,}", "\n\n", "\n".join(body).strip()).strip()])
        if m:
            heading, level, body = m.group(2).strip(), len(m.group(1)), []
        elif line is not None:
            body.append(line)
    found = [f for f in found if f[0] or f[2]]
    least = min((f[1] for f in found if f[0]), default=0)
    return [(h, lv + 1 if h and least == 1 else lv, b) for h, lv, b in found]


def test_sections_equal_a_plain_loop(spark):
    pick = random.Random(3)
    parts = ["# A", "## B c", "### ", "#x", "text", "", "  more ", "###### Six", "####### Seven"]
    texts = [(i, "\n".join(pick.choice(parts) for _ in range(pick.randrange(0, 12)))) for i in range(150)]
    got = {}
    for r in sections.markdown_sections(spark.createDataFrame(texts, "doc_id int, text string"), False).orderBy("doc_id", "seq").collect():
        got.setdefault(r["doc_id"], []).append((r["heading"], r["level"], r["body"]))
    assert got == {i: s for i, t in texts if (s := plain_sections(t))}


def test_chunks_with_context_and_answers(spark):
    docs = spark.createDataFrame([(1, "aa. bb. cc. dd."), (2, "x")], "doc_id int, text string")
    got = chunks.chunk_text(docs, size=4, context=0.5).orderBy("doc_id", "chunk_no").collect()
    assert "".join(r["chunk"] for r in got if r["doc_id"] == 1) == "aa. bb. cc. dd."
    assert got[0]["context"] == "" and got[1]["context"] == got[0]["chunk"][-2:]
    part = spark.createDataFrame([(1, 0, "AA"), (2, 0, "X")], "doc_id int, chunk_no int, answer string")
    table = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "x")], "doc_id int, chunk_no int, chunk string")
    whole = {r["doc_id"]: r["text"] for r in chunks.merge_answers(table, part).collect()}
    assert whole == {1: "a\n\nb", 2: "X"}
    assert {r["doc_id"]: r["text"] for r in chunks.merge_answers(table, part, whole=False).collect()} == {1: "AA\n\nb", 2: "X"}


def test_images(spark):
    rows = [(1, i, bytearray(6000 if i != 2 else 10), "png", 40 if i == 1 else 0, 0) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id int, seq int, image_bytes binary, format string, width int, height int")
    kept = images.worth_describing(df, cap=2).withColumn("position_marker", images.marker())
    assert [r["seq"] for r in kept.orderBy("seq").collect()] == [0, 3]
    mark = kept.where("seq = 0").first()["position_marker"]
    body = spark.createDataFrame([(1, 0, "h", 2, f"a {mark} b <!--IMG:00-->"), (1, 1, "", 2, "none")], "doc_id int, seq bigint, heading string, level int, body string")
    said = spark.createDataFrame([(mark, "a cat")], "position_marker string, description string")
    got = {r["seq"]: r["body"] for r in images.replace_markers(body, said).collect()}
    assert got == {0: f"a \n\n*Image:*\n\na cat\n\n b {images.UNAVAILABLE}", 1: "none"}
    assert [r["t"] for r in df.limit(1).select(images.media_type("format").alias("t")).collect()] == ["image/png"]


def test_polish(spark):
    """Documents with sections and without, some answers missing."""
    a = "---\ntitle: x\npolished: false\n---\n\n# T\n\n## One\n\nfirst text\n\n## Empty\n\n## Two\n\nlong one. long two. long three"
    b = "# T\n\n> line\n\npara one.\n\npara two"
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id int, markdown string")
    work = chunks.polish_work(docs, size=12, cjk_size=5, context=0.5)
    rows = {(r["doc_id"], r["section"], r["chunk_no"]): (r["chunk"], r["context"]) for r in work.collect()}
    assert rows[1, 0, 0] == ("first text", "") and rows[1, 2, 0] == ("long one.", "t text"[-6:]) and rows[2, -1, 0][0] == "para one."
    assert "".join(rows[1, 2, i][0] for i in range(3)) == "long one. long two. long three"
    answers = [(1, 0, 0, "FIRST"), (1, 2, 0, "L1"), (2, -1, 0, "P1")]
    got = {r["doc_id"]: r["markdown"] for r in chunks.polished(docs, work, spark.createDataFrame(answers, "doc_id int, section bigint, chunk_no int, answer string")).collect()}
    assert got[1] == "---\ntitle: x\npolished: true\n---\n\n# T\n\n\n## One\n\nFIRST\n\n## Empty\n\n\n## Two\n\nlong one. long two. long three"
    assert got[2].startswith("# T\n\n> line\n\nP1\n\n")


def test_playlists(spark):
    items = spark.createDataFrame([(0, "https://youtube.com/playlist?list=1"), (1, "https://youtube.com/watch?v=b"), (2, "https://youtube.com/playlist?list=bad")], "pos int, url string")
    entries = spark.createDataFrame([("https://youtube.com/playlist?list=1", 0, "https://www.youtube.com/watch?v=a", "a"), ("https://youtube.com/playlist?list=1", 1, "short", "b")], "url string, n int, entry_url string, entry_id string")
    got = [r["url"] for r in relational.expanded(items, entries).orderBy("pos").collect()]
    assert got == ["https://www.youtube.com/watch?v=a", "https://www.youtube.com/watch?v=b", "https://youtube.com/watch?v=b", "https://youtube.com/playlist?list=bad"]


def test_relational(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c")], "pos int, url string")
    assert [r["pos"] for r in relational.ordered_distinct(df, "url").orderBy("pos").collect()] == [0, 1, 3]
    text = spark.createDataFrame([("# no\nhttps://a/x.pdf\n\n'b.md'\n",)], "text string")
    items = relational.input_list(text, keep_all=False)
    assert [r["url"] for r in relational.input_list(text).orderBy("pos").collect()] == ["# no", "https://a/x.pdf", "", "'b.md'"]
    listed = spark.createDataFrame([("b.md",)], "path string")
    got = {r["url"]: r["content_type"] for r in relational.routed(items, listed).collect()}
    assert got == {"https://a/x.pdf": "pdf", "b.md": "local_file"}
    base = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    a, b = spark.createDataFrame([(1, "a1")], "k int, v string"), spark.createDataFrame([(1, "b1"), (2, "b2")], "k int, v string")
    assert {r["k"]: r["v"] for r in relational.cascade(base, [a, b], "k", ["v"]).collect()} == {1: "a1", 2: "b2", 3: None}
    last = relational.last_by_key(spark.createDataFrame([("x", 0, "old"), ("x", 1, "new")], "u string, pos int, v string"), "u")
    assert last.first()["v"] == "new"
    failed = relational.with_errors(base, F.col("k") == 2, "Bad", "it is two")
    assert {r["k"]: r["error_type"] for r in failed.collect()} == {1: None, 2: "Bad", 3: None}
    assert tuple(relational.outcome_counts(failed).first()) == (2, 1)
