"""Threads and short links on written pages."""

from loomtext.sources import threads

ITEM = '<div class="timeline-item"><a class="username" href="/h">@h</a><span class="tweet-date"><a title="May 6, 2024 · 7:08 AM UTC">x</a></span><div class="tweet-content media-body">{}</div></div>'


def test_threads(spark):
    two = '<div class="main-thread">' + ITEM.format("One &amp; <b>two</b><br>three") + ITEM.format("  ") + ITEM.format("last") + '</div><div class="replies">' + ITEM.format("reply") + "</div>"
    main = '<div class="main-tweet"><a class="fullname">Ann B</a><a class="username" href="/ann">@ann</a><span class="tweet-date"><a title="some day">x</a></span><div class="tweet-content">alone</div></div>'
    rows = [(1, "https://nitter.net/h/status/1", two), (2, "https://x.com/h/status/2", main), (3, "u", None), (4, "v", "<title>bob: hi - N</title><div class='tweet-content'>loose</div>")]
    got = {r["doc_id"]: r for r in threads.threads(spark.createDataFrame(rows, "doc_id int, url string, html string")).collect()}
    assert [(s["heading"], s["body"]) for s in got[1]["sections"]] == [("@h (1/3)", "One &\ntwo\nthree"), ("@h (3/3)", "last")]
    assert (got[1]["url"], got[1]["publish_date"], got[1]["is_thread"], got[1]["thread_length"]) == ("https://x.com/h/status/1", "2024-05-06", True, 2)
    assert [(s["heading"], s["body"]) for s in got[2]["sections"]] == [("", "alone")] and got[3]["error_type"] == "TweetFetchError"
    assert (got[2]["author"], got[2]["author_name"], got[2]["publish_date"]) == ("@ann", "Ann B", "some day")
    assert (got[4]["author"], got[4]["author_name"], got[4]["sections"][0]["body"]) == ("@bob", "bob", "loose")


def test_short_links(spark):
    docs = spark.createDataFrame([(1, "see https://t.co/ab and https://t.co/abc https://t.co/zz"), (2, "none"), (3, None)], "doc_id int, text string")
    known = spark.createDataFrame([("https://t.co/ab", "http://short"), ("https://t.co/abc", "http://long")], "short string, target string")
    got = {r["doc_id"]: r["text"] for r in threads.expand_links(docs, known).collect()}
    assert got == {1: "see http://short and http://long https://t.co/zz", 2: "none", 3: None}
