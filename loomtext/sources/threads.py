"""Threads of posts from a mirror's pages, and short links put in full."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.dates import UNKNOWN, post_date
from loomtext.functions.text import col, make_title, strip, word_count
from loomtext.functions.urls import canonical_post_url
from loomtext.operators.sections import body_text

VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr"}
#: A mirror's short links; each is looked up, not guessed.
SHORT_LINK = r"https://t\.co/[A-Za-z0-9]+"


class _Thread(HTMLParser):
    """Texts of the main thread's items, in order, or of all items where there is no thread; the main item's author and date."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, set[str]]] = []
        self.main: list[list[str]] = []
        self.all: list[list[str]] = []
        self.date = self.handle = self.name = self.link = self.title = ""

    def within(self, *names: str) -> bool:
        return all(any(name in classes for _, classes in self.open) for name in names)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        classes = set(a.get("class", "").split())
        if tag in VOID:
            return
        self.open.append((tag, classes))
        if "tweet-content" in classes:
            self.all.append([])
            if self.within("main-thread", "timeline-item") or self.within("main-tweet"):
                self.main.append(self.all[-1])
        if tag == "a" and self.within("tweet-date") and (self.within("main-tweet") or self.within("main-thread")) and not self.date:
            self.date = a.get("title", "")
        if tag == "a" and ("username" in classes or self.within("tweet-avatar")) and not self.link:
            self.link = a.get("href", "").strip("/")

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        text = data.strip()
        if not text:
            return
        if self.all and self.within("tweet-content"):
            self.all[-1].append(text)
        elif self.within("main-tweet", "fullname") and not self.name:
            self.name = text
        elif self.within("main-tweet", "username") and not self.handle:
            self.handle = text
        elif self.open and self.open[-1][0] == "title":
            self.title += data


def read_thread(html: str) -> dict:
    """Headings count blank posts too, as `@h (i/n)`; a lone post has none. Blank posts give no section."""
    page = _Thread()
    page.feed(html or "")
    page.close()
    texts = ["\n".join(parts) for parts in page.main or page.all]
    n, handle = len(texts), page.handle
    if not handle:
        titled = re.match(r"(@?\w+):", page.title)
        handle = "@" + titled.group(1).lstrip("@") if titled else f"@{page.link}" if page.link else ""
    sections = [{"seq": i - 1, "heading": f"{handle} ({i}/{n})" if n > 1 else "", "level": 2, "body": t} for i, t in enumerate(texts, 1) if t]
    return {"author": handle, "author_name": page.name or handle.lstrip("@"), "raw_date": page.date, "found": n, "sections": sections}


THREAD = "struct<author:string,author_name:string,raw_date:string,found:int,sections:array<struct<seq:bigint,heading:string,level:int,body:string>>>"


def _read(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_thread(h) for h in html], columns=["author", "author_name", "raw_date", "found", "sections"])


def thread_stats(sections) -> tuple:
    """(is_thread, thread_length, word_count, title) of a thread's sections: blank ones do not count, headings neither."""
    body = body_text(sections, False)
    return F.size(col(sections)) > 1, F.size(col(sections)), word_count(body), make_title(body)


def threads(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, url, html) as posts with sections, is_thread and thread_length; those without any post carry an error.
    A date that isn't read stays as it is written."""
    rows = pages.withColumn("t", F.pandas_udf(_read, THREAD)("html")).select("doc_id", "url", "t.*")
    is_thread, length, words, title = thread_stats("sections")
    read = post_date(F.regexp_extract("raw_date", r"(\w+ \d+, \d{4})", 1))
    date = F.when(read != UNKNOWN, read).otherwise(F.coalesce(F.nullif(strip("raw_date"), F.lit("")), F.lit(UNKNOWN)))
    none = F.col("found") == 0
    return rows.select(
        "doc_id", canonical_post_url("url").alias("url"), "author", "author_name", date.alias("publish_date"), title.alias("title"), "sections", words.alias("word_count"), is_thread.alias("is_thread"),
        length.alias("thread_length"), F.lit("tweet").alias("tweet_subtype"), F.when(none, "TweetFetchError").alias("error_type"), F.when(none, "no post on the page").alias("error_message"),
    )


def expand_links(docs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Texts (doc_id, text) with short links replaced by their targets (short, target), the longest first; unknown ones
    stay."""
    links = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({SHORT_LINK})"), F.lit(1)))).alias("short"))
    known = links.join(resolved, "short").groupBy("doc_id").agg(F.collect_list(F.struct((-F.length("short")).alias("n"), "short", "target")).alias("links"))
    text = F.aggregate(F.array_sort("links"), F.col("text"), lambda t, x: F.replace(t, x["short"], x["target"]))
    return docs.join(known, "doc_id", "left").withColumn("text", F.when(F.col("links").isNull(), F.col("text")).otherwise(text)).drop("links")
