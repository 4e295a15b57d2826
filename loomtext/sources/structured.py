"""JSON, XML and text formats with a schema: feeds, papers, posts, video metadata, cookies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.dates import UNKNOWN, feed_date, feed_duration, format_duration, pdf_date, post_date, upload_date
from loomtext.functions.text import collapse, is_link_only, make_title, strip, unescape_html, word_count
from loomtext.functions.urls import canonical_post_url
from loomtext.operators import sections as S
from loomtext.operators.images import marker

# A post as the syndication service tells it; all four spellings of the long note are read.
_NOTE = "id:string,note_tweet_results:struct<result:struct<text:string>>,noteTweetResults:struct<result:struct<text:string>>"
POST = (
    "__typename string, user struct<screen_name:string,name:string>, created_at string, text string, lang string, "
    f"note_tweet struct<{_NOTE}>, noteTweet struct<{_NOTE}>, tombstone struct<text:struct<text:string>>, "
    "article struct<title:string,preview_text:string,rest_id:string>, mediaDetails array<struct<type:string,media_url_https:string>>, photos array<string>"
)
SECTIONS = "array<struct<seq:bigint,heading:string,level:int,body:string>>"
VIDEO = (
    "id string, title string, webpage_url string, original_url string, channel string, uploader string, upload_date string, duration double, language string, description string, "
    "chapters array<struct<title:string,start_time:double,end_time:double>>"
)
PDF = "number_of_pages int, title string, author string, creation_date string"


#: What is read of Atom answers and of RSS feeds, tags by their local names. Tags that may come more than once are arrays, so
#: that the first can be taken.
ATOM = (
    "entry array<struct<id:array<string>,title:array<string>,author:array<struct<name:array<string>>>,summary:array<string>,published:array<string>,"
    "category:array<struct<_term:string>>,doi:array<string>>>"
)
RSS = (
    "channel struct<title:array<string>,language:array<string>,item:array<struct<title:array<string>,description:array<string>,summary:array<string>,episode:array<string>,pubDate:array<string>,duration:array<string>,"
    "link:array<struct<_VALUE:string,_href:string,_type:string>>,enclosure:array<struct<_url:string,_type:string>>>>>"
)
_AS_IS = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"}


def _parsed(xml: Column, schema: str) -> Column:
    """One parse of a text; nulls where it is no XML. Undeclared prefixes are cut from tags first."""
    return F.from_xml(F.regexp_replace(xml, r"(</?)[A-Za-z][\w.-]*:", "$1"), schema, _AS_IS)


def papers(xml: DataFrame) -> DataFrame:
    """Atom answers (doc_id, xml) as papers: the first entry; an entry that tells an error carries it, as does an answer
    that is no XML. Each answer is parsed once."""
    rows = xml.select("doc_id", F.get(_parsed(F.col("xml"), ATOM)["entry"], F.lit(0)).alias("e"))
    text = lambda n: F.coalesce(strip(collapse(F.get(f"e.{n}", F.lit(0)))), F.lit(""))
    some = lambda xs: F.coalesce(F.filter(xs, lambda x: x.isNotNull()), F.array().cast("array<string>"))
    error = F.col("e").isNull() | F.contains(text("id"), F.lit("api/errors"))
    return rows.select(
        "doc_id", F.coalesce(F.nullif(text("title"), F.lit("")), F.lit("Untitled")).alias("title"), some(F.transform("e.author", lambda a: F.get(a["name"], F.lit(0)))).alias("authors"), text("summary").alias("abstract"),
        F.coalesce(F.nullif(F.left(text("published"), F.lit(10)), F.lit("")), F.lit(UNKNOWN)).alias("publish_date"), some(F.transform("e.category", lambda c: c["_term"])).alias("categories"), F.nullif(text("doi"), F.lit("")).alias("doi"),
        F.lit("en").alias("language"), F.when(error, "ArxivAPIError").alias("error_type"),
    )


def feed_episodes(feeds: DataFrame, limit: int = 10) -> DataFrame:
    """RSS texts (doc_id, xml) as episodes: the first `limit` items (0: all), of which those without audio are then dropped.
    Each text is parsed once; of one that is no XML there are none.

    Audio is the first enclosure of an audio type or suffix, else the first link of an audio type."""
    rows = feeds.select("doc_id", _parsed(F.col("xml"), RSS)["channel"].alias("c"))
    items = F.slice("c.item", 1, limit) if limit else F.col("c.item")
    head = lambda n: F.coalesce(F.get(f"c.{n}", F.lit(0)), F.lit(""))
    rows = rows.select("doc_id", head("title").alias("show_name"), head("language").alias("language"), F.posexplode(items).alias("pos", "i"))
    audio = lambda kind: F.startswith(F.coalesce(kind, F.lit("")), F.lit("audio/"))
    enclosed = F.filter("i.enclosure", lambda e: audio(e["_type"]) | F.coalesce(e["_url"].rlike(r"\.(?:mp3|m4a|ogg|wav|aac)\z"), F.lit(False)))
    linked = F.filter("i.link", lambda x: audio(x["_type"]))
    rows = rows.withColumn("audio_url", F.coalesce(F.nullif(F.get(enclosed, F.lit(0))["_url"], F.lit("")), F.get(linked, F.lit(0))["_href"]))
    get = lambda n: F.nullif(strip(F.get(f"i.{n}", F.lit(0))), F.lit(""))
    link = F.nullif(strip(F.get("i.link", F.lit(0))["_VALUE"]), F.lit(""))
    described = F.coalesce(get("description"), get("summary"), F.lit(""))
    return rows.where("audio_url <> ''").select(
        "doc_id", "pos", F.coalesce(get("title"), F.lit("Untitled Episode")).alias("title"), F.coalesce(F.nullif("show_name", F.lit("")), F.lit("Unknown Podcast")).alias("show_name"), get("episode").alias("episode_number"),
        F.coalesce(link, "audio_url").alias("url"), "audio_url", feed_date(get("pubDate")).alias("publish_date"), feed_duration(get("duration")).alias("duration"), F.nullif("language", F.lit("")).alias("language"), described.alias("description"),
    )


ENTRY = "title string, series string, album string, channel string, episode_number string, webpage_url string, original_url string, url string, id string, upload_date string, duration double, language string, description string"


def ndjson(answers: DataFrame, schema: str, text: str = "text") -> DataFrame:
    """Lines of answers (doc_id, text) as rows (doc_id, pos, line, x); blank lines and those that are no JSON object go."""
    rows = answers.select("doc_id", F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", strip("line"))
    good = F.coalesce(F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT"), F.lit(False))
    return rows.where("line <> ''").where(good).withColumn("x", F.from_json("line", schema))


def first_line(text) -> Column:
    """The first line of an answer, where only that counts."""
    return F.substring_index(F.col(text) if isinstance(text, str) else text, "\n", 1)


def tool_episodes(answers: DataFrame, limit: int = 10) -> DataFrame:
    """A video tool's lines (doc_id, text), the first `limit` of them, as episodes. Defaults hold for missing keys only, and
    the show is the series, else the album, else the channel."""
    rows = ndjson(answers, ENTRY)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    if limit:
        rows = rows.where(F.col("n") <= limit)
    has = lambda k: F.array_contains(F.json_object_keys("line"), k)
    x = F.col("x")
    first = lambda default, *names: F.coalesce(*(F.when(has(n), F.struct(x[n].alias("v"))) for n in names), F.struct(default.cast("string").alias("v")))["v"]
    number = F.nullif(F.nullif(x["episode_number"], F.lit("")), F.lit("0"))
    return rows.select(
        "doc_id", (F.col("n") - 1).alias("pos"), first(F.lit("Untitled Episode"), "title").alias("title"), first(F.lit("Unknown Podcast"), "series", "album", "channel").alias("show_name"), number.alias("episode_number"),
        first(F.lit(""), "webpage_url", "original_url").alias("url"), first(F.col("doc_id").cast("string"), "url", "webpage_url").alias("audio_url"), upload_date(F.coalesce(x["upload_date"], F.lit(""))).alias("publish_date"),
        F.floor(F.coalesce(x["duration"], F.lit(0.0))).cast("bigint").alias("duration"), x["language"].alias("language"), first(F.lit(""), "description").alias("description"),
    )


def resolved_feeds(urls: DataFrame, feeds: DataFrame, tool: DataFrame, limit: int = 10) -> DataFrame:
    """Feeds (doc_id = their URL) as episodes: those of the RSS text, else those of the video tool's lines, else one episode
    that is the URL itself."""
    rss, entries = feed_episodes(feeds, limit), tool_episodes(tool, limit)
    entries = entries.join(rss.select("doc_id").distinct(), "doc_id", "left_anti")
    found = rss.unionByName(entries)
    none = urls.select("doc_id").join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    text, null = lambda x: F.lit(x), F.lit(None).cast("string")
    single = none.select(
        "doc_id", F.lit(0).alias("pos"), text("Episode").alias("title"), text("Podcast").alias("show_name"), null.alias("episode_number"), F.col("doc_id").alias("url"), F.col("doc_id").alias("audio_url"),
        text(UNKNOWN).alias("publish_date"), F.lit(0).cast("bigint").alias("duration"), null.alias("language"), text("").alias("description"),
    )
    return found.unionByName(single)


def playlist_entries(answers: DataFrame) -> DataFrame:
    """A playlist's lines (doc_id = its URL, text) as rows (url, n, entry_url, entry_id); entries without any URL go."""
    rows = ndjson(answers, "url string, webpage_url string, id string")
    entry = F.coalesce(F.nullif("x.url", F.lit("")), F.col("x.webpage_url"))
    return rows.select(F.col("doc_id").alias("url"), F.col("pos").alias("n"), entry.alias("entry_url"), F.coalesce("x.id", F.lit("")).alias("entry_id")).where("entry_url <> ''")


def video_info(meta: DataFrame) -> DataFrame:
    """Metadata (doc_id, json) with defaults. A default holds for a missing key only; JSON null stays null."""
    v = F.parse_json("json")
    missing = lambda k: F.get(F.json_object_keys("json"), 0).isNull() | ~F.array_contains(F.json_object_keys("json"), k)
    s = F.from_json("json", VIDEO)
    get = lambda k, default: F.when(missing(k), default).otherwise(s[k])
    return meta.select(
        "doc_id", get("id", F.lit("")).alias("video_id"), get("title", F.lit("Untitled")).alias("title"), F.when(missing("webpage_url"), get("original_url", F.lit(""))).otherwise(s["webpage_url"]).alias("url"),
        F.when(missing("channel"), get("uploader", F.lit("Unknown"))).otherwise(s["channel"]).alias("channel"), upload_date(s["upload_date"]).alias("publish_date"), F.coalesce(s["duration"], F.lit(0.0)).cast("int").alias("duration"), format_duration(F.coalesce(s["duration"], F.lit(0.0))).alias("duration_text"),
        s["language"].alias("language"), get("description", F.lit("")).alias("description"), F.coalesce(s["chapters"], F.array().cast("array<struct<title:string,start_time:double,end_time:double>>")).alias("chapters"), F.is_variant_null(v).alias("is_null"),
    )


def chapters_of(videos: DataFrame) -> DataFrame:
    return videos.select("doc_id", F.posexplode("chapters").alias("idx", "c")).select("doc_id", "idx", F.col("c.title").alias("title"), F.col("c.start_time").alias("start_seconds"), F.col("c.end_time").alias("end_seconds"))


def tracks_of(meta: DataFrame) -> DataFrame:
    """Rows (doc_id, declared, is_auto, pos, lang) of subtitle maps, in the order of their keys."""
    keys = lambda k: F.json_object_keys(F.get_json_object("json", f"$.{k}"))
    base = meta.select("doc_id", F.get_json_object("json", "$.language").alias("declared"), keys("subtitles").alias("m"), keys("automatic_captions").alias("a"))
    one = lambda c, auto: base.select("doc_id", "declared", F.lit(auto).alias("is_auto"), F.posexplode(c).alias("pos", "lang"))
    return one("m", False).unionByName(one("a", True))


def pdf_properties(rows: DataFrame) -> DataFrame:
    """A layout converter's properties (doc_id, json); what is missing or no JSON has its default."""
    p = F.from_json("json", PDF)
    authors = F.filter(F.transform(F.split(F.coalesce(p["author"], F.lit("")), ","), strip), lambda a: a != "")
    return rows.select("doc_id", F.coalesce(p["number_of_pages"], F.lit(0)).alias("page_count"), strip(F.coalesce(p["title"], F.lit(""))).alias("title"), authors.alias("authors"), pdf_date(F.coalesce(p["creation_date"], F.lit(""))).alias("publish_date"))


def page_range(most: int) -> str | None:
    """What a layout converter is asked for: the first pages by number, or null for all."""
    return ",".join(map(str, range(most))) if most > 0 else None


#: What a preview of a longer article says where the article itself could not be had.
PREVIEW_NOTE = "This is an X Article preview. Export cookies from Chrome and use --cookies cookies.txt for full content."
_POST_COLUMNS = ("doc_id", "url", "author", "author_name", "publish_date", "title", "sections", "word_count", "is_thread", "thread_length", "tweet_subtype", "error_type", "error_message")


def _section(heading: Column, body: Column, seq: int = 0) -> Column:
    return F.struct(F.lit(seq).cast("bigint").alias("seq"), heading.alias("heading"), F.lit(2).alias("level"), body.alias("body"))


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def note_text(p: Column) -> Column:
    """The long note, if it is longer than the text: the first of the four spellings that is."""
    text = F.coalesce(p["text"], F.lit(""))
    told = [p[a][b]["result"]["text"] for a in ("note_tweet", "noteTweet") for b in ("note_tweet_results", "noteTweetResults")]
    return F.coalesce(*(F.when(F.length(t) > F.length(text), t) for t in told))


def photos(p: Column) -> Column:
    """URLs of a post's photos: of its media those told to be photos, or else plain URLs."""
    media = F.coalesce(p["mediaDetails"], _empty("array<struct<type:string,media_url_https:string>>"))
    told = F.filter(F.transform(F.filter(media, lambda m: m["type"] == "photo"), lambda m: m["media_url_https"]), lambda u: u != "")
    return F.when(F.size(media) > 0, told).otherwise(F.coalesce(p["photos"], _empty("array<string>")))


def posts(rows: DataFrame, rendered: DataFrame | None = None, linked: DataFrame | None = None, cookies: bool = False) -> DataFrame:
    """Syndication answers (doc_id, url, json) as posts with sections.

    A full article if a browser has rendered it (`rendered`: doc_id, title, note, sections), else its preview, with a note
    if there were no cookies; else the page that a post of links alone leads to (`linked`: doc_id, title, sections); else
    the text, or the long note where it is longer. A deleted post says so and ends the cascade (`is_gone`).
    """
    df = rows.withColumn("p", F.from_json("json", POST))
    none = F.lit(None)
    df = df.join(rendered.select("doc_id", F.col("title").alias("r_title"), F.col("note").alias("r_note"), F.col("sections").alias("r_sections")), "doc_id", "left") if rendered is not None else df.withColumns({"r_title": none.cast("string"), "r_note": none.cast("string"), "r_sections": none.cast(SECTIONS)})
    df = df.join(linked.select("doc_id", F.col("title").alias("l_title"), F.col("sections").alias("l_sections")), "doc_id", "left") if linked is not None else df.withColumns({"l_title": none.cast("string"), "l_sections": none.cast(SECTIONS)})
    p, plain = F.col("p"), F.coalesce(F.col("p.text"), F.lit(""))
    has_id = F.coalesce(F.nullif(p["note_tweet"]["id"], F.lit("")), F.nullif(p["noteTweet"]["id"], F.lit(""))).isNotNull()
    note = F.coalesce(note_text(p), F.when(has_id & (F.length("r_note") > F.length(plain)), F.col("r_note")))
    title, preview = F.coalesce(p["article"]["title"], F.lit("")), F.coalesce(p["article"]["preview_text"], F.lit(""))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    df = df.withColumns({"note": note, "text": F.coalesce(note, plain), "a_title": title, "a_preview": preview})
    full = some("r_sections") & p["article"].isNotNull()
    short = p["article"].isNotNull() & ((F.col("a_title") != "") | (F.col("a_preview") != ""))
    led = (F.col("text") != "") & is_link_only("text") & some("l_sections")
    shown = F.array(_section(F.col("a_title"), F.col("a_preview")), _section(F.lit("Note"), F.lit(PREVIEW_NOTE), 1))
    shown = F.slice(shown, 1, 1) if cookies else shown
    own = F.when(F.col("text") != "", F.array(_section(F.lit(""), F.col("text")))).otherwise(_empty(SECTIONS))
    bodies = lambda c: S.body_text(c, False)
    first = lambda *x: F.coalesce(*(F.nullif(v, F.lit("")) for v in x), F.lit(""))
    gone = F.coalesce(p["__typename"] == "TweetTombstone", F.lit(False))
    broken = p.isNull() | F.coalesce(F.size(F.json_object_keys("json")) == 0, F.lit(True))
    said = F.coalesce(F.nullif(p["tombstone"]["text"]["text"], F.lit("")), F.lit("tombstoned"))
    handle = F.coalesce(F.nullif(p["user"]["screen_name"], F.lit("")))
    return df.select(
        "doc_id", canonical_post_url("url").alias("url"), F.coalesce(F.concat(F.lit("@"), handle), F.lit("")).alias("author"), F.coalesce(p["user"]["name"], handle, F.lit("")).alias("author_name"), post_date(F.coalesce(p["created_at"], F.lit(""))).alias("publish_date"),
        make_title(F.when(full, first("a_title", "r_title", bodies("r_sections"))).when(short, first("a_title", "a_preview")).when(led, first("l_title", bodies("l_sections"))).otherwise(F.col("text"))).alias("title"),
        F.when(full, F.col("r_sections")).when(short, shown).when(led, F.col("l_sections")).otherwise(own).alias("sections"),
        word_count(F.when(full, bodies("r_sections")).when(short, F.col("a_preview")).when(led, bodies("l_sections")).otherwise(F.col("text"))).alias("word_count"),
        F.lit(False).alias("is_thread"), F.lit(1).alias("thread_length"), F.when(full | short, "x_article").when(led | F.col("note").isNull(), "tweet").otherwise("note_tweet").alias("tweet_subtype"),
        F.when(gone | broken, "TweetFetchError").alias("error_type"), F.when(gone, F.concat(F.lit("Tweet deleted or unavailable: "), said)).when(broken, "Syndication API returned empty response").alias("error_message"),
        gone.alias("is_gone"), photos(p).alias("photos"), is_link_only("text").alias("link_only"), S.let(F.regexp_extract_all("text", F.lit(r"https?://\S+"), F.lit(0)), lambda u: u).alias("links"),
        ((word_count("text") < 50) & F.regexp_replace("text", r"\s+\z", "").rlike(r"(?:\.\.\.|…|https?://\S+)\z")).alias("maybe_cut"),
    )


def with_photo_markers(posts: DataFrame) -> DataFrame:
    """Markers of a post's photos after its last section's body, and images to fetch: (posts, rows doc_id, seq, src, position_marker)."""
    images = posts.where(F.size("sections") > 0).select("doc_id", F.posexplode("photos").alias("seq", "src")).withColumn("position_marker", marker())
    marks = images.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "position_marker"))), lambda x: x["position_marker"]).alias("marks"))
    rows = posts.join(marks, "doc_id", "left")
    body = F.concat_ws("\n\n", F.element_at("sections", -1)["body"], F.array_join("marks", "\n\n"))
    last = F.element_at("sections", -1)
    marked = F.concat(F.slice("sections", F.lit(1), F.size("sections") - 1), F.array(F.struct(last["seq"].alias("seq"), last["heading"].alias("heading"), last["level"].alias("level"), body.alias("body"))))
    return rows.withColumn("sections", F.when(F.col("marks").isNotNull(), marked).otherwise(F.col("sections"))).drop("marks"), images


def embedded_posts(rows: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """oEmbed answers (doc_id, url, json) as posts: the texts of the quoted paragraph, line by line, the handle and the date
    of the last link; the page that a post of links alone leads to (`linked`)."""
    get = lambda k: F.coalesce(F.get_json_object("json", f"$.{k}"), F.lit(""))
    df = rows.withColumn("quote", F.regexp_extract(get("html"), r"(?s)<blockquote[^>]*>(.*?)</blockquote>", 1))
    marked = F.regexp_replace(F.regexp_extract("quote", r"(?s)<p[^>]*>(.*?)</p>", 1), "<[^>]+>", "\x00")
    parts = F.filter(F.transform(F.split(unescape_html(marked), "\x00"), strip), lambda x: x != "")
    df = df.withColumn("text", F.array_join(parts, "\n"))
    if linked is None:
        df = df.withColumns({"l_title": F.lit(None).cast("string"), "l_sections": F.lit(None).cast(SECTIONS)})
    else:
        df = df.join(linked.select("doc_id", F.col("title").alias("l_title"), F.col("sections").alias("l_sections")), "doc_id", "left")
    handle = F.nullif(F.regexp_extract(get("author_url"), r"twitter\.com/(\w+)", 1), F.lit(""))
    links = F.regexp_extract_all("quote", F.lit(r"(?s)<a [^>]*>(.*?)</a>"), F.lit(1))
    date = F.regexp_extract(F.coalesce(F.try_element_at(links, F.lit(-1)), F.lit("")), r"(\w+ \d+, \d{4})", 1)
    led = (F.col("text") != "") & is_link_only("text") & F.coalesce(F.size("l_sections") > 0, F.lit(False))
    own = F.when(F.col("text") != "", F.array(_section(F.lit(""), F.col("text")))).otherwise(_empty(SECTIONS))
    body = S.body_text("l_sections", False)
    bad = F.get_json_object("json", "$").isNull()
    return df.select(
        "doc_id", canonical_post_url("url").alias("url"), F.coalesce(F.concat(F.lit("@"), handle), F.lit("")).alias("author"), get("author_name").alias("author_name"), post_date(date).alias("publish_date"),
        make_title(F.when(led, F.coalesce(F.nullif("l_title", F.lit("")), body)).otherwise(F.col("text"))).alias("title"), F.when(led, F.col("l_sections")).otherwise(own).alias("sections"),
        word_count(F.when(led, body).otherwise(F.col("text"))).alias("word_count"), F.lit(False).alias("is_thread"), F.lit(1).alias("thread_length"), F.lit("tweet").alias("tweet_subtype"),
        F.when(bad, "TweetFetchError").alias("error_type"), F.when(bad, "oEmbed returned no JSON").alias("error_message"),
    )


def post_cascade(items: DataFrame, syndicated: DataFrame, embedded: DataFrame, mirrored: DataFrame) -> DataFrame:
    """Items (doc_id, url) as posts: of the three sources (rows of posts, embedded_posts and threads) the first that has a
    post without error. A deleted post ends the search; where all fail, the message names each failure."""
    text = {"url", "author", "author_name", "publish_date", "title", "tweet_subtype", "error_type", "error_message"}
    kinds = {"sections": SECTIONS, "word_count": "bigint", "is_thread": "boolean", "thread_length": "int"} | dict.fromkeys(text, "string")
    post = lambda df, *more: df.select("doc_id", F.struct(*(F.col(c).cast(kinds[c]).alias(c) for c in _POST_COLUMNS[1:])).alias("post"), *more)
    df = items.select("doc_id", F.col("url").alias("item_url"))
    for i, (source, name) in enumerate(((syndicated, "Syndication"), (embedded, "oEmbed"), (mirrored, "Nitter"))):
        extra = post(source, *([F.col("is_gone").alias("gone")] if i == 0 else []))
        df = df.join(extra.withColumnRenamed("post", f"post{i}"), "doc_id", "left")
        df = df.withColumn(f"fault{i}", F.when(F.col(f"post{i}").isNull(), f"{name}: no answer").otherwise(F.concat(F.lit(f"{name}: "), F.col(f"post{i}.error_message"))))
    fine = lambda i: F.col(f"post{i}").isNotNull() & F.col(f"post{i}.error_type").isNull()
    gone = F.coalesce("gone", F.lit(False))
    best = F.when(gone | fine(0), F.col("post0")).when(fine(1), F.col("post1")).when(fine(2), F.col("post2"))
    failed = F.concat(F.lit("All tweet fetch methods failed for "), canonical_post_url("item_url"), F.lit(":\n  - "), F.concat_ws("\n  - ", "fault0", "fault1", "fault2"))
    df = df.select("doc_id", "item_url", best.alias("b"), failed.alias("failed"))
    own = {"url": F.coalesce("b.url", canonical_post_url("item_url")), "error_type": F.when(F.col("b").isNull(), "TweetFetchError").otherwise(F.col("b.error_type")), "error_message": F.when(F.col("b").isNull(), F.col("failed")).otherwise(F.col("b.error_message"))}
    return df.select("doc_id", *(own.get(c, F.col(f"b.{c}")).alias(c) for c in _POST_COLUMNS[1:]))


def dom_items(items: DataFrame) -> DataFrame:
    """Recorded nodes (doc_id, pos, type, cls, text, src, width, height) of an article's page as draft blocks (doc_id, pos,
    type, text, src). Images without source, data URIs, vector graphics and those small on both sides are dropped."""
    side = lambda c: (F.col(c) > 0) & (F.col(c) < 50)
    small = F.coalesce(side("width") & side("height"), F.lit(False))
    image = (F.col("src") != "") & ~F.startswith("src", F.lit("data:")) & ~F.endswith("src", F.lit(".svg")) & ~small
    rows = items.where((F.col("type") != "img") | image)
    kind = F.when(F.col("type") == "img", "image").otherwise(F.regexp_replace("cls", "^longform-", ""))
    rows = rows.select("doc_id", "pos", kind.alias("type"), "text", "src")
    return rows.withColumn("text", F.when(F.col("type") == "image", marker("doc_id", "pos")).otherwise(strip("text")))


def block_sections(items: DataFrame) -> DataFrame:
    """Draft blocks (doc_id, pos, type, text) as sections. Ordered items are numbered anew after anything but an image."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = items.where("type = 'image' OR trim(coalesce(text, '')) <> ''").withColumn("level", F.try_element_at(F.create_map(F.lit("header-one"), F.lit(1), F.lit("header-two"), F.lit(2), F.lit("header-three"), F.lit(3)), F.col("type")))
    rows = rows.withColumn("seq", F.sum(F.col("level").isNotNull().cast("int")).over(w)).withColumn("island", F.sum((~F.col("type").isin("ordered-list-item", "image")).cast("int")).over(w))
    number = F.sum((F.col("type") == "ordered-list-item").cast("int")).over(Window.partitionBy("doc_id", "island").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    line = F.when(F.col("type") == "ordered-list-item", F.concat(number.cast("string"), F.lit(". "), "text")).when(F.col("type") == "unordered-list-item", F.concat(F.lit("• "), "text")).otherwise(F.col("text"))
    rows = rows.withColumn("line", line)
    joined = F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("pos", "line")))), lambda x: x["line"])
    return rows.groupBy("doc_id", "seq").agg(F.coalesce(F.max(F.when(F.col("level").isNotNull(), F.col("text"))), F.lit("")).alias("heading"), F.coalesce(F.max("level"), F.lit(2)).alias("level"), F.array_join(joined, "\n\n").alias("body"))


def cookies(text: DataFrame, domain: str = ".x.com") -> DataFrame:
    """Netscape cookie lines (value) of a domain."""
    line = F.regexp_replace("value", "^#HttpOnly_", "")
    f = F.split(line, "\t")
    rows = text.select(F.startswith("value", F.lit("#HttpOnly_")).alias("http_only"), line.alias("line"), f.alias("f")).where(~F.startswith("line", F.lit("#")) & (F.size("f") >= 7))
    return rows.where(F.contains(F.col("f")[0], F.lit(domain))).select(F.col("f")[5].alias("name"), F.col("f")[6].alias("value"), F.col("f")[0].alias("domain"), F.col("f")[2].alias("path"), (F.upper(F.col("f")[3]) == "TRUE").alias("secure"), "http_only")
