"""Connectors put before the readers: what is fetched, by which URL, and what becomes of the answers.

Every function takes items (doc_id, url) and a connector, and gives rows of the reader behind it; items whose answer fails
keep their row with an error where the reader has one. Nothing is fetched until a sink asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import is_link_only, urls
from loomtext.functions.urls import canonical_post_url, is_feed_url, mirror_url, paper_id, post_id
from loomtext.operators import images as I
from loomtext.operators import relational as R
from loomtext.plans.config import Config
from loomtext.sources import connectors, structured, threads, web

# Services and their addresses.
PAPER_API = "https://export.arxiv.org/api/query?id_list="
SYNDICATION = "https://cdn.syndication.twimg.com/tweet-result?token=x&id="
EMBED = "https://publish.twitter.com/oembed?omit_script=true&url="


def _asked(items: DataFrame, url: Column, connector: connectors.Connector, cfg: Config, kind: str = "html", retries: int | None = None) -> DataFrame:
    """Items with what their own URL's service answers: (doc_id, url, answer, content, error_type, error_message)."""
    rows = items.select("doc_id", F.col("url").alias("item"), url.alias("url"))
    got = connectors.fetched(rows.where("url IS NOT NULL"), connector, cfg.network.retries if retries is None else retries, float(cfg.network.backoff_base), kind)
    got = got.select("doc_id", F.col("html").alias("answer"), "content", "error_type", "error_message")
    return rows.select("doc_id", F.col("item").alias("url")).join(got, "doc_id", "left")


def articles(items: DataFrame, connector: connectors.Connector, cfg: Config = Config()) -> DataFrame:
    """Pages (doc_id, url, html) for plans.pipelines.pages; those that can't be had carry an error."""
    return _asked(items, F.col("url"), connector, cfg).select("doc_id", "url", F.col("answer").alias("html"), "error_type", "error_message")


def papers(items: DataFrame, connector: connectors.Connector, cfg: Config = Config()) -> DataFrame:
    """What the papers' API tells of items whose URL names a paper, as rows of structured.papers."""
    rows = _asked(items, F.concat(F.lit(PAPER_API), paper_id("url")), connector, cfg).where(paper_id("url").isNotNull())
    told = structured.papers(rows.select("doc_id", F.coalesce("answer", F.lit("<feed/>")).alias("xml")))
    return told.join(rows.select("doc_id", F.col("error_type").alias("fault")), "doc_id").withColumn("error_type", F.coalesce("fault", "error_type")).drop("fault")


def pdf_files(items: DataFrame, connector: connectors.Connector, cfg: Config = Config()) -> DataFrame:
    """PDF files (doc_id, content) of items; a paper's page leads to its file."""
    from loomtext.functions.urls import paper_pdf_url

    return _asked(items, paper_pdf_url("url"), connector, cfg, "pdf").select("doc_id", "url", "content", "error_type", "error_message")


def feeds(items: DataFrame, connector: connectors.Connector, tool: connectors.Tool, cfg: Config = Config()) -> DataFrame:
    """Episodes of feeds (url): RSS, else a video tool's lines, else the URL itself."""
    urls_of = items.select(F.col("url").alias("doc_id"), "url").distinct()
    # Without prefer_rss, only URLs that look like feeds are read as such.
    rss_of = urls_of if cfg.podcast.prefer_rss else urls_of.where(is_feed_url(F.lower("url")))
    rss = _asked(rss_of, F.col("url"), connector, cfg, retries=1).select("doc_id", F.coalesce("answer", F.lit("")).alias("xml"))
    lines = connectors.video_metadata(urls_of, tool, whole=True).select("doc_id", F.coalesce("json", F.lit("")).alias("text"))
    return structured.resolved_feeds(urls_of, rss, lines, cfg.podcast.max_episodes)


def videos(items: DataFrame, tool: connectors.Tool) -> DataFrame:
    """Video items (pos, url) without blanks and comments, playlists and channels put in full, each URL once."""
    clean = items.withColumn("url", F.trim("url")).where("url <> '' AND NOT startswith(url, '#')")
    many = F.contains("url", F.lit("playlist")) | F.contains("url", F.lit("/c/")) | F.contains("url", F.lit("/channel/")) | F.contains("url", F.lit("/@"))
    lists = clean.where(many).select(F.col("url").alias("doc_id"), "url").distinct()
    lines = connectors.video_metadata(lists, tool, whole=True).where("json IS NOT NULL")
    return R.expanded(clean, structured.playlist_entries(lines.select("doc_id", F.col("json").alias("text"))))


def subtitles(items: DataFrame, tool: connectors.Tool, cfg: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(metadata, subtitle files) of video items, for plans.pipelines.videos: the track is chosen first and fetched alone."""
    from loomtext.operators import cues as C

    meta = connectors.video_metadata(items, tool)
    chosen = C.select_track(structured.tracks_of(meta.where("json IS NOT NULL")), cfg.subtitles.lang, cfg.subtitles.prefer_auto)
    files = connectors.subtitle_files(chosen.where("lang IS NOT NULL").join(items.select("doc_id", "url"), "doc_id"), tool)
    return meta, files.where("path IS NOT NULL").select("doc_id", "path", "text", "lang", "is_auto")


def syndicated(items: DataFrame, connector: connectors.Connector, cfg: Config = Config()) -> DataFrame:
    """Answers (doc_id, url, json) of the syndication service, asked once."""
    rows = _asked(items, F.concat(F.lit(SYNDICATION), post_id(canonical_post_url("url"))), connector, cfg, retries=1)
    return rows.select("doc_id", "url", F.col("answer").alias("json"))


def embedded(items: DataFrame, connector: connectors.Connector, cfg: Config = Config()) -> DataFrame:
    rows = _asked(items, F.concat(F.lit(EMBED), F.url_encode(canonical_post_url("url"))), connector, cfg, retries=1)
    return rows.where("answer IS NOT NULL").select("doc_id", "url", F.col("answer").alias("json"))


def mirrored(items: DataFrame, connector: connectors.Connector, cfg: Config = Config()) -> DataFrame:
    """Pages (doc_id, url, html) of the first mirror, in their order, that has the post."""
    out = None
    for place, instance in enumerate((cfg.twitter.nitter_instance, *cfg.twitter.nitter_fallback_instances)):
        rows = _asked(items, mirror_url(canonical_post_url("url"), f"https://{instance}"), connector, cfg).select("doc_id", "url", F.col("answer").alias("html"), F.lit(place).alias("place"))
        rows = rows.join(threads.threads(rows.select("doc_id", "url", "html")).where("error_type IS NULL").select("doc_id"), "doc_id", "left_semi")
        out = rows if out is None else out.unionByName(rows)
    first = Window.partitionBy("doc_id").orderBy("place")
    return out.withColumn("r", F.row_number().over(first)).where("r = 1").select("doc_id", "url", "html")


def linked_pages(texts: DataFrame, connector: connectors.Connector, cfg: Config = Config()) -> DataFrame:
    """Of posts (doc_id, text) that are links alone, the first page with sections: (doc_id, title, sections)."""
    links = texts.where("text <> ''").where(is_link_only("text")).select("doc_id", F.posexplode(urls("text")).alias("pos", "url"))
    items = links.select(F.struct("doc_id", "pos").alias("doc_id"), "url")
    got = _asked(items, F.col("url"), connector, cfg).where("answer IS NOT NULL")
    read = web.articles(got.select("doc_id", "url", F.col("answer").alias("html")), 0).where(F.size("sections") > 0)
    best = F.min_by(F.struct("title", "sections"), "doc_id.pos").alias("best")
    return read.groupBy(F.col("doc_id.doc_id").alias("doc_id")).agg(best).select("doc_id", "best.title", "best.sections")


def images(rows: DataFrame, connector: connectors.Connector, least_bytes: int = 5000) -> DataFrame:
    """Pictures (doc_id, seq, src, ...) with their bytes and format; each URL is asked once, and small files are dropped."""
    wanted = rows.select(F.col("src").alias("doc_id"), F.col("src").alias("url")).distinct()
    got = connectors.fetched(wanted, connector, 1, kind="image").select(F.col("doc_id").alias("src"), F.col("content").alias("image_bytes"))
    return web.images_with_bytes(rows, got, least_bytes).withColumn("media_type", I.media_type("format"))


def rendered(items: DataFrame, recorded: DataFrame) -> DataFrame:
    """What a browser has recorded of posts, for structured.posts: notes (doc_id, note), and nodes (doc_id, pos, type, cls, text,
    src, width, height) of articles as sections. A renderer's rows stand in for the browser itself."""
    blocks = structured.block_sections(structured.dom_items(recorded))
    one = F.array_sort(F.collect_list(F.struct(F.col("seq").cast("bigint").alias("seq"), "heading", F.col("level").cast("int").alias("level"), "body"))).alias("sections")
    found = blocks.groupBy("doc_id").agg(one, F.min_by("heading", F.when(F.col("heading") != "", F.col("seq"))).alias("title"))
    return items.select("doc_id").join(found, "doc_id").select("doc_id", "title", F.lit(None).cast("string").alias("note"), "sections")
