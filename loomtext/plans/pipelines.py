"""From raw tables to documents, by kind of content. Nothing runs until a sink asks.

Each plan keeps a row for every item: what fails says so in error_type and error_message and stops no other item.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.dates import format_duration
from loomtext.functions.text import has_math
from loomtext.functions.urls import paper_id, paper_pdf_url
from loomtext.operators import anchors as A
from loomtext.operators import cues as C
from loomtext.operators import images as I
from loomtext.operators import layout as L
from loomtext.operators import sections as S
from loomtext.plans import render
from loomtext.plans.config import Config, enabled
from loomtext.sources import files as files_of
from loomtext.sources import structured, subtitles, threads, web

def _text(cfg: Config) -> dict:
    return {"gap": cfg.text.paragraph_gap_seconds, "sentences": cfg.text.sentence_break_count, "cjk_threshold": cfg.text.cjk_threshold}


def _with_error(rows: DataFrame, kind: str) -> DataFrame:
    """An empty body is an error; an earlier one stays."""
    old = F.col("error_type") if "error_type" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("error_type", F.coalesce(old, F.when(F.col("body").isNull(), kind))).withColumn("body", F.coalesce("body", F.lit("")))


def videos(meta: DataFrame, files: DataFrame, cfg: Config = Config(), asr: DataFrame | None = None) -> DataFrame:
    """Metadata (doc_id, json) and subtitle files (doc_id, path, text, is_auto[, lang]) to documents; asr cues (cue rows with
    language) where a video has no subtitles.

    Of several files of a video the one of the chosen track is read. Lines that roll on are dropped from automatic tracks."""
    info = structured.video_info(meta)
    if "lang" not in files.columns:
        files = files.withColumn("lang", F.regexp_extract("path", r"\.([A-Za-z][A-Za-z0-9-]*)\.[A-Za-z]+\z", 1))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1
    tracks = files.withColumn("pos", place).join(info.select("doc_id", F.col("language").alias("declared")), "doc_id", "left")
    chosen = C.select_track(tracks, cfg.subtitles.lang, cfg.subtitles.prefer_auto).where("error_type IS NULL").select("doc_id", "lang", "is_auto")
    files = files.join(chosen, ["doc_id", "lang", "is_auto"], "left_semi")
    flags = ["is_auto", "sub_language", "is_asr"]
    raw = subtitles.parse_subtitles(files.withColumn("sub_language", F.col("lang")).withColumn("is_asr", F.lit(False)), keep=tuple(flags))
    clean = C.clean_cues(raw)
    cues = C.drop_rolling_lines(clean.where("is_auto")).unionByName(clean.where("NOT is_auto"))
    if asr is not None:
        heard = asr.join(cues.select("doc_id").distinct(), "doc_id", "left_anti")
        language = F.col("language") if "language" in asr.columns else F.lit(None).cast("string")
        cues = cues.unionByName(heard.withColumns({"is_auto": F.lit(False), "is_asr": F.lit(True), "sub_language": language}).select(*cues.columns))
    chapters = structured.chapters_of(info)
    if cfg.flags.no_chapters:
        chapters = chapters.where("false")
        info = info.withColumn("chapters", F.slice("chapters", 1, 0))
    # Without chapters all cues are of chapter 0, so one pass gives the texts of both kinds of videos.
    aligned = C.align_to_chapters(cues.select("doc_id", "seq", "start_seconds", "end_seconds", "text", *flags), chapters)
    texts = C.cues_to_text(aligned, ("doc_id", "chapter_idx", *flags), **_text(cfg))
    told = texts.groupBy("doc_id", *flags).agg(F.map_from_entries(F.collect_list(F.struct("chapter_idx", "body"))).alias("texts"))
    rows = info.join(told, "doc_id", "left")
    rows = rows.withColumn("body", F.when(F.col("texts").isNotNull(), F.when(F.size("chapters") > 0, render.chapters_text("chapters", "texts")).otherwise(F.try_element_at("texts", F.lit(0))))).drop("texts")
    rows = _with_error(rows, "NoSubtitlesError").withColumn("content_type", F.lit("youtube"))
    return rows.withColumn("markdown", render.transcript(rows, cfg.flags.include_description))


def podcasts(episodes: DataFrame, asr: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Episodes (rows of feed_episodes or resolved_feeds) and cues of their audio (audio_url, seq, ...) to documents. Cues are
    not cleaned; of episodes with one audio file the last tells about it."""
    last = episodes.groupBy("audio_url").agg(F.max_by(F.struct(*(c for c in episodes.columns if c not in ("audio_url", "doc_id"))), F.struct("doc_id", "pos")).alias("e"))
    rows = last.select(F.col("audio_url").alias("doc_id"), "audio_url", "e.*")
    body = C.cues_to_text(asr.withColumnRenamed("audio_url", "doc_id"), **_text(cfg))
    rows = rows.join(body, "doc_id", "left").withColumn("duration_text", format_duration("duration"))
    rows = _with_error(rows, "WhisperError").withColumn("content_type", F.lit("podcast"))
    return rows.withColumn("markdown", render.podcast(rows, cfg.flags.include_description))


def pages(html: DataFrame, cfg: Config = Config(), described: DataFrame | None = None, density: bool = False) -> DataFrame:
    """Pages (doc_id, url, html) to documents: one pass of the reader over each page, all else in its row. described:
    descriptions (doc_id, seq, anchor_text, description) of pictures, put after their anchors. density: pages without an
    element for their article are read by density and without their host's frame, for which hashes are counted."""
    found = web.articles(html, cfg.articles.min_content_length, density, cfg.articles.include_tables)
    if described is not None:
        found = A.insert_at_anchors(found, described).drop("image_places")
    found = found.drop("images").withColumn("body", S.body_text("sections")).withColumn("content_type", F.lit("article"))
    return found.withColumn("markdown", render.article(found, cfg.flags.include_description))


def paper_texts(spans: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Positioned spans (doc_id, page, x0, y0, x1, y1, text) of PDF pages to texts for papers(), by the settings
    pdf.reading_order and pdf.max_pages."""
    return L.page_texts(spans, cfg.pdf.reading_order, cfg.pdf.max_pages)


def papers(texts: DataFrame, properties: DataFrame, api: DataFrame | None = None, cfg: Config = Config(), descriptions: DataFrame | None = None) -> DataFrame:
    """Layout converters' Markdown (doc_id, text[, url]) and properties (doc_id, json) to documents; api: rows of
    structured.papers, which win where they say something. Words are counted before descriptions take the place of markers."""
    sections = S.without_references(S.markdown("text")) if cfg.pdf.strip_references else S.markdown("text")
    url = F.col("url") if "url" in texts.columns else F.lit(None).cast("string")
    rows = texts.select("doc_id", url.alias("url"), (F.length(F.trim("text")) < cfg.pdf.min_content_length).alias("short"), sections.alias("sections"))
    rows = rows.withColumns({"word_count": S.words("sections", False), "has_math": has_math(F.array_join(F.transform("sections", lambda s: s["body"]), "\n")), "first_heading": S.first_heading("sections", "Untitled PDF")})
    if descriptions is not None:
        rows = I.with_descriptions(rows, descriptions)
    rows = rows.withColumn("own_abstract", S.abstract("sections")).withColumn("sections", S.without_abstract("sections"))
    rows = rows.join(structured.pdf_properties(properties), "doc_id").withColumn("title", F.coalesce(render.nonempty("title"), "first_heading"))
    none = F.lit(None)
    if api is not None:
        names = ("title", "authors", "abstract", "publish_date", "doi", "categories", "language")
        known = api.where("error_type IS NULL").select("doc_id", *(F.col(c).alias(f"api_{c}") for c in names), F.lit(True).alias("known"))
        rows = rows.join(known, "doc_id", "left")
        rows = rows.withColumns({c: F.when(F.col("known"), F.col(f"api_{c}")).otherwise(F.col(c) if c in ("title", "authors", "publish_date") else none) for c in names if c != "abstract"})
        rows = rows.withColumn("abstract", F.coalesce(render.nonempty("api_abstract"), "own_abstract")).drop("known", *(f"api_{c}" for c in names))
    else:
        rows = rows.withColumns({"abstract": F.col("own_abstract"), "doi": none.cast("string"), "language": none.cast("string"), "categories": none.cast("array<string>")})
    rows = rows.withColumns({"paper_id": paper_id("url"), "pdf_url": paper_pdf_url("url"), "error_type": F.when(F.col("short"), "PDFExtractionError"), "body": S.body_text("sections"), "content_type": F.lit("pdf")})
    return rows.drop("short", "own_abstract", "first_heading").withColumn("markdown", render.paper(rows, cfg.pdf.include_abstract))


def local_files(files: DataFrame, cfg: Config = Config(), descriptions: DataFrame | None = None) -> DataFrame:
    """Scanned files (doc_id, path, content, modified) to documents."""
    own = cfg.local_files
    rows = files_of.local_documents(files, own.detect_txt_headings, own.include_tables, own.include_speaker_notes, own.min_content_length)
    if descriptions is not None:
        rows = I.with_descriptions(rows, descriptions)
    rows = rows.withColumn("body", S.body_text("sections")).withColumn("content_type", F.lit("local_file"))
    return rows.withColumn("markdown", render.article(rows, cfg.flags.include_description, content_type="local_file"))


def social(items: DataFrame, syndicated: DataFrame, embedded: DataFrame | None = None, pages: DataFrame | None = None, rendered: DataFrame | None = None, linked: DataFrame | None = None, cfg: Config = Config()) -> DataFrame:
    """Posts (doc_id, url) from the answers of three services: syndication (doc_id, url, json), oEmbed (the same) and mirrors'
    pages (doc_id, url, html), the first that has the post."""
    spark = items.sparkSession
    none = lambda column: spark.createDataFrame([], f"doc_id {items.schema['doc_id'].dataType.simpleString()}, url string, {column} string")
    first = syndicated if cfg.twitter.syndication_enabled else syndicated.where("false")
    found = structured.post_cascade(
        items, structured.posts(first, rendered, linked, bool(cfg.auth.cookies)), structured.embedded_posts(none("json") if embedded is None else embedded, linked), threads.threads(none("html") if pages is None else pages)
    )
    found = found.withColumn("body", S.body_text("sections")).withColumn("content_type", F.lit("twitter"))
    return found.withColumn("markdown", render.post(found))


def run(items: DataFrame, plans: dict[str, Callable[[DataFrame], DataFrame]], cfg: Config = Config()) -> DataFrame:
    """Routed items (pos, url, content_type, type_rank) through the plan of their kind, in the order of kinds and items.

    A plan takes items (doc_id, url) and gives documents. An item for which it gives none, or whose kind has no plan or is
    switched off, keeps its row with an error, so that no item is lost and none stops another."""
    columns = ("title", "publish_date", "markdown", "error_type", "error_message")
    kinds, out = enabled(cfg), None
    for kind, plan in plans.items():
        if kind not in kinds:
            continue
        made = plan(items.where(F.col("content_type") == kind).select(F.col("pos").alias("doc_id"), "url"))
        made = made.select("doc_id", *(F.col(c) if c in made.columns else F.lit(None).cast("string").alias(c) for c in columns))
        out = made if out is None else out.unionByName(made)
    rows = items if out is None else items.join(out.withColumnRenamed("doc_id", "pos"), "pos", "left")
    if out is None:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in columns})
    lost = F.col("markdown").isNull() & F.col("error_type").isNull()
    off = ~F.col("content_type").isin(*[k for k in plans if k in kinds])
    rows = rows.withColumn("error_message", F.when(lost, F.when(off, "this kind of content is switched off").otherwise("nothing was extracted")).otherwise(F.col("error_message")))
    return rows.withColumn("error_type", F.when(lost, "PipelineError").otherwise(F.col("error_type"))).orderBy("type_rank", "pos")


def preview_videos(meta: DataFrame, most: int = 10) -> DataFrame:
    """What a dry run tells of videos: languages of subtitles too, the first ten of automatic ones."""
    keys = lambda k: F.coalesce(F.json_object_keys(F.get_json_object("json", f"$.{k}")), F.array().cast("array<string>"))
    more = meta.select("doc_id", F.filter(keys("subtitles"), lambda k: k != "live_chat").alias("manual"), keys("automatic_captions").alias("auto"))
    info = structured.video_info(meta).select("doc_id", "title", "channel", "publish_date", "duration_text", F.coalesce(F.nullif("language", F.lit("")), F.lit("unknown")).alias("language"), F.size("chapters").alias("chapters"))
    return info.join(more, "doc_id").select(*info.columns, "manual", F.slice("auto", 1, most).alias("auto"), (F.size("auto") > most).alias("more_auto"))


def preview_articles(html: DataFrame) -> DataFrame:
    rows = web.articles(html)
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown"))
    return rows.select("doc_id", "url", known("title").alias("title"), known("author").alias("author"), known("site_name").alias("site"), known("publish_date").alias("date"), known("language").alias("language"))


def preview_papers(items: DataFrame, api: DataFrame, most: int = 5) -> DataFrame:
    """Papers by what the API tells, the first five authors; other PDF files by their URL alone."""
    n = F.size("authors")
    authors = F.concat(F.array_join(F.slice("authors", 1, most), ", "), F.when(n > most, F.concat(F.lit(" et al. ("), n.cast("string"), F.lit(" total)"))).otherwise(""))
    told = api.where("error_type IS NULL").select("doc_id", "title", authors.alias("authors"), F.col("publish_date").alias("date"), F.array_join("categories", ", ").alias("categories"), "doi")
    return items.select("doc_id", "url", paper_id("url").alias("paper_id"), F.when(paper_id("url").isNotNull(), paper_pdf_url("url")).alias("pdf_url")).join(told, "doc_id", "left")


def preview_files(listing: DataFrame) -> DataFrame:
    """Rows (path, length) of a listing; no file is opened."""
    return listing.select(F.regexp_extract("path", r"([^/\\]*)\z", 1).alias("file"), "path", F.format_number("length", 0).alias("bytes"), files_of.suffix().alias("format"))


def preview_podcasts(episodes: DataFrame, most: int = 5) -> DataFrame:
    """Feeds with their number of episodes and the first five, by title and duration."""
    line = F.struct("pos", F.concat("title", F.lit(" ("), format_duration("duration"), F.lit(")")).alias("line"))
    rows = episodes.groupBy("doc_id").agg(F.min_by("show_name", "pos").alias("feed"), F.count(F.lit(1)).alias("episodes"), F.array_sort(F.collect_list(line)).alias("lines"))
    return rows.select("doc_id", "feed", "episodes", F.transform(F.slice("lines", 1, most), lambda x: x["line"]).alias("first"), F.greatest(F.col("episodes") - most, F.lit(0)).alias("more"))


def preview_posts(posts: DataFrame, most: int = 120) -> DataFrame:
    return posts.select("doc_id", "author", "author_name", "publish_date", "thread_length", "word_count", F.left("title", F.lit(most)).alias("preview"))


def preview(documents: DataFrame) -> DataFrame:
    """What any dry run tells: no column that needs the text, so that scans are pruned."""
    return documents.select(*(c for c in ("doc_id", "content_type", "title", "url", "publish_date", "word_count", "error_type") if c in documents.columns))
