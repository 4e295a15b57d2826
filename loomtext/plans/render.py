"""Documents as Markdown with front matter, one string per row.

A document is a list of lines in the order and wording that readers of these files know: front matter, title, a quoted
line of metadata, a notice, the description folded away, then headed sections. Columns that a frame lacks count as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import col, escape_yaml

# The notices and the words that stand for missing text.
NOTICE_ASR = "*Transcribed from audio using Whisper — may contain errors.*"
NOTICE_AUTO = "*Auto-generated transcript — may contain errors.*"
NOTICE_MATH = "*This paper contains mathematical notation that may not render perfectly in extracted text.*"
NO_CHAPTER, NO_TRANSCRIPT = "*(No transcript for this section)*", "*(No transcript text extracted)*"
NO_SECTION, NO_POST = "*(No content for this section)*", "*(No content)*"


def front_matter(fields: dict[str, Column], plain: tuple[str, ...] = ()) -> Column:
    """Lines between `---`; fields that are null are left out, those in `plain` are not quoted."""
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v.cast("string")) if k in plain else F.concat(F.lit(f'{k}: "'), escape_yaml(v.cast("string")), F.lit('"'))
    lines = F.filter(F.array(*(line(k, v) for k, v in fields.items())), lambda x: x.isNotNull())
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---"))


def nonempty(x) -> Column:
    return F.nullif(col(x), F.lit(""))


def authors_line(authors: str = "authors") -> Column:
    """The first three authors, and how many there are if there are more; null for none."""
    n = F.size(authors)
    return F.when(n > 3, F.concat(F.array_join(F.slice(authors, 1, 3), ", "), F.lit(" et al. ("), n.cast("string"), F.lit(" authors)"))).when(n > 0, F.array_join(authors, ", "))


def section_lines(sections, empty: str = NO_SECTION) -> Column:
    """Headings as `#` lines of at most six, bodies below or what stands for none, in order."""
    head = lambda s: F.when(s["heading"] != "", F.concat(F.repeat(F.lit("#"), F.least(s["level"], F.lit(6))), F.lit(" "), s["heading"]))
    each = lambda s: F.concat_ws("\n\n", head(s), F.when(s["body"] != "", s["body"]).otherwise(empty))
    return F.array_join(F.transform(col(sections), each), "\n\n")


def chapters_text(chapters, texts) -> Column:
    """A heading per chapter, empty ones too, from an array of chapters and a map from their places to texts."""
    text = lambda i: F.coalesce(nonempty(F.try_element_at(col(texts), i)), F.lit(NO_CHAPTER))
    return F.array_join(F.transform(col(chapters), lambda c, i: F.concat(F.lit("## "), F.coalesce(c["title"], F.lit("")), F.lit("\n\n"), text(i))), "\n\n")


def details(title: str, text: Column) -> Column:
    """A text folded away; null for none."""
    return F.concat(F.lit(f"<details>\n<summary>{title}</summary>\n\n"), nonempty(text), F.lit("\n\n</details>"))


def told(*parts: Column) -> Column:
    """A quoted line of those parts that aren't null."""
    return F.concat(F.lit("> "), F.concat_ws(" | ", *parts))


def _document(head: Column, title: Column, *parts: Column) -> Column:
    return F.concat(F.concat_ws("\n\n", head, F.concat(F.lit("# "), title), *(nonempty(p) for p in parts)), F.lit("\n"))


def _get(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _flag(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def transcript(df: DataFrame, description: bool = False, polished: bool = False) -> Column:
    """Videos: columns title, url, channel, publish_date, sub_language, duration_text, is_auto, is_asr, description, body."""
    asr, auto = _flag(_get(df, "is_asr", "boolean")), _flag(_get(df, "is_auto", "boolean"))
    fields = {
        "title": F.col("title"), "url": _get(df, "url"), "channel": _get(df, "channel"), "date": F.col("publish_date"), "language": _get(df, "sub_language"), "duration": _get(df, "duration_text"),
        "auto_generated": auto, "whisper_transcribed": F.when(asr, F.lit(True)), "content_type": F.lit("transcript"), "polished": F.lit(polished),
    }
    line = F.concat(F.lit("> Channel: "), _get(df, "channel"), F.lit(" | Date: "), F.col("publish_date"), F.lit(" | Duration: "), _get(df, "duration_text"))
    about = details("Video Description", _get(df, "description")) if description else F.lit(None).cast("string")
    notice = F.when(asr, NOTICE_ASR).when(auto, NOTICE_AUTO)
    return _document(front_matter(fields, ("auto_generated", "whisper_transcribed", "polished")), F.col("title"), line, notice, about, F.coalesce(nonempty("body"), F.lit(NO_TRANSCRIPT)))


def podcast(df: DataFrame, description: bool = False, polished: bool = False) -> Column:
    """Episodes: columns title, show_name, episode_number, url, publish_date, duration_text, language, description, body."""
    show, number = nonempty(_get(df, "show_name")), nonempty(_get(df, "episode_number"))
    fields = {
        "title": F.col("title"), "show_name": _get(df, "show_name"), "episode_number": _get(df, "episode_number"), "url": _get(df, "url"), "date": F.col("publish_date"), "duration": _get(df, "duration_text"),
        "language": _get(df, "language"), "whisper_transcribed": F.lit(True), "content_type": F.lit("podcast"), "polished": F.lit(polished),
    }
    line = told(F.concat(F.lit("Show: "), show), F.concat(F.lit("Episode: "), number), F.concat(F.lit("Date: "), F.col("publish_date")), F.concat(F.lit("Duration: "), _get(df, "duration_text")))
    about = details("Episode Description", _get(df, "description")) if description else F.lit(None).cast("string")
    return _document(front_matter(fields, ("whisper_transcribed", "polished")), F.col("title"), line, F.lit(NOTICE_ASR), about, F.coalesce(nonempty("body"), F.lit(NO_TRANSCRIPT)))


def article(df: DataFrame, description: bool = False, polished: bool = False, content_type: str = "article") -> Column:
    """Articles and local files: columns title, url, author, site_name, publish_date, language, word_count, sections."""
    author, site = nonempty(_get(df, "author")), nonempty(_get(df, "site_name"))
    fields = {
        "title": F.col("title"), "url": _get(df, "url"), "author": author, "site_name": site, "date": F.col("publish_date"), "language": _get(df, "language"), "word_count": F.col("word_count"),
        "content_type": F.lit(content_type), "polished": F.lit(polished),
    }
    line = told(F.concat(F.lit("Author: "), author), F.concat(F.lit("Site: "), site), F.concat(F.lit("Date: "), F.col("publish_date")), F.concat(F.col("word_count").cast("string"), F.lit(" words")))
    about = details("Article Description", _get(df, "description")) if description else F.lit(None).cast("string")
    return _document(front_matter(fields, ("word_count", "polished")), F.col("title"), line, about, section_lines("sections"))


def paper(df: DataFrame, with_abstract: bool = True, polished: bool = False) -> Column:
    """Papers: columns title, url, pdf_url, authors, publish_date, paper_id, doi, categories, language, page_count,
    word_count, has_math, abstract, sections."""
    listed = lambda c: nonempty(F.array_join(_get(df, c, "array<string>"), ", "))
    math = _flag(_get(df, "has_math", "boolean"))
    fields = {
        "title": F.col("title"), "url": _get(df, "url"), "pdf_url": _get(df, "pdf_url"), "authors": listed("authors"), "date": F.col("publish_date"), "arxiv_id": _get(df, "paper_id"), "doi": _get(df, "doi"),
        "categories": listed("categories"), "language": _get(df, "language"), "pages": F.col("page_count"), "word_count": F.col("word_count"), "content_type": F.lit("paper"), "has_math": math, "polished": F.lit(polished),
    }
    size = F.concat(F.col("page_count").cast("string"), F.lit(" pages | "), F.col("word_count").cast("string"), F.lit(" words"))
    line = told(F.concat(F.lit("Authors: "), authors_line()), F.concat(F.lit("Date: "), F.col("publish_date")), F.concat(F.lit("arXiv: "), nonempty(_get(df, "paper_id"))), size)
    abstract = F.concat(F.lit("## Abstract\n\n"), nonempty("abstract")) if with_abstract else F.lit(None).cast("string")
    return _document(front_matter(fields, ("pages", "word_count", "has_math", "polished")), F.col("title"), line, F.when(math, NOTICE_MATH), abstract, section_lines("sections"))


def post(df: DataFrame, polished: bool = False) -> Column:
    """Posts and threads: columns title, url, author, author_name, publish_date, word_count, is_thread, thread_length,
    tweet_subtype, sections."""
    thread, length = _flag(_get(df, "is_thread", "boolean")), F.coalesce(_get(df, "thread_length", "int"), F.lit(1))
    fields = {
        "title": F.col("title"), "url": _get(df, "url"), "author": F.col("author"), "author_name": _get(df, "author_name"), "date": F.col("publish_date"), "word_count": F.col("word_count"), "is_thread": thread,
        "thread_length": length, "tweet_subtype": F.nullif(_get(df, "tweet_subtype"), F.lit("tweet")), "content_type": F.lit("tweet"), "polished": F.lit(polished),
    }
    name = F.concat(F.lit("Author: "), F.coalesce("author", F.lit("")), F.lit(" ("), F.coalesce(_get(df, "author_name"), F.lit("")), F.lit(")"))
    line = told(name, F.concat(F.lit("Date: "), F.col("publish_date")), F.concat(F.col("word_count").cast("string"), F.lit(" words")))
    notice = F.when(thread, F.concat(F.lit("*Thread ("), length.cast("string"), F.lit(" posts)*")))
    return _document(front_matter(fields, ("word_count", "is_thread", "thread_length", "polished")), F.col("title"), line, notice, section_lines("sections", NO_POST))
