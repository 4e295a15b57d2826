"""URL and path classes, canonical forms and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext import patterns as P
from loomtext.functions.text import any_of, col, strip


def is_post_url(lower: Column) -> Column:
    return any_of(lower, P.POST_HOSTS) & F.contains(lower, F.lit("/status/"))


def is_feed_url(lower: Column) -> Column:
    return any_of(lower, P.FEED_STRONG) | (any_of(lower, P.FEED_WEAK) & any_of(lower, P.FEED_WORDS))


def classify_url(x) -> Column:
    """youtube, pdf, twitter, podcast or article, by ordered substring tests."""
    u = strip(F.lower(col(x)))
    return (
        F.when(any_of(u, P.VIDEO), "youtube").when(any_of(u, P.PAPER) | F.endswith(u, F.lit(".pdf")), "pdf").when(is_post_url(u), "twitter")
        .when(any_of(u, P.PODCAST) | is_feed_url(u), "podcast").otherwise("article")
    )


def classify_path(x) -> Column:
    """pdf, local_file or null, by suffix. Whether the path exists is told by a join with a listing."""
    suffix = F.lower(F.regexp_extract(col(x), r"(\.[^./\\]+)\z", 1))
    return F.when(suffix == ".pdf", "pdf").when(suffix.isin(*P.LOCAL_SUFFIXES), "local_file")


def strip_quotes(x) -> Column:
    """Without one pair of quotes, a raw prefix included."""
    x = strip(x)
    return F.when(x.rlike(r"""^r?"[\s\S]*"\z|^r?'[\s\S]*'\z"""), F.regexp_replace(x, r"""^r?["']([\s\S]*)["']\z""", "$1")).otherwise(x)


def canonical_post_url(x) -> Column:
    """One host for all mirrors, and none of the parameters that tell where a link came from."""
    s = F.regexp_replace(col(x), r"(?i)^https?://(?:www\.)?(?:(?:mobile\.)?twitter\.com|x\.com|nitter\.[^/]+)/", "https://x.com/")
    return F.regexp_replace(s, r"[?&](?:t|s|ref_src|ref_url|src)=[^&#]*", "")


def post_id(x) -> Column:
    return F.nullif(F.regexp_extract(col(x), "/status/([0-9]+)", 1), F.lit(""))


def mirror_url(x, instance: str) -> Column:
    return F.regexp_replace(col(x), r"^https?://(?:www\.)?(?:twitter|x)\.com/", instance.rstrip("/") + "/")


def paper_id(x) -> Column:
    return F.nullif(F.regexp_extract(col(x), P.PAPER_ID, 1), F.lit(""))


def paper_pdf_url(x) -> Column:
    return F.coalesce(F.concat(F.lit("https://arxiv.org/pdf/"), paper_id(x)), col(x))


def http_verdict(status: Column, exception: Column) -> Column:
    """What a failed request asks for: retry or fatal."""
    return F.when(status == 429, "retry").when((status >= 400) & (status < 500), "fatal").when((status >= 500) | exception.isin("connection", "timeout"), "retry").otherwise("fatal")
