"""Functions that SQL lacks, and the engine's own, registered in a session."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomtext import patterns as P
from loomtext.functions.text import _normalised, _unescaped
from loomtext.operators.chunks import split_at_punctuation
from loomtext.runtime import ship


class SplitText:
    def eval(self, text: str, size: int):
        for i, piece in enumerate(split_at_punctuation(text or "", size, 0)):
            yield i, piece["chunk"]


class MarkdownSections:
    """Sections of a Markdown text, as operators.sections.markdown has them without the cleaning of PDF text."""

    def eval(self, text: str):
        heading, level, body, found = "", 2, [], []
        for line in [*re.sub("\r\n?", "\n", text or "").split("\n"), None]:
            opened = re.match(r"(#{1,6})\s+([^\n]+)\Z", line) if line is not None else None
            if line is None or opened:
                found.append((heading, level, re.sub("\n{3,}", "\n\n", "\n".join(body).strip()).strip()))
            if opened:
                heading, level, body = opened.group(2).strip(), len(opened.group(1)), []
            elif line is not None:
                body.append(line)
        least = min((lv for h, lv, b in found if h), default=0)
        for i, (h, lv, b) in enumerate(found):
            if h or b:
                yield i, h, lv + 1 if h and least == 1 else lv, b


#: Functions that are plain expressions over SQL's own.
EXPRESSIONS = {
    "format_duration(s BIGINT)": "CASE WHEN s >= 3600 THEN concat(s div 3600, ':', lpad((s div 60) % 60, 2, '0')) ELSE CAST(s div 60 AS STRING) END || ':' || lpad(s % 60, 2, '0')",
    "classify_url(u STRING)": "{kinds}",
    "estimate_tokens(t STRING)": "greatest(1, length(t) div 4)",
    "escape_yaml(t STRING)": "replace(replace(t, chr(92), concat(chr(92), chr(92))), '\"', concat(chr(92), '\"'))",
}


def _kinds() -> str:
    x = "lower(trim(u))"
    some = lambda parts: "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"
    post = f"{some(P.POST_HOSTS)} AND contains({x}, '/status/')"
    feed = f"{some(P.FEED_STRONG)} OR ({some(P.FEED_WEAK)} AND {some(P.FEED_WORDS)})"
    return f"CASE WHEN {some(P.VIDEO)} THEN 'youtube' WHEN {some(P.PAPER)} OR endswith({x}, '.pdf') THEN 'pdf' WHEN {post} THEN 'twitter' WHEN {some(P.PODCAST)} OR {feed} THEN 'podcast' ELSE 'article' END"


def register(spark: SparkSession) -> None:
    """html_unescape(text), nfkc(text), the functions of EXPRESSIONS, and the table functions split_text(text, size) and
    markdown_sections(text)."""
    ship(spark)
    spark.udf.register("html_unescape", F.pandas_udf(_unescaped, "string"))
    spark.udf.register("nfkc", F.pandas_udf(_normalised, "string"))
    spark.udtf.register("split_text", F.udtf(SplitText, returnType="chunk_no int, chunk string"))
    spark.udtf.register("markdown_sections", F.udtf(MarkdownSections, returnType="seq bigint, heading string, level int, body string"))
    for name, body in EXPRESSIONS.items():
        kind = "STRING" if "STRING)" in name and "tokens" not in name else "STRING" if "duration" in name else "BIGINT"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {kind} RETURN {body.format(kinds=_kinds()) if '{kinds}' in body else body}")
