"""WebVTT and SubRip files to cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext import patterns as P
from loomtext.functions.dates import seconds_of
from loomtext.functions.text import strip, unescape_html, universal_newlines


def _cues(files: DataFrame, vtt: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, seq, start_seconds, end_seconds, text, columns in `keep`). A stamp needs hours; a block's text follows its
    first stamp."""
    blocks = files.select("doc_id", *keep, vtt.alias("vtt"), F.posexplode(F.split(universal_newlines("text"), "\n\n+")).alias("seq", "block"))
    blocks = blocks.withColumn("lines", F.split(strip("block"), "\n"))
    head = F.col("lines")[0]
    blocks = blocks.where(~(F.col("vtt") & head.rlike("^(?:WEBVTT|NOTE|Kind:)")))
    stamp = F.transform("lines", lambda x: x.rlike(P.CUE_STAMP))
    rows = blocks.withColumn("at", F.array_position(stamp, F.lit(True)).cast("int")).where("at > 0")
    times = lambda i: seconds_of(F.regexp_extract(F.element_at("lines", F.col("at")), P.CUE_STAMP, i))
    text = F.array_join(F.slice("lines", F.col("at") + 1, F.greatest(F.size("lines") - F.col("at"), F.lit(0))), "\n")
    stamped = F.when(F.col("vtt"), F.regexp_replace(text, P.WORD_STAMP, "")).otherwise(text)
    rows = rows.select("doc_id", F.col("seq").cast("bigint"), times(1).alias("start_seconds"), times(2).alias("end_seconds"), F.regexp_replace(stamped, P.TAG, "").alias("text"), *keep)
    return rows.withColumn("text", strip(unescape_html(F.col("text")))).where("text <> ''")


def parse_vtt(files: DataFrame) -> DataFrame:
    return _cues(files, F.lit(True))


def parse_srt(files: DataFrame) -> DataFrame:
    return _cues(files, F.lit(False))


def parse_subtitles(files: DataFrame, path: str = "path", keep: tuple[str, ...] = ()) -> DataFrame:
    """By suffix; others as WebVTT, or as SubRip where that finds no cue. The grammars differ only in the blocks that WebVTT
    skips and in its word stamps, so one pass will do: a file of another suffix is WebVTT if any of its blocks is read so."""
    stamped = F.exists(F.split(universal_newlines("text"), "\n\n+"), lambda b: b.rlike(P.CUE_STAMP) & ~strip(b).rlike("^(?:WEBVTT|NOTE|Kind:)"))
    suffix = F.lower(F.col(path))
    return _cues(files, F.when(suffix.endswith(".srt"), False).when(suffix.endswith(".vtt"), True).otherwise(stamped), keep)
