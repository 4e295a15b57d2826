"""Subtitle cues: rows (doc_id, seq, start_seconds, end_seconds, text).

All operators order by seq within a document and share its partitioning, so a chain of them shuffles once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext import patterns as P
from loomtext.functions.text import collapse, strip


def _ordered(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy("seq")


def clean_cues(cues: DataFrame) -> DataFrame:
    """Single blanks, lines stripped, empty cues dropped."""
    lines = F.transform(F.split(collapse("text", r"[ \t]+"), "\n"), strip)
    return cues.withColumn("text", strip(F.array_join(lines, "\n"))).where("text <> ''")


def drop_rolling_lines(cues: DataFrame, by: str = "doc_id") -> DataFrame:
    """Lines that the cue just before also has are dropped, the rest joined by spaces; cues left empty are dropped."""
    lines = F.split("text", "\n")
    rows = cues.withColumn("lines", lines).withColumn("before", F.lag("lines").over(_ordered(by)))
    fresh = F.filter("lines", lambda x: ~F.array_contains(F.coalesce(F.col("before"), F.array().cast("array<string>")), x))
    return rows.withColumn("text", F.array_join(fresh, " ")).drop("lines", "before").where("text <> ''")


def align_to_chapters(cues: DataFrame, chapters: DataFrame) -> DataFrame:
    """Cues with chapter_idx: the last chapter that began before the cue or any cue before it; the first if none has.

    One union and one window instead of an inequality join: chapters and cues are put in one order by time and the
    last chapter seen is carried on.
    """
    upto = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    by_idx = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    starts = chapters.withColumn("at", F.when(F.min("idx").over(Window.partitionBy("doc_id")) == F.col("idx"), F.lit(float("-inf"))))
    later = F.max(F.when(F.col("at").isNull(), F.col("start_seconds"))).over(by_idx)
    starts = starts.select("doc_id", F.coalesce("at", later).alias("at"), F.lit(0).alias("is_cue"), F.lit(None).cast("long").alias("seq"), F.col("idx").alias("chapter_idx"), F.lit(None).cast(cues.select(F.struct("*")).schema[0].dataType).alias("cue"))
    keyed = cues.select("doc_id", F.max("start_seconds").over(upto).alias("at"), F.lit(1).alias("is_cue"), F.col("seq").cast("long"), F.lit(None).cast("int").alias("chapter_idx"), F.struct("*").alias("cue"))
    run = Window.partitionBy("doc_id").orderBy("at", "is_cue", F.coalesce("chapter_idx", F.lit(0)), "seq").rowsBetween(Window.unboundedPreceding, 0)
    both = starts.withColumn("chapter_idx", F.col("chapter_idx").cast("int")).unionByName(keyed)
    return both.withColumn("chapter_idx", F.coalesce(F.last("chapter_idx", ignorenulls=True).over(run), F.lit(0))).where("is_cue = 1").select("cue.*", "chapter_idx")


def paragraphs(cues: DataFrame, by: tuple[str, ...] = ("doc_id",), gap: float = 4.0, sentences: int = 6, cjk_threshold: float = 0.3, sample: int = 50) -> DataFrame:
    """Rows (by, seg, para, text, n_cues): cues joined, with a break before a gap and after so many sentence ends.

    Cues are joined without spaces where the first `sample` of them are CJK. Their characters are counted for these
    alone and summed by paragraph first, so that the window over all of a document moves two numbers for each."""
    w = _ordered(*by)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    early = F.row_number().over(w) <= sample
    rows = cues.withColumns({
        "gap": F.coalesce((F.col("start_seconds") - F.lag("end_seconds").over(w) > gap).cast("int"), F.lit(0)),
        "cjk": F.when(early, F.regexp_count("text", F.lit(P.CJK))), "solid": F.when(early, F.length(F.regexp_replace("text", P.WS, ""))),
        "ends": F.col("text").rlike(P.SENTENCE_END).cast("int"),
    })
    rows = rows.withColumn("seg", F.sum("gap").over(upto))
    before = _ordered(*by, "seg").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("para", F.floor(F.coalesce(F.sum("ends").over(before), F.lit(0)) / sentences))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    grouped = rows.groupBy(*by, "seg", "para").agg(joined.alias("t"), F.sum("cjk").alias("cjk"), F.sum("solid").alias("solid"), F.count(F.lit(1)).alias("n_cues"))
    every = Window.partitionBy(*by)
    dense = F.coalesce(F.sum("cjk").over(every) / F.nullif(F.sum("solid").over(every), F.lit(0)) > cjk_threshold, F.lit(False))
    return grouped.withColumn("dense", dense).select(*by, "seg", "para", F.when(F.col("dense"), F.array_join("t", "")).otherwise(F.array_join("t", " ")).alias("text"), "n_cues")


def cues_to_text(cues: DataFrame, by: tuple[str, ...] = ("doc_id",), **how) -> DataFrame:
    """Rows (by, body): paragraphs joined by blank lines."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seg", "para", "text"))), lambda x: x["text"])
    return paragraphs(cues, by, **how).groupBy(*by).agg(F.array_join(parts, "\n\n").alias("body"))


def select_track(tracks: DataFrame, forced: str | None = None, prefer_auto: bool = False) -> DataFrame:
    """Of (doc_id, declared, is_auto, pos, lang), each document's track: the forced language exactly or as a prefix, manual
    before automatic; else by preference the declared language exactly, as a prefix, or the first track there is.

    A document without a track that fits keeps its row, with an error and null lang."""
    wanted: Column = F.lit(forced) if forced else F.col("declared")
    exact, prefix = F.col("lang") == wanted, F.startswith("lang", wanted)
    match = F.when(exact, 0).when(prefix, 1)
    source = F.col("is_auto").cast("int")
    if not forced:
        match = F.coalesce(match, F.lit(2))
        source = 1 - source if prefer_auto else source
    fits = (F.col("lang") != "live_chat") & match.isNotNull()
    best = F.min(F.when(fits, F.struct(source.alias("source"), match.alias("match"), "pos", "lang", "is_auto"))).alias("best")
    rows = tracks.groupBy("doc_id").agg(best).select("doc_id", "best.lang", "best.is_auto")
    what = f"no subtitles in {forced}" if forced else "no subtitles"
    return rows.withColumns({"error_type": F.when(F.col("lang").isNull(), "NoSubtitlesError"), "error_message": F.when(F.col("lang").isNull(), what)})


def without_tracks(videos: DataFrame, tracks: DataFrame) -> DataFrame:
    """Documents (doc_id) that have no track at all, as rows of select_track."""
    none = videos.select("doc_id").join(tracks.select("doc_id"), "doc_id", "left_anti")
    return none.select("doc_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("boolean").alias("is_auto"), F.lit("NoSubtitlesError").alias("error_type"), F.lit("no subtitles").alias("error_message"))
