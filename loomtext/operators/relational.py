"""Relational steps behind loops and look-ups: ordered distinct, limits, routing, cascades, usage windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext import patterns as P
from loomtext.functions.text import col, strip
from loomtext.functions.urls import classify_path, classify_url, strip_quotes


def ordered_distinct(df: DataFrame, *keys: str, pos: str = "pos") -> DataFrame:
    """The first row of each key, by position. Minimum of the position first, so that copies are combined map-side."""
    first = df.groupBy(*keys).agg(F.min(pos).alias(pos))
    return df.join(first, [*keys, pos], "left_semi")


def first_n(df: DataFrame, n: int, by: str, *order) -> DataFrame:
    """The first n rows of each group; 0 keeps all."""
    if not n:
        return df
    return df.withColumn("place_", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place_") <= n).drop("place_")


def input_list(text: DataFrame, keep_all: bool = True) -> DataFrame:
    """Rows (pos, url) of list files' texts, with the files' other columns: each line as it is. With keep_all=False, as for playlists and channels, lines
    are trimmed and blank ones and comments dropped."""
    rows = text.select(*(c for c in text.columns if c != "text"), F.posexplode(F.split(strip("text"), "\n")).alias("pos", "url"))
    return rows if keep_all else rows.withColumn("url", strip("url")).where("url <> '' AND NOT startswith(url, '#')")


def inputs(given: list[str], configured: list[str], spark, text: DataFrame | None = None) -> DataFrame:
    """Rows (pos, url): the given URLs, in their absence those of the settings, and then the lines of a list file."""
    first = given or configured
    rows = spark.createDataFrame(list(enumerate(first)), "pos int, url string")
    return rows if text is None else rows.unionByName(input_list(text).withColumn("pos", F.col("pos") + len(first)))


def expanded(items: DataFrame, entries: DataFrame) -> DataFrame:
    """Items (pos, url) of playlists and channels put in full by entries (url, n, entry_url, entry_id), recorded or fetched.

    An entry URL that isn't a watch page is built from its id; an item without entries stays as it is; of equal URLs the
    first is kept."""
    entry = F.when(F.contains("entry_url", F.lit("watch")), F.col("entry_url")).otherwise(F.concat(F.lit("https://www.youtube.com/watch?v="), "entry_id"))
    rows = items.join(entries.select("url", "n", entry.alias("entry")), "url", "left")
    rows = rows.select(F.struct("pos", F.coalesce("n", F.lit(0)).alias("n")).alias("pos"), F.coalesce("entry", "url").alias("url"))
    return rows.groupBy("url").agg(F.min("pos").alias("pos"))


def routed(items: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Items (pos, url) with content_type and the order in which types are handled. Paths count only if listed."""
    clean = items.withColumn("url", strip_quotes("url"))
    if listing is not None:
        there = listing.select(F.col("path").alias("url"), F.lit(True).alias("is_file")).distinct()
        clean = clean.join(there, "url", "left")
        kind = F.coalesce(F.when(F.col("is_file"), classify_path("url")), classify_url("url"))
    else:
        kind = classify_url("url")
    rank = F.array_position(F.array(*map(F.lit, P.TYPE_ORDER)), F.col("content_type"))
    return clean.withColumn("content_type", kind).withColumn("type_rank", rank.cast("int")).drop("is_file")


def type_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("content_type").agg(F.count(F.lit(1)).alias("n"))


def outcome_counts(items: DataFrame, *by: str) -> DataFrame:
    """How many items succeeded and failed, in all or for each value of some columns."""
    return items.groupBy(*by).agg(F.count_if(F.col("error_type").isNull()).alias("succeeded"), F.count_if(F.col("error_type").isNotNull()).alias("failed"))


def cascade(base: DataFrame, sources: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """For each key, each source's row only where none before has one."""
    rows = base
    for i, source in enumerate(sources):
        rows = rows.join(source.select(key, *(F.col(c).alias(f"{c}_{i}") for c in columns), F.lit(True).alias(f"has_{i}")), key, "left")
    pick = lambda c: reduce(lambda out, i: out.when(F.col(f"has_{i}"), F.col(f"{c}_{i}")), range(1, len(sources)), F.when(F.col("has_0"), F.col(f"{c}_0")))
    return rows.select(*base.columns, *(pick(c).alias(c) for c in columns))


def last_by_key(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Of rows with equal keys the last, as in a look-up table that later rows overwrite."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), pos).alias("r")).select(key, "r.*")


def usage_window(events: DataFrame, ts: str, amount: Column | str, seconds: float = 60.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Events with `used` and `requests`: sum and count over those less than `seconds` before, themselves included."""
    micros = int(seconds * 1_000_000) - 1
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*by).orderBy(at).rangeBetween(-micros, 0)
    return events.withColumn("used", F.sum(col(amount)).over(w)).withColumn("requests", F.count(F.lit(1)).over(w))


def with_errors(df: DataFrame, failed: Column, kind: str, message: Column | str) -> DataFrame:
    """Failing rows keep their place and say why; an earlier error stays."""
    text = F.lit(message) if isinstance(message, str) else message
    old = F.col("error_type") if "error_type" in df.columns else F.lit(None).cast("string")
    old_text = F.col("error_message") if "error_message" in df.columns else F.lit(None).cast("string")
    return df.withColumns({"error_message": F.coalesce(old_text, F.when(failed & old.isNull(), text)), "error_type": F.coalesce(old, F.when(failed, kind))})
