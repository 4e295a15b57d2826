"""Incremental forms: the same transformations over arriving files and events."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, schema: str, form: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(form).load(path)


def into_table(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Each batch through a batch plan, written once: a batch that is tried again replaces its own folder. Rows that later
    ones replace go to a ledger.LatestTable instead."""

    def each(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage(stream: DataFrame, ts: str, amount: str, length: str = "60 seconds", slide: str = "1 second", late: str = "5 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Sums and counts of sliding windows, for limits on use."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, length, slide), *by).agg(F.sum(amount).alias("used"), F.count(F.lit(1)).alias("requests"))


def sessions(stream: DataFrame, ts: str, by: str, gap: str = "4 seconds", late: str = "5 minutes") -> DataFrame:
    """Events of a key without a longer gap between them."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count(F.lit(1)).alias("n"))


def first_seen(stream: DataFrame, ts: str, *keys: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def rolling_lines(stream: DataFrame) -> DataFrame:
    """Arriving cues (doc_id, seq, text) without the lines that the cue before also has, joined by spaces; empty ones go.

    The state of a document is the text of its last cue, so a cue that comes in a later batch is compared with it. Cues of a
    batch are taken in the order of seq; between batches they must arrive in it."""

    def each(key, frames, state):
        before = set(state.get[0].split("\n")) if state.exists else set()
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for doc_id, seq, text in zip(rows["doc_id"], rows["seq"], rows["text"], strict=True):
            lines = text.split("\n")
            fresh = " ".join(x for x in lines if x not in before)
            before = set(lines)
            if fresh:
                out.append((doc_id, seq, fresh))
        state.update((rows["text"].iloc[-1],))
        yield pd.DataFrame(out, columns=["doc_id", "seq", "text"])

    kind = stream.schema["doc_id"].dataType.simpleString()
    cues = stream.where("text IS NOT NULL").select("doc_id", "seq", "text")
    return cues.groupBy("doc_id").applyInPandasWithState(each, f"doc_id {kind}, seq bigint, text string", "last string", "append", "NoTimeout")
