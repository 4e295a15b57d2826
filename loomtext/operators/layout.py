"""Reading order of a page's spans by recursive cuts.

Rows (doc_id, page, x0, y0, x1, y1, text), with y from the top down. A set of spans is cut where its projection on one of
the axes leaves the widest gap: rows from the top down, columns from left to right, rows first where both gaps are equally
wide; and so on within each part. All gaps of that axis as wide as the widest are cut at once, so that a column's lines
need one step. What has no gap is read from the top down, then from left to right. So columns are read one after the
other, and what stands across all columns parts them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.runtime import ship

_BOX = ("x0", "y0", "x1", "y1")


def _gaps(low: np.ndarray, high: np.ndarray) -> tuple[float, np.ndarray | None]:
    """The widest gap of a projection, and the part that each interval lies in if it is cut at all gaps as wide; 0 if none."""
    order = np.argsort(low, kind="stable")
    reach = np.maximum.accumulate(high[order])
    gap = low[order][1:] - reach[:-1]
    if not len(gap) or (widest := float(gap.max())) <= 0:
        return 0.0, None
    part = np.empty(len(low), np.int64)
    part[order] = np.concatenate([[0], np.cumsum(gap >= widest)])
    return widest, part


def cut_order(boxes: np.ndarray) -> np.ndarray:
    """Places of boxes (n, 4) in reading order, from 0."""
    out: list[int] = []
    waiting = [np.arange(len(boxes))]
    while waiting:
        here = waiting.pop()
        if len(here) == 1:
            out.append(int(here[0]))
            continue
        b = boxes[here]
        (wide_x, parts_x), (wide_y, parts_y) = _gaps(b[:, 0], b[:, 2]), _gaps(b[:, 1], b[:, 3])
        part = parts_x if wide_x > wide_y else parts_y
        if part is None:
            out += here[np.lexsort((here, b[:, 0], b[:, 1]))].tolist()
        elif len(here) == part.max() + 1:
            out += here[np.argsort(part)].tolist()
        else:
            waiting += np.split(here[np.argsort(part, kind="stable")], np.cumsum(np.bincount(part))[:-1])[::-1]
    place = np.empty(len(boxes), np.int64)
    place[out] = np.arange(len(boxes))
    return place


def _places(pages: pa.Array) -> pa.Array:
    spans = pages.flatten()
    boxes = np.column_stack([spans.field(c).to_numpy(zero_copy_only=False) for c in _BOX]) if len(spans) else np.empty((0, 4))
    ends = np.cumsum([0, *pages.value_lengths().fill_null(0).to_pylist()])
    places = [cut_order(boxes[a:b]) for a, b in zip(ends[:-1], ends[1:])]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*places, np.empty(0, np.int64)]), pa.int64()))


def _pages(spans: DataFrame, max_pages: int) -> DataFrame:
    """Rows (doc_id, page, spans): a page's spans in an order that does not depend on how rows are dealt."""
    whole = F.coalesce(*(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in _BOX[:1]), F.lit(False))
    for c in _BOX[1:]:
        whole = whole & F.coalesce(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), F.lit(False))
    kept = spans.where(whole & F.col("text").isNotNull())
    kept = kept.where(F.col("page") < max_pages) if max_pages else kept
    one = F.struct(*(F.col(c).cast("double").alias(c) for c in ("y0", "x0", "y1", "x1")), "text")
    return kept.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(one)).alias("spans"))


def page_texts(spans: DataFrame, reading_order: str = "xycut", max_pages: int = 0, between: str = "\n") -> DataFrame:
    """Rows (doc_id, text): documents' spans in reading order, page after page, counted from 0.

    reading_order "off" leaves spans from the top down and left to right. With max_pages, only so many pages are read.
    Spans with a null or NaN side, or without text, are left out; equal spans are each read.
    """
    if reading_order not in ("xycut", "off"):
        raise ValueError(f"reading_order is xycut or off, not {reading_order!r}")
    ship(spans.sparkSession)
    pages = _pages(spans, max_pages)
    if reading_order == "xycut":
        boxes = F.transform("spans", lambda s: F.struct(*(s[c].alias(c) for c in _BOX)))
        pages = pages.withColumn("places", F.arrow_udf(_places, "array<bigint>")(boxes))
        ordered = F.array_sort(F.transform("spans", lambda s, i: F.struct(F.get("places", i).alias("place"), s["text"].alias("text"))))
    else:
        ordered = F.col("spans")
    text = F.array_join(F.transform(ordered, lambda s: s["text"]), between)
    pages = pages.select("doc_id", "page", text.alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), between).alias("text"))
