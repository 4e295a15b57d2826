"""Document fingerprints by winnowing, and what they say of each document's edit and successor.

A text's k-grams of code points are hashed by a polynomial rolling hash; of each window of w consecutive hashes the
smallest is kept, the rightmost of equal ones, once with its position. Two texts that share a passage of at least
w + k - 1 code points share a fingerprint there; matches shorter than k are never seen. A text of fewer than k code
points is one gram, one of fewer than w hashes one window, an empty one has no fingerprint.

A fingerprint is written as hexadecimal: 8 digits of hash and 8 of position for each kept gram, in order. Likeness is
the Jaccard coefficient of the sets of hashes; 1 if both are empty.

Null texts count as empty, null keys come last in descending order, equal keys are ordered by text; repeated rows are
documents each, so that the next of one may be its copy. An empty table gives no rows, a single document is its own next.
Very long texts are fingerprinted whole. Columns beside key and text are not carried along, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm._arrays import slices
from loomtext.llm._held import release
from loomtext.runtime import ship

#: Code points in a gram, hashes in a window: matches of K + W - 1 = 64 code points are found.
K, W = 16, 49
#: Odd factor of the rolling hash and of the final mixing; fixed for good, as fingerprints are compared.
FACTOR, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
PIECE_BYTES = 4 << 20


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hashes of all k-grams: sums of code points times powers of FACTOR, built by doubling, then mixed."""
    n = len(points) - k + 1
    if n < 1:
        return gram_hashes(points, len(points)) if len(points) else np.zeros(0, np.uint32)
    mask = (1 << 64) - 1
    power, size, bits = points.astype(np.uint64) + np.uint64(1), 1, bin(k)[3:]
    ones = power
    for bit in bits:
        power = power[: len(power) - size] * np.uint64(pow(FACTOR, size, 1 << 64)) + power[size:]
        size *= 2
        if bit == "1":
            power = power[: len(power) - 1] * np.uint64(FACTOR & mask) + ones[size:][: len(power) - 1]
            size += 1
    power = power[:n]
    power ^= power >> np.uint64(32)
    power *= np.uint64(MIX)
    return (power >> np.uint64(32)).astype(np.uint32)


def winnow(points: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes and their positions."""
    hashes = gram_hashes(points, k)
    n = len(hashes)
    if not n:
        return hashes, np.zeros(0, np.uint32)
    last = np.uint64(0xFFFFFFFF)
    best = hashes.astype(np.uint64) << np.uint64(32) | (last - np.arange(n, dtype=np.uint64))  # a later position is less
    w, size = min(w, n), 1
    while size < w:
        step = min(size, w - size)
        best = np.minimum(best[: len(best) - step], best[step:])
        size += step
    best = best[np.append(True, best[1:] != best[:-1])]
    return (best >> np.uint64(32)).astype(np.uint32), (last - (best & last)).astype(np.uint32)


def text_of(hashes: np.ndarray, places: np.ndarray) -> str:
    return np.stack((hashes, places), 1).astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard coefficient of two sorted sets of hashes; 1 if both are empty."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _fingerprints(key: str, k: int, w: int, batches):
    release()
    for batch in batches:
        for piece in slices(batch, batch.schema.names[1], PIECE_BYTES):
            texts = [text_of(*winnow(points_of(t.as_py() or ""), k, w)) for t in piece.column(1)]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(texts, pa.string())], names=[key, "fingerprint"])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Rows (key, fingerprint)."""
    ship(df.sparkSession)
    return df.select(key, text).mapInArrow(partial(_fingerprints, key, k, w), f"`{key}` {df.schema[key].dataType.simpleString()}, fingerprint string")


_EDIT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
EDIT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edits(k: int, w: int, batches):
    """Of ordered rows (doc_id, text, guest): a row for all but guests, each with the row after it."""
    ahead, out, size = None, [], 0

    def row(this, after):
        key, text, hashes, fingerprint, marks = this
        half = len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        if edited == text:
            edited_fingerprint, edited_marks = fingerprint, marks
        else:
            kept = winnow(points_of(edited), k, w)
            edited_fingerprint, edited_marks = text_of(*kept), np.unique(kept[0])
        return (key, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint, edited_fingerprint, likeness(marks, edited_marks), likeness(marks, after[4]))

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _EDIT, strict=True)], schema=pa.schema(_EDIT))

    for batch in batches:
        for key, text, guest in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            text = text.as_py() or ""
            kept = winnow(points_of(text), k, w)
            this = (key.as_py(), text, kept[0], text_of(*kept), np.unique(kept[0]))
            if ahead is not None:
                out.append(row(ahead, this))
                size += 2 * len(text)
            ahead = None if guest.as_py() else this
            if size > PIECE_BYTES:
                yield batch_of(out)
                out, size = [], 0
    if ahead is not None:  # alone in all: it follows itself
        out.append(row(ahead, ahead))
    if out:
        yield batch_of(out)


def edits(df: DataFrame, parts: int, key: str = "doc_id", text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Rows of EDIT: each document with its text edited by the next one's beginning, in descending order of the key.

    One shuffle of the texts: rows are dealt out by ranges of the key, and the first row of each range is sent to the
    range before it as well, as a guest. Range bounds and first rows are a few numbers per partition.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = sorted(set(rows.select("doc_id").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    bounds = [int(b) for b in bounds]
    # Range 0 holds the greatest keys; null keys are in the last range, after all others.
    place = F.lit(len(bounds)) - (F.expr(f"size(filter(array({','.join(f'{b}L' for b in bounds)}), b -> b < doc_id))") if bounds else F.lit(0))
    place = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(place).cast("int")
    rows = rows.withColumn("range", place)
    first = {r["range"]: r for r in rows.groupBy("range").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).collect()}
    if not first:
        return spark.createDataFrame([], EDIT)
    used = sorted(first)
    # Of the rows with a range's greatest key, the one with the greatest text comes first.
    back = {(used[i], first[used[i]]["doc_id"]): used[i - 1] for i in range(len(used))}
    pairs = F.create_map(*[x for (r, _), before in back.items() for x in (F.lit(r), F.lit(before))])
    heads = F.create_map(*[x for (r, d), _ in back.items() for x in (F.lit(r), F.lit(d).cast("bigint"))])
    head = F.col("doc_id").eqNullSafe(heads[F.col("range")])
    many = rows.withColumn("to", F.explode(F.when(head, F.array(F.col("range"), pairs[F.col("range")])).otherwise(F.array(F.col("range")))))
    if len(used) == 1:
        many = rows.withColumn("to", F.explode(F.when(head, F.array("range", F.lit(-1))).otherwise(F.array("range"))))
        many = many.withColumn("guest", F.col("to") < 0).withColumn("to", F.lit(used[0]))
    else:
        many = many.withColumn("guest", F.col("to") != F.col("range"))
    places = F.create_map(*[x for i, r in enumerate(used) for x in (F.lit(r), F.lit(i))])
    dealt = many.repartitionById(len(used), places[F.col("to")])
    ordered = dealt.sortWithinPartitions("to", "guest", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    return ordered.select("doc_id", "text", "to", "guest").mapInArrow(partial(_edits_by_range, k, w), EDIT)


def _edits_by_range(k: int, w: int, batches):
    """Several ranges may share a task: each is handled on its own, and only the first of its guests counts."""
    release()

    def pieces():
        for batch in batches:
            to = batch.column(2).to_numpy(zero_copy_only=False)
            guest = batch.column(3).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((to[1:] != to[:-1]) | (guest[1:] != guest[:-1])) + 1).tolist(), len(to)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    yield int(to[a]), bool(guest[a]), batch.slice(a, b - a)

    stream = pieces()
    held = next(stream, None)
    while held is not None:
        to = held[0]

        def own(to=to):
            nonlocal held
            guests = 0
            while held is not None and held[0] == to:
                if not held[1]:
                    yield pa.RecordBatch.from_arrays([held[2].column(0), held[2].column(1), held[2].column(3)], names=["a", "b", "c"])
                elif not guests:
                    guests = 1
                    one = held[2].slice(0, 1)
                    yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), one.column(3)], names=["a", "b", "c"])
                held = next(stream, None)

        yield from _edits(k, w, own())


