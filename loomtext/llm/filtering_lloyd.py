"""Vector code compression by filtering Lloyd: product codebooks, and codes of one entry for each part of a vector.

Components become integers floor(scale * x) and vectors are cut into equal consecutive parts. Every partition packs its
vectors in blocks and builds a kd-tree over each part of a block: halves by the widest side of the box, down to leaves
of a few points, with box, sum and count kept at every node. The trees are built once, stored, and gone through in each
round. Going down a tree, a node's box tells which entries can be nearest to any of its points: the entry nearest to the
box's middle is held against each other one at that corner of the box where the other does best, and an entry that loses
there is out for the whole subtree. Where one entry is left, all points below are its own, and the node's sum and count
go to it at once; leaves compare what is left. All numbers are integers, so sums, ties (to the lower index) and results
do not depend on how rows are dealt out.

A round brings to the driver one row for each entry of each part, a number set by `parts` and `entries` alone. Codes and
squared distances of a vector come from its block, without a shuffle.

Vectors that are null or hold null or non-finite components are left out. Vectors with another number of components than
the one of the smallest id keep their row, with null code and error. Null ids come last among those that begin the
codebooks; of equal ids, the smaller vector comes first. Repeated rows count each. With fewer vectors than entries there
are fewer entries. An empty table, or one in which no vector is kept, gives no rows. A number of components that the
parts do not divide, and components whose integer is over `limit` (2 ** 25 for four components and 64 entries), for which
numbers would not fit in 64 bits, are errors. Extra columns are not carried along.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm._held import release
from loomtext.runtime import drop_path, ship, stored

#: Vectors in a block, and points in a leaf of its trees at most.
BLOCK, LEAF = 8192, 8
#: Rows of label sums that are broadcast at most; beyond that they are joined by a shuffle.
SMALL = 50_000


@dataclass(frozen=True)
class Codebooks:
    """Entries (parts, entries, width) as integers, and the stored blocks that they were trained on."""

    entries: np.ndarray
    blocks: DataFrame | None
    path: str | None

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def drop(self, spark: SparkSession) -> None:
        """Delete the stored blocks."""
        if self.path:
            drop_path(spark, self.path)


def limit(width: int, entries: int) -> int:
    """Largest absolute integer of a component, so that what is compared stays below 2 ** 62."""
    return min((1 << 31) - 1, math.isqrt((1 << 58) // (width * entries)))


def usable(vector: str) -> Column:
    """A vector without null or non-finite components."""
    inf = F.lit(float("inf"))
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, lambda x: F.coalesce((F.abs(x) < inf) & ~F.isnan(x), F.lit(False))), F.lit(False))


# --- trees -------------------------------------------------------------------------------------------------------------


def levels_of(n: int, leaf: int = LEAF) -> int:
    """Levels below the root, so that no leaf has more than `leaf` points."""
    levels = 0
    while -(-n >> levels) > leaf:
        levels += 1
    return levels


def bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin in the order of points, and the end. Each level's are among the next one's."""
    return (np.arange((1 << level) + 1) * n) >> level


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trees over points (parts, n, width): order (parts, n), and low, high, sum (parts, nodes, width), nodes by level."""
    parts, n, width = points.shape
    levels = levels_of(n, leaf)
    order = np.tile(np.arange(n), (parts, 1))
    low, high = [], []
    for level in range(levels + 1):
        at = bounds(n, level)
        here = np.take_along_axis(points, order[:, :, None], 1)
        low.append(np.minimum.reduceat(here, at[:-1], 1))
        high.append(np.maximum.reduceat(here, at[:-1], 1))
        if level == levels:
            total = [np.add.reduceat(here, at[:-1], 1)]
            break
        size, node = np.diff(at), np.repeat(np.arange(1 << level), np.diff(at))
        widest = np.repeat(np.argmax(high[-1] - low[-1], 2), size, 1)
        side = np.take_along_axis(here, widest[:, :, None], 2)[:, :, 0] - here.min()
        order = np.take_along_axis(order, np.argsort((node << 32) + side, 1, "stable"), 1)
    while len(total) <= levels:
        total.append(total[-1][:, 0::2] + total[-1][:, 1::2])
    return order, np.concatenate(low, 1), np.concatenate(high, 1), np.concatenate(total[::-1], 1)


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span behind the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def _nearest(off: np.ndarray, entry: np.ndarray, begin: np.ndarray, k: int) -> np.ndarray:
    """Of each run of pairs, the entry of the least squared length of `off`, ties to the lower index."""
    return np.minimum.reduceat((off * off).sum(1) * k + entry, begin) % k


def assign(tree: tuple[np.ndarray, ...], points: np.ndarray, books: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entries by filtering: codes (parts, n) in the tree's order, counts (parts, entries), sums (parts, entries,
    width), and how many points were assigned with a whole subtree. `points` are in the tree's order. What is open is kept
    as runs of pairs of a node and an entry that is not out yet."""
    _, low, high, total = tree
    parts, n, width = points.shape
    k = books.shape[1]
    codes = np.zeros((parts, n), np.uint8 if k <= 256 else np.int32)
    counts, sums, whole = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64), 0
    part, node = np.arange(parts), np.zeros(parts, np.int64)  # the nodes of a level still open
    entry, size = np.tile(np.arange(k), parts), np.full(parts, k)  # their entries, and how many each has
    square, levels = (books * books).sum(2), levels_of(n, leaf)
    for level in range(levels + 1):
        if not len(part):
            break
        at, first = bounds(n, level), (1 << level) - 1
        lo, hi = low[part, first + node], high[part, first + node]
        own, begin = np.repeat(np.arange(len(part)), size), np.cumsum(size) - size
        z = books[part[own], entry]
        best = _nearest(2 * z - (lo + hi)[own], entry, begin, k)
        gap = z - books[part, best][own]
        corner = np.where(gap > 0, hi[own], lo[own])
        margin = square[part[own], entry] - square[part, best][own] - 2 * (corner * gap).sum(1)
        stays = (margin < 0) | ((margin == 0) & (entry <= best[own]))
        entry, size = entry[stays], np.add.reduceat(stays, begin, dtype=np.int64)
        done, begin = size == 1, np.cumsum(size) - size
        p, v, c = part[done], node[done], entry[begin[done]]
        np.add.at(sums, (p, c), total[p, first + v])
        np.add.at(counts, (p, c), (at[1:] - at[:-1])[v])
        codes.reshape(-1)[_spans(p * n + at[v], at[v + 1] - at[v])] = np.repeat(c, at[v + 1] - at[v])
        whole += int((at[v + 1] - at[v]).sum())
        times = 1 if level == levels else 2
        part, node = part[~done].repeat(times), node[~done]
        entry, size = entry[_spans(begin[~done].repeat(times), size[~done].repeat(times))], size[~done].repeat(times)
        node = node if level == levels else (2 * node[:, None] + [0, 1]).reshape(-1)
    at, flat = bounds(n, levels), points.reshape(-1, width)
    begin = np.cumsum(size) - size
    for s in range(0, len(part), 1024):  # leaves, as many at a time
        p, v, b, m = part[s : s + 1024], node[s : s + 1024], begin[s : s + 1024], size[s : s + 1024]
        held = at[v + 1] - at[v]
        places, m = _spans(p * n + at[v], held), m.repeat(held)
        c, own = entry[_spans(b.repeat(held), m)], np.repeat(np.arange(len(places)), m)
        p = p.repeat(held)
        near = _nearest(flat[places][own] - books[p[own], c], c, np.cumsum(m) - m, k)
        codes.reshape(-1)[places] = near
        np.add.at(counts, (p, near), 1)
        np.add.at(sums, (p, near), flat[places])
    return codes, counts, sums, whole


# --- blocks ------------------------------------------------------------------------------------------------------------

_TREE = ("order", "low", "high", "total")
_KINDS = {"points": np.int32, "order": np.int16, "low": np.int32, "high": np.int32, "total": np.int64}


def _whole(vectors: np.ndarray, scale: float, parts: int, most: int) -> np.ndarray:
    """Vectors (n, size) -> integers (parts, n, width)."""
    whole = np.floor(vectors.astype(np.float64) * scale)
    if np.abs(whole).max() > most:
        raise ValueError(f"a component's integer is over {most}")
    return np.ascontiguousarray(whole.astype(np.int64).reshape(len(vectors), parts, -1).transpose(1, 0, 2))


def _packed(ids: pa.Array, labels: pa.Array, flat: np.ndarray, parts: int, scale: float, most: int) -> pa.RecordBatch:
    n, points = len(ids), _whole(flat, scale, parts, most)
    tree = build(points)
    ordered = np.take_along_axis(points, tree[0][:, :, None], 1)
    values = {"points": ordered, **dict(zip(_TREE, tree))}
    lists = lambda a: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), a)
    columns = {"ids": lists(ids), "labels": lists(labels)} | {k: pa.array([v.astype(_KINDS[k]).tobytes()], pa.binary()) for k, v in values.items()}
    return pa.RecordBatch.from_pydict(columns)


def _pack(parts: int, size: int, scale: float, most: int, batches):
    """Batches of (id, label, vector) -> a row for each block of up to BLOCK vectors."""
    release()
    waiting: list[tuple[pa.Array, pa.Array, np.ndarray]] = []
    have = 0

    def block(rows: int) -> pa.RecordBatch:
        ids = pa.concat_arrays([w[0] for w in waiting])
        labels = pa.concat_arrays([w[1] for w in waiting])
        flat = np.concatenate([w[2] for w in waiting])
        waiting[:] = [(ids.slice(rows), labels.slice(rows), flat[rows:])] if len(ids) > rows else []
        return _packed(ids.slice(0, rows), labels.slice(0, rows), flat[:rows], parts, scale, most)

    for batch in batches:
        if batch.num_rows:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
            waiting.append((batch.column(0), batch.column(1), flat))
            have += batch.num_rows
        while have >= BLOCK:
            yield block(BLOCK)
            have -= BLOCK
    if have:
        yield block(have)


def _tree(row: dict, parts: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    n = len(row["ids"])
    read = lambda k: np.frombuffer(row[k], _KINDS[k]).astype(np.int64)
    nodes = lambda k: read(k).reshape(parts, (2 << levels_of(n)) - 1, -1)
    return (read("order").reshape(parts, n), *(nodes(k) for k in _TREE[1:])), read("points").reshape(parts, n, -1)


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() if name not in ("ids", "labels") else batch.column(j)[i].values for j, name in enumerate(batch.schema.names)}


def _sums(books: np.ndarray, batches):
    """Blocks -> (part, entry, n, sums), one row for each entry that a task's blocks use, over all of them."""
    release()
    parts, k, width = books.shape
    counts, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
    for row in _rows(batches):
        tree, points = _tree(row, parts)
        _, c, s, _ = assign(tree, points, books)
        counts += c
        sums += s
    p, e = np.nonzero(counts)
    yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(counts[p, e]), "sums": pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))})


def _codes(books: np.ndarray, batches):
    """Blocks -> (id, label, code, error) of each vector."""
    release()
    parts = books.shape[0]
    for row in _rows(batches):
        tree, points = _tree(row, parts)
        codes, _, _, _ = assign(tree, points, books)
        off = points - np.take_along_axis(books, codes.astype(np.int64)[:, :, None], 1)
        far = np.zeros_like(tree[0])
        np.put_along_axis(far, tree[0], (off * off).sum(2), 1)
        back = np.zeros_like(codes)
        np.put_along_axis(back, tree[0], codes, 1)
        digits = 2 * back.itemsize if back.dtype != np.uint8 else 2
        text = np.ascontiguousarray(back.T).astype(">u4" if digits > 2 else np.uint8).tobytes().hex()
        step = digits * parts
        yield pa.RecordBatch.from_pydict({"id": row["ids"], "label": row["labels"], "code": pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()), "error": pa.array(far.sum(0))})


# --- operator ----------------------------------------------------------------------------------------------------------


def train(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> Codebooks:
    """Codebooks that begin with the parts of the `entries` smallest ids' vectors, after `rounds` rounds."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector")).where(usable("vector"))
    first = rows.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector")
    sizes = first.limit(1).collect()
    if not sizes:
        return Codebooks(np.zeros((parts, 0, 0), np.int64), None, None)
    size = len(sizes[0]["vector"])
    if not size or size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    rows = rows.where(F.size("vector") == size)
    begin = np.array([r["vector"] for r in first.where(F.size("vector") == size).limit(entries).collect()])
    most = limit(size // parts, entries)
    books = _whole(begin, scale, parts, most)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, points binary, order binary, low binary, high binary, total binary"
    blocks, path = stored(rows.mapInArrow(partial(_pack, parts, size, scale, most), schema), "trees")
    for _ in range(rounds):
        partials = blocks.mapInArrow(partial(_sums, books), "part int, entry int, n bigint, sums array<bigint>")
        width = books.shape[2]
        total = partials.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)))
        books = books.copy()
        for r in total.collect():  # parts x entries rows at most
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return Codebooks(books, blocks, path)


def encode(model: Codebooks) -> DataFrame:
    """Rows (id, label, code, error) of the vectors that the model was trained on."""
    kinds = {f.name: f.dataType.elementType.simpleString() for f in model.blocks.schema if f.name in ("ids", "labels")}
    return model.blocks.mapInArrow(partial(_codes, model.entries), f"id {kinds['ids']}, label {kinds['labels']}, code string, error bigint")


def compress(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Rows (key, code, error, label_error, codebooks_sha256) of all kept vectors."""
    spark = df.sparkSession
    model = train(df, parts, entries, rounds, scale, key, vector, label)
    id_kind, label_kind = df.schema[key].dataType.simpleString(), df.schema[label].dataType.simpleString()
    if model.blocks is None:
        return spark.createDataFrame([], f"`{key}` {id_kind}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    coded, _ = stored(encode(model), "codes")
    model.drop(spark)
    size = model.entries.shape[0] * model.entries.shape[2]  # of the vectors that are coded
    other = df.where(usable(vector) & (F.size(vector) != size)).select(F.col(key).alias("id"), F.col(label).cast(label_kind).alias("label"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    coded = coded.unionByName(other)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    if sums.limit(SMALL + 1).count() <= SMALL:
        sums = F.broadcast(sums)
    out = coded.join(sums.withColumnRenamed("label", "label_"), F.col("label").eqNullSafe(F.col("label_")), "left")
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(model.digest()).alias("codebooks_sha256"))
