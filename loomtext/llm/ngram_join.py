"""N-gram Jaccard join: which documents' sets of word shingles are alike, and the components that such links form.

The document by n-gram incidence matrix is multiplied with its transpose block by block, a block being the rows of
one n-gram, and overlaps are bounded before they are counted:

1. A sketch of counters over all documents gives every shingle a level, the more frequent the higher. It has MOST_CELLS
   of them at most and only sets an order (level, hash), so results do not depend on it.
2. Documents with equal sets form one class. Of a class, only the first shingles in that order enter the product:
   a set of size a has |a| - ceil(t |a|) + 1 of them, since any other set that is alike must share one of these.
3. First each block links its members to one hub, the one with the fewest rare shingles, which settles most of a large
   group of near copies by as many pairs as it has members. Links found join classes to components.
4. Then every block pairs those members that are not yet in one component and whose sizes, positions and parities of
   512 counters (two sets differ in as many shingles as parities, at least) allow the overlap that they need. So no link
   between components is missed, and none within one is needed.
5. Pairs of either step are discarded if the parities bound their difference above what is allowed; overlaps of the rest
   are counted on the whole sets.
6. Links are counted in full, too: all of a class's links are in its component, whose classes are dealt into chunks.
   Each two chunks are a tile, in which the incidence rows of whole sets are multiplied, so overlaps of all pairs of a
   component are counted, and a set is moved once for each chunk of its component, not for each pair.

Null, empty and blank texts have no shingles and are alone, each its own component; equal texts fall in one class;
component_id is the smallest non-null key reachable, or null if there is none. Rows of one key with unlike texts each go
with their own text, rows alike in both are told each, and so are rows without a key. An empty table gives no rows. Very
long texts are whole sets, handled one at a time. Columns beside key and text are not carried along, whatever their names.
Sets are told apart by a 64-bit number of all their shingles.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm._arrays import slices, utf8_flat
from loomtext.llm._held import release
from loomtext.llm.shingles import mixed, shingle_sets
from loomtext.runtime import cleaned, drop_path, kept, ship, stored

#: Counters of the sketch, at least and at most, slices in which they are summed, and levels to each doubling of a count.
CELLS, MOST_CELLS, SLICES, STEPS = 1 << 22, 1 << 25, 64, 4
#: 64-bit words of parities that bound a difference.
WORDS = 8
PIECE_BYTES = 1 << 20
#: Shingles and sets of a chunk, about, and shingles that are multiplied at a time.
CHUNK_SHINGLES, CHUNK_SETS, SLAB = 1 << 16, 512, 4096


def needed(a, b, num: int, den: int):
    """Least overlap of sets of sizes a and b with den * overlap >= num * union."""
    return -((-num * (a + b)) // (den + num))


def prefix_size(size, num: int, den: int):
    """First shingles of which a set shares one with each set that is alike."""
    return size - -((-num * size) // den) + 1


def index_size(size, num: int, den: int):
    """The same, for partners that are no smaller."""
    return size - -((-2 * num * size) // (den + num)) + 1


def _sketch(n: int, cells: int, batches):
    release()
    shift = np.uint64(64 - (cells - 1).bit_length())
    counts = np.zeros(cells, np.uint32)
    for batch in batches:
        for piece in slices(batch, batch.schema.names[0], PIECE_BYTES):
            flat, _ = shingle_sets(*utf8_flat(piece.column(0)), n)
            np.add.at(counts, (flat >> shift).astype(np.int64), np.uint32(1))
    each = cells // SLICES
    for i in range(SLICES):
        planes = np.ascontiguousarray(counts[i * each : (i + 1) * each].view(np.uint8).reshape(-1, 4).T)
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(planes, 1)], pa.binary())], names=["slice", "counts"])


def _summed(batches):
    release()
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            planes = np.frombuffer(zlib.decompress(counts.as_py()), np.uint8).reshape(4, -1)
            part = np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.uint64)
            totals[i] = totals[i] + part if i in totals else part
    for i, total in totals.items():
        # Packed again, as most counts are small: what the driver gets is a fraction of 8 bytes a cell.
        planes = np.ascontiguousarray(total.view(np.uint8).reshape(-1, 8).T)
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(planes, 1)], pa.binary())], names=["slice", "counts"])


def levels(df: DataFrame, text: str, n: int, cells: int = CELLS) -> np.ndarray:
    """Level of each cell: STEPS for each time that its count doubles an even spread's. `cells` bytes at any input size."""
    ship(df.sparkSession)
    part = df.select(text).mapInArrow(partial(_sketch, n, cells), "slice int, counts binary")
    summed = part.repartition(SLICES, "slice").mapInArrow(_summed, "slice int, counts binary")
    counts = np.zeros((SLICES, cells // SLICES), np.float32)
    for row in summed.coalesce(8).toLocalIterator():
        planes = np.frombuffer(zlib.decompress(row["counts"]), np.uint8).reshape(8, -1)
        counts[row["slice"]] = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    mean = max(1.0, float(counts.mean(dtype=np.float64)))
    return np.concatenate([np.rint(STEPS * np.log2(np.maximum(1, c / mean))).astype(np.uint8) for c in counts])


_SETS = [("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("v", pa.int64()), ("rare", pa.int32()), ("prefix", pa.list_(pa.int64())), ("odd", pa.list_(pa.int64()))]
SETS = "doc_id bigint, mark bigint, n bigint, v bigint, rare int, prefix array<bigint>, odd array<bigint>"


def _set_key(own: np.ndarray) -> int:
    """One 64-bit number for a whole set."""
    place = np.arange(1, len(own) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(mixed(np.array([mixed(own ^ place).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64)).view(np.int64)[0])


def _sets(n: int, num: int, den: int, shared, batches):
    release()
    level = np.frombuffer(shared.value, np.uint8)
    shift = np.uint64(64 - (len(level) - 1).bit_length())
    for batch in batches:
        for piece in slices(batch, batch.schema.names[1], PIECE_BYTES):
            flat, at = shingle_sets(*utf8_flat(piece.column(1)), n)
            sizes = np.diff(at)
            high = level[(flat >> shift).astype(np.int64)]
            cell = (flat >> np.uint64(55)).astype(np.int64)
            keys, rare, prefix, odd = [], [], [], []
            for start, size in zip(at[:-1].tolist(), sizes.tolist(), strict=True):
                if not size:
                    keys.append(None)
                    rare.append(None)
                    prefix.append(None)
                    odd.append(None)
                    continue
                own, own_level = flat[start : start + size], high[start : start + size]
                # Sets are ascending, so a stable sort by level gives the order (level, hash). Prefixes hold places in this
                # order, the level before the hash's highest bits; places are numbers over zero, so they sort as it does.
                first = np.argsort(own_level, kind="stable")[: prefix_size(size, num, den)]
                keys.append(_set_key(own))
                rare.append(int(1000 * (own_level[first] < STEPS).mean()))
                prefix.append((own_level[first].astype(np.int64) << 55) | (own[first] >> np.uint64(9)).astype(np.int64))
                odd.append(np.packbits(np.bincount(cell[start : start + size], minlength=64 * WORDS) & 1).view(np.int64))
            columns = [piece.column(0), piece.column(2), pa.array(sizes, pa.int64()), keys, rare, prefix, odd]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, _SETS, strict=True)], schema=pa.schema(_SETS))


def _whole_sets(n: int, shared, batches):
    """Rows (id, text) -> (id, whole) of those whose id the bitmap holds."""
    release()
    bitmap = np.frombuffer(shared.value, np.uint8)
    for batch in batches:
        wanted = pa.array(_held(bitmap, np.asarray(batch.column(0))))
        for piece in slices(batch.filter(wanted), batch.schema.names[1], PIECE_BYTES):
            flat, at = shingle_sets(*utf8_flat(piece.column(1)), n)
            sets = [flat[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sets, pa.binary())], names=["id", "whole"])


def _held(bitmap: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which of the 64-bit marks a bitmap has."""
    place = marks & (8 * len(bitmap) - 1)
    return bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1


def _sieved(inside: bool, shared, batches):
    """Rows whose first column, an id, the bitmap holds, or those of which it doesn't, without the id."""
    release()
    bitmap = np.frombuffer(shared.value, np.uint8)
    for batch in batches:
        kept = batch.filter(pa.array(_held(bitmap, np.asarray(batch.column(0))) == inside))
        yield pa.RecordBatch.from_arrays(kept.columns[1:], names=kept.schema.names[1:])
    release()  # what a batch took goes back, as workers wait through stages that need no Python


class Sieve:
    """A bitmap of ids by which the few rows that a join concerns are told from the rest, so that the rest isn't moved.

    `inside` has all rows with one of the ids and some others by chance, `outside` the rest; together they are all rows."""

    def __init__(self, ids: DataFrame, column: str):
        spark = ids.sparkSession
        ship(spark)
        self.shared = spark.sparkContext.broadcast(_bitmap(ids, column, ids.count()))

    def _of(self, df: DataFrame, ids: Column, inside: bool) -> DataFrame:
        return df.select(ids.alias("sieve_id"), *df.columns).mapInArrow(partial(_sieved, inside, self.shared), df.schema)

    def inside(self, df: DataFrame, ids: Column) -> DataFrame:
        return self._of(df, ids, True)

    def outside(self, df: DataFrame, ids: Column) -> DataFrame:
        return self._of(df, ids, False)


def _picked(shared, batches):
    """Rows (v, n, prefix) of the classes that the bitmap holds."""
    release()
    bitmap = np.frombuffer(shared.value, np.uint8)
    for batch in batches:
        yield batch.filter(pa.array(_held(bitmap, np.asarray(batch.column(0)))))


def _common(shared, batches):
    """Rows (v, n, rare, prefix) -> (v, n, rare, pos, h): the places that the bitmap holds, and where in the prefix they are."""
    release()
    bitmap = np.frombuffer(shared.value, np.uint8)
    for batch in batches:
        prefix = batch.column(3)
        ends = np.asarray(prefix.offsets).astype(np.int64)
        flat = np.asarray(prefix.values)[ends[0] : ends[-1]]
        ends -= ends[0]
        here = _held(bitmap, flat)
        pos = (np.arange(len(flat)) - np.repeat(ends[:-1], np.diff(ends)))[here]
        cuts = pa.array(np.concatenate((np.zeros(1, np.int64), np.cumsum(here)))[ends], pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x, t)) for x, t in ((pos, pa.int32()), (flat[here], pa.int64()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *lists], names=["v", "n", "rare", "pos", "h"])


def _bitmap(marks: DataFrame, column: str, n: int) -> bytes:
    """Bits of the marks' lowest bits, as a filter that lets no mark go: some 16 bits for each of n marks, 2^28 at most,
    whatever the input. Bits are set by Spark, so that what reaches the driver is the bitmap."""
    bits = min(28, max(18, (16 * n).bit_length()))
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    rows = marks.select((place / (1 << 15)).cast("int").alias("bucket"), (place % (1 << 15)).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = bytearray(1 << (bits - 3))
    with cleaned(marks.sparkSession):
        for row in rows.collect():
            out[row["bucket"] << 12 : (row["bucket"] + 1) << 12] = row["bits"]
    return bytes(out)


def _counted(num: int, den: int, batches):
    """Pairs whose sets' overlap is what they need. A batch holds at most a few MB of sets (`ship`)."""
    release()
    for batch in batches:
        kept = []
        for a, b in zip(batch.column("whole_a"), batch.column("whole_b"), strict=True):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
            both = np.concatenate((x, y))
            both.sort()
            kept.append(int((both[1:] == both[:-1]).sum()) >= needed(len(x), len(y), num, den))
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Overlap of each set of a with each of b: the product of their incidence rows, SLAB shingles at a time."""
    flat = [np.concatenate(x) for x in (a, b)]
    row = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    both = np.intersect1d(*flat)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(both):
        return out
    place = [np.searchsorted(both, x) for x in flat]
    for i, x in enumerate(flat):
        known = both[np.minimum(place[i], len(both) - 1)] == x
        order = np.argsort(place[i][known], kind="stable")
        place[i], row[i] = place[i][known][order], row[i][known][order]
    for start in range(0, len(both), SLAB):
        tables = []
        for i, x in enumerate((a, b)):
            lo, hi = np.searchsorted(place[i], (start, start + SLAB))
            tables.append(np.zeros((len(x), min(SLAB, len(both) - start)), np.float32))
            tables[i][row[i][lo:hi], place[i][lo:hi] - start] = 1
        out += tables[0] @ tables[1].T
    return out


def _linked(tile, rows, num: int, den: int):
    """Of a tile's rows (chunk, v, copies, whole), the classes of each side, their copies, and which of them link."""
    sides = [[x for x in rows if x[0] == chunk] for chunk in tile[1:]]
    if not all(sides):
        return None
    sets = [[np.frombuffer(x[3], np.uint64) for x in side] for side in sides]
    n = [np.array([len(x) for x in side], np.int64) for side in sets]
    yes = _overlaps(*sets).astype(np.int64) >= needed(n[0][:, None], n[1][None, :], num, den)
    if tile[1] == tile[2]:
        yes &= ~np.eye(len(sets[0]), dtype=bool)
    return *(np.array([x[1] for x in side], np.int64) for side in sides), *(np.array([x[2] for x in side], np.int64) for side in sides), yes


def _tiles(num: int, den: int, pairs: bool, batches):
    """Rows (root, i, j, chunk, v, copies, whole) in the order of tiles -> links (a, b), or (v, links) counted in copies."""
    release()

    def of(tile, rows):
        if (found := _linked(tile, rows, num, den)) is None:
            return
        va, vb, ca, cb, yes = found
        own = tile[1] == tile[2]
        if pairs:
            at = np.nonzero(np.triu(yes) if own else yes)
            a, b = va[at[0]], vb[at[1]]
            columns = {"a": np.minimum(a, b), "b": np.maximum(a, b)}
        else:
            v, n = (va, yes @ cb) if own else (np.concatenate((va, vb)), np.concatenate((yes @ cb, ca @ yes)))
            columns = {"v": v[n > 0], "links": n[n > 0]}
        yield pa.RecordBatch.from_pydict({k: pa.array(x, pa.int64()) for k, x in columns.items()})

    now, rows = None, []
    for batch in batches:
        for root, i, j, *row in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
            if (root, i, j) != now:
                if rows:
                    yield from of(now, rows)
                now, rows = (root, i, j), []
            rows.append(row)
    if rows:
        yield from of(now, rows)


def row_id(key, mark) -> Column:
    """One number for a row's key, which may be null or repeated, and its text's hash."""
    return F.xxhash64(F.coalesce(key, F.lit(0)), key.isNull(), mark)


class _Join:
    def __init__(self, df: DataFrame, text: str, n: int, num: int, den: int, classes: DataFrame):
        self.df, self.text, self.n, self.num, self.den, self.classes = df, text, n, num, den, classes
        self.need = f"-floor(-{num} * (n_a + n_b) / {den + num})"

    def links(self, pairs: DataFrame) -> tuple[DataFrame, str]:
        """Of distinct pairs (a, b), those that link; stored, and where.

        Prefixes bound the overlap first: a place of one that isn't past the other's last, and isn't in it, is in no place of
        that set. What is left is counted on whole sets."""
        spark = self.df.sparkSession
        pairs, pairs_path = stored(pairs, "pairs")
        if not (n := pairs.count()):
            return pairs, pairs_path
        some = pairs.select(F.explode(F.array("a", "b")).alias("v"))
        shared = spark.sparkContext.broadcast(_bitmap(some, "v", 2 * n))
        told = self.classes.select("v", "n", "prefix").mapInArrow(partial(_picked, shared), "v bigint, n bigint, prefix array<bigint>")
        both = pairs
        for c in ("b", "a"):
            both = both.join(told.select(F.col("v").alias(c), F.col("n").alias(f"n_{c}"), F.col("prefix").alias(f"p_{c}")), c)
        last = "least(element_at(p_a, -1), element_at(p_b, -1))"
        missing = lambda x, y: f"size(array_except(filter(p_{x}, p -> p <= {last}), p_{y})) <= n_{x} - ({self.need})"
        left, left_path = stored(both.where(missing("a", "b")).where(missing("b", "a")).select("a", "b"), "bounded")
        shared.destroy()
        drop_path(spark, pairs_path)
        whole, whole_path = self.whole(left.select(F.explode(F.array("a", "b")).alias("v")).distinct())
        both = left.join(whole.select(F.col("v").alias("b"), F.col("whole").alias("whole_b")), "b").join(whole.select(F.col("v").alias("a"), F.col("whole").alias("whole_a")), "a")
        out = stored(both.mapInArrow(partial(_counted, self.num, self.den), "a bigint, b bigint"), "links")
        for path in (left_path, whole_path):
            drop_path(spark, path)
        return out

    def whole(self, some: DataFrame) -> tuple[DataFrame, str]:
        """Rows (v, whole) of some classes (v), by a row of each.

        Texts are not moved: sets are made where the texts are read, of those rows that a bitmap of ids lets through. Rows of
        one id are alike (their key and text are), so that one is taken where they are joined, and sets are moved once."""
        spark = self.df.sparkSession
        ids = kept(some.join(self.classes.select("v", row_id(F.col("sample.doc_id"), F.col("sample.mark")).alias("id")), "v"))
        shared = spark.sparkContext.broadcast(_bitmap(ids, "id", ids.count()))
        sets = self.df.select(row_id(F.col("key"), F.col("mark")).alias("id"), self.text).mapInArrow(partial(_whole_sets, self.n, shared), "id bigint, whole binary")
        whole, path = stored(sets.join(ids, "id").dropDuplicates(["id"]).select("v", "whole"), "whole")
        shared.destroy()
        ids.unpersist()
        return whole, path


def components(links: DataFrame) -> DataFrame:
    """Rows (v, root) of all ends of links (a, b): root is the least end reachable.

    Large-star and small-star steps in turn, until all components are stars; each round is stored, so that lineage stays
    short. Minima are aggregated before they are joined to the edges, so that no end's edges are gathered.
    """
    spark = links.sparkSession
    edges, path = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        own = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(own, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own.select("a", F.col("m").alias("b")))
        new, new_path = stored(small.distinct(), "edges")
        drop_path(spark, path)
        edges, path = new, new_path
    roots = edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each greater end a of distinct edges (a, b) has one lesser end b, which is no greater end itself."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    with cleaned(edges.sparkSession):
        return not ends.where("up > 1 OR (up = 1 AND down = 1)").agg(F.count(F.lit(1))).first()[0]


def joined(told: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (v, root) of components that were told and of the ends of more links: of components that these join, the
    least root is all's. Roots alone are linked anew, so that settled components are not gone through again."""
    ends = links
    for c in ("a", "b"):
        ends = ends.join(told.select(F.col("v").alias(c), F.col("root").alias(f"root_{c}")), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
    over = components(ends.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).select(F.col("v").alias("old"), F.col("root").alias("new"))
    # An end that was in no component is its own root.
    lone = over.select(F.col("old").alias("v")).join(told.select("v"), "v", "left_anti").withColumn("root", F.col("v"))
    return told.unionByName(lone).join(over, F.col("root") == F.col("old"), "left").select("v", F.coalesce("new", "root").alias("root"))


def _grouped(df: DataFrame, key: str, text: str, n: int, num: int, den: int, cells: int | None) -> tuple[DataFrame, DataFrame, DataFrame, _Join]:
    """Sets of all rows, the classes of equal ones, and (v, root, first) of the classes that have links."""
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    # More documents, more counters, so that rare shingles stay apart: a fourth as many as documents.
    cells = cells or min(MOST_CELLS, max(CELLS, 1 << (df.count() // 4).bit_length()))
    shared = spark.sparkContext.broadcast(levels(docs, "text", n, cells).tobytes())
    sets, _ = stored(docs.mapInArrow(partial(_sets, n, num, den, shared), SETS), "sets")
    shared.destroy()
    some = sets.where("n > 0")
    one = [F.first(c).alias(c) for c in ("n", "rare", "prefix", "odd")]
    classes, _ = stored(some.groupBy("v").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "mark")).alias("sample"), F.count(F.lit(1)).alias("copies"), *one), "classes")
    join = _Join(docs, "text", n, num, den, classes)

    # Most shingles of prefixes are in one set alone: counts of the bare places tell the others, of which a bitmap is made.
    places, size = classes.select(F.explode("prefix").alias("h")), classes.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    common = places.groupBy("h").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("h")
    seen = spark.sparkContext.broadcast(_bitmap(common, "h", size // 4))
    rows = classes.select("v", "n", "rare", "prefix").mapInArrow(partial(_common, seen), "v bigint, n bigint, rare int, pos array<int>, h array<bigint>")
    rows = rows.select("v", "n", "rare", F.explode(F.arrays_zip("pos", "h")).alias("x")).select("v", "n", "rare", "x.pos", "x.h")
    # The fewest rare shingles, then any fixed order; one number, so that the minimum is a hash aggregate.
    order = F.shiftleft(F.col("rare").cast("bigint"), 50) + F.shiftrightunsigned("v", 14)
    hubs = rows.groupBy("h").agg(F.min_by("v", order).alias("hub"), F.min_by("n", order).alias("hub_n"), F.count(F.lit(1)).alias("members")).where("members > 1")
    blocks, blocks_path = stored(rows.drop("rare").join(hubs.drop("members"), "h"), "blocks")
    seen.destroy()

    alike = lambda a, b: den * F.least(a, b) >= num * F.greatest(a, b)
    need = join.need
    few_odd = " + ".join(f"bit_count(odd_a[{i}] ^ odd_b[{i}])" for i in range(WORDS)) + f" <= n_a + n_b - 2 * ({need})"
    star = blocks.where((F.col("v") != F.col("hub")) & alike(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("v").alias("b")).distinct()
    for c in ("b", "a"):
        star = star.join(classes.select(F.col("v").alias(c), F.col("n").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}")), c)
    links, star_path = join.links(star.where(few_odd).select("a", "b"))
    told = components(links)
    left = blocks.select("h", "v", "n", "pos").join(told, "v", "left").withColumn("root", F.coalesce("root", "v"))
    left, left_path = stored(left, "left")
    # Blocks of the same members are one: the first in order of them has each pair's positions least.
    members = [F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("v") % (1 << 40)).alias("total"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("mark"), F.min_by("pos", "v").alias("place")]
    mixed_blocks = left.groupBy("h").agg(F.min("root").alias("least"), F.max("root").alias("most"), *members).where("least != most")
    mixed_blocks = mixed_blocks.groupBy("least", "most", "members", "total", "mark").agg(F.min_by("h", "place").alias("h")).select("h")
    open_rows, open_path = stored(left.join(mixed_blocks, "h").join(classes.select("v", "odd"), "v"), "open")
    a, b = (open_rows.select("h", *(F.col(c).alias(f"{c}_{side}") for c in ("v", "n", "pos", "root", "odd"))) for side in ("a", "b"))
    wanted = (
        F.expr("(n_a < n_b OR (n_a = n_b AND v_a < v_b)) AND root_a != root_b")
        & F.expr(f"{num} * n_b <= {den} * n_a")
        & F.expr(f"n_a - pos_a >= {need} AND n_b - pos_b >= {need}")
        & F.expr(few_odd)
    )
    pairs = a.where(F.expr(f"pos_a < n_a + floor(-2 * {num} * n_a / {den + num}) + 1")).join(b, "h").where(wanted)
    more, more_path = join.links(pairs.select(F.col("v_a").alias("a"), F.col("v_b").alias("b")).distinct())
    for path in (blocks_path, left_path, open_path):
        drop_path(spark, path)

    linked = joined(told, more).join(classes.select("v", "first"), "v")
    linked, _ = stored(linked, "linked")
    for p in (star_path, more_path):
        drop_path(spark, p)
    return sets, classes, linked, join


def _named(sets: DataFrame, classes: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows (doc_id, mark, n_shingles, component_id, v, root) of all rows; v and root are null without shingles."""
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    ids = classes.select("v", "first").join(linked.select("v", "root").join(least, "root").select("v", "root", "least"), "v", "left")
    ids, _ = stored(ids.select("v", F.coalesce("root", "v").alias("root"), F.coalesce("least", "first").alias("component_id")), "component-ids")
    return sets.select("doc_id", "mark", F.col("n").alias("n_shingles"), "v").join(ids, "v", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def similar_rows(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, num: int = 85, den: int = 100, cells: int | None = None) -> DataFrame:
    """Rows (doc_id, mark, n_shingles, component_id, v, root) of all rows: mark is the text's xxhash64, v the set and
    root the component, which tell rows apart whose keys are null or repeated."""
    return _named(*_grouped(df, key, text, n, num, den, cells)[:3])


def similar_components(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, num: int = 85, den: int = 100, cells: int | None = None) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) of all rows: sets link when den * overlap >= num * union."""
    return similar_rows(df, key, text, n, num, den, cells).select("doc_id", "n_shingles", "component_id")


def _tiled(classes: DataFrame, linked: DataFrame, join: _Join, pairs: bool) -> DataFrame:
    """Links of all pairs of each component's classes: (a, b), or the sums (v, links); stored."""
    spark = classes.sparkSession
    members = linked.select("v", "root").join(classes.select("v", "n", "copies"), "v")
    chunks = F.ceil(F.greatest(F.sum("n") / CHUNK_SHINGLES, F.count(F.lit(1)) / CHUNK_SETS)).cast("int")
    members = members.join(members.groupBy("root").agg(chunks.alias("chunks")), "root")
    members, path = stored(members.select("v", "root", "copies", "chunks", F.expr("pmod(xxhash64(v, 2), chunks)").cast("int").alias("chunk")), "members")
    whole, whole_path = join.whole(members.select("v"))
    rows = members.join(whole, "v").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("root", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "v", "copies", "whole")
    rows = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    out = rows.mapInArrow(partial(_tiles, join.num, join.den, pairs), "a bigint, b bigint" if pairs else "v bigint, links bigint")
    out, _ = stored(out if pairs else out.groupBy("v").agg(F.sum("links").alias("links")), "all-links")
    for p in (path, whole_path):
        drop_path(spark, p)
    return out


def similar_links(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, num: int = 85, den: int = 100, cells: int | None = None) -> DataFrame:
    """Rows (doc_id_a, copies_a, doc_id_b, copies_b): each link between different sets once, by a row of each set (the
    least key) and how many rows have it. There are as many as links, so the square of a group's size where all are alike."""
    sets, classes, linked, join = _grouped(df, key, text, n, num, den, cells)
    out = _tiled(classes, linked, join, True)
    for side in ("a", "b"):
        out = out.join(classes.select(F.col("v").alias(side), F.col("first").alias(f"doc_id_{side}"), F.col("copies").alias(f"copies_{side}")), side)
    return out.select("doc_id_a", "copies_a", "doc_id_b", "copies_b")


def link_counts(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, num: int = 85, den: int = 100, cells: int | None = None) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, n_links) of all rows: n_links is the number of other rows that a row's
    set links with, those of equal sets included."""
    sets, classes, linked, join = _grouped(df, key, text, n, num, den, cells)
    counts = classes.select("v", "copies").join(_tiled(classes, linked, join, False), "v", "left")
    counts, _ = stored(counts.select("v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "n-links")
    rows = _named(sets, classes, linked).join(counts, "v", "left")
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
