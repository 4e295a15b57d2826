"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ORDER bytes is counted on its training texts. Escape method C with
exclusion gives every byte a probability in every context: an unseen byte escapes to the next shorter context, where
bytes that the longer one holds no longer count; below the empty context, all bytes left are alike. Statistics are
frozen after training, so a context's code lengths are a row of a table, and a text's code length under a language is
the sum over its bytes, which NumPy looks up batch by batch. The language with the shortest code is predicted.

Training texts are a bounded sample: of each language about TRAIN_TEXTS labelled texts of least hash (equal texts count
once), and of these the first that together reach TRAIN_BYTES, so the model is small at any input size. Prediction
covers whole texts.
Texts are lower-cased first. A null text or one without a letter gives `und` and score 0. Score is the probability of
the predicted language if every language were alike before, with the difference of code lengths counted for at most
SCORE_BYTES bytes of the text. Ties go to the language first in order. Without labelled texts all rows give `und`.
Repeated rows are predicted each and learned from once; an empty table gives no rows; extra columns are not carried along.

How far a text is from all languages is told by its best code length: `far_bound` sets bits a byte that texts of known
language stay below by a wide margin, and `is_far` allows SLACK bits more, so that no text is rejected for few bytes.
"""

from __future__ import annotations

import pickle
import uuid
from dataclasses import dataclass
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm._arrays import slices, utf8_flat
from loomtext.llm._held import held
from loomtext.runtime import ship

#: Bytes of context; bound of the training sample for each language; how often a context of ORDER bytes must occur.
ORDER, TRAIN_TEXTS, TRAIN_BYTES, LEAST = 3, 300, 600_000, 3
#: Labels that train() takes unless told otherwise: a language's tables take some megabytes of each worker.
LANGUAGES = 200
#: Code lengths are kept in units of 1/1024 bit.
UNIT = 1024
SCORE_BYTES = 64
#: A bound is FAR times the median of known texts' bits a byte, and MARGIN times their 99th percentile at least; it takes
#: LEAST_KNOWN such texts. Bits that any text has besides.
FAR, MARGIN, LEAST_KNOWN, SLACK = 3.0, 1.25, 30, 64
PIECE_BYTES = 1 << 20


class Tree:
    """Counts of one language's contexts: by order, {context: counts of the 256 next bytes}."""

    def __init__(self, data: list[bytes], order: int = ORDER, least: int = LEAST):
        self.order = order
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        grams: list[list[np.ndarray]] = [[] for _ in range(order + 1)]
        for text in data:
            flat = np.frombuffer(text, np.uint8).astype(np.uint32)
            code = np.zeros(len(flat), np.uint32)
            for k in range(order + 1):  # gram of k + 1 bytes that ends at each byte
                code[k:] |= flat[: len(flat) - k] << np.uint32(8 * k) if k < len(flat) else 0
                grams[k].append(code[k:].copy())
        for k in range(order + 1):
            gram, n = np.unique(np.concatenate(grams[k]) if grams[k] else np.zeros(0, np.uint32), return_counts=True)
            context, at = np.unique(gram >> np.uint32(8), return_inverse=True)
            table = np.zeros((len(context), 256), np.float32)
            table[at, gram & np.uint32(255)] = n
            kept = table.sum(1) >= least if k > 1 else np.ones(len(context), bool)
            self.keys.append(context[kept])
            self.counts.append(table[kept])

    def code_lengths(self, contexts: np.ndarray) -> np.ndarray:
        """Bits of each next byte after each context, a row per context of ORDER bytes."""
        bits = np.zeros((len(contexts), 256), np.float32)
        open_ = np.ones((len(contexts), 256), bool)
        paid = np.zeros(len(contexts), np.float32)
        for k in range(self.order, -1, -1):
            keys, suffix = self.keys[k], contexts & np.uint32((1 << 8 * k) - 1)
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, suffix), len(keys) - 1)
            rows = np.flatnonzero(keys[at] == suffix)
            n = np.where(open_[rows], self.counts[k][at[rows]], 0)
            seen, total = (n > 0).sum(1), n.sum(1)
            some = total > 0
            rows, n, seen, total = rows[some], n[some], seen[some], total[some]
            left = open_[rows].sum(1)
            full = seen == left  # nothing to escape to
            all_ = total + np.where(full, 0, seen)
            with np.errstate(divide="ignore"):
                own = paid[rows, None] - np.log2(n / all_[:, None])
            hit = n > 0
            bits[rows] = np.where(hit, own, bits[rows])
            open_[rows] &= ~hit
            paid[rows] += np.where(full, 0, -np.log2(np.maximum(seen, 1) / all_))
        return np.where(open_, paid[:, None] + np.log2(np.maximum(open_.sum(1), 1))[:, None], bits)


class Model:
    """Frozen code lengths of all languages over their common contexts."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        self.languages = sorted(texts)
        trees = [Tree(texts[x], order) for x in self.languages]
        # Bytes of contexts are put in classes, 0 for those never seen in training: then three fit a small table.
        seen = np.unique(np.concatenate([np.frombuffer(b"".join(texts[x]), np.uint8) for x in self.languages]))
        self.bits = 7 if len(seen) < 128 else 8
        if len(seen) > 255:
            seen = seen[1:]
        self.class_of = np.zeros(256, np.uint32)
        self.class_of[seen] = np.arange(1, len(seen) + 1)
        byte_of = np.zeros(1 << self.bits, np.uint32)
        byte_of[self.class_of[seen]] = seen
        contexts = np.unique(np.concatenate([np.zeros(1, np.uint32), *(t.keys[order] for t in trees)]))
        packed = sum(self.class_of[contexts >> np.uint32(8 * k) & np.uint32(255)] << np.uint32(self.bits * k) for k in range(order))
        # Contexts of ORDER bytes that no tree holds are told apart by their last two bytes.
        pairs = np.arange(1 << 2 * self.bits, dtype=np.uint32)
        used = np.isin(byte_of[pairs & np.uint32((1 << self.bits) - 1)] | byte_of[pairs >> np.uint32(self.bits)] << np.uint32(8), np.unique(np.concatenate([t.keys[2] for t in trees])) if order > 2 else np.zeros(0, np.uint32))
        last = np.where(used, np.cumsum(used), 0)
        one = (pairs & np.uint32((1 << self.bits) - 1)).astype(np.int64)
        ones = 1 + int(used.sum())
        last = np.where(used, last, ones + one)
        state = np.tile(last.astype(np.int32), 1 << self.bits * (order - 2)) if order > 2 else last.astype(np.int32)
        first = ones + (1 << self.bits)
        state[packed] = first + np.arange(len(contexts))
        far = np.uint32(0xFF << 24)  # a context that nobody has seen, above the bytes that count
        rows = np.zeros(first + len(contexts), np.uint64)
        two = pairs[used]
        rows[1:ones] = byte_of[two & np.uint32((1 << self.bits) - 1)] | byte_of[two >> np.uint32(self.bits)] << np.uint32(8)
        rows[ones:first] = byte_of
        rows[first:] = contexts
        self.state = state
        depth = np.concatenate((np.zeros(1, int), np.full(ones - 1, 2), np.ones(1 << self.bits, int), np.full(len(contexts), order)))
        depth[ones] = 0  # the class of unseen bytes
        self.costs = [self._costs(t, rows.astype(np.uint32), depth, far) for t in trees]

    @staticmethod
    def _costs(tree: Tree, rows: np.ndarray, depth: np.ndarray, far) -> np.ndarray:
        out = np.zeros((len(rows), 256), np.uint16)
        for d in np.unique(depth):
            short, at = Tree.__new__(Tree), np.flatnonzero(depth == d)
            short.order, short.keys, short.counts = int(d), tree.keys, tree.counts
            for i in range(0, len(at), 4096):
                out[at[i : i + 4096]] = np.minimum(np.rint(short.code_lengths(rows[at[i : i + 4096]]) * UNIT), 65535)
        return out.ravel()

    def code_lengths(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of each text under each language; texts are flat[at[i]:at[i + 1]], each coded from an unseen context."""
        out = np.zeros((len(at) - 1, len(self.languages)))
        full = np.flatnonzero(at[1:] > at[:-1])
        if not len(full):
            return out
        classes = self.class_of[flat]
        context = np.zeros(len(flat), np.uint32)
        starts = at[:-1][full]
        for k in range(1, ORDER + 1):
            shifted = np.zeros(len(flat), np.uint32)
            shifted[k:] = classes[:-k]
            for j in range(k):  # no context reaches into the text before
                near = starts + j
                shifted[near[near < len(flat)]] = 0
            context |= shifted << np.uint32(self.bits * (k - 1))
        place = self.state[context].astype(np.int64) << 8 | flat
        for i, costs in enumerate(self.costs):
            out[full, i] = np.add.reduceat(costs[place], starts, dtype=np.int64)
        return out / UNIT


def train(df: DataFrame, text: str = "text", lang: str = "lang", languages: int = LANGUAGES) -> Model | None:
    """Fit on the labelled rows of df; only the bounded sample reaches the driver. None without any text.

    Of each language, distinct texts under a bound of their hash are taken, so that about TRAIN_TEXTS are expected; no
    text is moved to choose them. More labels than `languages` are an error, as texts of those left out would get another's.
    """
    span = float(1 << 62)
    rows = df.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.withColumn("hash", F.shiftrightunsigned(F.xxhash64("text"), 2))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).limit(languages + 1).collect()}
    if len(counts) > languages:
        raise ValueError(f"more than {languages} labels: clean them, or give train() the number of languages that workers can hold")
    if not counts:
        return None
    bound = F.create_map(*[x for name, n in counts.items() for x in (F.lit(name), F.lit(int(span * min(1.0, TRAIN_TEXTS / max(n, 1)))))])
    sample = rows.where(F.col("hash") <= bound[F.col("lang")]).dropDuplicates(["lang", "hash"])
    texts: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for row in sample.orderBy("lang", "hash").toLocalIterator():
        data = row["text"].lower().encode()
        if size.get(row["lang"], 0) < TRAIN_BYTES:
            texts.setdefault(row["lang"], []).append(data)
            size[row["lang"]] = size.get(row["lang"], 0) + len(data)
    return Model(texts)


@dataclass
class Shared:
    """A broadcast model and its name."""

    id: str
    model: Any


def _coded(shared, carried: int, batches):
    model = held(("ppm", shared.id), lambda: pickle.loads(shared.model.value)) if shared is not None else None
    for batch in batches:
        for piece in slices(batch, batch.schema.names[1], PIECE_BYTES):
            texts = pc.fill_null(piece.column(1), "")
            lettered = np.asarray(pc.match_substring_regex(texts, r"\p{L}")).astype(bool)
            if model is None:
                names, scores, least, sizes = ["und"] * len(texts), *np.zeros((2, len(texts))), np.zeros(len(texts), np.int64)
            else:
                flat, at = utf8_flat(pc.utf8_lower(texts))
                bits = model.code_lengths(flat, at)
                best = bits.argmin(1)
                sizes, least = np.maximum(np.diff(at), 1), bits.min(1)
                over = (bits - least[:, None]) * (np.minimum(sizes, SCORE_BYTES) / sizes)[:, None]
                scores = np.where(lettered, 1 / np.exp2(-np.minimum(over, 1000)).sum(1), 0.0)
                names = [model.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
            found = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(least, pa.float64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*piece.columns[:carried], *found], names=[*piece.schema.names[:carried], "lang_pred", "score", "bits", "bytes"])


def _with_codes(df: DataFrame, model: Model | None, carried: int) -> DataFrame:
    """The first columns of df, whose second is the text, with lang_pred, score, bits of the best code and bytes."""
    spark = df.sparkSession
    ship(spark)
    shared = Shared(uuid.uuid4().hex, spark.sparkContext.broadcast(pickle.dumps(model))) if model is not None else None
    kinds = [f"`{c.name}` {c.dataType.simpleString()}" for c in df.schema.fields[:carried]]
    return df.mapInArrow(partial(_coded, shared, carried), ", ".join([*kinds, "lang_pred string, score double, bits double, bytes bigint"]))


def predict(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, lang_pred, score)."""
    return _with_codes(df.select(key, text), model, 1).select(key, "lang_pred", "score")


def coded(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df's rows, each with its lang_pred, score, bits of the best code and bytes; other columns of these names go."""
    added = ("lang_pred", "score", "bits", "bytes")
    return _with_codes(df.select(key, text, *(c for c in df.columns if c not in (key, text, *added))), model, len(set(df.columns) - set(added)))


def far_bound(known: DataFrame) -> float | None:
    """Bits a byte beyond which a text is in no learned language, from coded rows of known language that the model was
    not trained on; None if they are too few to tell."""
    per = F.col("bits") / F.col("bytes")
    n, levels = known.where("lang_pred != 'und'").agg(F.count(F.lit(1)), F.percentile_approx(per, [0.5, 0.99])).first()
    return max(FAR * levels[0], MARGIN * levels[1]) if n >= LEAST_KNOWN else None


def is_far(bound: float | None):
    return F.lit(False) if bound is None else F.col("bits") > bound * F.col("bytes") + SLACK
