"""Token-id output compressed by Re-Pair.

Documents are tokenized, ended by an end id and written in ascending key order as shards. Within a shard, frequent
pairs of neighbouring ids are replaced by new symbols (nonterminals), round after round until no pair is frequent; each
round replaces all the pairs that it picked at once, the more frequent pair first where two overlap. No pair begins with
a document's end, so that each document is a run of whole symbols and can be decoded alone.

File format: a Parquet table, one row per shard, ordered by (part, shard).
  part, shard   position; part is the range partition, shard counts within it
  before        ids of the part's shards before this one
  doc_ids       the documents' keys, in order
  symbol_ends   per document, where its symbols end
  n_ids         ids that the shard stands for
  rules         little-endian unsigned 32-bit pairs (left, right); rule i defines symbol base + i
  expansions    per rule, the number of ids that it stands for, little-endian unsigned 32-bit
  symbols       the sequence, little-endian unsigned, `width` bytes each
  base, width   first nonterminal; 2 or 4

Null texts count as empty and give the end id alone; equal keys keep their rows, ordered by text; null keys come
first. An empty table gives no shards. A text longer than a shard is a shard of its own. Columns beside key and text
are not carried along, whatever their names.
"""

from __future__ import annotations

import gc
import json
import os
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm._arrays import slices, utf8_flat
from loomtext.llm._held import held, release
from loomtext.llm.pretokens import Cutter, put_together
from loomtext.runtime import ship

#: Ids in a shard, about; a longer document is a shard of its own.
SHARD_IDS = 1 << 20
#: Pairs replaced in a round, how often a pair must occur, and how often it must be replaced to be worth a rule.
PAIRS, LEAST, WORTH = 4000, 24, 4
#: Bits of the hash by which pairs are counted first.
SLOT_BITS = 18
#: Bytes that a worker's memo of pre-tokens holds, about, before it becomes the old one and a new one begins; what an entry
#: takes besides its bytes and ids; bytes of a pre-token that is kept at most; and text bytes encoded at a time.
MEMO_BYTES, ENTRY_BYTES, LONG, TEXT_BYTES = 48_000_000, 170, 64, 4 << 20
#: The pre-tokenizer whose pre-tokens can be cut here.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}

SHARDS = "part int, shard int, before bigint, doc_ids array<bigint>, symbol_ends array<bigint>, n_ids bigint, rules binary, expansions binary, symbols binary, base int, width int"
DECODED = "doc_id bigint, part int, shard int, at bigint, n_tokens bigint, ids binary"


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """The tokenizers library with a memo of pre-tokens. Texts that hold an added token's name (as the end of text's), which
    the library makes that token wherever it stands, are encoded whole.

    Texts are cut, and the same pre-tokens of a batch are found, in Arrow; the library's model sees each of them once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0
        self.letters = _byte_letters()
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        own = told.get("pre_tokenizer") or {}
        #: Whether pre-tokens can go to the library's model as they are.
        self.plain_pieces = told.get("normalizer") is None and told["model"].get("dropout") is None and BYTE_LEVEL.items() <= own.items()
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str if self.plain_pieces else None
        self.cutter = Cutter(lambda text: len(cut(text)))

    def plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        """Encode new pre-tokens, each by the library's model for itself, and keep those that may come again: short ones, with
        a space before them or of signs. Letters and digits without a space are mostly of texts without spaces."""
        if not pieces:
            return []
        model, memo, flat, stops = self.tokenizer.model, self.memo, [], []
        # No byte of UTF-8 is 0xFF, and no letter but its own stands for it.
        for x in b"\xff".join(pieces).decode("latin-1").translate(self.letters).split("\xff"):
            flat += [t.id for t in model.tokenize(x)]
            stops.append(4 * len(flat))
        ids = np.array(flat, "<u4").tobytes()
        found = [ids[start:stop] for start, stop in zip([0, *stops[:-1]], stops, strict=True)]
        for x, own in zip(pieces, found, strict=True):
            if len(x) <= LONG and not (x[0] >= 0x80 or x[:1].isalnum()):
                memo[x] = own
                self.held += len(x) + len(own) + ENTRY_BYTES
        return found

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of whole texts (null: none), as little-endian unsigned 32-bit integers. What is made here has no cycles, so that looking
        for some, a seventh of the time, is put off."""
        on = gc.isenabled()
        gc.disable()
        try:
            return self.encoded(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        finally:
            if on:
                gc.enable()

    def encoded(self, texts: pa.Array) -> list[bytes]:
        if not self.plain_pieces:
            return self.plain([t or "" for t in texts.to_pylist()])
        if self.held > MEMO_BYTES:
            self.old, self.memo, self.held = self.memo, {}, 0
        memo, old, new = self.memo, self.old, []
        flat, at = utf8_flat(texts)
        pieces, which, piece_at = self.cutter.distinct(flat, at)
        found = list(map(memo.get, pieces))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            x = pieces[i]
            if (ids := old.get(x)) is not None:
                memo[x] = found[i] = ids
                self.held += len(x) + len(ids) + ENTRY_BYTES
            else:
                new.append(i)
        for i, ids in zip(new, self.learn([pieces[i] for i in new]), strict=True):
            found[i] = ids
        out = put_together(found, which, piece_at)
        for i in self.with_added(flat.tobytes(), at):
            out[i] = self.plain([texts[i].as_py()])[0]
        return out

    def with_added(self, raw: bytes, at: np.ndarray) -> list[int]:
        """Which texts, given by their bytes and where each begins, hold an added token's name."""
        places = []
        for name in map(str.encode, self.added):
            place = raw.find(name)
            while place >= 0:
                places.append(place)
                place = raw.find(name, place + 1)
        return np.unique(np.searchsorted(at, places, "right") - 1).tolist() if places else []


def encoder(path: str) -> Encoder:
    return held(("repair_tokens", path), lambda: Encoder(path))


def compress(ids: np.ndarray, ends: np.ndarray, base: int, rounds: int | None = None, pairs: int = PAIRS, least: int = LEAST):
    """Symbols, their documents' ends, rules and expansion lengths. `ends`: where each document's ids end.

    Goes on until no pair occurs `least` times, or for so many rounds. Each round makes rules of at most `pairs` pairs.
    """
    seq, ends = ids.astype(np.int64), ends.astype(np.int64)
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lengths = np.ones(base, np.uint32)
    while len(seq) >= 2 and (rounds is None or len(lefts) <= rounds):
        key = seq[:-1] << 32 | seq[1:]
        # Counts by a hash pass most positions by: a slot's count is no less than that of any of its pairs.
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).view(np.int64)
        likely = (np.bincount(slot, minlength=1 << SLOT_BITS) >= least)[slot]
        likely[ends[ends < len(seq)] - 1] = False  # no pair begins with a document's end
        at = np.flatnonzero(likely)
        own, own_slot = key[at], slot[at]
        found, counts = np.unique(own, return_counts=True)
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        picked = found[often[np.argsort(-counts[often], kind="stable")][:pairs]]
        # Of pairs that share a slot, the most frequent is taken; the others are found again in the next round.
        of = ((picked.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).view(np.int64)
        only = np.sort(np.unique(of, return_index=True)[1])
        picked, of = picked[only], of[only]
        table = np.full(1 << SLOT_BITS, len(picked), np.int32)
        table[of] = np.arange(len(picked), dtype=np.int32)
        rank = table[own_slot]
        hit = np.append(picked, -1)[rank] == own
        hits, rank = at[hit], rank[hit]
        joined = np.diff(hits, prepend=-2) == 1
        before = np.where(joined, np.roll(rank, 1), len(picked))
        after = np.where(np.append(joined[1:], False), np.roll(rank, -1), len(picked))
        # In a run of one pair (aaaa), every other position counts, from the run's start.
        place = np.arange(len(hits))
        start = np.maximum.accumulate(np.where(rank != before, place, 0))
        taken = (rank <= after) & (before[start] > rank) & ((place - start) % 2 == 0)
        at, rank = hits[taken], rank[taken]
        # Pairs that lost most places to more frequent ones get no rule in this round.
        worth = np.bincount(rank, minlength=len(picked)) >= min(WORTH, least)
        worth[0] = True
        at, rank = at[worth[rank]], (np.cumsum(worth) - 1)[rank[worth[rank]]]
        pair = picked[worth]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq[at] = len(lengths) + rank
        lefts.append(pair >> 32)
        rights.append(pair & 0xFFFFFFFF)
        lengths = np.concatenate((lengths, lengths[lefts[-1]] + lengths[rights[-1]]))
        ends = np.cumsum(keep, dtype=np.int64)[ends - 1]
        seq = seq[keep]
    return seq.astype(np.uint32), ends, np.stack((np.concatenate(lefts), np.concatenate(rights)), 1).astype(np.uint32), lengths[base:]


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> bytes:
    """The ids that symbols stand for, as little-endian unsigned 32-bit integers."""
    unit = lambda s: s.to_bytes(4, "little") if s < base else of[s - base]
    of: list[bytes] = []
    for left, right in rules.tolist():
        of.append(unit(left) + unit(right))
    book = np.concatenate((np.arange(base, dtype=np.uint32), np.frombuffer(b"".join(of), "<u4")))
    sizes = np.concatenate((np.ones(base, np.int64), np.array([len(x) // 4 for x in of], np.int64)))
    each = sizes[symbols]
    shift = (np.cumsum(sizes) - sizes)[symbols] - (np.cumsum(each) - each)
    return book[np.repeat(shift, each) + np.arange(int(each.sum()))].astype("<u4").tobytes()


def _shard(part: int, number: int, before: int, keys: list, ids: list[bytes], base: int) -> pa.RecordBatch:
    flat = np.frombuffer(b"".join(ids), "<u4")
    ends = np.cumsum([len(x) // 4 for x in ids])
    symbols, symbol_ends, rules, lengths = compress(flat, ends, base)
    width = 2 if not len(symbols) or int(symbols.max()) < 1 << 16 else 4
    row = {
        "part": part, "shard": number, "before": before, "doc_ids": keys, "symbol_ends": symbol_ends.tolist(), "n_ids": len(flat), "rules": rules.astype("<u4").tobytes(),
        "expansions": lengths.astype("<u4").tobytes(), "symbols": symbols.astype(f"<u{width}").tobytes(), "base": base, "width": width,
    }
    return pa.RecordBatch.from_pylist([row], schema=_SHARD_SCHEMA)


_SHARD_SCHEMA = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("symbol_ends", pa.list_(pa.int64())), ("n_ids", pa.int64()),
    ("rules", pa.binary()), ("expansions", pa.binary()), ("symbols", pa.binary()), ("base", pa.int32()), ("width", pa.int32()),
])
_DECODED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("shard", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _write(path: str, end_id: int, shard_ids: int, batches):
    encode, part, number = encoder(path), TaskContext.get().partitionId(), 0
    base, end = max(encode.size, end_id + 1), end_id.to_bytes(4, "little")
    keys, ids, held, before = [], [], 0, 0
    for batch in batches:
        for piece in slices(batch, batch.schema.names[1], TEXT_BYTES):
            for key, found in zip(piece.column(0).to_pylist(), encode(piece.column(1)), strict=True):
                found += end
                if keys and held + len(found) // 4 > shard_ids:
                    yield _shard(part, number, before, keys, ids, base)
                    keys, ids, held, number, before = [], [], 0, number + 1, before + held
                keys.append(key)
                ids.append(found)
                held += len(found) // 4
    if keys:
        yield _shard(part, number, before, keys, ids, base)


def read_documents(row: dict, wanted: range | None = None):
    """(position, ids) of a shard's documents; with `wanted`, only of these positions, without expanding the others."""
    symbols = np.frombuffer(row["symbols"], f"<u{row['width']}").astype(np.uint32)
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
    ends = np.asarray(row["symbol_ends"], np.int64)
    lengths = np.frombuffer(row["expansions"], "<u4").astype(np.int64)
    if wanted is not None:
        for i in wanted:
            yield i, expand(symbols[ends[i - 1] if i else 0 : ends[i]], rules, row["base"])
        return
    each = np.ones(len(symbols), np.int64)
    high = symbols >= row["base"]
    each[high] = lengths[symbols[high] - row["base"]]
    stops = np.cumsum(each)[ends - 1] * 4
    whole, start = memoryview(expand(symbols, rules, row["base"])), 0
    for i, stop in enumerate(stops.tolist()):
        yield i, whole[start:stop]
        start = stop


def _read(batches):
    release()
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            held, size, at = [], 0, row["before"]
            for k, ids in read_documents(row):
                held.append((row["doc_ids"][k], row["part"], row["shard"], at, len(ids) // 4, bytes(ids)))
                size, at = size + len(ids), at + len(ids) // 4
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _DECODED_SCHEMA, strict=True)], schema=_DECODED_SCHEMA)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _DECODED_SCHEMA, strict=True)], schema=_DECODED_SCHEMA)


def write_shards(df: DataFrame, path: str, tokenizer_path: str, end_id: int, parts: int, key: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Tokenize whole texts and write the shards to `path`, in ascending order of the key."""
    ship(df.sparkSession)
    rows = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(partial(_write, tokenizer_path, end_id, shard_ids), SHARDS).write.parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """Rows (doc_id, part, shard, at, n_tokens, ids) of all documents; `at` counts ids within the part."""
    ship(spark)
    return spark.read.schema(SHARDS).parquet(path).mapInArrow(_read, DECODED)


def part_starts(spark, path: str) -> DataFrame:
    """Rows (part, before): ids of all parts before. There are as many as parts, a number that write_shards was given."""
    shards = spark.read.schema(SHARDS).parquet(path)
    sizes = sorted(shards.groupBy("part").agg(F.max(F.col("before") + F.col("n_ids")).alias("n")).collect())
    before = [0, *accumulate(n for _, n in sizes)]
    return spark.createDataFrame(pa.table({"part": pa.array([p for p, _ in sizes], pa.int32()), "before_part": pa.array(before[: len(sizes)], pa.int64())}))


def starts(spark, path: str) -> DataFrame:
    """Rows of read_shards with `start`, the ids of all documents before. What is broadcast has a row for each part."""
    return read_shards(spark, path).join(F.broadcast(part_starts(spark, path)), "part").withColumn("start", F.col("before_part") + F.col("at")).drop("before_part")
