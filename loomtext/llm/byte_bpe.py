"""Byte-level BPE encoding and decoding with an Aho-Corasick automaton.

Bytes are mapped to Latin-1 characters, so that pyahocorasick can hold the vocabulary. A piece is encoded from the
left by its longest token; a token is kept only if it is compatible with the one before it, that is if merging the
two tokens' bytes would give these two tokens again. Where none fits, the last token is undone and a shorter one is
tried; positions that led nowhere are marked, so that each is given up once and the time stays linear. Compatible
neighbours everywhere mean exactly the result of merging by rank, so ids equal those of the merge loop.

Null texts count as empty and give no ids; repeated rows are each encoded; extra columns are not carried along. Very long
texts are encoded whole, in linear time, and what of them is long is not remembered. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import struct
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomtext.llm._arrays import binary_column, slices, utf8_flat
from loomtext.llm._held import held, release
from loomtext.llm.pretokens import PATTERN, Cutter, put_together
from loomtext.runtime import ship

#: Bytes that a worker's memos of pieces with a space before them and of other pieces hold, about, before these become the
#: old ones and new ones begin, so that all four stay below 50 MB; what an entry takes besides its bytes and ids; bytes of
#: what is kept at most, as longer pieces (of texts without spaces) hardly come again.
CHUNK_BYTES, PIECE_BYTES, ENTRY_BYTES, LONG = 19_000_000, 4_000_000, 160, 64
#: Pairs of tokens whose compatibility a worker remembers, of some 120 bytes each; text bytes encoded at a time.
FIT_ENTRIES, TEXT_BYTES = 150_000, 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    """Encoder for one vocabulary. `ranks` maps bytes to ids; a lower id merges first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.length = list(map(len, self.bytes_of))
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}
        self._shorter: dict[int, int] = {}
        self._pieces: dict[bytes, bytes] = {}
        self._old_pieces: dict[bytes, bytes] = {}
        self._chunks: dict[bytes, bytes] = {}
        self._old_chunks: dict[bytes, bytes] = {}
        self._chunk_bytes = self._piece_bytes = 0
        matches = self.pattern.findall  # not through self, so that an encoder goes when it is let go
        self._cutter = Cutter(lambda text: len(matches(text))) if pattern == PATTERN else None

    def merge(self, token: bytes, below: int | None = None) -> list[int]:
        """Merging by rank, step by step; with `below`, only merges of a lower rank than that."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best) and (below is None or rank < below):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; None for a single byte."""
        if token not in self._parts:
            whole = self.bytes_of[token]
            if len(whole) == 1:
                self._parts[token] = None
            else:
                halves = self.merge(whole, token)
                if len(halves) != 2:
                    raise ValueError(f"token {token} can't be reached by merges")
                self._parts[token] = (halves[0], halves[1])
        return self._parts[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives these two tokens."""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= FIT_ENTRIES:
                self._fits.clear()
            known = self._fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Take merges back from the latest, always the one nearest the border. A merge across the border that comes
        # before the one just taken back would have been made in its place.
        earlier_than = 1 << 62
        while True:
            across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and across < earlier_than:
                return False
            l_parts, r_parts = self.parts(left), self.parts(right)
            if l_parts is None and r_parts is None:
                return True
            if r_parts is None or (l_parts is not None and left > right):
                earlier_than, left = left, l_parts[1]
            else:  # of equal merges, the left one comes first: that across the border
                earlier_than, right = right + 1, r_parts[0]

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix; -1 if none."""
        found = self._shorter.get(token)
        if found is None:
            whole, found = self.bytes_of[token], -1
            for n in range(len(whole) - 1, 0, -1):
                if whole[:n] in self.ranks:
                    found = self.ranks[whole[:n]]
                    break
            self._shorter[token] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        if not piece:
            return []
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        length, known, fits = self.length, self._fits.get, self.fits
        longest = [0] * len(piece)
        reach = [0] * len(piece)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            n = length[token]
            if n > reach[end + 1 - n]:
                reach[end + 1 - n], longest[end + 1 - n] = n, token
        open_at = bytearray(b"\x01") * (len(piece) + 1)
        out: list[int] = []
        at, token, size = 0, longest[0], len(piece)
        while at < size:
            while token >= 0:
                end = at + length[token]
                if open_at[end] and (not out or (fit := known(out[-1] << 32 | token)) or (fit is None and fits(out[-1], token))):
                    out.append(token)
                    at = end
                    token = longest[at] if at < size else -1
                    break
                token = self.shorter(token)
            else:
                open_at[at] = 0
                token = out.pop()
                at -= length[token]
        return out

    def remembered(self, piece: bytes) -> bytes:
        """Ids of one match of the pattern, kept for the next batches."""
        spaced = piece[0] == 0x20
        ids = (self._old_chunks if spaced else self._old_pieces).get(piece)
        if ids is None:
            found = self.encode_piece(piece)
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) > LONG:
            return ids
        held = len(piece) + len(ids) + ENTRY_BYTES
        if spaced:
            self._chunks[piece] = ids
            self._chunk_bytes += held
            if self._chunk_bytes > CHUNK_BYTES:
                self._old_chunks, self._chunks, self._chunk_bytes = self._chunks, {}, 0
        else:
            self._pieces[piece] = ids
            self._piece_bytes += held
            if self._piece_bytes > PIECE_BYTES:
                self._old_pieces, self._pieces, self._piece_bytes = self._pieces, {}, 0
        return ids

    def _known(self, piece: bytes) -> bytes | None:
        return self._chunks.get(piece) or self._pieces.get(piece)

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers, each match of the pattern separately."""
        if self._cutter is None:
            found = [[x.encode() for x in self.pattern.findall(text or "")] for text in texts.to_pylist()]
            return [b"".join([self._known(x) or self.remembered(x) for x in own]) for own in found]
        pieces, which, at = self._cutter.distinct(*utf8_flat(texts))
        ids = list(map(self._known, pieces))
        for i in [i for i, x in enumerate(ids) if x is None]:
            ids[i] = self.remembered(pieces[i])
        return put_together(ids, which, at)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text."""
        return self.encode_all(pa.array([text], pa.large_string()))[0]

    def decode(self, ids: bytes) -> bytes:
        """Bytes of ids given as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(path: str, pattern: str) -> ByteBpe:
    """The worker's encoder for a vocabulary file."""
    return held(("byte_bpe", path, pattern), lambda: ByteBpe(read_ranks(path), pattern))


def _encode(path: str, pattern: str, key: str, batches):
    bpe = encoder(path, pattern)
    for batch in batches:
        for some in slices(batch, batch.schema.names[1], TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([some.column(0), binary_column(bpe.encode_all(some.column(1)))], names=[key, "ids"])
    del bpe
    release()  # a task warms its memos within a second, and workers that wait hold none


def _decode(path: str, pattern: str, key: str, batches):
    bpe = encoder(path, pattern)
    for batch in batches:
        texts = [bpe.decode(ids.as_py() or b"") for ids in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), binary_column(texts)], names=[key, "ids", "decoded"])
    del bpe
    release()


def _round_trip(path: str, pattern: str, key: str, batches):
    yield from _decode(path, pattern, key, _encode(path, pattern, key, batches))
    release()


def _typed(df: DataFrame, key: str) -> str:
    return f"`{key}` {df.schema[key].dataType.simpleString()}"


def encode(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids): ids as little-endian unsigned 32-bit integers, without special tokens."""
    ship(df.sparkSession)
    return df.select(key, text).mapInArrow(partial(_encode, ranks_path, pattern, key), f"{_typed(df, key)}, ids binary")


def decode(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Rows (key, ids, decoded): the bytes that the ids stand for; null ids count as none."""
    ship(df.sparkSession)
    return df.select(key, ids).mapInArrow(partial(_decode, ranks_path, pattern, key), f"{_typed(df, key)}, ids binary, decoded binary")


def round_trip(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids, decoded) of texts: encode and decode in one worker, so that it holds the vocabulary once."""
    ship(df.sparkSession)
    return df.select(key, text).mapInArrow(partial(_round_trip, ranks_path, pattern, key), f"{_typed(df, key)}, ids binary, decoded binary")
