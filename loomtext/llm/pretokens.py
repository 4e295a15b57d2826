"""Texts of a batch cut into the pre-tokens of the byte-level pattern, in NumPy and Arrow.

The pattern is `PATTERN`: contractions, then runs of letters, of digits and of other signs, each with one space before it,
then white space. Classes of characters beyond ASCII are asked of whoever will encode them, once each, so that the cut is
theirs. Pre-tokens of a batch are told apart in Arrow, and Python handles each distinct one once a batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_UNKNOWN, _BLANK, _LETTER, _DIGIT, _OTHER = range(5)
_ASCII = np.full(256, _OTHER, np.uint8)
_ASCII[[0x20, *range(0x09, 0x0E)]] = _BLANK
_ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_ASCII[0x30:0x3A] = _DIGIT


class Cutter:
    """`count` tells into how many pre-tokens the encoder cuts a text."""

    def __init__(self, count: Callable[[str], int]):
        self.count = count
        self.known = np.zeros(0x110000, np.uint8)

    def _class(self, c: str) -> int:
        for kind, sign in ((_LETTER, "a"), (_DIGIT, "1"), (_OTHER, "!")):
            if self.count(sign + c + sign) == 1:
                return kind
        return _BLANK

    def starts(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the pre-tokens of texts, given by their bytes and where each begins (one more entry), begin."""
        size = len(flat)
        kind = _ASCII[flat]
        lead = np.flatnonzero(flat >= 0xC0)
        if len(lead):
            first = flat[lead]
            more = np.zeros((3, len(lead)), np.uint32)
            for i in range(3):  # bytes past the end belong to no character of so many bytes
                more[i] = flat[np.minimum(lead + 1 + i, size - 1)] & 0x3F
            two, three = first < 0xE0, first < 0xF0
            point = np.where(two, (first & 0x1F).astype(np.uint32) << 6 | more[0], np.where(three, (first & 0x0F).astype(np.uint32) << 12 | more[0] << 6 | more[1], (first & 0x07).astype(np.uint32) << 18 | more[0] << 12 | more[1] << 6 | more[2]))
            own = self.known[point]
            if not own.all():
                for c in np.unique(point[own == _UNKNOWN]).tolist():
                    self.known[c] = self._class(chr(c))
                own = self.known[point]
            for i, some in enumerate((slice(None), slice(None), ~two, ~three)):
                kind[lead[some] + i] = own[some]
        new = np.ones(size + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=new[1:-1])
        texts = at[:-1][at[:-1] < at[1:]]
        new[texts] = True
        fresh = np.zeros(size + 1, bool)
        fresh[texts] = fresh[size] = True
        runs = np.flatnonzero(new)
        blank = np.flatnonzero(kind[runs[:-1]] == _BLANK)
        end = runs[blank + 1]
        end = end[~fresh[end]]  # of white space before a sign, the last one stands alone; a space joins the sign
        last = end - 1
        while len(inner := np.flatnonzero(flat[last] & 0xC0 == 0x80)):
            last[inner] -= 1
        new[last] = True
        new[end[flat[last] == 0x20]] = False
        quote = np.flatnonzero(flat == 0x27)
        quote = quote[new[quote]]
        if len(quote):
            a, b = flat[np.minimum(quote + 1, size - 1)], flat[np.minimum(quote + 2, size - 1)]
            one = (a == 0x73) | (a == 0x74) | (a == 0x6D) | (a == 0x64)
            two = ((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)
            long = np.where(one, 1, np.where(two & (quote + 2 < size) & ~fresh[np.minimum(quote + 2, size)], 2, 0))
            there = (long > 0) & (quote + 1 < size) & ~fresh[quote + 1]
            new[quote[there] + 1] = False
            new[(quote + 1 + long)[there]] = True
        return np.flatnonzero(new[:size])

    def distinct(self, flat: np.ndarray, at: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct pre-tokens of texts; which of them each pre-token is; where each text's pre-tokens begin (one more entry)."""
        cut = self.starts(flat, at)
        bounds = np.append(cut, len(flat)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(bounds), pa.py_buffer(flat)]).dictionary_encode()
        return coded.dictionary.to_pylist(), np.asarray(coded.indices), np.searchsorted(cut, at)


def put_together(found: list[bytes], which: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The ids of each text, of those of its pre-tokens."""
    sizes = np.fromiter(map(len, found), np.int32, len(found)) >> 2
    book = np.frombuffer(b"".join(found), "<u4")
    each = sizes[which]
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(each, dtype=np.int64)))
    shift = (np.cumsum(sizes, dtype=np.int64) - sizes)[which] - ends[:-1]
    whole = memoryview(book[np.repeat(shift, each) + np.arange(ends[-1])].tobytes())
    stops = (4 * ends[at]).tolist()
    return [bytes(whole[start:stop]) for start, stop in zip(stops[:-1], stops[1:], strict=True)]
