"""Word shingles of whole texts as 64-bit hashes, computed for a batch of texts at once."""

from __future__ import annotations

import numpy as np

#: Odd factors of the polynomial hash and of mixing; fixed, as hashes of different tasks meet.
FACTOR, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_MASK = (1 << 64) - 1

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_powers = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(MIX_1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> np.ndarray:
    global _powers
    while len(_powers) <= n:
        _powers = np.concatenate((_powers, _powers * np.uint64(pow(FACTOR, len(_powers), 1 << 64))))
    return _powers


#: Hashes of bytes: no two alike, none zero.
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


def word_spans(flat: np.ndarray, at: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, where each text's words start (one more entry than texts), and the bytes
    where the words begin. `blank` tells the bytes that separate words."""
    low = _LOWER[flat]
    solid = ~blank[low]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts = at[:-1][at[:-1] < at[1:]]
    first[starts] = solid[starts]
    begin = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = starts[1:] - 1
    last[ends] = solid[ends]
    end = np.flatnonzero(last) + 1
    sizes = end - begin
    # Bytes from the word's start on, each times a power of FACTOR; the sum of a word is a difference of running sums.
    place = np.arange(len(flat)) - np.repeat(begin, np.diff(np.append(begin, len(flat)))) if len(begin) and begin[0] == 0 else None
    if place is None:
        head = begin[0] if len(begin) else len(flat)
        place = np.concatenate((np.zeros(head, np.int64), np.arange(head, len(flat)) - np.repeat(begin, np.diff(np.append(begin, len(flat))))))
    longest = int(sizes.max()) if len(sizes) else 0
    powers = _powers_to(longest + 1)
    terms = np.where(solid, _BYTE[low] * powers[np.minimum(place, longest)], np.uint64(0))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
    words = mixed(total[end] - total[begin] + sizes.astype(np.uint64))
    return words, np.searchsorted(begin, at), begin


def word_hashes(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return word_spans(flat, at)[:2]


def shingle_sets(flat: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of n words of each text, ascending, and where each text's start.

    A text of fewer words has its whole sequence as its only shingle; one without words has none.
    """
    words, word_at = word_hashes(flat, at)
    counts = np.diff(word_at)
    rolled = words.copy()
    for k in range(1, n):
        rolled = (rolled[:-1] if k > 1 else rolled[: len(words) - 1]) * np.uint64(FACTOR) + words[k:] if len(words) > k else rolled[:0]
    rolled = mixed(rolled) if len(rolled) else rolled
    out, sizes = [], np.zeros(len(counts), np.int64)
    for i, (start, count) in enumerate(zip(word_at[:-1].tolist(), counts.tolist(), strict=True)):
        if count >= n:
            own = np.sort(rolled[start : start + count - n + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        elif count:
            h = 0
            for w in words[start : start + count].tolist():
                h = (h * FACTOR + w) & _MASK
            own = mixed(np.array([h ^ count], np.uint64))
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    flat_sets = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return flat_sets, np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))


