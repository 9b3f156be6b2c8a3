"""Vectorised text primitives on Arrow string columns: words, word hashes and shingles of many texts at once.

A column's bytes are treated as one array; offsets tell texts apart. Temporary arrays take some tens of bytes per text byte,
so callers go through a batch in pieces of bounded size; a single text over that size is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes in a piece.
PIECE = 1 << 18

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: ASCII white space separates words.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: Words of letters and digits: ASCII ones, and any byte of a character beyond ASCII.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: A-Z to a-z, all else as it is.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_BYTE_VALUES = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER_VALUES = _BYTE_VALUES[LOWER]

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        _powers, _inverses = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x)])) for x in (_BASE, _INVERSE))
    return _powers[:n], _inverses[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its texts in them; null is empty."""
    values = values.fill_null("").cast(pa.large_string())
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def pieces(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, a longer row alone."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(rows, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, bounds): the words of texts data[offsets[i]:offsets[i + 1]]; text i has words bounds[i]:bounds[i + 1].

    ``offsets`` start at 0 and end at len(data).
    """
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    flag = in_word[data]
    start, end = flag.copy(), flag.copy()
    start[1:] &= ~flag[:-1]
    end[:-1] &= ~flag[1:]
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    start[first] = flag[first]
    end[last] = flag[last]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, offsets)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word data[s:e], from prefix sums of a polynomial; ``lower`` folds A-Z."""
    if not len(s):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data))
    terms = (_LOWER_VALUES if lower else _BYTE_VALUES)[data] * power
    sums = np.cumsum(terms)
    return mix((sums[e - 1] - sums[s] + terms[s]) * inverse[s] + (e - s).astype(np.uint64))


def hash_of(word: str, lower: bool = True) -> int:
    """The hash that ``word_hashes`` gives one word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(data, np.zeros(1, np.int64), np.array([len(data)]), lower)[0])


def shingles(h: np.ndarray, words: int) -> np.ndarray:
    """Hashes of all runs of ``words`` word hashes of one text; of fewer words, one of the whole sequence; none of none."""
    n = len(h)
    if not n:
        return h
    width = min(words, n)
    out = np.full(n - width + 1, _U(width))
    for k in range(width):
        out = mix(out * _BASE + h[k : n - width + 1 + k])
    return out
