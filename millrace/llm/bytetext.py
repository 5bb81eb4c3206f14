"""Whole batches of texts as byte arrays: word bounds and word hashes without a loop over words.

UTF-8 bytes of 128 and above belong to non-ASCII characters only, so classes
of ASCII characters can be told on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that one vectorised step takes; a longer text is a step of its own.
STEP = 1 << 21

_random = np.random.default_rng(20240501)
#: A random odd 64-bit number for each byte.
CODES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def class_table(pattern_ranges: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes in the (first, last) ranges."""
    table = np.zeros(256, dtype=bool)
    for first, last in pattern_ranges:
        table[first : last + 1] = True
    return table


def powers(n: int) -> np.ndarray:
    """BASE to the power 0..n-1, modulo 2**64."""
    out = np.full(max(n, 1), BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each text starts (one more at the end); null texts are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def steps(starts: np.ndarray, size: int = STEP) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `size` bytes together."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + size, "right")) - 1)
        yield first, last
        first = last


class Words:
    """Words of a run of texts: bounds, hashes, and which words each text has."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, table: np.ndarray):
        self.data = data = FOLD[data]
        inside = table[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        own = starts[:-1][np.diff(starts) > 0]
        begins[own] = inside[own]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        ends[own - 1] = inside[own - 1]  # own[0] - 1 is the last byte, an end anyway
        self.begin, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        #: Words of text i are first[i] to first[i + 1].
        self.first = np.searchsorted(self.begin, starts)
        lengths = self.end - self.begin
        if len(self.begin):
            letters = np.flatnonzero(inside)
            heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            place = np.arange(len(letters)) - np.repeat(heads, lengths)
            weight = powers(int(lengths.max()))
            self.hash = mixed(np.add.reduceat(CODES[data[letters]] * weight[place], heads))
        else:
            self.hash = np.zeros(0, dtype=np.uint64)

    def runs(self, n: int) -> np.ndarray:
        """A hash for each n words that begin at a word, as long as n words follow in the table; runs over a text's end are the caller's to leave out."""
        return run_hash(self.hash, n)

    def bytes_of(self, first: int, n: int) -> bytes:
        """n words from the first, joined by spaces."""
        return b" ".join(self.data[self.begin[i] : self.end[i]].tobytes() for i in range(first, first + n))


def run_hash(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n word hashes."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    weight, total = powers(n + 1)[1:], np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * weight[k]
    return mixed(total)
