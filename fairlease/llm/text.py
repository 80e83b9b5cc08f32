"""Numpy text helpers for Arrow batches: byte blocks, words, and rolling hashes of words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once (its arrays fit a core's cache); a longer single text makes a block of its own.
BLOCK_BYTES = (1 << 18) - 1
#: For lookups in large word tables, whose cost is by block.
LARGE_BLOCK = (1 << 20) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    ends = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if len(column) and buffers[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + block_bytes, "right")) - 1)
        stop = min(stop, len(column))
        yield row, stop, data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop
    release()


@lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: nothing to trim
        return None


def release() -> None:
    """Give freed memory back to the system: several workers share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text): maximal runs of non-separator bytes within a text."""
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


@lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


@lru_cache(maxsize=4)
def byte_codes(seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RollingHash:
    """Hashes of any substrings of a block from one pass over it."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        up, self._down = _powers(max(18, int(len(data)).bit_length()))
        self._sums = np.zeros(len(data) + 1, np.uint64)
        terms = byte_codes(seed)[data]
        terms *= up[: len(data)]
        np.cumsum(terms, out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self._sums[ends]
        h -= self._sums[starts]
        h *= self._down[starts]
        h += (ends - starts).astype(np.uint64)
        return mix(h)


def sorted_unique(x: np.ndarray) -> np.ndarray:
    """Distinct values in order; sorting is far quicker here than numpy's hash-based unique."""
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])]


def sorted_counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each occurs."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))
    return x[first], np.diff(np.append(first, len(x)))


class WordTable:
    """Values of words by their 64-bit hash, worked out once a word.

    ``columns`` holds an array per value; ``ragged`` ones (with their start offsets) hold any
    number of entries a word.  At most ``keep`` words with ``KEPT_VALUES * keep`` entries stay; once
    full, new words last for one lookup, and what a lookup of long words grew is given back.  Two
    of a table's words share a hash with odds of about ``keep ** 2 / 2 ** 65``.
    """

    #: Entries kept a word, on average.
    KEPT_VALUES = 8

    def __init__(self, keep: int, columns: dict[str, type], ragged: str, ragged_type: type):
        self.keep, self.ragged, self.words = keep, ragged, 0
        self.keys, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.columns = {c: np.empty(1024, t) for c, t in columns.items()}
        self.values, self.starts = np.empty(4096, ragged_type), np.zeros(1025, np.int64)

    def _put(self, held: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
        """``new`` written at ``at``, into an array twice as long if need be."""
        if at + len(new) > len(held):
            grown = np.empty(2 * (at + len(new)), held.dtype)
            grown[:at] = held[:at]
            held = grown
        held[at : at + len(new)] = new
        return held

    def resolve(self, h: np.ndarray, make) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """(slot of each word, columns, ragged values, their starts).

        ``make(i)`` gets the first positions of the words that are new and returns their column
        values, with a list of sequences for the ragged one.
        """
        order = np.argsort(h)
        in_order = h[order]
        first = np.concatenate([np.ones(min(1, len(h)), bool), in_order[1:] != in_order[:-1]])
        distinct = in_order[first]
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        slot = np.empty(len(distinct), np.int64)
        slot[known] = self.slots[at[known]]
        if not known.all():
            new = np.flatnonzero(~known)
            slot[new] = self.words + np.arange(len(new))
            made = make(order[np.flatnonzero(first)[new]])
            own = made.pop(self.ragged)
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            used = int(self.starts[self.words])
            self.values = self._put(self.values, used, np.fromiter((x for w in own for x in w), self.values.dtype, int(sizes.sum())))
            self.starts = self._put(self.starts, self.words + 1, used + np.cumsum(sizes))
            self.columns = {c: self._put(v, self.words, np.asarray(made[c], v.dtype)) for c, v in self.columns.items()}
            if self.words + len(new) <= self.keep and used + int(sizes.sum()) <= self.KEPT_VALUES * self.keep:  # else the next lookup writes over them
                self.words += len(new)
                self.keys = np.insert(self.keys, at[new], distinct[new])
                self.slots = np.insert(self.slots, at[new], slot[new])
        columns, values, starts = self.columns, self.values, self.starts
        if len(values) > 2 * self.KEPT_VALUES * self.keep:
            self.values = values[: int(starts[self.words])].copy()
        of = np.empty(len(h), np.int64)
        of[order] = slot[np.cumsum(first) - 1]
        return of, columns, values, starts


def gather(slot: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ragged values of all words in a row, number of values of each word)."""
    sizes = starts[slot + 1] - starts[slot]
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts[slot] - before, sizes) + np.arange(int(sizes.sum()))], sizes
