"""Word tables of whole Arrow text columns, as NumPy arrays: no Python object per word.

A batch of texts is one byte buffer.  Words are found, hashed to 64 bits and counted with array
operations over that buffer, so the cost per word is a few dozen nanoseconds and memory is bounded
by the size of a batch (``batches`` cuts what Spark hands over into pieces of about ``BATCH_BYTES``;
a longer text is a batch of its own).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 1_000_000
#: Bytes of a batch that are looked at together.
SEGMENT = 1 << 20
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Also ASCII punctuation separates.
PUNCT = SPACE.copy()
PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(z: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finalizer of splitmix64; a bijection of 64 bits."""
    z = z + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    n, inv = 1 << bits, pow(base, -1, 1 << 64)
    both = []
    for b in (base, inv):
        a = np.full(n, b, np.uint64)
        a[0] = 1
        both.append(np.cumprod(a, dtype=np.uint64))
    return both[0], both[1]


class Rolling:
    """Polynomial hashes modulo 2**64 of any range of a sequence of integers."""

    def __init__(self, values: np.ndarray, base: int = _Q):
        n = len(values)
        self.up, self.down = _powers(base, max(10, int(n).bit_length()))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * self.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


class Words:
    """Words of a text column: ``start``/``end`` byte positions, ``hash``, and ``first[d]:first[d+1]`` per text.

    The bytes are read in segments of ``SEGMENT``, so what is held beside the texts is three numbers a word; a word that
    crosses segments has its hash put together from its parts.
    """

    def __init__(self, texts: pa.Array, separators: np.ndarray = SPACE, lower: bool = False):
        texts = pc.fill_null(texts, "")
        wide = pa.types.is_large_string(texts.type)
        _, offsets, data = texts.buffers()
        self.at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bytes = raw[self.at[0] : self.at[-1]]
        self.at = self.at - self.at[0]
        self.n_docs = len(texts)
        self._table = LOWER if lower else np.arange(256, dtype=np.uint8)
        starts, ends, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        open_at, open_sum = -1, 0  # a word begun in an earlier segment, and its sum so far
        for lo in range(0, len(self.bytes), SEGMENT):
            hi = min(lo + SEGMENT, len(self.bytes))
            start, end, sums, open_at, open_sum = self._segment(lo, hi, separators, open_at, open_sum)
            starts.append(start)
            ends.append(end)
            hashes.append(sums)
        self.start, self.end = np.concatenate(starts), np.concatenate(ends)
        self.hash = mix(np.concatenate(hashes) + (self.end - self.start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        self.first = np.searchsorted(self.start, self.at)

    def _segment(self, lo: int, hi: int, separators: np.ndarray, open_at: int, open_sum: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
        """Words that end between ``lo`` and ``hi``, their polynomial sums, and the word still open at ``hi``."""
        part = self.bytes[lo:hi]
        inside = ~separators[part]
        edge = np.zeros(hi - lo + 1, bool)  # texts begin or end here
        edge[self.at[np.searchsorted(self.at, lo) : np.searchsorted(self.at, hi, "right")] - lo] = True
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1] | edge[1:-1]
        closes[:-1] &= ~inside[1:] | edge[1:-1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        sums = Rolling(self._table[part].astype(np.uint64) + np.uint64(1), _P).of(start, end)
        start, end = start + lo, end + lo
        if open_at >= 0:  # the first piece is the rest of the open word
            sums[0] = np.uint64((open_sum + int(sums[0]) * pow(_P, lo - open_at, 1 << 64)) % (1 << 64))
            start[0] = open_at
        if hi < len(self.bytes) and inside[-1] and not edge[-1] and not separators[self.bytes[hi]]:
            return start[:-1], end[:-1], sums[:-1], int(start[-1]), int(sums[-1])
        return start, end, sums, -1, 0

    def prefixes(self, lengths: Sequence[int]) -> list[np.ndarray]:
        """Hashes of the first bytes of each word, for each of the ascending ``lengths`` (of the whole word, if shorter)."""
        out, total, power = [], np.zeros(len(self.start), np.uint64), 1
        room = self.end - self.start
        for k in range(max(lengths)):
            values = (self._table.astype(np.uint64) + np.uint64(1)) * np.uint64(power)
            total += values[self.bytes[np.minimum(self.start + k, len(self.bytes) - 1)]] * (room > k) if len(room) else total
            power = power * _P % (1 << 64)
            if k + 1 in lengths:
                out.append(mix(total, k + 1))
        return out

    def doc(self) -> np.ndarray:
        """The text's number, for each word."""
        return np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def ends(self) -> np.ndarray:
        """One past the last word of the text, for each word."""
        return np.repeat(self.first[1:], np.diff(self.first))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of ``size`` words and the text each stands in.

    A text of 1 to ``size - 1`` words has one shingle, the whole text.
    """
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.diff(w.first)
    begin = np.arange(n)
    doc, ends = w.doc(), w.ends()
    keep = (begin + size <= ends) | ((begin == w.first[doc]) & (count[doc] < size))
    begin, doc = begin[keep], doc[keep]
    end = np.minimum(begin + size, ends[keep])
    return mix(Rolling(w.hash).of(begin, end), size), doc


def batches(it: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text of each is about ``limit`` bytes (a longer text stands alone)."""
    for batch in it:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        lo = 0
        while lo < len(size):
            base = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
