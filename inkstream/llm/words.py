"""Words of UTF-8 text as 64-bit identities, computed for whole Arrow batches in numpy.

A word is a maximal run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased.  All
excluded characters are ASCII, so the rule can be applied byte by byte without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[0x00:0x30] = _IS_WORD[0x3A:0x61] = _IS_WORD[0x7B:0x80] = False

_rng = np.random.default_rng(20240131)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_STEP = np.uint64(int(_rng.integers(1, 2**62)) * 2 + 1)
_BLOCK = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWER = _powers(_BASE, 2 * _BLOCK + 1)
_INVERSE = _powers(pow(_BASE, -1, 2**64), 2 * _BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    """hashes, starts, ends: per word; offsets: where each text's words begin; data: lower-cased bytes."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def prefix(self, n: int) -> np.ndarray:
        """Identity of the first n bytes of each word (all of it, if shorter)."""
        return _hash(self.data, self.starts, np.minimum(self.starts + n, self.ends), n)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Identity of k consecutive words from each word on, and whether they all lie in one text."""
        n = len(self.hashes)
        out, valid = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
        if n >= k:
            total = self.hashes[: n - k + 1].copy()
            for j in range(1, k):
                total *= _STEP
                total += self.hashes[j : n - k + 1 + j]
            out[: n - k + 1] = mix(total + np.uint64(k))
            last = np.repeat(self.offsets[1:], self.counts())
            valid[: n - k + 1] = np.arange(n - k + 1) + k <= last[: n - k + 1]
        return out, valid


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    out = np.zeros(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        first = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, first + _BLOCK, "right")))
        size = int(ends[hi - 1]) - first
        if size > 2 * _BLOCK:  # a single word of over a block
            total = 0
            for at in range(first, first + size, _BLOCK):
                part = _BYTE[data[at : min(at + _BLOCK, first + size)]] * _POWER[: min(_BLOCK, first + size - at)]
                total = (total * 0x9E3779B97F4A7C15 + int(part.sum(dtype=np.uint64))) % 2**64
            out[lo] = total
        else:
            run = np.zeros(size + 1, dtype=np.uint64)
            np.cumsum(_BYTE[data[first : first + size]] * _POWER[:size], out=run[1:])
            s, e = starts[lo:hi] - first, ends[lo:hi] - first
            out[lo:hi] = (run[e] - run[s]) * _INVERSE[s]
        lo = hi
    return mix(out + np.uint64(salt))


def split(texts: pa.Array) -> Words:
    """The words of each text of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, where, values = texts.buffers()
    where = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(values, dtype=np.uint8)[where[0] : where[-1]] if values is not None and where[-1] > where[0] else np.zeros(0, np.uint8)
    where = where - where[0]
    data = _LOWER[raw]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[where] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return Words(_hash(data, starts, ends), starts, ends, np.searchsorted(starts, where), data)


def parts(batch: pa.RecordBatch, column: str, most: int = _BLOCK) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """The batch in row ranges of about ``most`` bytes of text, each with its words."""
    where = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))])
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(where, where[lo] + most, "right")) - 1)
        rows = batch.slice(lo, hi - lo)
        yield rows, split(rows.column(column))
        lo = hi

