"""Words and shingles of texts as 64-bit hashes, computed over whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SHINGLE = 5
_RANDOM = np.random.default_rng(20240229)
BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
PLACES = _RANDOM.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an array, NULL as empty, and where each text starts and ends."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[bounds[0]:bounds[-1]], bounds - bounds[0]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of an array of texts: ``hashes``, byte ``starts`` and
    ``ends`` within all bytes, and ``first``: number of words before each text."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        self.data, self.bounds = text_bytes(texts)
        self.bytes = LOWER[self.data] if lower else self.data
        inside = ~SPACE[self.bytes]
        n = len(inside)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cut = self.bounds[(self.bounds > 0) & (self.bounds < n)]
        before[cut], after[cut - 1] = False, False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.bounds)
        if len(self.starts):
            lengths = self.ends - self.starts
            place = np.arange(len(inside), dtype=np.int64)[inside] - np.repeat(self.starts, lengths)
            powers = np.multiply.accumulate(np.full(int(lengths.max()) + 1, STEP))
            values = BYTE_VALUES[self.bytes[inside]] * powers[place]
            begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            self.hashes = mixed(np.add.reduceat(values, begins) + lengths.astype(np.uint64))
        else:
            self.hashes = np.empty(0, np.uint64)

    def of(self, text: int) -> np.ndarray:
        return self.hashes[self.first[text]:self.first[text + 1]]


def shingle_set(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingles of ``size`` words; the whole sequence if it is shorter, none without words."""
    if not len(words):
        return words
    if len(words) < size:
        return mixed((words * PLACES[:len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    total = words[:len(words) - size + 1] * PLACES[0]
    for k in range(1, size):
        total = total + words[k:len(words) - size + 1 + k] * PLACES[k]
    return np.unique(mixed(total))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
