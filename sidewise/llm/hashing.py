"""Hashes of words and of runs of words over Arrow buffers, without an object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import SPACE_BYTES

U = np.uint64
_MULT = U(0x9E3779B97F4A7C15)
_MULT2 = U(0xC2B2AE3D27D4EB4F)
#: Places of a word that have random values of their own for each byte.
_PLACES = 64
#: Bytes of words that are hashed together.
_SLICE = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[0x41:0x5B] += 0x20


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all others."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _random(n: int, seed: int) -> np.ndarray:
    return mix64(mix64(np.arange(1, n + 1, dtype=U) * _MULT) ^ mix64(np.full(n, seed, U) * _MULT2))


_VALUES = _random(_PLACES * 256, 1)
_FACTORS = _random(1 << 12, 2) | U(1)
_ROUNDS = _random(1 << 12, 3)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins and the last ends. Null: empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and the number of words before each text (and in all)."""
    word = ~_SPACE[raw]
    before = np.empty_like(word)
    if len(word):
        before[0] = False
        before[1:] = word[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(raw)]
    before[firsts] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    if len(word):
        after[-1] = False
        after[:-1] = word[1:]
    lasts = offsets[1:-1]
    lasts = lasts[(lasts > 0) & (lasts <= len(raw))] - 1
    after[lasts] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _hash_slice(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    inside = np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat(first, sizes).astype(np.int32)
    at = inside + np.repeat(starts, sizes)
    values = _VALUES[(inside % _PLACES) * 256 + bytes_[raw[at]]]
    if int(sizes.max()) > _PLACES:  # each stretch of places has a factor of its own
        block = inside // _PLACES
        far = np.flatnonzero(block)
        values[far] = mix64(values[far] + mix64(block[far].astype(U) * _MULT2))
    return mix64(np.add.reduceat(values, first) + sizes.astype(U) * _MULT2)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word: the sum of random values for each byte at each place, then
    mixed. A slice of words at a time, so that little memory is taken besides the result."""
    bytes_ = (_LOWER if lower else _SAME).astype(np.int32)
    out = np.zeros(len(starts), U)
    before = np.concatenate([[0], np.cumsum(ends - starts)])
    for a, b in chunks(before, _SLICE):
        out[a:b] = _hash_slice(raw, starts[a:b], ends[a:b], bytes_)
    return out


def hash_runs(words: np.ndarray, n: int, kind: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words; shorter than ``words`` by n - 1. Each place
    has a random odd factor; ``kind`` chooses the factors."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    total = np.full(m, n, U) * _MULT2
    for k in range(n):
        j = (k + 64 * kind) % len(_FACTORS)
        total += (words[k : k + m] ^ _ROUNDS[j]) * _FACTORS[j]
    return mix64(total)


def chunks(offsets: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes together, or a single longer one."""
    at = 0
    while at < len(offsets) - 1:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = max(at + 1, min(to, len(offsets) - 1))
        yield at, to
        at = to


def sets_of_runs(raw: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each text its number and the sorted distinct hashes of runs of ``n`` words, A-Z
    lower-cased. A text of fewer words has the whole as its one run; without words none."""
    for a, b in chunks(offsets):
        part, ends = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, stops, counts = word_bounds(part, ends)
        words = hash_words(part, starts, stops, lower=True)
        runs = hash_runs(words, n)
        for k in range(b - a):
            i, j = int(counts[k]), int(counts[k + 1])
            if j - i >= n:
                yield a + k, np.unique(runs[i : j - n + 1])
            else:
                yield a + k, hash_runs(words[i:j], j - i) if j > i else np.zeros(0, U)
