"""Five-word shingles as sets of 64-bit hashes, computed with numpy over whole Arrow batches.

Words are maximal runs of bytes other than space and 0x09-0x0D of the UTF-8 text, with A-Z lower-cased.
A text with fewer than ``width`` words has the whole word sequence as its one shingle; a text without
words (or a null text) has the empty set.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
#: Texts are hashed in slabs of about this many bytes, so that temporary arrays stay small.
SLAB_BYTES = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C13)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    codes = np.arange(256, dtype=np.uint64)
    lowered = np.where((codes >= 65) & (codes <= 90), codes + np.uint64(32), codes)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    return _mix(lowered + np.uint64(1)), space


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _BASE, np.uint64)) if n else np.empty(0, np.uint64)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, in the order of ``texts``."""
    out: list[np.ndarray] = []
    slab: list[bytes] = []
    held = 0
    for text in texts:
        slab.append(text)
        held += len(text) + 1
        if held >= SLAB_BYTES:
            out += _slab_sets(slab, width)
            slab, held = [], 0
    if slab:
        out += _slab_sets(slab, width)
    return out


def _slab_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    values, space = _byte_tables()
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    ends_of_text = np.cumsum(lengths)
    gap = space[joined]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap))))
    starts, ends = edge[0::2], edge[1::2]
    words = _word_hashes(joined, starts, ends, values)
    first = np.searchsorted(starts, ends_of_text - lengths)
    last = np.searchsorted(starts, ends_of_text)
    grams = _window_hashes(words, width)
    sets = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        n = b - a
        if n == 0:
            sets.append(np.empty(0, np.uint64))
        elif n < width:
            sets.append(_window_hashes(words[a:b], n, salt=n))
        else:
            sets.append(np.unique(grams[a : b - width + 1]))
    return sets


def _word_hashes(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Polynomial hash of each word modulo 2**64, by segmented sums."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    inside = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(inside)) - np.repeat(begin, lengths)
    with np.errstate(over="ignore"):
        terms = values[joined[inside]] * _powers(int(lengths.max()))[place]
        return _mix(np.add.reduceat(terms, begin) + lengths.astype(np.uint64))


def _window_hashes(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(n, salt, np.uint64)
        for k in range(width):
            total = _mix(total * _BASE + words[k : k + n])
        return total
