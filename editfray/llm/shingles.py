"""Hashes of word shingles, for whole Arrow columns at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random number for each byte, after A-Z is lower-cased.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.concatenate((np.ones(1, dtype=np.uint64), np.cumprod(np.full(2 * n, _STEP), dtype=np.uint64)))
    return _powers[:n]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word [^\\x20\\x09-\\x0D]+ of all texts, and where each text's words begin (one more entry than texts)."""
    parts = [b"" if x is None else x for x in texts.cast(pa.binary()).to_pylist()]
    raw = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    blank = _BLANK[raw]
    step = np.diff(blank.astype(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    places = np.concatenate(([0], np.cumsum([len(x) + 1 for x in parts])))
    first = np.searchsorted(starts, places)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), first
    ends = ends[-len(starts):] if len(ends) > len(starts) else ends
    sizes = ends - starts
    inside = np.flatnonzero(~blank)
    offsets = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    within = np.arange(len(inside)) - np.repeat(offsets, sizes)
    values = _BYTE[raw[inside]] * _power(int(sizes.max()))[within]
    return mix(np.add.reduceat(values, offsets) + sizes.astype(np.uint64)), first


def shingle_hashes(texts: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each shingle of all texts, in order and with repeats, and where each text's begin.

    A text of fewer words has one shingle, the whole sequence; one without words has none."""
    hashes, first = word_hashes(texts)
    counts = np.diff(first)
    n = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    begin = np.concatenate(([0], np.cumsum(n)))
    out = np.zeros(begin[-1], dtype=np.uint64)
    full = counts >= words
    if full.any():
        rows = max(len(hashes) - words + 1, 0)
        sums = np.zeros(rows, dtype=np.uint64)
        for k in range(words):
            sums += hashes[k : k + rows] * _PLACE[k]
        wanted = np.repeat(first[:-1][full] - np.concatenate(([0], np.cumsum(n[full])[:-1])), n[full]) + np.arange(n[full].sum())
        to = np.repeat(begin[:-1][full] - np.concatenate(([0], np.cumsum(n[full])[:-1])), n[full]) + np.arange(n[full].sum())
        out[to] = sums[wanted]
    for i in np.flatnonzero((counts > 0) & ~full):
        own = hashes[first[i] : first[i + 1]]
        out[begin[i]] = np.concatenate((own * _PLACE[: len(own)], _PLACE[32 + len(own) : 33 + len(own)])).sum(dtype=np.uint64)
    return mix(out), begin


def shingle_sets(texts: pa.Array, words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, begin = shingle_hashes(texts, words)
    out = []
    for i in range(len(begin) - 1):
        own = np.sort(hashes[begin[i] : begin[i + 1]])
        out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own)
    return out
