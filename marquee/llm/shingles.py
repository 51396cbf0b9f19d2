"""Word shingles of many texts at once, as 64-bit hashes computed on the bytes of a batch."""

from __future__ import annotations

import numpy as np

from marquee.llm.common import mix

WIDTH = 5
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(256)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte of each word and the byte after it, counted from the first text's, and where each text's words begin."""
    low = int(offsets[0])
    part = data[low : int(offsets[-1])]
    bounds = offsets - low
    word = ~_SPACE[part]
    first, last = word.copy(), word.copy()
    if len(part):
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(part))]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, bounds)


def word_hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes, ASCII letters lowered."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    position = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    table = _POWERS if lengths.max() <= len(_POWERS) else _powers(int(lengths.max()))
    values = (_LOWER[part[position + np.repeat(starts, lengths)]] + np.uint64(1)) * table[position]
    return mix(np.add.reduceat(values, firsts))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts ``data[offsets[i]:offsets[i+1]]``, and where each text's begin.

    A word is a run of bytes other than ASCII white space; ASCII letters are lowered.
    """
    starts, ends, places = word_bounds(data, offsets)
    return word_hashes(data[int(offsets[0]) : int(offsets[-1])], starts, ends), places


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and where each text's begin.

    A text of fewer words has one shingle of all its words; a text without words has none.
    """
    hashes, places = words(data, offsets)
    n = len(hashes)
    if not n:
        return hashes, np.zeros(len(offsets), np.int64)
    counts = np.diff(places)
    ends = np.repeat(places[1:], counts)
    begins = np.repeat(places[:-1], counts)
    at = np.arange(n)
    sums = np.zeros(n, np.uint64)
    for j in range(width):
        inside = at + j < ends
        sums += np.where(inside, hashes[np.minimum(at + j, n - 1)] * _POWERS[j], np.uint64(0))
    keep = (at + width <= ends) | (at == begins)
    bounds = np.concatenate([[0], np.cumsum(keep)])[places]
    return mix(sums[keep]), bounds
