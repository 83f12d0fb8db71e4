"""Word shingles of text slices as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from scorecraft.llm.text import mix, prefix_hash, span_hash

_STEP = np.uint64(0xD6E8FEB86659FD93)


def ascii_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lowered, split at U+0020 and U+0009-U+000D), its row, and word offsets per row."""
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    solid = ~((lower == 32) | ((lower >= 9) & (lower <= 13)))
    edge = np.zeros(len(lower) + 1, bool)
    edge[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    words = span_hash(prefix_hash(lower), s, e)
    bounds = np.searchsorted(s, offsets)
    return words, np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)), bounds


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted, and their offsets.

    A row with fewer than ``k`` words has its whole sequence as one shingle;
    one without words has none.
    """
    words, row, bounds = ascii_words(data, offsets)
    n = np.diff(bounds)
    h = np.zeros(len(words), np.uint64)
    last = np.repeat(bounds[1:], n)
    at = np.arange(len(words))
    for i in range(k):
        ahead = at + i
        inside = ahead < last
        h[inside] = mix(h[inside] * _STEP + words[ahead[inside]] + np.uint64(i + 1))
    keep = (at + k <= last) | ((n[row] < k) & (at == bounds[row]))
    h, row = h[keep], row[keep]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[first], row[first]
    return h, np.searchsorted(row, np.arange(len(offsets)))
