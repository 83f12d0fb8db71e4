"""Suffix arrays over selected suffixes, and longest previous factors from them."""

from __future__ import annotations

import numpy as np


def _named(values: np.ndarray) -> np.ndarray:
    """Rank of each value among the distinct ones."""
    order = np.argsort(values)
    ordered = values[order]
    step = np.zeros(len(values), np.int64)
    step[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(step)
    return out


def suffix_ranks(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Rank of each suffix ``data[s:s+length]`` in byte order; equal prefixes share a rank.

    Prefix doubling (tripling, where three ranks fit 63 bits): ranks of 8-byte
    prefixes are joined into ranks of longer ones; the last step overlaps, so
    that ``length`` is met exactly.  Every suffix in ``starts`` must hold
    ``length`` bytes.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    width = min(8, length)
    for i in range(width):
        key |= padded[i:i + n] << np.uint64(8 * (7 - i))
    rank = _named(key)
    while width < length:
        bits = int(rank.max() + 1).bit_length()
        parts = 3 if 3 * bits <= 63 else 2
        reach = min(parts * width, length)
        offsets = [min(i * width, reach - width) for i in range(parts)]
        last = reach == length
        at = starts if last else np.arange(n)
        joined = np.zeros(len(at), np.int64)
        for o in offsets:
            ahead = np.minimum(at + o, n - 1)
            joined = joined << bits | np.where(at + o < n, rank[ahead] + 1, 0)
        width = reach
        if last:
            return _named(joined)
        rank = _named(joined)
    return rank[starts]


def _smaller(pos: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """For each suffix in suffix order: the common prefix with the nearest suffix before it
    (in that order) whose text position is smaller; 0 where it is under ``least``.

    ``lcp[i]`` belongs to suffixes i-1 and i.  Pointers jump: what a larger
    neighbour has skipped already, its followers skip at once.
    """
    n = len(pos)
    at = np.arange(n) - 1
    low = lcp.copy()
    todo = np.flatnonzero((at >= 0) & (low >= least))
    todo = todo[pos[at[todo]] > pos[todo]]
    low[low < least] = 0
    while len(todo):
        c = at[todo]
        low[todo] = np.minimum(low[todo], low[c])
        at[todo] = at[c]
        low[todo[at[todo] < 0]] = 0
        todo = todo[(at[todo] >= 0) & (low[todo] >= least)]
        todo = todo[pos[at[todo]] > pos[todo]]
    return low


def longest_factors(data: np.ndarray, starts: np.ndarray, pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest following factor of each suffix, as far as they reach ``length`` (else 0, at most ``length``).

    ``pos`` orders the suffixes in the text.  Previous and next smaller
    positions in suffix order are the only earlier matches that count;
    with positions turned round, the only later ones.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = suffix_ranks(data, starts, length)
    order = np.lexsort((pos, rank))
    r, p = rank[order], pos[order]
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = np.where(r[1:] == r[:-1], length, 0)
    back = np.zeros(len(order), np.int64)
    back[1:] = lcp[:0:-1]
    out = []
    for q in (p, -p):
        best = np.zeros(len(starts), np.int64)
        best[order] = np.maximum(_smaller(q, lcp, length), _smaller(q[::-1], back, length)[::-1])
        out.append(best)
    return out[0], out[1]
