"""Vectorised text helpers for Arrow batches.

Everything works on flat arrays: the UTF-8 bytes or code points of a slice of
rows, row bounds, and unit (word) bounds.  A slice holds about ``SLICE_BYTES``
of text (one longer row makes a slice of its own), so the memory of a task
does not grow with its partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
STEP = 1 << 14
#: Hashes are polynomials modulo the prime 2^61 - 1: modulo a power of two, words of regular build collide whatever the base.
PRIME = (1 << 61) - 1
_BASE = 0x1E3779B97F4A7C15 % PRIME
_INV = pow(_BASE, -1, PRIME)
_P, _M30, _M31 = np.uint64(PRIME), np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_1, _30, _31, _61 = (np.uint64(i) for i in (1, 30, 31, 61))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= _MIX1
    h ^= h >> np.uint64(27)
    h *= _MIX2
    h ^= h >> np.uint64(31)
    return h


def _folded(x: np.ndarray) -> np.ndarray:
    """64-bit values congruent modulo ``PRIME``, under its size plus 8."""
    return (x & _P) + (x >> _61)


def modulo(x: np.ndarray) -> np.ndarray:
    """64-bit values modulo ``PRIME``."""
    x = _folded(x)
    return np.minimum(x, x - _P)  # what is under the prime already wraps round and loses


def _shifted(x: np.ndarray) -> np.ndarray:
    """``x * 2**31`` for values under 2**62, congruent and under 2**62."""
    return (x >> _30) + ((x & _M30) << _31)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo ``PRIME`` of values under it, from halves of 31 bits."""
    high, low, bh, bl = a >> _31, a & _M31, b >> _31, b & _M31
    return modulo(((high * bh) << _1) + _shifted(high * bl + low * bh) + low * bl)


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` for i < n, modulo ``PRIME`` (kept for the next call)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = -(-max(n, 1 << 16) // STEP) * STEP
        have = np.ones(size, np.uint64)
        done = 1
        while done < STEP:  # one step by doubling, the others from it
            have[done:2 * done] = times(have[:done], np.uint64(pow(base, done, PRIME)))
            done *= 2
        for i in range(STEP, size, STEP):
            have[i:i + STEP] = times(have[:STEP], np.uint64(pow(base, i, PRIME)))
        _powers[base] = have
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash: ``out[i]`` covers ``values[:i]``."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    power = powers(_BASE, len(values))
    for i in range(0, len(values), STEP):  # steps that stay in the processor's cache
        part = values[i:i + STEP]
        v, p = part.astype(np.uint64), power[i:i + STEP]
        v += _1
        if int(part.max()) < (1 << 33) // STEP - 1:  # sums of halves stay under 64 bits as they are
            high, low = v * (p >> _31), v * (p & _M31)
        else:
            terms = times(modulo(v), p)
            high, low = terms >> _31, terms & _M31
        np.cumsum(high, out=high)
        np.cumsum(low, out=low)
        out[i + 1:i + 1 + len(part)] = modulo(_shifted(_folded(high)) + _folded(low) + out[i])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``values[start:end]``, the same wherever the span stands."""
    inv = powers(_INV, len(prefix))
    out = np.empty(len(start), np.uint64)
    for i in range(0, len(start), STEP):
        s, e = start[i:i + STEP], end[i:i + STEP]
        out[i:i + STEP] = mix(times(modulo(prefix[e] + (_P - prefix[s])), inv[s]) + (e - s).astype(np.uint64) * _MIX1)
    return out


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offs, data = col.buffers()
    if offs is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(offs, dtype=kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (single longer rows stand alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts on end, and row offsets."""
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offs[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), offs


def flat_ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``concatenate([arange(s, s + n)])`` without a loop."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - length), length)


class SpanCache:
    """Values (one or several per key) by 64-bit hash, kept between batches of a task.

    At most ``limit`` keys are held; beyond it the cache starts afresh, which
    costs time and changes no result.
    """

    def __init__(self, limit: int = 600_000, dtype=np.int32):
        self.limit, self.dtype = limit, dtype
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.dtype)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where absent."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        i = np.searchsorted(self.keys, keys)
        i[i == len(self.keys)] = 0
        return np.where(self.keys[i] == keys, i, -1)

    def resolve(self, keys: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Slots of sorted distinct keys; ``make(missing)`` gives flat values and counts of those absent."""
        slot = self.find(keys)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            if len(self.keys) + len(missing) > self.limit and len(self.keys):
                self.clear()
                missing = np.arange(len(keys))
            flat, count = make(missing)
            where = np.searchsorted(self.keys, keys[missing])
            begin = len(self.flat) + np.cumsum(count) - count
            self.keys = np.insert(self.keys, where, keys[missing])
            self.at = np.insert(self.at, where, begin)
            self.n = np.insert(self.n, where, count)
            self.flat = np.concatenate([self.flat, flat.astype(self.dtype, copy=False)])
            slot = self.find(keys)
        return slot


def decode(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Rows of a slice as Python strings."""
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
