"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

Each word is a row of symbols; above the ranks of its adjacent pairs stands a
segment tree whose leaves hold ``rank * width + position``.  The root is the
leftmost lowest-rank merge; a merge changes three leaves (the pair itself, its
left and its right neighbour), so one step costs a logarithmic number of node
updates.  Steps repeat until the root holds no mergeable pair.  The trees of
many words are updated together (one array operation per tree level), and a
word is encoded once per task and then taken from a cache.

Ids equal those of the ``tokenizers`` library for byte-level models with the
two patterns of ``PRETOKENIZERS`` (tested against it).  Special strings inside
a text become their special id, as the library does by default.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import regex

from scorecraft.llm.text import SpanCache, code_points, flat_ranges, prefix_hash, span_hash

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_NONE = np.int64(1) << np.int64(62)


_UNKNOWN = 255
_classes = np.full(0x110000, _UNKNOWN, np.uint8)


def char_classes(cp: np.ndarray) -> np.ndarray:
    """Class of each code point, as the library's own patterns see it (worked out once for each 1024 of them)."""
    kind = _classes[cp]
    new = kind == _UNKNOWN
    if new.any():
        for block in np.unique(cp[new] >> 10).tolist():
            _learn(block << 10)
        kind = _classes[cp]
    return kind


def _learn(low: int) -> None:
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    points = [p for p in range(low, low + 1024) if not 0xD800 <= p < 0xE000]
    _classes[low:low + 1024] = OTHER
    every = "".join(map(chr, points))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        for found, _ in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
            _classes[ord(found)] = kind


@functools.cache
def byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def _contractions(cp: np.ndarray, ends: np.ndarray, may: np.ndarray) -> np.ndarray:
    """Length (2 or 3) of 's 't 'm 'd 're 've 'll where ``may`` holds, else 0; ``ends``: end of each position's row."""
    out = np.zeros(len(cp), np.int64)
    at = np.flatnonzero(may & (cp == ord("'")))
    if len(at):
        pad = np.concatenate([cp, np.zeros(2, cp.dtype)])
        a = np.where(at + 1 < ends[at], pad[at + 1], 0)
        b = np.where(at + 2 < ends[at], pad[at + 2], 0)
        two = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        one = np.isin(a, [ord(c) for c in "stmd"])
        out[at] = np.where(one, 2, np.where(two, 3, 0))
    return out


def _rows(cp: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = np.zeros(len(cp) + 1, bool)
    first[offs] = True
    ends = np.repeat(offs[1:], np.diff(offs))
    return first[:-1], first[1:], ends


def split_words(cp: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of the word model: contractions, letter runs, single numbers, runs of the rest; white space goes."""
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = char_classes(cp)
    first, _, ends = _rows(cp, offs)
    before = np.concatenate([[SPACE], kind[:-1]])
    before[first] = SPACE
    start = first | (kind != before) | (kind == NUMBER)
    n = _contractions(cp, ends, (before != OTHER))
    at = np.flatnonzero(n)
    start[at] = True
    for i in (1, 2):
        start[at[n[at] > i] + i] = False
    after = at + n[at]
    start[after[after < len(cp)]] = True
    s = np.flatnonzero(start)
    e = np.append(s[1:], len(cp))
    keep = kind[s] != SPACE
    return s[keep], e[keep]


def split_bytes(cp: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of the byte model: as above with number runs; one blank before a unit joins it, other white space stays."""
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = char_classes(cp)
    first, last, ends = _rows(cp, offs)
    before = np.concatenate([[SPACE], kind[:-1]])
    before[first] = SPACE
    blank_before = np.concatenate([[False], cp[:-1] == 32]) & ~first
    start = first | (kind != before)
    n = _contractions(cp, ends, (before != OTHER) & ~blank_before)
    at = np.flatnonzero(n)
    for i in (1, 2):
        start[at[n[at] > i] + i] = False
    after = at + n[at]
    start[after[after < len(cp)]] = True
    # the last white-space character before a unit: a blank joins the unit, another stands alone
    space = kind == SPACE
    nxt_solid = np.zeros(len(cp), bool)
    nxt_solid[:-1] = ~space[1:]
    tail = space & nxt_solid & ~last
    start[tail] = True
    joined = np.flatnonzero(tail & (cp == 32)) + 1
    start[joined] = False
    s = np.flatnonzero(start)
    return s, np.append(s[1:], len(cp))


def lower_nfc(text: str) -> str:
    """The word model's normaliser: composed form, then lower case letter by letter."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


PRETOKENIZERS = {"words": split_words, "bytes": split_bytes}


class SegmentTreeBPE:
    """Encoder and decoder for one ``tokenizers`` JSON file."""

    def __init__(self, path: str, cache_words: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        kinds = [p["type"] for p in (spec["normalizer"] or {}).get("normalizers", [])]
        self.normalise = lower_nfc if "Lowercase" in kinds else None
        self.split = split_words if spec["pre_tokenizer"]["type"] == "Sequence" else split_bytes
        chars = byte_chars()
        self.byte_id = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.last_id = np.array([vocab[chars[b] + self.suffix] for b in range(256)], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.uint64)
        right = np.array([vocab[b] for _, b in merges], np.uint64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self._table(left << np.uint64(32) | right)
        back = {c: b for b, c in chars.items()}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        tokens = [b""] * size
        for token, i in vocab.items():
            body = token[: -len(self.suffix)] + " " if self.suffix and token.endswith(self.suffix) else token
            tokens[i] = bytes(back[c] if c in back else ord(" ") for c in body)
        for token, i in self.specials.items():
            tokens[i] = token.encode()
        self.token_bytes = tokens
        self.cache = SpanCache(cache_words)

    # --- pair ranks: an open-addressing table ------------------------------------
    def _table(self, keys: np.ndarray) -> None:
        self.bits = np.uint64(64 - 18)
        size = 1 << 18
        self.slot_key = np.full(size, np.iinfo(np.uint64).max, np.uint64)
        self.slot_rank = np.full(size, -1, np.int64)
        order = np.unique(keys, return_index=True)[1]  # of equal pairs the first rank counts
        for k, r in zip(keys[order].tolist(), order.tolist()):
            i = ((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> 46
            while self.slot_rank[i] >= 0:
                i = (i + 1) & (size - 1)
            self.slot_key[i], self.slot_rank[i] = k, r

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where there is none (or a symbol is -1)."""
        ok = (a >= 0) & (b >= 0)
        key = np.where(ok, a, 0).astype(np.uint64) << np.uint64(32) | np.where(ok, b, 0).astype(np.uint64)
        i = ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)
        out = np.where(self.slot_key[i] == key, self.slot_rank[i], -1)
        todo = np.flatnonzero((self.slot_key[i] != key) & (self.slot_rank[i] >= 0))
        while len(todo):
            i[todo] = (i[todo] + 1) & (len(self.slot_key) - 1)
            j = i[todo]
            hit = self.slot_key[j] == key[todo]
            out[todo[hit]] = self.slot_rank[j[hit]]
            todo = todo[~hit & (self.slot_rank[j] >= 0)]
        out[~ok] = -1
        return out

    # --- the segment trees ---------------------------------------------------------
    def merge_rows(self, symbols: np.ndarray) -> np.ndarray:
        """Merge every row (width a power of two, -1 as padding) to its end; taken slots become -1."""
        n, w = symbols.shape
        sym = symbols.astype(np.int64)
        right = np.full((n, w), -1, np.int64)
        right[:, :-1] = sym[:, 1:]
        pos = np.arange(w, dtype=np.int64)
        tree = np.full((n, 2 * w), _NONE, np.int64)
        rank = self.ranks(sym.ravel(), right.ravel()).reshape(n, w)
        tree[:, w:] = np.where(rank >= 0, rank * w + pos, _NONE)
        half = w
        while half > 1:
            half //= 2
            level = tree[:, 2 * half:4 * half]
            tree[:, half:2 * half] = np.minimum(level[:, ::2], level[:, 1::2])
        nxt = np.tile(pos + 1, (n, 1))
        prv = np.tile(pos - 1, (n, 1))
        flat_tree, flat_sym, flat_nxt, flat_prv = tree.ravel(), sym.ravel(), nxt.ravel(), prv.ravel()
        row = np.flatnonzero(flat_tree[1::2 * w] < _NONE)
        while len(row):
            best = flat_tree[row * (2 * w) + 1]
            at, r = best % w, best // w
            base, tbase = row * w, row * (2 * w)
            gone = flat_nxt[base + at]
            new = self.merged[r]
            flat_sym[base + at] = new
            flat_sym[base + gone] = -1
            after = flat_nxt[base + gone]
            flat_nxt[base + at] = after
            has = after < w
            flat_prv[(base + after)[has]] = at[has]
            sym_after = np.where(has, flat_sym[np.minimum(base + after, len(flat_sym) - 1)], -1)
            ahead = flat_prv[base + at]
            had = ahead >= 0
            sym_ahead = np.where(had, flat_sym[np.maximum(base + ahead, 0)], -1)
            ra, rb = self.ranks(np.concatenate([new, sym_ahead]), np.concatenate([sym_after, new])).reshape(2, -1)
            flat_tree[tbase + w + gone] = _NONE
            flat_tree[tbase + w + at] = np.where(ra >= 0, ra * w + at, _NONE)
            flat_tree[(tbase + w + ahead)[had]] = np.where(rb >= 0, rb * w + ahead, _NONE)[had]
            node = np.concatenate([w + gone, w + at, np.where(had, w + ahead, w + at)])
            tb = np.concatenate([tbase, tbase, tbase])
            while node[0] > 1:
                node = node >> 1
                i = tb + 2 * node
                flat_tree[tb + node] = np.minimum(flat_tree[i], flat_tree[i + 1])
            row = row[flat_tree[tbase + 1] < _NONE]
        return sym

    def encode_words(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts of the byte spans ``data[start:start+length]``."""
        parts_at, parts_ids = [], []
        count = np.zeros(len(start), np.int64)
        width = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(length, 2))).astype(np.int64))
        for w in np.unique(width):
            which = np.flatnonzero(width == w)
            step = max(1, (1 << 18) // int(w))
            for k in range(0, len(which), step):
                rows = which[k:k + step]
                size = length[rows]
                sym = np.full((len(rows), int(w)), -1, np.int64)
                inside = np.arange(int(w)) < size[:, None]
                sym[inside] = self.byte_id[data[flat_ranges(start[rows], size)]]
                full = size > 0
                sym[np.flatnonzero(full), size[full] - 1] = self.last_id[data[(start[rows] + size - 1)[full]]]
                done = self.merge_rows(sym)
                alive = done >= 0
                count[rows] = alive.sum(axis=1)
                parts_ids.append(done[alive])
                parts_at.append(np.repeat(rows, count[rows]))
        if not parts_ids:
            return np.zeros(0, np.int64), count
        ids, owner = np.concatenate(parts_ids), np.concatenate(parts_at)
        return ids[np.argsort(owner, kind="stable")], count

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.normalise:
            texts = [self.normalise(t) for t in texts]
        cp, offs = code_points(texts)
        s, e = self.split(cp, offs)
        if not len(s):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        key, one, inverse = np.unique(span_hash(prefix_hash(cp), s, e), return_index=True, return_inverse=True)
        joined = "".join(texts)

        def make(missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = one[missing]
            words = [joined[a:b].encode("utf-8", "surrogatepass") for a, b in zip(s[at].tolist(), e[at].tolist())]
            size = np.array([len(x) for x in words], np.int64)
            return self.encode_words(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)

        slot = self.cache.resolve(key, make)[inverse]
        n = self.cache.n[slot]
        ids = self.cache.flat[flat_ranges(self.cache.at[slot], n)]
        upto = np.zeros(len(s) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        return ids, upto[np.searchsorted(s, offs)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and their row offsets."""
        marked = [i for i, t in enumerate(texts) if any(m in t for m in self.specials)]
        if not marked:
            return self._encode_plain(texts)
        pieces: list[str] = []
        after: list[int] = []  # special id that follows a piece, or -1
        rows = np.zeros(len(texts) + 1, np.int64)
        odd = set(marked)
        for i, t in enumerate(texts):
            if i in odd:
                at = 0
                for m in self.special_pattern.finditer(t):
                    pieces.append(t[at:m.start()])
                    after.append(self.specials[m[0]])
                    at = m.end()
                t = t[at:]
            pieces.append(t)
            after.append(-1)
            rows[i + 1] = len(pieces)
        ids, offs = self._encode_plain(pieces)
        extra = np.array(after, np.int64)
        has = np.flatnonzero(extra >= 0)
        ids = np.insert(ids, offs[has + 1], extra[has])
        grown = offs + np.concatenate([[0], np.cumsum(extra >= 0)])
        return ids, grown[rows]

    def table(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte strings by id as one array with starts and lengths."""
        size = np.array([len(p) for p in parts], np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size

    @functools.cached_property
    def _bytes_table(self):
        return self.table(self.token_bytes)

    @functools.cached_property
    def _decimal_table(self):
        return self.table([b"%d," % i for i in range(len(self.token_bytes))])

    def _spell(self, table, ids: np.ndarray, offs: np.ndarray) -> tuple[bytes, np.ndarray]:
        data, at, size = table
        n = size[ids]
        upto = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        return data[flat_ranges(at[ids], n)].tobytes(), upto[offs]

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """UTF-8 of each row's decoded text; broken sequences become U+FFFD."""
        raw, at = self._spell(self._bytes_table, ids, offs)
        out = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return out if _valid(raw) else [x.decode("utf-8", "replace").encode() for x in out]

    def decimal(self, ids: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """Each row's ids in decimal, joined by commas."""
        raw, at = self._spell(self._decimal_table, ids, offs)
        return [raw[a:max(a, b - 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _valid(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


@functools.lru_cache(maxsize=4)
def codec(path: str) -> SegmentTreeBPE:
    """One encoder per file and Python worker."""
    return SegmentTreeBPE(path)
