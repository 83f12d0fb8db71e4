"""Operator 11: ranked lexical search with per-term geometric blocking.

Terms are maximal runs of letters, digits and characters beyond ASCII, A-Z
lowered.  A document's score for an item is a sum of whole-number impacts, one
for each of the item's terms (see ``impacts``), so bounds are exact.

1. One pass over all texts counts every document's terms and keeps, of the terms
   of the items, how often each occurs: a table of the documents' vectors.
2. Numbers of documents and terms, and each term's documents, are summed over it.
3. Each task reads the vectors in shards of at most ``shard`` entries.  In a shard
   a term's posting list is cut, when an item first needs it, into blocks of
   documents that are alike (nearest of some pivots by a random projection of
   their impacts); a block's summary holds the largest impact of every term among
   its documents.  An item's lists are read from the largest impact down, until what
   is left can't reach its worst kept score; a block is skipped only when the
   product of its summary with the item is under that score, else its documents are
   scored in full.  So nothing is missed, and ties are settled by id.
4. The best of all shards are merged.

Items are taken in blocks of at most ``ITEM_BYTES`` of text: only one block's terms
and weights are sent to the tasks.  Memory of a task is bounded by a shard.

Defined cases: null or empty texts have no terms and take no part, an item without
terms has no rows; every row of either table counts for itself (equal ids or texts
included); a null id is ranked after all others of its score; texts of any length
are read whole; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorecraft.llm.common import list_array, map_text, stored
from scorecraft.llm.text import flat_ranges, prefix_hash, span_hash

#: Entries (document, term) of a shard; one document more at most.
SHARD = 400_000
#: Documents of a block on average, dimensions of the projection that tells which are alike.
BLOCK, DIMS = 32, 16
#: Bytes of items' texts that one job serves.
ITEM_BYTES = 4 << 20
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FOUND = "item long, item_id long, doc_id long, score long, tie long"


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lowered bytes of a slice, begin and end of every term, and the first term of every row."""
    solid = _TERM[data]
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start, stop = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return lower, s, e, np.searchsorted(s, offsets)


class Vocabulary:
    """The terms of a block of items: found by hash, verified by their bytes."""

    def __init__(self, words: list[bytes]):
        for self.salt in range(100):  # a salt that gives no two words one hash
            h = self._hash(*self._flat(words))
            if len(np.unique(h)) == len(words):
                break
        order = np.argsort(h)
        self.hashes, self.words = h[order], [words[i] for i in order]

    @staticmethod
    def _flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(size)
        return np.frombuffer(b"".join(words), np.uint8), end - size, end

    def _hash(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return span_hash(prefix_hash(data.astype(np.uint64) + np.uint64(257 * self.salt)), s, e)

    def find(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The number of each span's word, -1 if it is none of these."""
        if not len(s) or not self.words:
            return np.full(len(s), -1, np.int64)
        h = self._hash(data, s, e)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.words) - 1)
        at[self.hashes[at] != h] = -1
        hit = np.flatnonzero(at >= 0)
        kinds, first = np.unique(at[hit], return_index=True)
        for word, i in zip(kinds.tolist(), hit[first].tolist()):
            if data[s[i]:e[i]].tobytes() != self.words[word]:
                for j in hit[at[hit] == word].tolist():
                    if data[s[j]:e[j]].tobytes() != self.words[word]:
                        at[j] = -1
        return at


def vectors(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tie (a digest of the text), n (terms with repeats), terms and counts of the vocabulary's words, of every text with a term."""
    size = max(len(vocabulary.words), 1)

    def count(data, offsets, rows):
        lower, s, e, bounds = terms(data, offsets)
        n = np.diff(bounds)
        word = vocabulary.find(lower, s, e)
        row = np.repeat(np.arange(len(n)), n)
        known = word >= 0
        pair, tf = np.unique(row[known] * size + word[known], return_counts=True)
        at = np.searchsorted(pair // size, np.arange(len(n) + 1))
        return {"doc_id": rows.column("doc_id"), "tie": rows.column("tie"), "n": n, "terms": list_array((pair % size).astype(np.int32), at, pa.int32()), "counts": list_array(tf.astype(np.int32), at, pa.int32())}

    text = F.col(text_col).cast("string")
    rows = docs.filter(text != "").select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    return map_text(rows, count, "doc_id long, tie long, n long, terms array<int>, counts array<int>").filter("n > 0")


def weight(documents: int, holding: int) -> int:
    """A term's weight from the numbers of all documents and of those that hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term adds to a document's score each time the item names it (64-bit whole numbers)."""
    m = 75 + (25 * n * documents) // length
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Shard:
    """Vectors of some documents, their posting lists, and blocks of those that were asked for."""

    def __init__(self, at: np.ndarray, term: np.ndarray, impact: np.ndarray, basis: np.ndarray):
        self.at, self.term, self.impact, self.size = at, term, impact, len(basis)
        n = np.diff(at)
        order = np.argsort(term, kind="stable")
        self.holder = np.repeat(np.arange(len(n)), n)[order]
        self.list = np.searchsorted(term[order], np.arange(self.size + 1))
        self.most = np.zeros(self.size, np.int64)
        there = np.diff(self.list) > 0
        if len(term):
            self.most[there] = np.maximum.reduceat(impact[order], self.list[:-1][there])
        self.basis, self.space = basis, None
        self.blocks: dict[int, tuple] = {}
        self.read = self.skipped = 0

    def _alike(self, docs: np.ndarray) -> np.ndarray:
        """A cluster number for each document: the nearest of some pivots from among them."""
        pivots = -(-len(docs) // BLOCK)
        if pivots == 1:
            return np.zeros(len(docs), np.int64)
        if self.space is None:
            flat = self.basis[self.term] * self.impact[:, None].astype(np.float32)
            space = np.zeros((len(self.at) - 1, DIMS), np.float32)
            full = np.diff(self.at) > 0
            space[full] = np.add.reduceat(flat, self.at[:-1][full], axis=0)
            self.space = space / np.maximum(np.linalg.norm(space, axis=1, keepdims=True), 1e-9)
        mine = self.space[docs]
        return np.argmax(mine @ mine[np.linspace(0, len(docs) - 1, pivots).astype(np.int64)].T, axis=1)

    def cut(self, term: int) -> tuple:
        """A list's blocks: documents block by block, where each begins, and their summaries (first entry, terms, largest impacts)."""
        if term not in self.blocks:
            docs = self.holder[self.list[term]:self.list[term + 1]]
            cluster = self._alike(docs)
            order = np.argsort(cluster, kind="stable")
            docs, cluster = docs[order], cluster[order]
            start = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1]])
            n = self.at[docs + 1] - self.at[docs]
            entry = flat_ranges(self.at[docs], n)
            key = np.repeat(np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(docs)])), n) * self.size + self.term[entry]
            by = np.argsort(key, kind="stable")
            key = key[by]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            most = np.maximum.reduceat(self.impact[entry[by]], first)
            key = key[first]
            self.blocks[term] = docs, np.r_[start, len(docs)], np.searchsorted(key // self.size, np.arange(len(start))), key % self.size, most
        return self.blocks[term]

    def search(self, words: np.ndarray, times: np.ndarray, best: "Best") -> None:
        """Offer every document that may be among the best for an item (its distinct terms and how often it names them)."""
        bound = times * self.most[words]
        order = np.argsort(-bound, kind="stable")
        left = np.cumsum(bound[order][::-1])[::-1]
        dense = np.zeros(self.size, np.int64)
        dense[words] = times
        seen = np.zeros(len(self.at) - 1, bool)
        for i, rest in zip(order.tolist(), left.tolist()):
            if rest < best.need:
                return
            docs, start, summary, term, most = self.cut(int(words[i]))
            reach = np.add.reduceat(dense[term] * most, summary)
            likely = np.argsort(-reach, kind="stable")
            j, step = 0, 1
            while j < len(likely) and reach[likely[j]] >= best.need:
                few = likely[j:j + step]
                few = few[reach[few] >= best.need]
                j, step, self.read = j + step, 2 * step, self.read + len(few)
                found = docs[flat_ranges(start[few], start[few + 1] - start[few])]
                found = found[~seen[found]]
                if len(found):
                    seen[found] = True
                    n = self.at[found + 1] - self.at[found]
                    entry = flat_ranges(self.at[found], n)
                    best.offer(found, np.add.reduceat(dense[self.term[entry]] * self.impact[entry], np.cumsum(n) - n))
            self.skipped += len(likely) - min(j, len(likely))


class Best:
    """The best documents of an item: score falling, then id (null last), then digest of the text."""

    def __init__(self, top: int):
        self.top, self.rows, self.need = top, [], 1

    def begin(self, ids: list, ties: np.ndarray) -> None:
        self.ids, self.ties = ids, ties

    def offer(self, docs: np.ndarray, scores: np.ndarray) -> None:
        keep = scores >= self.need
        if not keep.any():
            return
        docs, scores = docs[keep], scores[keep]
        if len(docs) > self.top:  # ties of the worst kept score stay
            enough = scores >= np.partition(scores, -self.top)[-self.top]
            docs, scores = docs[enough], scores[enough]
        for d, s in zip(docs.tolist(), scores.tolist()):
            i = self.ids[d]
            self.rows.append((-s, i is None, i or 0, int(self.ties[d])))
        self.rows = sorted(self.rows)[:self.top]
        if len(self.rows) == self.top:
            self.need = -self.rows[-1][0]


def search(docs: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard: int = SHARD) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the ``top`` best documents of every item."""
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // ITEM_BYTES + 1
    asked = stored(asked.withColumn("item", F.monotonically_increasing_id()).withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts))), "items")
    found = None
    for part in range(parts):
        some = _search(docs, asked.filter(F.col("part") == part), top, id_col, text_col, shard)
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "tie")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _search(docs: DataFrame, items: DataFrame, top: int, id_col: str, text_col: str, size: int) -> DataFrame:
    """The best of every shard for one block of items."""
    rows = items.select("item", "item_id", "text").collect()  # at most about ITEM_BYTES of text
    named = []
    for r in rows:
        raw = np.frombuffer(r["text"].encode(), np.uint8)
        lower, s, e, _ = terms(raw, np.array([0, len(raw)]))
        named.append(Counter(lower[a:b].tobytes() for a, b in zip(s.tolist(), e.tolist())))
    vocabulary = Vocabulary(sorted(set().union(*named)))
    number = {w: i for i, w in enumerate(vocabulary.words)}
    vector = stored(vectors(docs, vocabulary, id_col, text_col), "vectors")
    total = vector.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    holding = dict(vector.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # one row per word of the items
    weights = np.array([weight(total["docs"], holding.get(i, 0)) for i in range(len(number))], np.int64)
    wanted = [(r["item"], r["item_id"], np.array([number[w] for w in c], np.int64), np.array(list(c.values()), np.int64)) for r, c in zip(rows, named) if c]
    basis = np.random.default_rng(11).standard_normal((max(len(number), 1), DIMS)).astype(np.float32)
    documents, length = total["docs"], total["terms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in wanted]
        for ids, ties, n, at, term, tf in _shards(batches, size):
            shard = Shard(at, term, impacts(weights[term], tf, np.repeat(n, np.diff(at)), documents, length), basis)
            for (_, _, words, often), b in zip(wanted, best):
                b.begin(ids, ties)
                shard.search(words, often, b)
        out = [(item, item_id, None if none else i, -s, tie) for (item, item_id, _, _), b in zip(wanted, best) for s, none, i, tie in b.rows]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["item", "item_id", "doc_id", "score", "tie"])

    return vector.mapInArrow(run, FOUND)


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple]:
    """Ids, digests, lengths, first entries, terms and counts of the documents of each shard."""
    def flat(held: list[pa.RecordBatch]) -> tuple:
        t = pa.Table.from_batches(held).combine_chunks()
        term, tf = t.column("terms").combine_chunks(), t.column("counts").combine_chunks()
        at = np.r_[0, np.cumsum(term.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
        return t.column("doc_id").to_pylist(), t.column("tie").to_numpy(), t.column("n").to_numpy(), at, term.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64)

    held, size = [], 0
    for batch in batches:
        entries = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
        i = 0
        while i < batch.num_rows:
            room = most - size + (entries[i - 1] if i else 0)
            j = max(int(np.searchsorted(entries, room, side="right")), i + 1)
            held.append(batch.slice(i, j - i))
            size += int(entries[j - 1] - (entries[i - 1] if i else 0))
            i = j
            if size >= most or i < batch.num_rows:
                yield flat(held)
                held, size = [], 0
    if held:
        yield flat(held)
