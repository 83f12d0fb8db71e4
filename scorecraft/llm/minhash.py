"""Operator 9: near-duplicate groups by MinHash with tensored banding.

Two small collections of sub-signatures (``halves`` each, ``width`` hashes per
sub-signature) give ``halves ** 2`` tables: the key of table (i, j) combines
sub-signature i of the first with j of the second.  ``2 * halves * width``
hashes so do the work of ``2 * width * halves ** 2``, about the square root.
Two sets of likeness s share a key unless no sub-signature matches in one of
the collections: missed with about ``2 * (1 - s ** width) ** halves`` (0.12 % at
s = 0.85 with 4 and 10; for every lower threshold at most 0.315 %).

1. Documents with equal sets form a class; only classes go on.
2. In each key's bucket all classes are paired with one pivot, first inside
   each task, then the tasks' pivots among themselves: a bucket of any size
   gives one pair per class and no task receives more than one row per key
   and run of rows that a task combines.
3. Of the pairs a spanning forest of those in most buckets is verified on full
   sets; links are contracted to components.  A pair left out joins classes that
   the forest joins: in one component, or in components that a failed pair joins.
4. Components that a failed pair joins may hold further candidate links.  Their
   classes are searched by prefixes: shingles in order of rarity, two sets that
   reach the threshold share one of each's first ``n - ceil(s * n) + 1``.  What a
   class's first shared shingle leaves possible bounds the sizes of its partners;
   classes that no size is left for go.  Classes that share a shingle are compared
   in blocks of at most ``BLOCK`` by size, place and parity sketch (bits in which two
   sketches differ are never more than the shingles that only one set has); the
   pairs left are verified on full sets.  First rounds take of each block a forest
   of the nearest pairs between components, which then are few; the last one takes
   all pairs left between components.  So no candidate link is lost.

Sets are of 64-bit shingle hashes.  A text without words has an empty set and
is linked with nothing.  Equal rows and repeated ids are fine (rows with one
id and different texts are judged by text); a row with a null id is grouped by
its text, never gives a component its name, and is not kept while its group
has an id.  An empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorecraft.llm.common import list_array, map_text, stored
from scorecraft.llm.components import components, spanning, thinned
from scorecraft.llm.shingles import shingle_sets
from scorecraft.llm.text import flat_ranges, mix

SEED = 20240607
#: Orders of precedence among nodes, one of them for each bucket (a power of two).
PIVOTS = 8
#: Rows (16 bytes and more each) that a task sorts into stars at once.
RUN = 500_000
#: Most classes of one side in a block of the search across components.
BLOCK = 4096
#: Rounds that look at the nearest pairs only, before the one that looks at all that are left.
BEST_FIRST = 2
#: Bits of a parity sketch.
BITS = 1024
#: Bound of 2 * (1 - s ** width) ** halves at the threshold s.
MISSED = 0.00315


def row_digest(id_col: str, text_col: str) -> Column:
    """A 64-bit digest of a row's id and text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def tensor_shape(percent: int) -> tuple[int, int]:
    """(width, halves) for a threshold in percent: a pair at the threshold itself is missed with a chance of at most ``MISSED``."""
    if percent >= 85:
        return 4, 10
    width = 3 if percent >= 65 else 2 if percent >= 40 else 1
    found = (max(percent, 1) / 100) ** width
    return width, max(9, math.ceil(math.log(MISSED / 2) / math.log1p(-found)))


def _node(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set, whatever the order of its members."""
    size = np.diff(offs)
    out = np.zeros(len(size), np.uint64)
    full = size > 0
    if full.any():
        out[full] = mix(np.add.reduceat(mix(h + np.uint64(SEED)), offs[:-1][full]) + size[full].astype(np.uint64))
    return out.view(np.int64)


def signatures(df: DataFrame, k: int, width: int, halves: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, uid (digest of id and text), n_shingles, node (digest of the set, null if empty), first and second sub-signatures."""
    rng = np.random.default_rng(SEED)
    count = 2 * width * halves
    mult = rng.integers(1, 2 ** 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    xor = rng.integers(0, 2 ** 63, count, dtype=np.uint64)

    def sign(data, offsets, rows):
        h, offs = shingle_sets(data, offsets, k)
        n = np.diff(offs)
        full = np.flatnonzero(n)
        subs = np.zeros((len(n), 2 * halves), np.uint64)
        for g in range(2 * halves if len(full) else 0):
            acc = np.full(len(full), np.uint64(g + 1))
            for i in range(g * width, (g + 1) * width):
                acc = mix(acc + np.minimum.reduceat((h ^ xor[i]) * mult[i], offs[:-1][full]))
            subs[full, g] = acc
        at = np.arange(len(n) + 1) * halves
        subs = subs.view(np.int64)
        return {"row_id": rows.column("row_id"), "uid": rows.column("uid"), "n_shingles": n, "node": pa.array(_node(h, offs), pa.int64(), mask=n == 0),
                "one": list_array(subs[:, :halves].ravel(), at, pa.int64()), "two": list_array(subs[:, halves:].ravel(), at, pa.int64())}

    rows = df.select(F.col(id_col).cast("long").alias("row_id"), row_digest(id_col, text_col).alias("uid"), F.col(text_col).cast("string").alias("text"))
    return map_text(rows, sign, "row_id long, uid long, n_shingles long, node long, one array<long>, two array<long>")


def _tables(classes: DataFrame) -> DataFrame:
    """key, node: one row per table and class."""
    keys = F.flatten(F.transform("one", lambda x, i: F.transform("two", lambda y, j: F.xxhash64(i, j, x, y))))
    return classes.select("node", F.explode(keys).alias("key")).select("key", "node")


def _stars(batches, final: bool):
    """Of each key in a run of rows keep one pivot and pair the key's other nodes with it.

    Columns key, node, other, times: with ``other`` a finished pair and in how many buckets it was met, else a bucket row.
    ``final``: rows come sorted by key, only pairs are told, and a key that goes on
    in the next run takes its pivot along.
    """
    names = ["key", "node", "other", "times"]
    held: list[pa.RecordBatch] = []
    size = 0

    def flush():
        t = pa.Table.from_batches(held)
        ready = t.column("other").is_valid().to_numpy()
        key, node = t.column("key").to_numpy(), t.column("node").to_numpy()
        other = t.column("other").fill_null(0).to_numpy()
        pairs = [(node[ready], other[ready], t.column("times").to_numpy()[ready])]
        key, node = key[~ready], node[~ready]
        # the same few nodes are pivots in most of a group's buckets, so its pairs repeat and are told once
        order = np.lexsort((mix(node.view(np.uint64) + (key.view(np.uint64) & np.uint64(PIVOTS - 1))), key))
        key, node = key[order], node[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        pivot = node[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))] if len(key) else node
        rest = ~first & (node != pivot)
        pairs.append((node[rest], pivot[rest], np.ones(int(rest.sum()), np.int64)))
        a, b, times = (np.concatenate(c) for c in zip(*pairs))
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b, times = a[order], b[order], times[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        new = np.flatnonzero(new)
        return key[first], node[first], a[new], b[new], np.add.reduceat(times, new) if len(new) else times

    def row(k, n):
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n), pa.nulls(len(k), pa.int64()), pa.array(np.ones(len(k), np.int64))], names=names)

    def emit(k, n, a, b, times):
        if not final and len(k):
            yield row(k, n)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(mix(a.view(np.uint64)).view(np.int64)), pa.array(a), pa.array(b), pa.array(times)], names=names)

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= RUN:
            k, n, *pairs = flush()
            held, size = [row(k[-1:], n[-1:])] if final and len(k) else [], 0
            yield from emit(k, n, *pairs)
    if held:
        yield from emit(*flush())


def _candidates(classes: DataFrame) -> DataFrame:
    """a < b: a forest of the star pairs of all buckets."""
    schema = "key long, node long, other long, times long"
    rows = _tables(classes).select("*", F.lit(None).cast("long").alias("other"), F.lit(1).cast("long").alias("times"))
    local = rows.mapInArrow(lambda it: _stars(it, False), schema)
    met = local.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _stars(it, True), schema)
    pairs = met.filter("other is not null").groupBy(F.col("node").alias("a"), F.col("other").alias("b")).agg(F.sum("times").alias("weight"))
    return thinned(pairs, "star-pairs")


def _sets(df: DataFrame, rows: DataFrame, nodes: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """node, n, shingles of ``nodes``, from one document each."""
    wanted = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("row_id").alias("want_id"))
    texts = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(wanted.select("want_id").distinct(), F.col("row_id").eqNullSafe(F.col("want_id")), "left_semi")

    def build(data, offsets, batch):
        h, offs = shingle_sets(data, offsets, k)
        n = np.diff(offs)
        return {"node": pa.array(_node(h, offs), pa.int64(), mask=n == 0), "n": n, "shingles": list_array(h.view(np.int64), offs, pa.int64())}

    made = map_text(texts, build, "node long, n long, shingles array<long>")
    return made.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with ``linked``: the full sets' likeness reaches the threshold."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    # sizes first: sets too unlike in size can't reach the threshold
    fit = pairs.join(one.drop("sa"), "a").join(two.drop("sb"), "b")
    fit = fit.withColumn("fit", 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    near = fit.filter("fit").join(one.drop("na"), "a").join(two.drop("nb"), "b").withColumn("shared", shared)
    near = near.select("a", "b", (100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).alias("linked"))
    return near.unionByName(fit.filter("not fit").select("a", "b", F.lit(False).alias("linked")))


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, shape: tuple[int, int] | None = None,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, uid (digest of the row), n_shingles, node (class of equal sets), comp (class that stands for the group), component_id, kept of every row.

    Documents are linked at ``100 * shared >= percent * union`` of their sets of
    ``k``-word shingles; component_id is the smallest id reachable by links.
    """
    width, halves = shape or tensor_shape(percent)
    signed = stored(signatures(df, k, width, halves, id_col, text_col), "signatures")
    rows = signed.select("row_id", "uid", "n_shingles", "node")
    classes = signed.filter("node is not null").groupBy("node").agg(F.min("row_id").alias("least"), F.first("one").alias("one"), F.first("two").alias("two"))
    classes = stored(classes, "classes")

    pairs = stored(_candidates(classes), "pairs")
    tested = stored(_verify(pairs, stored(_sets(df, rows, _ends(pairs), k, id_col, text_col), "sets"), percent), "tested")
    links = tested.filter("linked").select("a", "b")
    comps = components(links)

    open_ = stored(_open_classes(tested, comps), "open-classes")
    if open_.limit(1).count():
        sets = stored(_sets(df, rows, open_.select("node"), k, id_col, text_col), "open-sets")
        prefixes = stored(_prefixes(sets, percent), "prefixes")
        for best in [True] * BEST_FIRST + [False]:
            apart = stored(_across(prefixes, open_, percent, best), "pairs-across")
            more = stored(_verify(apart, sets, percent).filter("linked").select("a", "b"), "links-across")
            comps = components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more))
            open_ = open_.select("node").join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))

    named = classes.select("node", "least").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = named.join(names, "comp").select("node", "comp", "component_id")
    full = rows.join(named, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("row_id")).otherwise(F.col("component_id")))
    return full.select(F.col("row_id").alias(id_col), "uid", "n_shingles", "node", "comp", "component_id",
                       F.coalesce(F.col("row_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def one_per_group(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df``, all its columns, with one row of each group: that of the smallest id; rows without words all stay."""
    found = near_duplicates(df, k, percent, None, id_col, text_col)
    groups = found.filter("node is not null").groupBy("comp").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("i"), "uid")).alias("m"))
    kept = groups.select(F.col("m.uid").alias("__uid"), F.lit(False).alias("__free")).unionByName(
        found.filter("node is null").select(F.col("uid").alias("__uid"), F.lit(True).alias("__free")).distinct())
    rows = df.withColumn("__uid", row_digest(id_col, text_col)).join(kept, "__uid")
    first = Window.partitionBy("__uid").orderBy("__uid")
    return rows.withColumn("__n", F.row_number().over(first)).filter("__free or __n = 1").select(*df.columns)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _open_classes(tested: DataFrame, comps: DataFrame) -> DataFrame:
    """node, comp of the components that a failed pair connects with another one."""
    left, right = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), comps.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    apart = tested.filter("not linked").join(left, "a", "left").join(right, "b", "left")
    apart = apart.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).filter("ca != cb")
    ends = stored(apart.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ca").alias("comp")), F.struct(F.col("b").alias("node"), F.col("cb").alias("comp")))).alias("x"))
                  .select("x.node", "x.comp").distinct(), "ends-apart")
    return comps.join(ends.select("comp").distinct(), "comp", "left_semi").select("node", "comp").unionByName(ends).distinct()


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """token, node, n, place: the shared shingles of each class's prefix, rare ones first; ``most``: the largest set that one place leaves possible; sketch."""
    s = percent / 100
    flat = stored(sets.select("node", "n", F.explode("shingles").alias("token")), "open-shingles")
    shared = flat.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    # shingles of one class come first and match nothing: they only move the others on
    order = flat.join(shared, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("order"))
    least = F.ceil(F.col("n") * percent / 100)  # a partner shares so many
    own = F.col("n") - F.size("order")
    room = (F.col("n") - least + 1 - own).cast("int")
    order = order.select("node", "n", own.alias("own"), F.slice("order", 1, F.greatest(room, F.lit(0))).alias("order"))
    rows = order.select("node", "n", "own", F.posexplode("order")).select("node", "n", (F.col("own") + F.col("pos")).alias("place"), "col.token")
    # shared <= n - place, and shared >= s / (1 + s) * (n + partner's n)
    most = F.floor((F.col("n") - F.col("place")) * ((1 + s) / s) - F.col("n") + 1e-6)
    rows = rows.withColumn("most", most.cast("long")).filter(F.col("most") >= F.ceil(F.col("n") * percent / 100))
    return rows.join(_sketches(sets), "node")


def _sketches(sets: DataFrame) -> DataFrame:
    """node, sketch: for each of ``BITS`` buckets, whether an odd number of a set's shingles falls into it."""
    def sketch(batches):
        for batch in batches:
            lists = batch.column("shingles")
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(n)])
            at = (mix(lists.flatten().to_numpy().view(np.uint64)) % np.uint64(BITS)).astype(np.int64)
            for i in range(0, len(n), 256):
                j = min(i + 256, len(n))
                cell = np.repeat(np.arange(j - i), n[i:j]) * BITS + at[upto[i]:upto[j]]
                odd = np.bincount(cell, minlength=(j - i) * BITS).reshape(-1, BITS) & 1
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, j - i), pa.array([x.tobytes() for x in np.packbits(odd.astype(bool), axis=1)], pa.binary())], names=["node", "sketch"])

    return sets.select("node", "shingles").mapInArrow(sketch, "node long, sketch binary")


def _across(prefixes: DataFrame, members: DataFrame, percent: int, best: bool) -> DataFrame:
    """a, b: pairs of classes of different components that may be links, by prefixes, places, sizes and sketches; ``best``: of each block a forest of the nearest."""
    rows = prefixes.join(members, "node")
    kinds = rows.groupBy("token").agg(F.count("*").alias("k"), F.min("n").alias("small"), F.max("most").alias("large"), F.min("comp").alias("c"), F.max("comp").alias("d"))
    kinds = kinds.filter("k > 1 and c != d").select("token", "small", "large", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
    near = rows.join(kinds, "token").filter("most >= small and large >= n")
    side = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    near = near.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    near = near.select("token", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "comp", "n", "most", "sketch")

    def pairs(t: pa.Table) -> pa.Table:
        node, comp, n, most, side = (t.column(c).to_numpy().astype(np.int64) for c in ("node", "comp", "n", "most", "side"))
        order = np.argsort(n, kind="stable")
        node, comp, n, most, side = node[order], comp[order], n[order], most[order], side[order]
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(n), -1)[order]
        # partners that aren't smaller: later in this order, as large as one's own place allows
        upto = np.searchsorted(n, np.minimum(most, 100 * n // percent), side="right")
        count = np.maximum(upto - np.arange(len(n)) - 1, 0)
        out = []
        for begin, end in _spans(count, 200_000):
            one = np.repeat(np.arange(begin, end), count[begin:end])
            two = flat_ranges(np.arange(begin, end) + 1, count[begin:end])
            fit = (most[two] >= n[one]) & (comp[one] != comp[two])
            if side.min() != side.max():
                fit &= side[one] != side[two]
            one, two = one[fit], two[fit]
            apart = np.bitwise_count(sketch[one] ^ sketch[two]).sum(axis=1, dtype=np.int64)
            fit = (100 + percent) * apart <= (100 - percent) * (n[one] + n[two])
            one, two, far = one[fit], two[fit], apart[fit] * 1000 // (n[one[fit]] + n[two[fit]])
            if best:
                keep = spanning(comp[one], comp[two], -far)
                one, two = one[keep], two[keep]
            out.append((node[one], node[two]))
        a, b = (np.concatenate([x[i] for x in out] + [np.zeros(0, np.int64)]) for i in (0, 1))
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return near.groupBy("token", "i", "j").applyInArrow(pairs, "a long, b long").distinct()


def _spans(count: np.ndarray, most: int):
    """Row ranges of about ``most`` pairs."""
    upto, begin = np.cumsum(count), 0
    while begin < len(count):
        end = max(int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + most, side="right")), begin + 1)
        yield begin, end
        begin = end
