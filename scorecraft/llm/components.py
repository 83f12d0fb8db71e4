"""Connected components of a link table: forests inside tasks, then minimum labels and pointer jumping on what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.common import stored

#: Links that a task contracts at once, and nodes whose roots it holds at most (and one batch more).
LINKS = 250_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of some links, and the smallest node that each is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while len(one):
        low = np.minimum(root[one], root[two])
        np.minimum.at(root, root[one], low)
        np.minimum.at(root, root[two], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        apart = root[one] != root[two]
        one, two = one[apart], two[apart]
    return nodes, nodes[root]


def spanning(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which links make a spanning forest of the largest weights: every component takes its best link to another, until none is left."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = at[:len(a)], at[len(a):]
    place = np.empty(len(a), np.int64)
    place[np.argsort(-weight, kind="stable")] = np.arange(len(a))
    link = np.argsort(place)
    chosen = np.zeros(len(a), bool)
    root, left = np.arange(len(nodes)), np.arange(len(a))
    while True:
        left = left[root[one[left]] != root[two[left]]]
        if not len(left):
            return chosen
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, root[one[left]], place[left])
        np.minimum.at(best, root[two[left]], place[left])
        took = link[np.unique(best[best < len(a)])]
        chosen[took] = True
        which, low = forest(root[one[took]], root[two[took]])
        root[which] = low
        root = root[root]


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b, weight) thinned to spanning forests of runs of ``LINKS``."""
    held: list[list[np.ndarray]] = []
    size = 0

    def thin() -> list[np.ndarray]:
        cols = [np.concatenate(c) for c in zip(*held)]
        keep = spanning(*cols)
        return [c[keep] for c in cols]

    for batch in batches:
        held.append([batch.column(i).to_numpy() for i in range(3)])
        size += batch.num_rows
        if size >= LINKS:
            held = [thin()]
            size = len(held[0][0])
            if size >= LINKS // 2:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0][:2]], names=["a", "b"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in thin()[:2]], names=["a", "b"])


def thinned(links: DataFrame, name: str) -> DataFrame:
    """Links (a, b, weight) without most that close a circle in a task: what they connect stays connected, by heavier links."""
    links = stored(links.select("a", "b", "weight"), name)
    return links.coalesce(links.count() // LINKS + 1).mapInArrow(_thinned, "a long, b long")


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) as node and root: whatever their number, one row for each node that a task holds."""
    nodes = roots = np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def tell() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= LINKS:
            nodes, roots = forest(np.concatenate([nodes, *(a for a, _ in held)]), np.concatenate([roots, *(b for _, b in held)]))
            held, size = [], 0
            if len(nodes) >= LINKS:
                yield tell()
                nodes = roots = np.zeros(0, np.int64)
    if held:
        nodes, roots = forest(np.concatenate([nodes, *(a for a, _ in held)]), np.concatenate([roots, *(b for _, b in held)]))
    if len(nodes):
        yield tell()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``comp`` (the component's smallest node) of every node in ``links`` (a, b).

    Tasks contract about ``LINKS`` links each to a forest of stars: a node of any
    number of links leaves a task as one row.  Roots that share a node are the only
    links left; usually few, they are joined by rounds of labels.
    """
    links = stored(links.select("a", "b"), "links")
    tasks = links.count() // LINKS + 1
    stars = links.coalesce(tasks).mapInArrow(_rooted, "node long, root long")
    # a node has one root a task at most
    nodes = stored(stars.groupBy("node").agg(F.min("root").alias("comp"), F.collect_set("root").alias("roots")), "rooted")
    between = nodes.select(F.col("comp").alias("a"), F.explode("roots").alias("b")).filter("a != b").distinct()
    between = stored(between, "root-links")
    if tasks == 1 or not between.limit(1).count():
        return nodes.select("node", "comp")
    named = _labelled(between)
    return nodes.join(named.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))


def _labelled(links: DataFrame) -> DataFrame:
    """Each round a node takes the smallest label among itself and its neighbours, then
    the label of its label; every round is written to the shared folder, so a lost
    executor never repeats earlier rounds."""
    both = stored(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "links")
    labels = stored(both.select("node").distinct().withColumn("comp", F.col("node")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        down = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        down = stored(down, "labels-down")
        up = down.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        jumped = stored(down.join(up, "comp").select("node", "was", F.col("root").alias("comp")), "labels")
        moved = jumped.filter("was != comp").limit(1).count()
        labels = jumped.select("node", "comp")
        if not moved:
            return labels
