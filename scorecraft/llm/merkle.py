"""Operator 13: a Merkle manifest of a table, and what becomes of it when rows are altered.

Every row is a leaf: the sha256 of its fields, each with its length.  Leaves of
one group stand in order of their id; 8 consecutive nodes become one until one
is left, the group's subroot; subroots in order of the group's name become the
root the same way.

The tree is cut into aligned blocks of ``FAN ** depth`` leaves.  A task holds one
block at a time as a persistent tree: its nodes are shared by all versions, and
an altered leaf makes a version that copies only its ancestors in the block.
The roots of blocks are the leaves of the next, smaller table, and so on; on
the way back each block learns the siblings above it, once, and the versions of
its altered leaves continue over them to a root of their own.  A version costs
its path, however many there are, and no task holds more than one block.

Positions come from one range partitioning by group, id and leaf; every task
numbers its own rows and adds the counts of the earlier ones, so a group with
most of the rows is spread like any other.

Defined cases: a null field is ``-``, a null group comes first, null ids first in
their group; rows of one id stand in the order of their leaves; equal rows are
leaves of their own; a text of any length is hashed whole by the JVM; other
columns take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorecraft.llm.common import stored

FAN = 8
#: Levels of a block: 8 ** 4 = 4,096 leaves, some 300 kB of digests.
DEPTH = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NODES = "key string, at long, hash string, name string"
INFO = NODES + ", siblings string, places array<int>, runs array<int>, subroot string, root string"
PROVED = "id long, leaf string, subroot string, root string, siblings string, places array<int>, runs array<int>, folded_root string, verified boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Tree:
    """The shared nodes of one block, level by level."""

    def __init__(self, leaves: Sequence[str], levels: int | None):
        """``levels`` None: as many as lead to one node."""
        self.levels = [list(leaves)]
        while len(self.levels) <= levels if levels is not None else len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([digest("".join(below[i:i + FAN])) for i in range(0, len(below), FAN)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def path(self, i: int) -> tuple[str, list[int], list[int]]:
        """Siblings of leaf ``i`` and of its ancestors on end, the place of each in its run, and the runs' lengths."""
        siblings, places, runs = [], [], []
        for nodes in self.levels[:-1]:
            first = i - i % FAN
            run = nodes[first:first + FAN]
            siblings += run[:i - first] + run[i - first + 1:]
            places.append(i - first)
            runs.append(len(run))
            i //= FAN
        return "".join(siblings), places, runs

    def version(self, i: int, leaf: str) -> "Version":
        """The tree with another leaf ``i``: copies of that leaf's ancestors, all other nodes shared."""
        copies = [leaf]
        for nodes in self.levels[:-1]:
            first = i - i % FAN
            copies.append(digest("".join(nodes[first:i]) + copies[-1] + "".join(nodes[i + 1:first + FAN])))
            i //= FAN
        return Version(self, copies)


class Version:
    """A version of a tree: the copied nodes of one path over the base's shared ones."""

    def __init__(self, base: Tree, copies: list[str]):
        self.base, self.copies = base, copies

    @property
    def root(self) -> str:
        return self.copies[-1]


def fold(leaf: str, siblings: str, places: Sequence[int], runs: Sequence[int]) -> str:
    """The root above ``leaf`` by its siblings."""
    start = 0
    for place, run in zip(places, runs):
        cut, end = start + 64 * place, start + 64 * (run - 1)
        leaf = digest(siblings[start:cut] + leaf + siblings[cut:end])
        start = end
    return leaf


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row's fields: ``-`` for null, else byte count, colon, value."""
    def one(c: Column) -> Column:
        s = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return F.sha2(F.concat(*[one(c) for c in fields]), 256)


def _numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` (with a column ``key``) written once in order, with ``at``: each row's place in its key, from 0."""
    spark = df.sparkSession
    schema = T.StructType([*df.schema, T.StructField("__part", T.IntegerType()), T.StructField("__own", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            own = []
            for key in batch.column("key").to_pylist():
                n = n + 1 if key == last else 0
                last = key
                own.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(own), pa.int32()), pa.array(own, pa.int64())], names=[*batch.schema.names, "__part", "__own"])

    # the last column spreads rows that are equal in all others; which of them comes first changes nothing
    spread = df.withColumn("__tie", F.monotonically_increasing_id())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = spread.repartitionByRange(parts, "key", *order, "__tie").sortWithinPartitions("key", *order, "__tie").drop("__tie")
    rows = stored(cut.mapInArrow(number, schema), "merkle-order")
    counts = rows.groupBy("key", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("key", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return rows.join(counts, ["key", "__part"]).withColumn("at", F.col("__before") + F.col("__own")).drop("__part", "__own", "__before")


def _tree(t: pa.Table, depth: int) -> tuple[pa.Table, Tree]:
    """A block's rows in order, and its tree: as deep as a block, less only where it is all of its key."""
    t = t.sort_by("at")
    sole = t.column("at")[0].as_py() == 0 and t.num_rows < FAN ** depth
    return t, Tree(t.column("hash").to_pylist(), None if sole else depth)


def _block(depth: int) -> Column:
    return F.shiftright("at", 3 * depth).alias("__block")  # FAN is 2 ** 3


def _blocks(nodes: DataFrame, depth: int) -> DataFrame:
    """The root of each block, as a node of the next table."""
    def up(t: pa.Table) -> pa.Table:
        t, tree = _tree(t, depth)
        return pa.table({"key": t.column("key")[:1], "at": pa.array([t.column("at")[0].as_py() // FAN ** depth], pa.int64()), "hash": pa.array([tree.root])})

    rows = nodes.select("key", "at", "hash", _block(depth))
    return rows.groupBy("key", "__block").applyInArrow(up, "key string, at long, hash string")


def _climb(nodes: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """The tables from ``nodes`` up, and the one root of each key."""
    tables = []
    while True:
        tables.append(nodes)
        last = nodes.agg(F.max("at")).first()[0]
        nodes = stored(_blocks(nodes, depth), "merkle-nodes").withColumn("name", F.lit(None).cast("string"))
        if last is None or last < FAN ** depth:
            return tables, nodes


def _descend(nodes: DataFrame, above: DataFrame, make: Callable, schema: str, depth: int) -> DataFrame:
    """``make(rows, tree, info)`` for each block of ``nodes``, with what is known of the block from above."""
    def down(t: pa.Table, info: pa.Table) -> pa.Table:
        return make(*_tree(t, depth), info.to_pylist()[0])

    rows = nodes.select("*", _block(depth))
    info = above.select("key", F.col("at").alias("__block"), "siblings", "places", "runs", "subroot", "root")
    return rows.groupBy("key", "__block").cogroup(info.groupBy("key", "__block")).applyInArrow(down, schema)


def _paths(t: pa.Table, tree: Tree, info: dict) -> pa.Table:
    """Each node's path to the root: its own in the block, then the block's."""
    own = [tree.path(i) for i in range(t.num_rows)]
    hashes = t.column("hash")
    return pa.table({
        "key": t.column("key"), "at": t.column("at"), "hash": hashes, "name": t.column("name"),
        "siblings": pa.array([s + info["siblings"] for s, _, _ in own], pa.string()),
        "places": pa.array([p + info["places"] for _, p, _ in own], pa.list_(pa.int32())), "runs": pa.array([r + info["runs"] for _, _, r in own], pa.list_(pa.int32())),
        "subroot": pa.array([info["subroot"]] * t.num_rows, pa.string()), "root": pa.array([info["root"]] * t.num_rows, pa.string())})


def _proofs(t: pa.Table, tree: Tree, info: dict) -> pa.Table:
    """Each leaf's path to the root, and the root of its altered version."""
    cols: dict[str, list] = {c: [] for c in ("siblings", "places", "runs", "folded_root")}
    for i, changed in enumerate(t.column("changed").to_pylist()):
        siblings, places, runs = tree.path(i)
        at = tree.root if changed is None else tree.version(i, changed).root
        # a version's root goes on over the shared nodes above its block
        cols["folded_root"].append(fold(at, info["siblings"], info["places"], info["runs"]))
        cols["siblings"].append(siblings + info["siblings"])
        cols["places"].append(places + info["places"])
        cols["runs"].append(runs + info["runs"])
    n = t.num_rows
    return pa.table({
        "id": t.column("id"), "leaf": t.column("hash"), "subroot": pa.array([info["subroot"]] * n, pa.string()), "root": pa.array([info["root"]] * n, pa.string()),
        "siblings": pa.array(cols["siblings"], pa.string()), "places": pa.array(cols["places"], pa.list_(pa.int32())), "runs": pa.array(cols["runs"], pa.list_(pa.int32())),
        "folded_root": pa.array(cols["folded_root"], pa.string()), "verified": pa.array([f == info["root"] for f in cols["folded_root"]], pa.bool_())})


def manifest(df: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang",
             altered: dict[str, Column] | None = None, where: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """One row per row of ``df``: id, leaf, subroot, root, its path (siblings on end, place in each run, length of each run),
    folded_root (of the version in which the leaf has the ``altered`` fields, for rows where ``where`` holds) and verified."""
    changed = leaf([(altered or {}).get(c, F.col(c)) for c in fields])
    key = F.when(F.col(group_col).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group_col).cast("string")))
    rows = df.select(key.alias("key"), F.col(id_col).cast("long").alias("id"), leaf([F.col(c) for c in fields]).alias("hash"),
                     F.when(where if where is not None else F.lit(False), changed).alias("changed"), F.lit(None).cast("string").alias("name"))
    leaves = stored(_numbered(rows, ["id", "hash"]), "merkle-leaves")
    tables, subroots = _climb(leaves, depth)
    groups = stored(_numbered(subroots.select(F.lit("").alias("key"), F.col("key").alias("name"), "hash"), ["name"]).select("key", "at", "hash", "name"), "merkle-groups")
    upper, root = _climb(groups, depth)
    none = F.array().cast("array<int>")
    info = root.select("key", "at", "hash", "name", F.lit("").alias("siblings"), none.alias("places"), none.alias("runs"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"))
    for nodes in reversed(upper):
        info = stored(_descend(nodes.select("key", "at", "hash", "name"), info, _paths, INFO, depth), "merkle-paths")
    info = info.select(F.col("name").alias("key"), F.lit(0).cast("long").alias("at"), "siblings", "places", "runs", F.col("hash").alias("subroot"), "root")
    for nodes in reversed(tables[1:]):
        info = stored(_descend(nodes.select("key", "at", "hash", "name"), info, _paths, INFO, depth), "merkle-paths")
    return _descend(leaves, info, _proofs, PROVED, depth)


def lowered(text: Column) -> Column:
    """A-Z lowered, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def every_third(doc_id: Column) -> Column:
    """Rows whose id's crc32 (of its decimal form) is divisible by 3."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 0, F.lit(False))
