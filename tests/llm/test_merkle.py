"""Operator 13 against a plain tree over all rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorecraft.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def walk(tree, i):
    """Per level: siblings before and after."""
    for nodes in tree[:-1]:
        first = i // 8 * 8
        yield nodes[first:i], nodes[i + 1:first + 8]
        i //= 8


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for n in names:
        groups[n].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[n] = levels([leaf(r) for r in groups[n]])
    top = levels([trees[n][-1][0] for n in names])
    out = []
    for g, n in enumerate(names):
        for i, r in enumerate(groups[n]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            now = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if bad else leaf(r)
            proof = ""
            for before, after in [*walk(trees[n], i), *walk(top, g)]:
                proof += "".join(before + after)
                now = h("".join(before) + now + "".join(after))
            out.append((r[0], leaf(r), trees[n][-1][0], top[-1][0], h(proof), now, now == top[-1][0]))
    return Counter(out)


def query(df, depth=merkle.DEPTH):
    made = merkle.manifest(df, depth=depth, altered={"text": merkle.lowered(F.col("text"))}, where=merkle.every_third(F.col("doc_id")))
    return made.select("id", "leaf", "subroot", "root", F.sha2("siblings", 256), "folded_root", "verified")


def test_manifest(docs, empty):
    rows = [tuple(r[c] for c in FIELDS) for r in docs.collect()]
    assert Counter(map(tuple, query(docs).collect())) == brute(rows)
    assert query(empty).count() == 0


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("n_chars", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()), T.StructField("at", T.LongType())])


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 700])
def test_any_number_of_rows_and_blocks(spark, n):
    """Blocks of 8 and of 64 leaves, so that trees have several tables of blocks; a hot group, single rows, names in byte order."""
    rows = [(3 * i, "s", "en" if i % 3 else [None, "é", "z", "Z", ""][i % 5], i, f"Text {i} A" if i % 4 else None, "k", 0) for i in range(n)]
    for depth in (1, 2):
        got = query(spark.createDataFrame(rows, SCHEMA).repartition(5), depth).collect()
        assert Counter(map(tuple, got)) == brute([r[:5] for r in rows])


def test_versions_share_all_but_a_path():
    tree = merkle.Tree([h(str(i)) for i in range(4096)], merkle.DEPTH)
    before = [list(nodes) for nodes in tree.levels]
    version = tree.version(1234, h("other"))
    assert tree.levels == before and version.base is tree and len(version.copies) == merkle.DEPTH + 1
    changed = merkle.Tree([h("other") if i == 1234 else h(str(i)) for i in range(4096)], merkle.DEPTH)
    at = 1234
    for mine, theirs in zip(version.copies, changed.levels):
        assert mine == theirs[at]
        at //= 8
    siblings, places, runs = tree.path(1234)
    assert merkle.fold(h("1234"), siblings, places, runs) == tree.root and merkle.fold(h("other"), siblings, places, runs) == version.root


def test_many_groups_and_equal_rows(spark):
    rows = [(5, "s", f"g{i % 70:02d}", 1, "Same", "k", 0) for i in range(150)]
    assert Counter(map(tuple, query(spark.createDataFrame(rows, SCHEMA)).collect())) == brute([r[:5] for r in rows])
