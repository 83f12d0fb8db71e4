"""Operator 2: approximate nearest neighbours by cosine over balanced posting lists.

Index
  Equal vectors form a class with its smallest ids (only they can be among
  anyone's nearest), so copies of one vector never fill a list.  Centroids
  come from a sample of ``SAMPLE`` classes (more if the lists are many: at least
  ``PER_LIST`` a list), halved again and again at the median along its two
  centres: lists of equal size.  Every class goes to
  its nearest list and, near a border, to up to ``COPIES`` lists no farther
  than ``BORDER`` times the nearest, skipping lists that lie closer to a
  chosen one than to the vector.
Search
  Centroids are the nodes of an in-memory graph (nearest neighbours plus long
  links); a best-first search with a beam finds a query's lists, and those
  within ``REACH`` times the nearest distance are read.  Where the beam is full
  before that distance is met, the query is compared with every centroid: the
  distance alone decides, not the width of the beam.  Exact cosines in
  double precision rank what the lists hold.  Queries with too few finds, and
  those with over ``MANY`` lists in reach, are compared with every vector, block
  of queries by block of vectors.

Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, nor do null ids.  Rows equal in id and
vector count once; a query never finds a row of its own id; ties go to the
smaller id; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorecraft.llm.common import stored

TOP = 5
SAMPLE = 20_000
PER_LIST = 16
LIST_SIZE = 128
MOST_LISTS = 4096
COPIES = 4
BORDER = 1.15
REACH = 1.4
BEAM = 64
MANY = 256
BLOCK = 16_384
DEGREE = 24
SEED = 11


# --- centroids ---------------------------------------------------------------------
def balanced_centroids(x: np.ndarray, lists: int, seed: int = SEED) -> np.ndarray:
    """About ``lists`` centres of equally large parts of the unit vectors ``x``."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(x))]
    while len(parts) < lists:
        parts.sort(key=len)
        own = parts.pop()
        if len(own) < 2:
            parts.append(own)
            break
        v = x[own]
        two = v[rng.choice(len(own), 2, replace=False)]
        for _ in range(6):
            side = v @ (two[1] - two[0])
            half = np.argsort(side, kind="stable")
            low, high = half[:len(own) // 2], half[len(own) // 2:]
            two = np.stack([v[low].mean(axis=0), v[high].mean(axis=0)])
        parts += [own[low], own[high]]
    centres = np.stack([x[p].mean(axis=0) for p in parts])
    norm = np.linalg.norm(centres, axis=1, keepdims=True)
    return centres / np.where(norm > 0, norm, 1)


def centroid_graph(c: np.ndarray, degree: int = DEGREE, seed: int = SEED) -> np.ndarray:
    """Neighbours of each centroid: the nearest ones and a few far links."""
    n = len(c)
    near = min(degree * 2 // 3, n - 1)
    far = min(degree - degree * 2 // 3, n - 1)
    out = np.zeros((n, max(1, near + far)), np.int64)
    if n == 1:
        return out
    rng = np.random.default_rng(seed)
    for k in range(0, n, 1024):
        sim = c[k:k + 1024] @ c.T
        sim[np.arange(len(sim)), np.arange(k, k + len(sim))] = -np.inf
        out[k:k + 1024, :near] = np.argsort(-sim, axis=1, kind="stable")[:, :near]
    out[:, near:] = rng.integers(0, n, (n, far))
    return out


def graph_search(c: np.ndarray, graph: np.ndarray, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Centroids near each row of ``x``, nearest first, with distances; found by walking the graph."""
    n, m = len(c), len(x)
    beam = min(beam, n)
    entry = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))
    ids = np.full((m, beam + graph.shape[1]), -1, np.int64)
    dist = np.full(ids.shape, np.inf)
    open_ = np.zeros(ids.shape, bool)
    seen = np.zeros((m, n), bool)
    first = entry[:beam]
    ids[:, :len(first)] = first
    dist[:, :len(first)] = 1 - x @ c[first].T
    open_[:, :len(first)] = True
    seen[:, first] = True
    rows = np.arange(m)
    while len(rows):
        waiting = np.where(open_[rows, :beam], dist[rows, :beam], np.inf)
        pick = waiting.argmin(axis=1)
        live = np.isfinite(waiting[np.arange(len(rows)), pick])
        rows, pick = rows[live], pick[live]
        if not len(rows):
            break
        node = ids[rows, pick]
        open_[rows, pick] = False
        nb = graph[node]
        fresh = ~seen[rows[:, None], nb]
        # of a neighbour named twice in a row only the first counts
        order = np.argsort(nb, axis=1, kind="stable")
        sorted_nb = np.take_along_axis(nb, order, axis=1)
        twice = np.zeros(nb.shape, bool)
        np.put_along_axis(twice, order[:, 1:], sorted_nb[:, 1:] == sorted_nb[:, :-1], axis=1)
        fresh &= ~twice
        seen[rows[:, None], nb] = True
        d = 1 - np.einsum("rd,rkd->rk", x[rows], c[nb])
        ids[rows, beam:] = np.where(fresh, nb, -1)
        dist[rows, beam:] = np.where(fresh, d, np.inf)
        open_[rows, beam:] = fresh
        best = np.argsort(dist[rows], axis=1, kind="stable")
        ids[rows] = np.take_along_axis(ids[rows], best, axis=1)
        dist[rows] = np.take_along_axis(dist[rows], best, axis=1)
        open_[rows] = np.take_along_axis(open_[rows], best, axis=1)
    return ids[:, :beam], dist[:, :beam]


class Lists:
    """Centroids, their graph, and the choice of lists for vectors and queries."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        self.graph = centroid_graph(centroids)
        self.apart = None

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [graph_search(self.c, self.graph, x[k:k + 1024]) for k in range(0, len(x), 1024)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def for_vectors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: the nearest list and the border ones."""
        ids, dist = self.search(x)
        ids, dist = ids[:, :4 * COPIES], np.maximum(dist[:, :4 * COPIES], 0)
        near = (ids >= 0) & (np.sqrt(dist) <= BORDER * np.sqrt(dist[:, :1]) + 1e-12)
        keep = np.zeros(ids.shape, bool)
        keep[:, 0] = True
        for j in range(1, ids.shape[1]):
            here = np.maximum(ids[:, j], 0)
            ok = near[:, j] & (keep.sum(axis=1) < COPIES)
            for i in range(j):
                between = 1 - np.einsum("nd,nd->n", self.c[here], self.c[np.maximum(ids[:, i], 0)])
                ok &= ~(keep[:, i] & (between < dist[:, j]))
            keep[:, j] = ok
        row, j = np.nonzero(keep)
        return row, ids[row, j]

    def for_queries(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: all lists within ``REACH`` times the nearest distance; none for rows with over ``MANY``."""
        ids, dist = self.search(x)
        dist = np.sqrt(np.maximum(dist, 0))
        near = (ids >= 0) & (dist <= REACH * np.maximum(dist[:, :1], 0.05))
        full = near[:, -1] & (near.shape[1] < len(self.c))  # lists beyond the beam may be within reach too
        row, j = np.nonzero(near & ~full[:, None])
        where = ids[row, j]
        if full.any():
            dist = np.sqrt(np.maximum(1 - x[full] @ self.c.T, 0))
            within = dist <= REACH * np.maximum(dist.min(axis=1, keepdims=True), 0.05)
            within[within.sum(axis=1) > MANY] = False  # these are compared with every vector
            more, other = np.nonzero(within)
            row, where = np.append(row, np.flatnonzero(full)[more]), np.append(where, other)
        return row, where


# --- Spark ---------------------------------------------------------------------------
def _matrix(col: pa.Array) -> np.ndarray:
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and v (array of double) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & fine)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (sizes["d"] if sizes else 0))


def _few(keep: int):
    """Per task and vector the ``keep`` smallest ids."""

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows > 200_000:
                held = _fewest(held, keep)
        if held is not None:
            yield from _fewest(held, keep).combine_chunks().to_batches(max_chunksize=5000)

    return run


def _fewest(t: pa.Table, keep: int) -> pa.Table:
    pdf = pd.DataFrame({"c": t.column("class").to_numpy(), "i": t.column("vec_id").to_numpy()})
    pdf["at"] = np.arange(len(pdf))
    pdf = pdf.drop_duplicates(["c", "i"]).sort_values(["c", "i"])
    return t.take(pa.array(np.sort(pdf.groupby("c").head(keep)["at"].to_numpy())))


def nearest(df: DataFrame, top: int = TOP, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by ``every`` its ``top`` nearest other rows found."""
    spark = df.sparkSession
    rows = _valid(df, id_col, vec_col).withColumn("class", F.xxhash64("v"))
    keep = top + 1  # a query may be one of them itself
    # copies of a vector: only its smallest ids, first in each task, then over all
    part = rows.select("class", "vec_id", "v").mapInArrow(_few(keep), "class long, vec_id long, v array<double>")
    ids = F.slice(F.array_sort(F.collect_set("vec_id")), 1, keep)
    classes = stored(part.groupBy("class").agg(ids.alias("ids"), F.first("v").alias("v")), "ann-classes")
    queries = stored(rows.filter(F.col("vec_id") % every == 0).select("vec_id", "class", "v").distinct(), "ann-queries")
    asked = stored(queries.groupBy("class").agg(F.first("v").alias("v")), "ann-asked")

    n = classes.count()
    if not n:
        return queries.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    wanted = int(min(MOST_LISTS, max(1, n // LIST_SIZE)))
    some = max(SAMPLE, PER_LIST * wanted)  # at most PER_LIST * MOST_LISTS vectors
    sample = classes.orderBy("class").limit(some).select("v").toArrow().column("v").combine_chunks()
    lists = Lists(balanced_centroids(_unit(_matrix(sample)), wanted))
    shared = spark.sparkContext.broadcast(lists)  # at most MOST_LISTS centroids

    def place(batches, choose):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                b = batch.slice(k, 512)
                row, where = getattr(shared.value, choose)(_unit(_matrix(b.column(b.schema.get_field_index("v")))))
                for i in range(0, len(row), 8192):  # a query may visit thousands of lists
                    own = pa.array(row[i:i + 8192], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(where[i:i + 8192], pa.int64()), *(c.take(own) for c in b.columns)], names=["list", *b.schema.names])

    posted = classes.mapInArrow(lambda it: place(it, "for_vectors"), "list long, class long, ids array<long>, v array<double>")
    probes = asked.mapInArrow(lambda it: place(it, "for_queries"), "list long, class long, v array<double>")
    # a list that grew large is split; its queries visit every part
    sizes = stored(posted, "ann-lists")
    splits = sizes.groupBy("list").agg(F.ceil(F.count("*") / (16 * LIST_SIZE)).cast("int").alias("parts"))
    posted = sizes.join(splits, "list").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")).drop("parts")
    found = _best(_read(probes, splits, posted, keep), keep)
    found = stored(found, "ann-found")
    total = classes.select(F.explode("ids").alias("i")).distinct().limit(keep).count()
    short = asked.join(found.groupBy("class").count().filter(F.col("count") >= min(keep, total)), "class", "left_anti")
    asking = short.count()
    if asking:
        here, there = -(-n // BLOCK), -(-asking // BLOCK)

        def block(of, blocks):
            return F.pmod(F.xxhash64("class", F.lit(SEED)), F.lit(of)), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")

        own, other = block(there, here)
        everywhere = short.select("class", "v", own.alias("own"), other).select((F.col("other") * there + F.col("own")).cast("long").alias("list"), "class", "v")
        own, other = block(here, there)
        every_vector = classes.select("class", "ids", "v", own.alias("own"), other).select((F.col("own") * there + F.col("other")).cast("long").alias("list"), "class", "ids", "v", F.lit(0).alias("part"))
        whole = spark.range(here * there).select(F.col("id").alias("list"), F.lit(1).alias("parts"))
        more = _best(_read(everywhere, whole, every_vector, keep), keep)
        found = found.join(short.select("class"), "class", "left_anti").unionByName(more)
    answers = queries.select(F.col("vec_id").alias("query_id"), "class").join(found, "class").filter("query_id != vec_id")
    line = Window.partitionBy("query_id", "class").orderBy(F.desc("score"), "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _read(probes: DataFrame, splits: DataFrame, posted: DataFrame, keep: int) -> DataFrame:
    """class, vec_id, score: what each query's lists hold, the best of each list."""
    asked = probes.join(splits, "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def score(left, right):
        q, c = _matrix(left.column("v").combine_chunks()), _matrix(right.column("v").combine_chunks())
        if not len(q) or not len(c):
            return _scored([], [], [])
        ids = right.column("ids").to_pylist()
        qn, cn = np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
        qu, cu = _unit(q), _unit(c)
        out_class, out_id, out_score = [], [], []
        names = left.column("class").to_numpy()
        for k in range(0, len(q), 256):
            sim = qu[k:k + 256] @ cu.T
            m = min(keep, sim.shape[1])
            floor = -np.partition(-sim, m - 1, axis=1)[:, m - 1]
            row, col = np.nonzero(sim >= floor[:, None] - 1e-9)
            a, b = q[k + row], c[col]
            with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
                exact = (a * b).sum(axis=1) / (qn[k + row] * cn[col])
            exact = np.where(np.isfinite(exact) & (qn[k + row] > 1e-150) & (cn[col] > 1e-150), exact, (qu[k + row] * cu[col]).sum(axis=1))
            for r, j, s in zip(row.tolist(), col.tolist(), exact.tolist()):
                for i in ids[j]:
                    out_class.append(int(names[k + r]))
                    out_id.append(i)
                    out_score.append(s)
        return _scored(out_class, out_id, out_score)

    pairs = asked.groupBy("list", "part").cogroup(posted.groupBy("list", "part"))
    return pairs.applyInArrow(score, "class long, vec_id long, score double")


def _scored(c, i, s) -> pa.Table:
    return pa.table({"class": pa.array(c, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})


def _best(found: DataFrame, keep: int) -> DataFrame:
    line = Window.partitionBy("class").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("class", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("r", F.row_number().over(line)).filter(F.col("r") <= keep).drop("r")
