"""Operator 10: quality classifier with supervised subword embeddings.

Every word and every character n-gram of it (with word edges) has a learned
vector, found by hashing into ``BUCKETS`` rows.  A word that repeats the one
before it has one shared vector instead, so that repetition itself is learned.
A document is the average of all its vectors; a softmax layer gives the class.  Vectors and layer are
trained together by plain stochastic gradient descent in numpy, in one task
over a sample of at most ``PER_CLASS`` labelled documents of each class.

Scoring needs no vectors: the average and the layer are linear, so each bucket
keeps one number, each distinct word of a batch is worked out once, and a
document sums its words.  Whole texts are scored; null or empty text gets the
score of the layer's bias alone; with no labelled rows, or labels of one kind,
every score is the smoothed share of label 1.  Repeated rows get equal scores;
an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.bpe import SPACE, char_classes
from scorecraft.llm.common import add_columns, fold
from scorecraft.llm.examples import labelled_sample
from scorecraft.llm.text import SpanCache, code_points, decode, flat_ranges, prefix_hash, span_hash

BUCKETS = 1 << 17
REPEATED = BUCKETS
DIM = 8
NGRAMS = (2, 3, 4)
PER_CLASS = 2000
EPOCHS = 4
RATE = 0.5
SEED = 7


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, word starts and ends, and word offsets per text; words end at white space."""
    cp, offs = code_points(texts)
    if not len(cp):
        return cp, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    solid = char_classes(cp) != SPACE
    edge = np.zeros(len(cp) + 1, bool)
    edge[offs] = True
    start, stop = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return cp, s, e, np.searchsorted(s, offs)


def features(cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and its n-grams: flat, with counts per word."""
    size = e - s + 2
    at = np.cumsum(size) - size
    edged = np.full(int(size.sum()), ord(" "), np.uint32)
    edged[flat_ranges(at + 1, e - s)] = cp[flat_ranges(s, e - s)]
    prefix = prefix_hash(edged)
    word = np.arange(len(s))
    owner, bucket = [word], [span_hash(prefix, at, at + size) >> np.uint64(20)]
    for n in NGRAMS:
        k = np.maximum(size - n + 1, 0)
        begin = flat_ranges(at, k)
        owner.append(np.repeat(word, k))
        bucket.append(span_hash(prefix, begin, begin + n) >> np.uint64(20))
    owner, bucket = np.concatenate(owner), np.concatenate(bucket)
    order = np.argsort(owner, kind="stable")
    return (bucket[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(owner, minlength=len(s))


def repeats(key: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Words (by hash) that equal the word before them in their text."""
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    same[offs[offs < len(key)]] = False
    return same


def train(texts: list[str], y: np.ndarray, weight: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, float]:
    """One number per bucket, and the bias: the trained model in its linear form."""
    docs = []
    for t in texts:
        cp, s, e, offs = words_of([t])
        if len(s):
            ids, per_word = features(cp, s, e)
            ids[np.repeat(repeats(span_hash(prefix_hash(cp), s, e), offs), per_word)] = REPEATED
            ids, n = np.unique(ids, return_counts=True)
            docs.append((ids, (n / n.sum()).astype(np.float32)))
        else:
            docs.append((np.zeros(0, np.int64), np.zeros(0, np.float32)))
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 1, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    scale = weight / weight.mean()
    steps = EPOCHS * len(docs)
    step = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            ids, share = docs[i]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = share @ emb[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            p *= min(float(scale[i]), 10.0)
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= 0.1 * rate * p
            if len(ids):
                # every vector of the document moves by its share, scaled so that rare ones learn too
                emb[ids] -= (rate * np.minimum(share * 200, 1.0))[:, None] * back
    return (emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


class Scorer:
    """Scores texts with a model in linear form; words are worked out once per task."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.cache = SpanCache(dtype=np.float64)

    def scores(self, texts: list[str]) -> np.ndarray:
        cp, s, e, offs = words_of(texts)
        z = np.full(len(texts), self.bias)
        if len(s):
            words = span_hash(prefix_hash(cp), s, e)
            key, one, inverse = np.unique(words, return_index=True, return_inverse=True)

            def make(missing):
                at = one[missing]
                bucket, n = features(cp, s[at], e[at])
                total = np.add.reduceat(self.weights[bucket].astype(np.float64), np.cumsum(n) - n)
                return np.stack([total, n.astype(np.float64)], axis=1).ravel(), np.full(len(at), 2)

            slot = self.cache.resolve(key, make)[inverse]
            at = self.cache.at[slot]
            upto = np.zeros((2, len(s) + 1))
            size = self.cache.flat[at + 1]
            np.cumsum(np.where(repeats(words, offs), size * self.weights[REPEATED], self.cache.flat[at]), out=upto[0, 1:])
            np.cumsum(size, out=upto[1, 1:])
            total, count = upto[0, offs[1:]] - upto[0, offs[:-1]], upto[1, offs[1:]] - upto[1, offs[:-1]]
            z = z + np.where(count > 0, total / np.maximum(count, 1), 0)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> dict:
    """The model: ``weights`` and ``bias``, one number per bucket whatever the data."""
    sample = labelled_sample(docs, labels, label, per_class).coalesce(1)

    def run(batches):
        pdf = pd.concat([b.to_pandas() for b in batches] or [pd.DataFrame()])
        pdf = pdf.sort_values("row_id").reset_index(drop=True) if len(pdf) else pdf
        if not len(pdf) or pdf["label"].nunique() < 2:
            ones = float((pdf["label"] * pdf["share"]).sum()) if len(pdf) else 0.0
            rows = float(pdf["share"].sum()) if len(pdf) else 0.0
            p = (ones + 1) / (rows + 2)
            weights, bias = np.zeros(BUCKETS + 1, np.float32), math.log(p / (1 - p))
        else:
            weights, bias = train(pdf["text"].fillna("").tolist(), pdf["label"].to_numpy(), pdf["share"].to_numpy(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])

    got = sample.mapInArrow(run, "weights binary, bias double").first()
    if got is None:  # no task ran: no labelled rows
        return {"weights": np.zeros(BUCKETS + 1, np.float32).tobytes(), "bias": 0.0}
    return {"weights": bytes(got["weights"]), "bias": got["bias"]}


def _scorer(shared) -> Scorer:
    """One scorer per broadcast model and Python worker."""
    if not hasattr(shared, "scorer"):
        shared.scorer = Scorer(np.frombuffer(shared.value["weights"], np.float32), shared.value["bias"])
    return shared.scorer


def add_scores(df: DataFrame, model: dict, column: str = "score", text_col: str = "text") -> DataFrame:
    """``df`` with the score of ``text_col`` as ``column``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return add_columns(df, lambda data, offsets, rows: {column: _scorer(shared).scores(decode(data, offsets))}, f"`{column}` double", text_col)


def score(df: DataFrame, model: dict, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, score, predicted of every row."""
    rows = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text"))
    scored = add_scores(rows, model).drop("text")
    return scored.select(F.col("row_id").alias(id_col), (fold(F.col("row_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    return score(docs, fit(docs, labels), threshold)
