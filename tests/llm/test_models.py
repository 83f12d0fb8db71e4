"""Operators 1 and 10: held-out accuracy, exact search, and the rules for odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorecraft.llm import quality, toxicity
from scorecraft.llm.common import documents, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    return documents(spark, SF), table(spark, SF, "labels")


def labelled(rows, labels, column):
    want = {r["doc_id"]: r[column] for r in labels.collect()}
    return [(want[r["doc_id"]], r) for r in rows if r["doc_id"] in want]


def test_folds(corpus):
    docs, labels = corpus
    for r in quality.classify(docs, labels).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_quality_on_held_out_rows(corpus):
    docs, labels = corpus
    rows = labelled(quality.classify(docs, labels).filter("held_out").collect(), labels, "quality")
    assert len(rows) > 50
    assert np.mean([y == r["predicted"] for y, r in rows]) >= 0.9
    bad, good = [r["score"] for y, r in rows if y == 0], [r["score"] for y, r in rows if y == 1]
    assert np.median(bad) + 0.3 < np.median(good)


def test_toxicity_on_held_out_rows(corpus):
    docs, labels = corpus
    rows = labelled(toxicity.classify(docs, labels).filter("held_out").collect(), labels, "toxic")
    base = np.mean([y == 0 for y, _ in rows])
    assert np.mean([y == r["predicted"] for y, r in rows]) >= max(0.9, base)


def test_search_is_exact():
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(500):
        t = np.sort(rng.choice(40, rng.integers(0, 9), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt((w * w).sum()) if len(t) else w))
    ids = rng.permutation(500)
    index = toxicity.Index(vectors, ids, rng.integers(0, 2, 500), ids.astype(np.int64), 40)
    dense = np.zeros((500, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for q in range(0, 500, 7):
        t, w = vectors[q]
        best, score = index.search(t, w, int(ids[q]), k=10)
        cos = dense @ dense[q]
        want = sorted(((-round(float(cos[i]), 9), int(ids[i])) for i in range(500) if i != q and cos[i] > 0))[:10]
        assert [(-round(float(s), 9), int(index.ids[b])) for b, s in zip(best, score)] == want


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, docs, empty, texts, module):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(0, 40)] + [(None, 1, 1), (3, None, None), (4, 5, 5), (6, 1, 1)], "doc_id long, quality int, toxic int")
    rows = module.classify(docs, labels).collect()
    assert len(rows) == len(texts)
    by_text = {}
    for r in rows:
        assert 0 <= r["score"] <= 1
    for (i, t), r in zip(sorted(texts, key=lambda x: (x[0] is None, x[0] or 0, x[1])), sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))):
        if i is not None:
            assert by_text.setdefault(t, r["score"]) == r["score"]
    assert module.classify(empty, labels).count() == 0
    one = {r["score"] for r in module.classify(docs, labels.limit(0)).collect()}
    assert len(one) == 1
    kept = module.add_scores(docs, module.fit(docs, labels), "__score" if module is quality else "__")
    assert kept.columns[:len(docs.columns)] == docs.columns and kept.count() == docs.count()


def test_labels_are_no_inputs(spark):
    """Scores of held-out rows don't change when their own labels do."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["good", "bad", "plain", "word", "other"]) for _ in range(20)) + (" vile" if i % 2 else " kind") for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for module in (quality, toxicity):
        labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
        turned = labels.select("doc_id", *(F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col(c)).otherwise(F.col(c)).cast("int").alias(c) for c in ("quality", "toxic")))
        one, two = ({r["doc_id"]: r["score"] for r in module.classify(docs, x).collect()} for x in (labels, turned))
        assert one == two
        assert np.mean([(one[i] >= 0.5) == (i % 2 == 1) for i in range(200)]) > 0.95


def test_rare_words_of_examples_count(spark):
    """A toxic text whose insult stands in three examples only, and one that almost equals an example without any telling word."""
    rng = random.Random(8)
    plain = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    for_one = lambda: [rng.choice(plain) for _ in range(12)]
    rows, labels = [], []
    for i in range(400):
        rows.append((i, " ".join([*for_one(), *(["vile"] if i % 2 else [])])))
        labels.append((i, i % 2))
    near = [f"odd{chr(97 + k)}" for k in range(15)]
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 == 0][:2]
    trained = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 != 0]
    rows += [(i, " ".join([*for_one(), "wretch", "gutter"])) for i in trained[:3]] + [(trained[3], " ".join(near))]
    labels += [(i, 1) for i in trained[:4]]
    rows += [(held[0], " ".join([*for_one()[:4], "wretch", "gutter"])), (held[1], " ".join([*near[:-1], "changed"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got[held[1]]["neighbours"][0] == trained[3] and got[held[1]]["similarity"] > 0.9 and got[held[1]]["predicted"] == 1
    assert set(got[held[0]]["neighbours"][:3]) == set(trained[:3]) and got[held[0]]["predicted"] == 1
    unlabelled = [r for i, r in got.items() if i < 400 and r["held_out"]]
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in unlabelled]) >= 0.95


def test_search_equals_scoring_every_example():
    """Random vectors with long light lists and short heavy ones: the nearest are those of a plain product, whatever is left out."""
    rng = np.random.default_rng(12)
    for size in (3, 40, 700):
        vs = []
        for _ in range(size):
            t = np.unique(np.concatenate([rng.integers(0, 30, 20), rng.integers(30, 600, 5)]))
            w = np.where(t < 30, 0.05, 1.0) * rng.random(len(t)) + 1e-3
            vs.append((t, w / np.sqrt((w * w).sum())))
        vs[-1] = (np.zeros(0, np.int64), np.zeros(0))
        ids, keys = rng.permutation(size), rng.integers(0, 5, size)
        index = toxicity.Index(vs, ids, rng.integers(0, 2, size), keys, 600)
        for q in vs[:60]:
            dense = np.zeros(600)
            dense[q[0]] = q[1]
            best, score = index.search(q[0], q[1], 2)
            every = sorted(((-round(float((dense[t] * w).sum()), 9), int(i)) for (t, w), i, key in zip(vs, ids, keys) if key != 2 and len(t) and (dense[t] * w).sum() > 0))
            assert [(-round(float(s), 9), int(i)) for s, i in zip(score, index.ids[best])] == every[:toxicity.NEIGHBOURS]
