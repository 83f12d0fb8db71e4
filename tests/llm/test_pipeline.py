"""The pipeline's stages against plain versions, on the smallest table."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scorecraft.llm import quality, toxicity
from scorecraft.llm.common import table
from test_dedup import shingles


@pytest.fixture(scope="module")
def steps(spark, small_dir):
    docs = table(spark, small_dir, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small_dir).cache()
        out.append(docs)
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_return_the_columns_of_documents(steps):
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes


def test_filters_keep_what_their_classifier_accepts(spark, small_dir, steps):
    labels = table(spark, small_dir, "labels")
    fine = quality.classify(steps[0], labels).filter("predicted = 1").select("doc_id")
    assert rows(steps[1]) == rows(steps[0].join(fine, "doc_id", "left_semi").select(*steps[0].columns))
    fine = toxicity.classify(steps[1], labels).filter("predicted = 0").select("doc_id")
    assert rows(steps[2]) == rows(steps[1].join(fine, "doc_id", "left_semi").select(*steps[0].columns))


def test_one_of_each_group(steps):
    before, after = [(r["doc_id"], r["text"] or "") for r in steps[2].collect()], {r["doc_id"] for r in steps[3].collect()}
    sets = {i: shingles(t, 5) for i, t in before}
    near = defaultdict(set)
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                near[i].add(j)
                near[j].add(i)
    seen, want = set(), set()
    for i in ids:
        if i not in seen:
            want.add(i)
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in seen:
                    seen.add(k)
                    todo += near[k]
    assert after == want


def test_later_copies_go(steps):
    size = corpus_pipeline.REPEAT_BYTES
    first, want = {}, {}
    for r in sorted(steps[3].collect(), key=lambda r: r["doc_id"]):
        b = (r["text"] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if first.setdefault(b[k:k + size], (r["doc_id"], k)) != (r["doc_id"], k):
                gone[k:k + size] = b"\1" * size
        kept = "".join(c for c, covered in chars(b, gone) if not covered)
        want[r["doc_id"]] = kept
    got = {r["doc_id"]: r["text"] for r in steps[4].collect()}
    assert {i: t or "" for i, t in got.items()} == want
    assert steps[4].filter(F.col("n_chars") != F.char_length("text")).count() == 0


def test_passages_of_51_short_words_go(spark, small_dir):
    letters = "abcdefghijklmnopqrstuvwxyz"
    passage = " ".join(letters[k % 26] + letters[k // 26] + "xy"[:k % 3] for k in range(51))
    assert len(passage.split()) == 51 and 200 <= len(passage.encode()) < 230
    texts = [f"one {passage} two", f"three\t{passage}\tfour", "", "five"]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: r for r in corpus_pipeline.without_repeats(spark, docs, small_dir).collect()}
    assert [got[i]["text"] for i in range(4)] == [texts[0], "three\t\tfour", "", "five"]
    assert got[1]["n_chars"] == len("three\t\tfour")


def chars(b, gone):
    at = 0
    for c in b.decode():
        n = len(c.encode())
        yield c, all(gone[at:at + n])
        at += n


def test_packed(spark, small_dir, steps):
    got = steps[5]
    assert got.select("doc_id").distinct().count() == steps[4].count()
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).filter("n > 2048 or n != m").count() == 0
    again = corpus_pipeline.run(spark, small_dir).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert rows(again) == rows(got.select("doc_id", "piece", "start", "length", "ids_crc32"))


def test_empty_table(spark, small_dir, steps):
    docs = steps[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small_dir)
        assert docs.count() == 0
