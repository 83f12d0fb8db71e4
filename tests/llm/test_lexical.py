"""Operator 11 against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorecraft.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def named(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=20):
    """(item id, rank, doc id, score) by scoring every document for every item."""
    all_terms = [(i, named(t)) for i, t in docs]
    all_terms = [(i, Counter(w), len(w)) for i, w in all_terms if w]
    n_docs, n_terms = len(all_terms), sum(n for _, _, n in all_terms)
    df = Counter(t for _, c, _ in all_terms for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in all_terms:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in named(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:top])]
    return Counter(out)


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(3)
    texts = [None, "", "?!", "one", "One ONE two", "x " * 50, "日本語 é", "nowhere-to-be-found", "a b c d e f g h", " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3))) for _ in range(60))]
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(4, "One ONE two", "clash"), (None, "one two", None)], "item_id long, text string, score string")


@pytest.mark.parametrize("top", [1, 3, 20])
def test_best_documents(docs, items, texts, top):
    got = lexical.search(docs, items, top).collect()
    want = brute(texts, [(r["item_id"], r["text"]) for r in items.collect()], top)
    assert Counter(map(tuple, got)) == want


def test_small_shards_and_blocks_skip_and_find_the_same(spark):
    """Long lists, many ties and copies; blocks must be skipped and nothing missed."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    text = [" ".join(rng.choices(words[:1 + 300 // (1 + i % 7)], k=rng.randint(1, 60))) for i in range(1500)]
    text += [text[5]] * 200 + ["common " * rng.randint(1, 9) for _ in range(500)]
    docs = [(i, t) for i, t in enumerate(text)]
    asked = [(i, " ".join(rng.choices(words, k=12)) + " common") for i in range(12)] + [(99, text[5])]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string"), shard=3000).collect()
    assert Counter(map(tuple, got)) == brute(docs, asked)


def test_summaries_bound_and_prune():
    rng = np.random.default_rng(2)
    at = np.r_[0, np.cumsum(rng.integers(1, 20, 20000))]
    owner = np.repeat(np.arange(20000), np.diff(at))
    topic = owner % 10  # alike documents share a tenth of the terms
    term = topic * 20 + rng.integers(0, 20, at[-1])
    pair = np.unique(owner * 200 + term)
    owner, term = pair // 200, pair % 200
    at = np.searchsorted(owner, np.arange(20001))
    shard = lexical.Shard(at, term, rng.integers(1, 1000, len(term)), rng.standard_normal((200, lexical.DIMS)).astype(np.float32))
    docs, start, summary, words, most = shard.cut(25)
    assert sorted(docs.tolist()) == sorted(owner[term == 25].tolist())
    ends = np.r_[summary[1:], len(words)]
    for b in range(len(start) - 1):
        top = dict(zip(words[summary[b]:ends[b]].tolist(), most[summary[b]:ends[b]].tolist()))
        for d in docs[start[b]:start[b + 1]].tolist():
            assert all(top[t] >= i for t, i in zip(term[at[d]:at[d + 1]].tolist(), shard.impact[at[d]:at[d + 1]].tolist()))
    best = lexical.Best(5)
    best.begin(list(range(20000)), np.zeros(20000, np.int64))
    words, often = np.array([25, 26, 27, 28, 131]), np.array([2, 1, 1, 1, 1])
    shard.search(words, often, best)
    dense = np.zeros(200, np.int64)
    dense[words] = often
    every = np.bincount(owner, weights=dense[term] * shard.impact, minlength=20000).astype(int)
    assert [(-s, d) for s, _, d, _ in best.rows] == sorted(((int(s), i) for i, s in enumerate(every)), key=lambda x: (-x[0], x[1]))[:5]
    assert shard.skipped > 0


def test_words_are_told_apart_by_their_bytes():
    words = [b"one", b"two", "日本語".encode()]
    v = lexical.Vocabulary(words)
    data = np.frombuffer("one two onetwo 日本語 thre".encode(), np.uint8)
    lower, s, e, _ = lexical.terms(data, np.array([0, len(data)]))
    v.hashes = v.hashes.copy()
    found = [v.words[i] if i >= 0 else None for i in v.find(lower, s, e).tolist()]
    assert found == [b"one", b"two", None, "日本語".encode(), None]
    swapped = lexical.Vocabulary(words)
    swapped.words = swapped.words[::-1]  # every hash now stands for another word
    hits = swapped.find(lower, s, e)
    assert all(i < 0 or data[a:b].tobytes() == swapped.words[i] for i, a, b in zip(hits.tolist(), s.tolist(), e.tolist()))


def test_empty_tables_and_item_blocks(monkeypatch, docs, empty, items, texts):
    assert lexical.search(empty, items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.withColumn("text", F.lit("")), items).count() == 0
    monkeypatch.setattr(lexical, "ITEM_BYTES", 100)
    want = brute(texts, [(r["item_id"], r["text"]) for r in items.collect()])
    assert Counter(map(tuple, lexical.search(docs, items).collect())) == want
