"""Operators 5, 8 and 9 against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorecraft.llm import fingerprints, minhash, suffix_dedup
from scorecraft.llm.components import components
from scorecraft.llm.lpf import longest_factors

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str, k: int) -> frozenset:
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups(rows, k, percent):
    """Brute force: (id, text) -> (set size, component by row number)."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[m][0] for m in members[find(i)] if rows[m][0] is not None]
        comp = min(ids, default=None) if sets[i] else doc
        out.append((doc, len(sets[i]), comp))
    return Counter(out)


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_minhash_groups(docs, empty, texts, k, percent):
    got = minhash.near_duplicates(docs, k, percent).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == groups(texts, k, percent)
    for r in got:
        assert r["kept"] == (r["component_id"] is None or r["doc_id"] == r["component_id"])
    assert minhash.near_duplicates(empty, k, percent).count() == 0


def test_misses_at_any_threshold_stay_bounded():
    assert minhash.tensor_shape(85) == (4, 10) and minhash.tensor_shape(80) == (3, 9)
    for percent in range(1, 101):
        width, halves = minhash.tensor_shape(percent)
        assert 2 * (1 - (percent / 100) ** width) ** halves <= 0.0032, percent


def test_minhash_chains(spark):
    """Links that only a chain makes, in one large bucket, survive."""
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*(f"x{j}" for j in range(i * 3)), *words[i * 3:]])) for i in range(30)]
    rows += [(100 + i, " ".join(f"v{i}_{j}" for j in range(40))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, 3, 85).collect())
    assert got == groups(rows, 3, 85)


@pytest.mark.parametrize("block", [2048, 7])
def test_open_buckets_are_searched(spark, monkeypatch, block):
    """With keys of one hash nearly all classes meet in few buckets: pairs a pivot misses are still verified."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = [(i, " ".join(["the"] * 3 + [f"g{i % 7}_{j}" for j in range(30)] + [f"r{i}"])) for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = minhash.near_duplicates(df, 1, 85, shape=(1, 2)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == groups(rows, 1, 85)


def test_one_row_of_each_group_stays(docs, texts):
    got = minhash.one_per_group(docs, 5, 80)
    assert got.columns == docs.columns
    kept = Counter((r["doc_id"], r["text"] or "") for r in got.collect())
    without = [x for x in texts if not shingles(x[1], 5)]
    by = defaultdict(list)
    sets = groups(texts, 5, 80)
    for doc, n, comp in sets:
        if n:
            by[comp].append(doc)
    assert sum(kept.values()) == len(without) + len(by)
    for comp, ids in by.items():
        assert comp is None or sum(n for (i, t), n in kept.items() if i == comp and shingles(t, 5)) == 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(min(p)), int(max(p))) for p in rng.integers(0, 60, (40, 2)) if p[0] != p[1]]
    pairs += [(100 + i, 101 + i) for i in range(12)]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["comp"] for r in got} == label


# --- repeated strings ------------------------------------------------------------
def covered(rows, length):
    """Brute force: windows of every row that start anywhere else too."""
    places = defaultdict(list)
    for r, (_, t) in enumerate(rows):
        b = t.encode()
        for i in range(len(b) - length + 1):
            places[b[i:i + length]].append((r, i))
    out = [np.zeros(len(t.encode()), bool) for _, t in rows]
    for where in places.values():
        if len(where) > 1:
            for r, i in where:
                out[r][i:i + length] = True
    return out


def expected(rows, length):
    out = Counter()
    for (doc, t), gone in zip(rows, covered(rows, length)):
        b = np.frombuffer(t.encode(), np.uint8)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
        out[(doc, len(b), int(gone.sum()), spans, b[~gone].tobytes())] += 1
    return out


@pytest.mark.parametrize("length", [400, 40])
def test_repeats(docs, empty, texts, length):
    got = suffix_dedup.remove_repeats(docs, length, keep_first=False).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == expected(texts, length)
    assert suffix_dedup.remove_repeats(empty, length).count() == 0


def test_repeats_with_hot_anchors(docs, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_CLASSES", 1)
    got = suffix_dedup.remove_repeats(docs, 40, keep_first=False).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == expected(texts, 40)


@pytest.mark.parametrize("hot", [5000, 1])
def test_first_copy_stays(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_CLASSES", hot)
    shared = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(300))
    rows = [(3, "start " + shared + " end"), (1, shared + " tail of one"), (2, "é" + shared[:200] + " other"), (4, shared), (5, "nothing shared here")]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, s int").repartition(2)
    places = defaultdict(list)
    for i, t in rows:
        b = t.encode()
        for k in range(len(b) - 99):
            places[b[k:k + 100]].append((i, k))
    want = {}
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if min(places[b[k:k + 100]]) < (i, k):
                gone[k:k + 100] = True
        want[i] = np.frombuffer(b, np.uint8)[~gone].tobytes()
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(df, 100, keep_first=True).collect()}
    assert got == want
    whole = suffix_dedup.without_repeats(df, 100)
    assert whole.columns == df.columns
    assert {r["doc_id"]: r["text"].encode() for r in whole.collect()} == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=6, max_size=60), st.integers(1, 12))
def test_longest_previous_factors(bits, length):
    data = np.array(bits, np.uint8)
    starts = np.arange(len(data) - length + 1) if len(data) >= length else np.zeros(0, np.int64)
    before, after = longest_factors(data, starts, starts, length)
    raw = data.tobytes()
    assert before.tolist() == [length if raw.find(raw[s:s + length]) < s else 0 for s in starts.tolist()]
    assert after.tolist() == [length if raw.rfind(raw[s:s + length]) > s else 0 for s in starts.tolist()]


# --- fingerprints ------------------------------------------------------------------
def plain_words(text):
    return WORD.findall(text)


def jaccard(a, b, k=5):
    def s(t):
        w = plain_words(t)
        return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    x, y = s(a), s(b)
    return 1.0 if x == y else len(x & y) / len(x | y)


@pytest.mark.parametrize("per_range", [4096, 5])
def test_fingerprints(docs, empty, texts, per_range):
    got = fingerprints.fingerprints(docs, per_range=per_range).collect()
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    want = Counter()
    near = defaultdict(list)
    for n, (doc, t) in enumerate(order):
        nxt = order[(n + 1) % len(order)][1]
        q = len(t) // 4
        edited = t[:len(t) - q] + nxt[:q]
        want[(doc, len(t), edited)] += 1
        near[(doc, edited)].append((jaccard(t, edited), jaccard(t, nxt)))
    assert Counter((r["doc_id"], r["n_chars"], r["edited"]) for r in got) == want
    for r in got:
        assert any(abs(r["near_edited"] - a) < 0.17 and abs(r["near_next"] - b) < 0.17 for a, b in near[(r["doc_id"], r["edited"])])
    assert fingerprints.fingerprints(empty).count() == 0


def test_sketches_merge_and_estimate(spark):
    one, two = " ".join(f"a{i}" for i in range(3000)), " ".join(f"a{i}" for i in range(1500, 6000))
    df = spark.createDataFrame([(one, two)], "one string, two string").select(fingerprints.sketch(F.col("one")).alias("x"), fingerprints.sketch(F.col("two")).alias("y"))
    x, y = F.col("x"), F.col("y")
    r = df.select(fingerprints.distinct_shingles(x).alias("n"), fingerprints.distinct_shingles(fingerprints.merge(x, y)).alias("u"), fingerprints.resemblance(x, y).alias("r"),
                  fingerprints.containment(x, y).alias("c"), fingerprints.containment(y, x).alias("d"), F.size(fingerprints.merge(x, y)).alias("k")).first()
    assert abs(r["n"] - 2996) < 900 and abs(r["u"] - 5996) < 1800 and r["k"] == fingerprints.K
    assert abs(r["r"] - 0.25) < 0.15 and abs(r["c"] - 0.5) < 0.25 and abs(r["d"] - 0.33) < 0.2


def test_equal_texts_have_equal_fingerprints(spark, small_dir):
    from scorecraft.llm.queries import QUERIES, documents

    rows = QUERIES["op5_fingerprints"](spark, small_dir).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in documents(spark, small_dir).collect()}
    ids = sorted(docs)
    by_text = {}
    for r in rows:
        t = docs[r["doc_id"]]
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        nxt = docs[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        edited = t[:len(t) - len(t) // 4] + nxt[:len(t) // 4]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())


def thue_morse():
    """Two words of 1,024 letters that a hash modulo a power of two can't tell apart."""
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_of_regular_build_stay_apart(spark):
    one, two = thue_morse()
    df = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 3, 85).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_alike_but_unlinked_texts_make_no_pairs(spark):
    """4,000 texts of one template, likeness about 0.6: no pair of them needs a look, and each stays alone."""
    rng = np.random.default_rng(4)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(4000):
        words = list(base)
        for at in rng.choice(120, 5, replace=False):
            words[at] = f"x{rng.integers(1 << 40)}"
        rows.append((i, " ".join(words)))
    rows += [(4000, rows[7][1].replace("x", "y", 1)), (4001, rows[9][1] + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    signed = minhash.signatures(df, 3, 4, 10)
    members = signed.selectExpr("node", "node AS comp")
    sets = minhash._sets(df, signed.select("row_id", "uid", "n_shingles", "node"), members.select("node"), 3, "doc_id", "text")
    assert minhash._across(minhash._prefixes(sets, 85), members, 85, False).count() <= 10
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 3, 85).collect()}
    alone = {i: i for i in range(4000)}
    assert got == {**alone, 4000: 7, 4001: 9}


@pytest.mark.parametrize("percent", [60, 80, 85, 100])
def test_prefixes_lose_no_link(spark, percent):
    """Random sets of all likenesses and sizes, every one in a component of its own: the pairs found hold all links."""
    rng = np.random.default_rng(percent)
    sets = []
    for _ in range(12):
        base = rng.choice(400, rng.integers(3, 60), replace=False)
        for _ in range(8):
            keep = base[rng.random(len(base)) < rng.choice([0.85, 0.95, 1])]
            sets.append(frozenset(np.concatenate([keep, rng.choice(400, rng.integers(0, 4))]).tolist()) or frozenset([1]))
    sets = sorted(set(sets), key=sorted)
    df = spark.createDataFrame([(i, len(s), sorted(s)) for i, s in enumerate(sets)], "node long, n long, shingles array<long>")
    found = {(r["a"], r["b"]) for r in minhash._across(minhash._prefixes(df, percent), df.selectExpr("node", "node AS comp"), percent, False).collect()}
    links = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
    assert links <= found and len(found) < len(sets) * (len(sets) - 1) / 2


def test_forests_of_many_tasks_are_joined(spark, monkeypatch):
    import scorecraft.llm.components as module

    rng = np.random.default_rng(6)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 3000, (2500, 2))] + [(5, i) for i in range(5000, 7000)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent}
    df = spark.createDataFrame(links, "a long, b long").repartition(16)
    assert {r["node"]: r["comp"] for r in components(df).collect()} == want
    monkeypatch.setattr(module, "LINKS", 400)
    assert {r["node"]: r["comp"] for r in components(df).collect()} == want
    nodes, roots = module.forest(*map(np.array, zip(*links)))
    assert dict(zip(nodes.tolist(), roots.tolist())) == want


def test_spanning_forest_keeps_the_heaviest_links():
    from scorecraft.llm.components import forest, spanning

    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 300, (2, 1500))
    a, b = a[a != b], b[a != b]
    weight = rng.integers(1, 50, len(a))
    keep = spanning(a, b, weight)
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    total = 0
    for i in np.argsort(-weight, kind="stable").tolist():  # one link after another, heaviest first
        x, y = find(a[i]), find(b[i])
        if x != y:
            parent[x] = y
            total += weight[i]
    assert weight[keep].sum() == total
    one, two = forest(a, b), forest(a[keep], b[keep])
    assert (one[0] == two[0]).all() and (one[1] == two[1]).all() and keep.sum() == len(one[0]) - len(set(one[1].tolist()))
    assert not spanning(*np.zeros((3, 0), np.int64)).any()
