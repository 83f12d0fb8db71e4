"""Operators 2 and 3 against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorecraft.llm import ann, url_rules
from scorecraft.llm.common import table
from scorecraft.llm.queries import QUERIES


def brute(rows, top, every):
    """query -> [(vec_id, score)] over (id, vector) pairs that take part."""
    rows = sorted({(i, tuple(v)) for i, v in rows})
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    norm = np.sqrt((m * m).sum(axis=1))
    out = {}
    for k in range(len(rows)):
        if ids[k] % every == 0:
            cos = (m * m[k]).sum(axis=1) / (norm * norm[k])
            best = {}
            for j in range(len(rows)):
                if ids[j] != ids[k]:
                    best[int(ids[j])] = max(best.get(int(ids[j]), -9), float(cos[j]))
            out[int(ids[k])] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:top]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf_dir, "embeddings").collect()]
    want = brute(rows, 5, 50)
    got = {}
    for r in QUERIES["op2_nearest_vectors"](spark, sf_dir).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert sorted(found) == [1, 2, 3, 4, 5]
        scores = [found[k][1] for k in sorted(found)]
        assert scores == sorted(scores, reverse=True)
        exact = dict(brute([r for r in rows if r[0] in {q, *(v for v, _ in found.values())}], 10, 50)[q])
        assert all(abs(exact[v] - s) < 1e-12 for v, s in found.values())
        hits += len({v for v, _ in want[q]} & {v for v, _ in found.values()})
    assert hits / sum(map(len, want.values())) >= 0.95


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    same = rng.normal(size=4).tolist()
    rows += [(i, same) for i in range(100, 400)] + [(i, [2 * x for x in same]) for i in range(400, 420)]
    odd = [(500, None), (501, [0.0] * 4), (502, [1.0, None, 1.0, 1.0]), (503, [1.0, math.nan, 0.0, 0.0]), (504, [math.inf, 0.0, 0.0, 0.0]), (505, [1.0, 2.0]), (None, [1.0] * 4), (550, []), rows[0], rows[70]]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd], "vec_id long, embedding array<double>, class int, list int").repartition(4)
    want = brute(rows, 5, 50)
    got = {}
    for r in ann.nearest(df, 5, 50).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    for q in want:
        assert [round(s, 9) for _, s in got[q]] == [round(s, 9) for _, s in want[q]]
        if q >= 100:
            assert len(got[q]) == 5
    # copies: the smallest ids first, never the query itself
    assert [v for v, s in got[100]][:1] == [101] or all(s < 1 for _, s in got[100])
    few = spark.createDataFrame([(0, [1.0, 0.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(few).collect()] == [(0, 1, 7)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_graph_search_finds_nearest_centroids():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = ann.balanced_centroids(x, 128)
    assert len(c) == 128
    ids, dist = ann.graph_search(c, ann.centroid_graph(c), x[:300])
    near = (x[:300] @ c.T).argmax(axis=1)
    assert np.mean(ids[:, 0] == near) > 0.97 and (np.diff(dist, axis=1) >= 0).all()


@pytest.mark.parametrize("size, dim, many", [(16000, 32, 500), (16000, 32, 100)])
def test_distance_decides_how_many_lists_are_read(size, dim, many, monkeypatch):
    monkeypatch.setattr(ann, "MANY", many)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(size, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = ann.Lists(ann.balanced_centroids(x, 512))
    q = x[:100]
    dist = np.sqrt(np.maximum(1 - q @ lists.c.T, 0))
    within = dist <= ann.REACH * np.maximum(dist.min(axis=1, keepdims=True), 0.05)
    assert np.median(within.sum(axis=1)) > 64
    got = np.zeros(within.shape, bool)
    got[lists.for_queries(q)] = True
    some = got.any(axis=1)  # the others are compared with every vector
    assert (within[~some].sum(axis=1) > many).all()
    assert (got & within)[some].sum() >= 0.99 * within[some].sum()


def test_recall_with_more_lists_than_the_beam(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_SIZE", 16)
    monkeypatch.setattr(ann, "BLOCK", 1000)
    rng = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(3000, 64)).tolist())]
    want = brute(rows, 5, 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    for many in (64, 4096):
        monkeypatch.setattr(ann, "MANY", many)
        got = {}
        for r in ann.nearest(df, 5, 2).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert set(got) == set(want)
        hits = sum(len(got[q] & {v for v, _ in want[q]}) for q in want)
        assert hits / sum(map(len, want.values())) >= 0.975


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[cut:]
    end = min((path.index(c) for c in "?#" if c in path), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def rule_of(host, path):
    best = None
    for verdict, h, p in url_rules.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best


URLS = [None, "", "no scheme", "http://", "https://A.Example.NET/en/x?y#z", "http://example.net", "http://example.net/", "http://example.net?x=/en/", "http://x.example.com/de/1.html",
        "http://notexample.com/de/", "https://ÀB.org/fr/ü", "http://org/fr/", "http://org/fr", "ftp://a.b.net//en/", "x://y.example.net/EN/", "a://b://c.net/", "http://a.net/\nx", "http://a.net\n/x",
        "http://" + "a." * 3000 + "net/" + "p/" * 3000, "http://.net/", "http://net./", "http://user@h.net:80/en"]


def test_hosts_and_listed_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS * 2)] + [(None, "http://a.net/", "h", "r")], "page_id long, url string, host string, rule string")
    rows = url_rules.judge(pages).collect()
    assert len(rows) == 2 * len(URLS) + 1
    for r in rows:
        host, path = plain((URLS * 2)[r["page_id"]] if r["page_id"] is not None else "http://a.net/")
        assert (r["host"], r["path"]) == (host, path)
        rule = rule_of(host, path)
        assert r["rule"] == (rule[0] if rule else None)
        assert r["verdict"] == rule[1] if rule else r["verdict"] in ("allow", "block")
    assert url_rules.judge(pages.limit(0)).count() == 0


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(400):
        items = sorted({rng.choice("abcdefgh") for _ in range(4)})
        rows.append((items, "block" if {"a", "b"} <= set(items) or "h" in items else "allow"))
    got = url_rules.mine(spark.createDataFrame(rows, "items array<string>, verdict string"), 0.02, 0.9)
    import itertools

    sure = {}
    for size in range(1, 6):
        for left in itertools.combinations("abcdefgh", size):
            hit = [v for items, v in rows if set(left) <= set(items)]
            for v in ("allow", "block"):
                n = hit.count(v)
                if n >= 0.02 * len(rows) and n >= 0.9 * len(hit):
                    sure[(left, v)] = n / len(hit)
    want = {(left, v) for (left, v), c in sure.items() if not any(set(o) < set(left) and w == v and d >= c for (o, w), d in sure.items())}
    assert {(r[0], r[1]) for r in got} == want
    pages = spark.createDataFrame([(i, items) for i, (items, _) in enumerate(rows)] + [(-1, None), (-2, [])], "i long, items array<string>")
    for r in url_rules.apply_mined(pages, got).collect():
        fit = next((x for x in got if set(x[0]) <= set(r["items"] or ())), None)
        assert r["mined"] == (fit[1] if fit else None)


def test_late_tokens_of_long_urls_count(spark):
    urls, n = [], 100
    deep = "/".join(f"deep{k}" for k in range(30))  # 30 words that always come together
    for i in range(n):
        own = "/".join(f"w{i}x{k}" for k in range(20))
        urls += [f"http://a{i}.net/{deep}/{own}/casino?aff=1", f"http://b{i}.org/fr/{deep}/{own}/casino?x=1", f"http://c{i}.org/fr/{own}/{i}?aff=1"]
    words = "/".join(f"new{k}" for k in range(20))
    asked = {-1: (f"http://shop.com/{words}/casino?y=2&aff=1", "block"), -2: (f"http://shop.com/{words}/casino?y=2", "allow"), -3: (f"http://shop.com/{words}?aff=1", "allow")}
    pages = spark.createDataFrame([*enumerate(urls), *((i, u) for i, (u, _) in asked.items())], "page_id long, url string").repartition(3)
    got = {r["page_id"]: r for r in url_rules.judge(pages).filter("page_id < 0").collect()}
    assert {i: r["verdict"] for i, r in got.items()} == {i: v for i, (_, v) in asked.items()}
    assert got[-1]["mined_rule"] == "ask=aff + path=casino"


def test_tokens_of_the_same_urls(spark):
    import itertools

    rng = random.Random(9)
    rows = []
    for _ in range(400):
        items = {rng.choice("abcd") for _ in range(2)}
        verdict = "block" if {"a", "b"} <= items and rng.random() < 0.95 else "allow"
        items |= {"u"} | ({"A", "x"} if "a" in items else set()) | ({"B"} if "b" in items else set()) | ({"p"} if verdict == "block" and rng.random() < 0.5 else set())
        rows.append((sorted(items), verdict))
    got = url_rules.mine(spark.createDataFrame(rows, "items array<string>, verdict string"), 0.02, 0.9)
    sure = {}
    for size in range(1, 9):
        for left in itertools.combinations("ABabcdpux", size):
            hit = [v for items, v in rows if set(left) <= set(items)]
            for v in ("allow", "block"):
                if hit.count(v) >= 0.02 * len(rows) and hit.count(v) >= 0.9 * len(hit):
                    sure[(left, v)] = hit.count(v) / len(hit)
    want = {(left, v) for (left, v), c in sure.items() if not any(set(o) < set(left) and w == v and d >= c for (o, w), d in sure.items())}
    assert {(r[0], r[1]) for r in got} == want and (("A", "B"), "block") in want


def test_query_covers_every_page(spark, small_dir):
    rows = QUERIES["op3_url_rules"](spark, small_dir)
    assert rows.count() == table(spark, small_dir, "pages").count()
    assert rows.filter(F.col("verdict").isNull()).count() == 0
