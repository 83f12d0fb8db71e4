"""Operators 4, 6 and 7 against the tokenizer libraries."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorecraft.llm import bpe_codec, packing, token_counts
from scorecraft.llm.bpe import codec
from scorecraft.llm.queries import queries, tokenizer_path

ALPHABET = "ab'sterl \n\t<|>éΣ世1½\x1c\x85\xa0 .!́İ▁"


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(name, texts):
    rng = random.Random(3)
    cases = [t for _, t in texts] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    cases += ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "don't 's !'s ''s 'll x'RE'", "\n\n  x\n y\t z  ", "12345 a1b2"]
    ids, offs = codec(tokenizer_path(name)).encode(cases)
    want = [e.ids for e in library(name).encode_batch(cases, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:])] == want


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_library_on_any_text(text):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        assert codec(tokenizer_path(name)).encode([text])[0].tolist() == library_ids(name, text)


_libraries = {}


def library_ids(name, text):
    if name not in _libraries:
        _libraries[name] = library(name)
    return _libraries[name].encode(text, add_special_tokens=False).ids


def test_round_trip(docs, empty, texts):
    path = tokenizer_path("byte_bpe_50k.json")
    got = bpe_codec.decode(bpe_codec.encode(docs, path), path).collect()
    lib = library("byte_bpe_50k.json")
    want = Counter((i, tuple(e := lib.encode(t, add_special_tokens=False).ids), lib.decode(e, skip_special_tokens=False)) for i, t in texts)
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == want
    assert bpe_codec.decode(bpe_codec.encode(empty, path), path).count() == 0


def test_decoding_broken_sequences(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    lib = library("byte_bpe_50k.json")
    ids = lib.encode("日本é", add_special_tokens=False).ids
    rows = spark.createDataFrame([(1, ids[:1]), (2, ids[1:]), (3, None), (4, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe_codec.decode(rows, path).collect()}
    assert got == {1: lib.decode(ids[:1]), 2: lib.decode(ids[1:]), 3: "", 4: ""}


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts(docs, empty, texts, name):
    path = tokenizer_path(name)
    got = Counter(tuple(r) for r in token_counts.token_counts(docs, path, limit=500).collect())
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(sp.encode(t))
    else:
        count = lambda t: len(library_ids(name, t))
    assert got == Counter((i, len(t.encode()), n := count(t), n > 500) for i, t in texts)
    assert token_counts.token_counts(empty, path).count() == 0


def test_piece_counts_on_random_texts():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(9)
    cases = ["".join(rng.choice(ALPHABET + "   ") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    assert token_counts.counter(path).counts(cases).tolist() == [len(x) for x in sp.encode(cases)]


def stored_counts(spark, cache):
    return spark.read.option("recursiveFileLookup", "true").schema(token_counts.CACHE_SCHEMA).parquet(cache)


def test_cache_encodes_only_misses(spark, docs, tmp_path):
    path, cache = tokenizer_path("piece_bpe_32k.model"), str(tmp_path / "cache")
    half = docs.filter("doc_id % 2 = 0")
    token_counts.token_counts(half, path, cache).count()
    first = stored_counts(spark, cache)
    held = {bytes(r["content"]): r["n_tokens"] for r in first.collect()}
    assert len(held) == first.count() == half.select(F.coalesce("text", F.lit(""))).distinct().count()
    token_counts.token_counts(docs, path, cache).count()
    after = stored_counts(spark, cache)
    assert after.count() == after.select("content").distinct().count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    # a stored count is used as it stands
    wrong = str(tmp_path / "wrong")
    stored_counts(spark, cache).withColumn("n_tokens", F.lit(77).cast("long")).write.parquet(wrong)
    assert {r["n_tokens"] for r in token_counts.token_counts(docs, path, wrong).collect()} == {77}


def test_a_second_run_with_a_lasting_cache_encodes_nothing(spark, small_dir, tmp_path):
    """The lasting cache holds each content once after two runs, whose rows equal the query's own, and nothing is encoded again."""
    path, cache = tokenizer_path("piece_bpe_32k.model"), f"file://{tmp_path}/lasting"
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    assert token_counts.lasting_cache(spark).endswith(token_counts.LASTING)

    def run():
        return sorted(map(tuple, token_counts.token_counts(docs, path, cache).collect()))

    one = run()
    assert one == sorted(map(tuple, queries()["op7_token_counts"](spark, small_dir).collect()))
    n = stored_counts(spark, cache).count()
    two = run()
    after = stored_counts(spark, cache)
    assert one == two and after.count() == n == after.select("tokenizer", "content").distinct().count() > 0
    # a half-written addition of another run is not met
    (tmp_path / "lasting" / "other" / "_temporary" / "0").mkdir(parents=True)
    (tmp_path / "lasting" / "other" / "_temporary" / "0" / "part-0.parquet").write_bytes(b"half")
    assert run() == one


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_packing(docs, empty, texts):
    path = tokenizer_path("word_bpe_49k.json")
    got = packing.pack(packing.pieces(docs, path, capacity=64), capacity=64, rows_per_part=100).collect()
    want = Counter()
    total = 0
    for i, t in texts:
        ids = [*library_ids("word_bpe_49k.json", t), 0]
        total += len(ids)
        for k in range(0, len(ids), 64):
            want[(i, k // 64, k, np.array(ids[k:k + 64], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in got) == want
    assert check_packing(got, 64) <= -(-total // 64) + 2
    assert packing.pack(packing.pieces(empty, path)).count() == 0


def test_packing_exchanges_between_partitions(spark):
    rng = random.Random(2)
    sizes = [min(2048, int(rng.lognormvariate(5.8, 1.1)) + 1) for _ in range(3000)]
    df = spark.createDataFrame([(i, s, "keep") for i, s in enumerate(sizes)], "i long, length long, sequence_id string").repartition(4)
    rows = packing.pack(df, capacity=2048, rows_per_part=300).collect()
    assert Counter((r["i"], r["length"]) for r in rows) == Counter(enumerate(sizes))
    bins = check_packing(rows, 2048)
    bound = packing.lower_bound(np.bincount(sizes, minlength=2049), 2048)
    alone = check_packing(packing.pack(df, capacity=2048, rows_per_part=300, rounds=1).collect(), 2048)
    assert bound <= bins <= min(alone, bound + 1)


def test_packing_refuses_lengths_out_of_range(spark):
    for bad in (0, 65, None):
        with pytest.raises(Exception):
            packing.pack(spark.createDataFrame([(bad,)], "length long"), capacity=64).count()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_lower_bound_never_exceeds_the_optimum(sizes):
    capacity = 20

    def fewest(rest, bins):
        if not rest:
            return len(bins)
        best, tried = 99, set()
        for i, room in enumerate(bins):
            if room >= rest[0] and room not in tried:
                tried.add(room)
                best = min(best, fewest(rest[1:], [*bins[:i], room - rest[0], *bins[i + 1:]]))
        return min(best, fewest(rest[1:], [*bins, capacity - rest[0]]))

    order = sorted(sizes, reverse=True)
    bound = packing.lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
    used = packing.best_fit(np.array(order), capacity)
    assert bound <= fewest(order, []) <= used.max() + 1
    assert max(Counter({b: sum(s for s, x in zip(order, used) if x == b) for b in used}).values()) <= capacity


def test_query_digests(spark, small_dir):
    from scorecraft.llm.queries import QUERIES, documents

    docs = {r["doc_id"]: r["text"] or "" for r in documents(spark, small_dir).collect()}
    for r in QUERIES["op6_bpe_round_trip"](spark, small_dir).collect():
        ids = library_ids("byte_bpe_50k.json", docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
    rows = QUERIES["op4_best_fit_packing"](spark, small_dir).collect()
    for r in rows:
        ids = [*library_ids("word_bpe_49k.json", docs[r["doc_id"]]), 0][r["start"]:r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    check_packing(rows, 2048)


def test_words_of_regular_build_stay_apart(spark):
    """Two words of 1,024 letters that a hash modulo a power of two can't tell apart, in one batch: ids, counts and round trip are the library's."""
    import sentencepiece

    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    texts = [one, one.translate(str.maketrans("ab", "ba"))]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        ids, offs = codec(tokenizer_path(name)).encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:])] == [library_ids(name, t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    path = tokenizer_path("byte_bpe_50k.json")
    assert {r["doc_id"]: r["decoded"] for r in bpe_codec.decode(bpe_codec.encode(df, path), path).collect()} == dict(enumerate(texts))
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, tokenizer_path("piece_bpe_32k.model")).collect()}
    assert got == {i: len(model.encode(t)) for i, t in enumerate(texts)}
