"""Registered queries of the corpus operators: ``opN_<name>`` and ``pipeline``.

Each applies its operator to the whole of its table and derives the digest
columns of its contract from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecraft.llm.common import documents, table
from scorecraft.llm.sql import ORACLE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All corpus queries, the pipeline of ``corpus_pipeline.py`` included."""
    import corpus_pipeline

    return {**QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return {**ORACLE_SQL, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens."""
    from scorecraft.llm import packing

    cut = packing.pieces(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    rows = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(rows).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text and decode it again."""
    from scorecraft.llm import bpe_codec

    path = tokenizer_path("byte_bpe_50k.json")
    both = bpe_codec.decode(bpe_codec.encode(documents(spark, sf_dir), path), path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count the tokens of every text, each distinct content once."""
    from scorecraft.llm import token_counts

    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model")).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op9_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: three-word shingles, likeness of 0.85 or more."""
    from scorecraft.llm import minhash

    found = minhash.near_duplicates(documents(spark, sf_dir), k=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove every byte of a 400-byte string that starts anywhere else too."""
    from scorecraft.llm import suffix_dedup

    cut = suffix_dedup.remove_repeats(documents(spark, sf_dir), length=400, keep_first=False)
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")  # what is left of a character cut in two becomes U+FFFD
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text)


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every text for quality."""
    from scorecraft.llm import quality

    return quality.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"), threshold=0.3)


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every text for toxicity, with its nearest labelled examples as evidence."""
    from scorecraft.llm import toxicity

    return toxicity.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's URL by the listed rules, else by mined ones."""
    from scorecraft.llm import url_rules

    found = url_rules.judge(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict", "mined_rule")


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited copy, and how near they are."""
    from scorecraft.llm import fingerprints

    made = fingerprints.fingerprints(documents(spark, sf_dir))
    return made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprints.spelled(F.col("sketch")).alias("fingerprint"),
                       fingerprints.spelled(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


@query
def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    from scorecraft.llm import ann

    return ann.nearest(table(spark, sf_dir, "embeddings"), top=5, every=50)


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty highest-scoring documents of every benchmark item."""
    from scorecraft.llm import lexical

    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=20)


@query
def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by its host's wrapper."""
    from scorecraft.llm import wrappers

    found = wrappers.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and which rows a tampered text gives away."""
    from scorecraft.llm import merkle

    made = merkle.manifest(table(spark, sf_dir, "documents"), altered={"text": merkle.lowered(F.col("text"))}, where=merkle.every_third(F.col("doc_id")))
    return made.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", "verified")
