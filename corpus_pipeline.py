"""A corpus from raw documents to packed training sequences, in five stages.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; all but the last return
the columns of ``documents``.  ``run`` writes each stage's rows to the shared
folder and reads them back for the next one, so a lost executor never repeats
an earlier stage.  No stage can be written as SQL (trained models, hashing,
suffix arrays); tests compare them with plain versions on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecraft.llm import minhash, packing, quality, suffix_dedup, toxicity
from scorecraft.llm.common import stored, table
from scorecraft.llm.queries import tokenizer_path

#: A document stays if its quality score reaches this and its toxicity score stays under that.
QUALITY, TOXICITY = 0.3, 0.5
#: Repeated strings of at least so many bytes are cut: of 3,107,153 stretches of 51 words in the documents
#: of sf0.1 that the quality classifier accepts, the shortest has 230.
REPEAT_BYTES = 200


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.add_scores(docs, model, "__score").filter(F.col("__score") >= QUALITY).select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.add_scores(docs, model, "__").filter(F.col("__score") < TOXICITY).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, likeness of 0.8 or more."""
    return minhash.one_per_group(docs, k=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated passages; ``n_chars`` follows."""
    cut = suffix_dedup.without_repeats(docs, length=REPEAT_BYTES, keep_first=True)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    cut = packing.pieces(docs, tokenizer_path("word_bpe_49k.json"))
    rows = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(rows)


STAGES = [
    ("quality_classifier", good_quality),
    ("toxicity", not_toxic),
    ("minhash_dedup", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("best_fit_packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
