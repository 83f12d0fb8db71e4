"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.common import fold, stored


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """row_id, label (0 or 1), text, share: at most ``per_class`` documents of each label outside fold 0.

    Taken by a hash of the id, so the sample is the same in every run.
    ``share`` is how many labelled documents of that label one example stands
    for.  Null ids, null labels and labels other than 0 and 1 are left out; of
    repeated ids the largest label and the smallest text count.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("row_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("row_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("row_id")) != 0))
    known = known.groupBy("row_id").agg(F.max("label").alias("label"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    taken = None
    for y in (0, 1):
        part = known.filter(F.col("label") == y).orderBy(F.xxhash64("row_id"), "row_id").limit(per_class)
        part = part.withColumn("share", F.lit(max(1.0, totals.get(y, 0) / per_class)))
        taken = part if taken is None else taken.unionByName(part)
    taken = stored(taken, "sample-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("row_id"), F.col("text").cast("string").alias("text"))
    # at most 2 * per_class rows are broadcast
    return texts.join(F.broadcast(taken), "row_id").groupBy("row_id", "label", "share").agg(F.min("text").alias("text"))
