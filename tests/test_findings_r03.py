"""Faults that only large tables show: hash tables built in the driver, wide rows stored for a few columns, wide sorts."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from scorecraft.plans import line_items, targeting
from scorecraft.session import SESSION_DEFAULTS
from scorecraft.sources import tables
from scorecraft.sources.roles import Warehouse


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_a_few_columns_of_a_large_table_are_not_broadcast(spark, tmp_path):
    """Two columns of 600,000 rows are 9 MB as parquet and far more as a hash table: they are dealt, not gathered in the driver."""
    path = f"file://{tmp_path}/orders"
    spark.range(600_000).select("id", F.xxhash64("id").alias("cust"), F.xxhash64("id", F.lit(1)).alias("other")).repartition(4).write.parquet(path)
    keys = [k for k in SESSION_DEFAULTS if k.endswith("utoBroadcastJoinThreshold")]
    held = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, SESSION_DEFAULTS[k])
        orders = spark.read.parquet(path).select("id", "cust")
        joined = spark.range(0, 3_000_000, 3).withColumn("line", F.rand(1)).join(orders, "id")
        assert joined.count() == 200_000
        joined = spark.read.parquet(path).select("id", "other").join(orders, "id")
        joined.collect()
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_a_small_file_of_many_parts_is_not_broadcast(spark, tmp_path):
    """Four columns of 400,000 parts are 2 MB in their file and 48 MB as a hash table: the driver doesn't build it."""
    path = f"file://{tmp_path}/part"
    spark.range(400_000).select(F.col("id").alias("p_partkey"), F.concat(F.lit("Brand#"), F.col("id") % 25).alias("p_brand"), (F.col("id") % 50).cast("int").alias("p_size"),
                                (F.col("id") % 1000 + 0.5).alias("p_retailprice")).repartition(4).write.parquet(path)
    keys = [k for k in SESSION_DEFAULTS if k.endswith("utoBroadcastJoinThreshold")]
    held = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, SESSION_DEFAULTS[k])
        part = spark.read.parquet(path)
        lines = spark.range(0, 1_200_000, 3).withColumn("l_partkey", F.col("id").cast("long"))
        joined = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("id", "p_brand", "p_size", "p_retailprice")
        assert len(joined.collect()) == 133_334
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_quotes_are_read_from_their_lines(spark, small_dir):
    """A query that needs a column or two of the quotes writes no table of them."""
    t = Warehouse(spark, small_dir).prepare()
    assert {f.rsplit("/", 1)[1] for f in t.role("research").inputFiles()} == {"lineitem.parquet"}
    plan = line_items.research_ids(t)._jdf.queryExecution().executedPlan().toString()
    assert "l_partkey" in plan and "l_extendedprice" not in plan
    assert rows(line_items.research_ids(t)) == rows(line_items.research_ids(Warehouse(spark, small_dir)))


def formulary(spark):
    return SimpleNamespace(
        formulary=spark.createDataFrame([(1, 3), (1, 3), (2, 3), (None, 3), (None, 6), (4, 9), (5, None), (7, 12)], "document_id long, o_string long"),
        item_prices=spark.createDataFrame([(3,), (3,), (6,), (12,), (None,)], "oem_item_number long"),
        items=spark.createDataFrame([(3, "a", 10), (3, "a", 10), (3, "b", 10), (3, None, 11), (6, "c", 10), (9, "d", 10), (12, "e", 99), (None, "f", 10)],
                                    "item_number long, description string, company_id long"),
        vendors=spark.createDataFrame([(10, "V"), (10, "V"), (10, "W"), (11, None), (None, "X")], "company_id long, company_name string"))


def test_formulary_documents_are_counted_before_the_names(spark):
    """Repeated items, vendors and documents, null keys; and no row holds a document beside a description."""
    got = targeting.formulary_rules(formulary(spark))
    want = [(3, 10, "V", "a", 2), (3, 10, "V", "b", 2), (3, 10, "W", "a", 2), (3, 10, "W", "b", 2), (3, 11, None, None, 2), (6, 10, "V", "c", 0), (6, 10, "W", "c", 0)]
    assert rows(got) == sorted(map(str, want))
    plan = got._jdf.queryExecution().optimizedPlan()

    def outputs(p):
        yield p.output().mkString(",")
        for i in range(p.children().size()):
            yield from outputs(p.children().apply(i))

    assert not [o for o in outputs(plan) if "document_id" in o and "description" in o]


@pytest.mark.parametrize("dealt", [False, True])
def test_rows_grouped_by_the_bucket_key_are_dealt_once(spark, dealt):
    rows_ = spark.range(4000).withColumn("k", F.col("id") % 500).groupBy("k").agg(F.max("id").alias("m"))
    made = tables.bucketed(rows_, "grouped", "k", dealt=dealt)
    assert made.count() == 500 and made.filter("m - k != 3500").count() == 0
    joined = made.join(made.select("k", F.col("m").alias("n")).hint("shuffle_hash"), "k")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 500


def test_windows_of_a_hot_anchor_join_into_stretches(spark, monkeypatch):
    """A passage in many texts that differ around it: each class takes a few intervals, not one for each window."""
    from scorecraft.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "HOT_CLASSES", 1)
    shared = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(300))
    texts = [(i, f"{i:05d}" * 30 + shared + f"{i * 7919:07d}" * 20) for i in range(6)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    _, classes = suffix_dedup.repeated_windows(suffix_dedup._rows(df, "doc_id", "text"), 100, 25)
    found = classes.filter("found is not null").select(F.sum(F.size("found")).alias("k"), F.sum(F.expr("aggregate(found, 0L, (a, x) -> a + x.hi - x.lo + 1)")).alias("windows"), F.count("*").alias("n")).first()
    assert found["windows"] > 500 and found["k"] <= 2 * found["n"]
