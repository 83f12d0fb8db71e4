"""Rules that the small tables cannot show: sums past 64 bits, hot groups, labels per return line, rebuilt tables."""

import datetime as dt
import os
import shutil
from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from scorecraft.functions.money import to_decimal, to_double, total
from scorecraft.operators.windows import rank_in_group
from scorecraft.plans import compliance, params, primitives, scorecard
from scorecraft.sources.roles import Warehouse


def test_money_sums_pass_64_bits(spark):
    """300 million rows of 4.8e10 units pass 2^63; the sum stays exact, its double is the nearest one."""
    rows, each = 300_000_000, 48_000_000_003
    r = spark.range(rows).select(F.lit(each).alias("spend_e6")).agg(
        to_decimal(total("spend_e6"), 6).alias("exact"), to_double(total("spend_e6"), 6).alias("near")).first()
    assert r["exact"] == Decimal(rows * each).scaleb(-6)
    assert r["near"] == float(Decimal(rows * each).scaleb(-6))


def test_double_is_nearest_above_2_to_53(spark):
    units = [2 ** 53 + 1, 2 ** 60 + 123_457, 9_007_199_254_740_993]
    got = spark.createDataFrame([(i, u) for i, u in enumerate(units)], "i int, u long").groupBy("i").agg(to_double(total("u"), 4).alias("x")).collect()
    assert {r["i"]: r["x"] for r in got} == {i: float(Decimal(u).scaleb(-4)) for i, u in enumerate(units)}


def test_ranks_with_payload_and_a_hot_group(spark):
    """1.2 million rows, a third of them in one group, payload columns kept."""
    n = 1_200_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 1000).alias("g"), (F.xxhash64("id") % 1_000_000).alias("o"),
        F.col("id").alias("tie"), F.concat(F.lit("payload "), F.col("id").cast("string")).alias("note"), F.rand(5).alias("weight"))
    ranked = rank_in_group(rows, ["g"], ["o", "tie"], "rank", 16)
    per_group = ranked.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    assert per_group.filter("n != d or lo != 1 or hi != n").count() == 0
    assert ranked.count() == n
    # the order of ranks is the order of (o, tie): neighbours by rank within a group
    a = ranked.select("g", "rank", "o", "tie")
    b = a.select(F.col("g").alias("h"), (F.col("rank") - 1).alias("before"), F.col("o").alias("o2"), F.col("tie").alias("t2"))
    wrong = a.join(b, (F.col("g") == F.col("h")) & (F.col("rank") == F.col("before"))).filter("o2 < o or (o2 = o and t2 <= tie)")
    assert wrong.count() == 0
    assert ranked.filter(F.col("note") != F.concat(F.lit("payload "), F.col("tie").cast("string"))).count() == 0


class Tables:
    """Role tables made by hand."""

    def __init__(self, **tables):
        self.__dict__.update(tables)


def test_returns_count_their_whole_line(spark):
    """Two rows of one return line with different responsibilities: each counts the line, not its label alone."""
    day = dt.date(1998, 3, 5)
    t = Tables(
        returns=spark.createDataFrame(
            [(1, "RGA-1", 2, "C", 99, 3, "Y", 1, dt.datetime(1998, 3, 5, 8)), (1, "RGA-1", 2, "V", 99, 3, "Y", 1, dt.datetime(1998, 3, 5, 8))],
            "line_item_id long, rga_number string, rga_type_id int, responsibility string, return_reason_id int, quantity long, active string, status_id int, created_timestamp timestamp"),
        txn=spark.createDataFrame([(1, 5, 1000, 1)], "line_item_id long, vendor_id long, price_e2 long, orders int"),
        calendar=spark.createDataFrame([(day, dt.date(1998, 3, 31))], "date_key date, month_end date"),
        vendors=spark.createDataFrame([(5,)], "company_id long"))
    r = scorecard.vendor_returns(t, params.PERIOD_START, params.PERIOD_END, "reference").first()
    assert (r["total_returns"], r["customer_returns"], r["vendor_returns"]) == (4, 2, 2)
    assert (r["total_rtn_rev"], r["customer_returns_rev"], r["vendor_returns_rev"]) == (60.0, 60.0, 60.0)
    d = scorecard.vendor_returns(t, params.PERIOD_START, params.PERIOD_END, "distinct").first()
    assert (d["total_returns"], d["customer_returns"], d["vendor_returns"], d["customer_returns_rev"]) == (2, 1, 1, 30.0)


def test_a_second_build_leaves_the_first_readable(spark, small_dir):
    t = Warehouse(spark, small_dir).prepare()
    one = compliance.backorder_trends(t, params.PERIOD_START, params.PERIOD_END)
    two = compliance.backorder_trends(t, params.PERIOD_START, params.PERIOD_END)
    assert one.count() == two.count() > 0
    one, two = primitives.a4_full_refresh(t), primitives.a4_full_refresh(t)
    assert one.count() == two.count() > 0


def test_plans_run_no_job_unless_prepared(spark, small_dir):
    before = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    t = Warehouse(spark, small_dir)
    t.role("txn")
    scorecard.vendor_metrics(t, params.PERIOD_START, params.PERIOD_END)
    schema_reads = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs() - before
    assert schema_reads <= 6  # a footer read for each base table, nothing else


def test_other_data_in_the_same_folder(spark, small_dir, tmp_path):
    folder = tmp_path / "sf"
    shutil.copytree(small_dir, folder)
    spark.conf.set("scorecraft.warehouse.path", str(tmp_path / "shared"))
    try:
        first = Warehouse(spark, str(folder)).prepare().role("txn").count()
        assert Warehouse(spark, str(folder)).prepare().role("txn").count() == first
        assert len(os.listdir(tmp_path / "shared")) == 1
        some = pq.read_table(f"{small_dir}/lineitem.parquet").slice(0, 100)
        os.chmod(folder, 0o755)
        os.chmod(folder / "lineitem.parquet", 0o644)
        pq.write_table(some, folder / "lineitem.parquet")
        assert Warehouse(spark, str(folder)).prepare().role("txn").count() < first
    finally:
        spark.conf.unset("scorecraft.warehouse.path")


@pytest.mark.parametrize("name", ["K1_vendor_metrics", "K3_research_funnel", "K4_supplier_type", "K10_compliance_details"])
def test_names_come_after_the_aggregation(spark, small_dir, name):
    """Without broadcasts, no plan joins detail rows to vendors before they are aggregated."""
    from scorecraft.registry import QUERIES

    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    held = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        plan = QUERIES[name](spark, small_dir)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    lines = plan.splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    aggregates = [i for i, x in enumerate(lines) if x.lstrip(" :+-").startswith("Aggregate")]
    assert aggregates
    for i in aggregates:
        below = range(i + 1, next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines)))
        assert not any("Relation" in lines[j] and "s_suppkey#" in lines[j] for j in below)
