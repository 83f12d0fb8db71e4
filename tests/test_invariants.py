"""Invariants of the reports (survey section 5, layer 3)."""

import math

from pyspark.sql import functions as F

from scorecraft.plans import compliance, dashboard, params as P, primitives, scorecard
from scorecraft.sources.roles import Warehouse


def _close(a, b, tol=1e-6):
    return math.isclose(a or 0.0, b or 0.0, rel_tol=tol, abs_tol=1e-6)


def test_segment_rows_add_to_total(spark, small_dir):
    t = Warehouse(spark, small_dir)
    rows = {r["segment"]: r for r in dashboard.daily_budget(t, P.ASOF).collect()}
    total = rows.pop("Estimated Total")
    for c in dashboard.K19_MEASURES:
        assert _close(sum(r[c] or 0.0 for r in rows.values()), total[c]), c


def test_biomed_plus_imaging_is_total(spark, small_dir):
    t = Warehouse(spark, small_dir)
    g = {(r["customer_segment"], r["metric"]): r for r in dashboard.summary_statistics(t, P.ASOF).collect()}
    for m in ("Revenue", "Margin"):
        for c in ("mtd_actual", "ytd_actual", "mtd_var", "ytd_var"):
            assert _close((g[("Biomed", m)][c] or 0) + (g[("Imaging", m)][c] or 0), g[("Total", m)][c]), (m, c)


def test_spread_budget_adds_back_to_month(spark, small_dir):
    t = Warehouse(spark, small_dir)
    spread = primitives.i3_spread_budget(t).withColumn("month_end", F.last_day("date_key"))
    per_month = {r["month_end"]: r["s"] for r in spread.groupBy("month_end").agg(
        F.sum("budget_revenue_day").alias("s")).collect()}
    for r in t.budget_supplement.collect():
        if r["days"]:
            assert _close(per_month[r["month_end"]], float(r["budget_revenue"])), r["month_end"]


def test_slot_columns_equal_long_table(spark, small_dir):
    t = Warehouse(spark, small_dir)
    wide = primitives.c12_slots(t).collect()
    long = {(r["vendor_id"], r["ship_priority_id"]): r["settings"] for r in t.auto_order.collect()}
    for r in wide:
        for i in range(1, 6):
            assert r[f"priority_{i}"] == long.get((r["vendor_id"], i))


def test_full_join_keeps_both_key_sets(spark, small_dir):
    t = Warehouse(spark, small_dir)
    merged = {r["vendor_id"] for r in primitives.c5_full_merge(t).collect()}
    orders = {r["vendor_id"] for r in compliance._vend_orders(t, P.PERIOD_START, P.PERIOD_END).collect()}
    research = {r["vendor_id"] for r in compliance._vend_research(t, P.PERIOD_START, P.PERIOD_END).collect()}
    assert merged == orders | research


def test_distinct_mode_never_exceeds_reference_mode(spark, small_dir):
    t = Warehouse(spark, small_dir)
    ref = {(r["company_id"], r["month_end"]): r["total_orders"]
           for r in scorecard.vendor_metrics(t, P.PERIOD_START, P.PERIOD_END, "reference").collect()}
    dis = {(r["company_id"], r["month_end"]): r["total_orders"]
           for r in scorecard.vendor_metrics(t, P.PERIOD_START, P.PERIOD_END, "distinct").collect()}
    assert ref.keys() == dis.keys()
    assert all(dis[k] <= ref[k] for k in ref)


def test_rank_in_group_is_a_permutation(spark, small_dir):
    t = Warehouse(spark, small_dir)
    ranks = primitives.f3_sort_before_by(t).groupBy("search_item_number").agg(
        F.count(F.lit(1)).alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"),
        F.countDistinct("rank").alias("d")).collect()
    assert all(r["lo"] == 1 and r["hi"] == r["n"] == r["d"] for r in ranks)
