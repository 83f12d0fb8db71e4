"""The reference's literal forms of three rewrites, kept for the benchmark only.

R3: working days as a correlated range subquery over the calendar.
R5: the metric grid as one UNION ALL branch per segment x metric (one scan each).
R6: k slot columns as k joins to the same child table.
They return the same rows as C11, D15 and C12 and show what the rewrites save.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.plans import params as P
from scorecraft.plans import scorecard
from scorecraft.sources.roles import Warehouse


def r3_correlated_workdays(t: Warehouse) -> DataFrame:
    b = scorecard.on_time_lines(t, P.PERIOD_START).select("line_item_id", "vendor_id", "ctime", "delivered")
    return t.spark.sql("""
        SELECT line_item_id, vendor_id, ctime, delivered,
               CASE WHEN delivered IS NULL THEN NULL
                    ELSE (SELECT sum(c.workday_ind) FROM {calendar} c
                          WHERE c.date_key BETWEEN coalesce(l.ctime, DATE '0001-01-01') AND l.delivered) - 1
               END AS clo_del_days
        FROM {lines} l""", lines=b, calendar=t.calendar.select("date_key", "workday_ind"))


def r5_union_grid(t: Warehouse) -> DataFrame:
    d = t.daily_actuals
    segs = [("Total", F.lit(True)),
            ("Biomed", F.coalesce(F.col("product_category_description").isin("Biomed", "Stryker"), F.lit(False))),
            ("Imaging", F.col("product_category_description").isNull()
             | ~F.col("product_category_description").isin("Biomed", "Stryker"))]
    out = None
    for seg, cond in segs:
        def total(c: str):
            return F.sum(c).cast("double")

        values = {m.title(): (total(f"actual_{m}"), total(f"budget_{m}")) for m in ("revenue", "margin")}
        values["GM %"] = tuple(F.try_divide(total(f"{k}_margin"), total(f"{k}_revenue")) for k in ("actual", "budget"))
        for metric, (a, b) in values.items():
            var = F.lit(None).cast("double") if metric == "GM %" else F.try_divide(a - b, b)
            part = d.filter(cond).agg(F.lit(seg).alias("customer_segment"), F.lit(metric).alias("metric"),
                                      a.alias("actual"), b.alias("budget"), var.alias("var_pct"))
            out = part if out is None else out.unionByName(part)
    return out


def r6_slot_joins(t: Warehouse) -> DataFrame:
    ao = t.auto_order
    out = ao.select("vendor_id").distinct()
    for i in range(1, 6):
        s = ao.filter(F.col("ship_priority_id") == i).select("vendor_id", F.col("settings").alias(f"priority_{i}"))
        out = out.join(s, "vendor_id", "left")
    return out
