"""Supplier scorecard (K1-K7).

Each branch is a lazy DataFrame; ``supplier_scorecard`` joins them once.

Two modes reproduce the reference's fan-out rules without ever emitting
the pairs it creates:

* ``mode="reference"``: the reference's sums at the report's grain.  Where it
  joins the fact to itself per line (C8) or sums remerged aggregates (S4),
  the repeated rows are counted with multiplicities computed by aggregates
  keyed by line id and joined back (no row pairs, no cartesian product).
  The copies of a result row that its remerge would keep aren't returned.
* ``mode="distinct"``: the report grain - each fact row counts once.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecraft.functions.codes import band, effective_cost, map_codes, transit_days
from scorecraft.functions.money import row_double, to_double, units
from scorecraft.functions.scalar import seconds_of_day, to_day
from scorecraft.functions.semantics import in_list, ne_keep_missing, ratio, sas_le, sas_lt
from scorecraft.operators.filters import period_pred
from scorecraft.operators.joins import bounded, workdays_between
from scorecraft.sources.roles import Warehouse

MODES = ("reference", "distinct")


def _check(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")


def _months(t: Warehouse) -> DataFrame:
    return bounded(t.calendar.select("date_key", "month_end"))


def _non_contract(t: Warehouse) -> DataFrame:
    return t.once("line_detail").filter(F.col("contract_pro_id").isNull())


# ---------------------------------------------------------------------------
# K1 vendor order metrics
# ---------------------------------------------------------------------------

def vendor_metrics(t: Warehouse, start, end, mode: str = "distinct") -> DataFrame:
    """K1: vendor x month order metrics on non-contract lines.

    Reference mode weights every fact row by the number of fact rows of the
    same vendor and line (the reference's fact self-join, C8).  One row per
    vendor and month in both modes.
    """
    _check(mode)
    q = t.during("txn", start, end)
    lid = _non_contract(t).select(
        "line_item_id", "smart_price_selected", "smart_sourced", "photo_shown",
        "backorder_ship_date", "return_required", "smart_order_po")
    trk = t.once("tracking").filter(F.col("shipment_leg_id") == 1).select("line_item_id", "auto_label", "tracking_number")
    rows = (q.join(lid, "line_item_id", "inner")
            .join(trk, "line_item_id", "left")
            .join(_months(t), F.col("transaction_date") == F.col("date_key"), "left"))
    if mode == "reference":
        mult = t.txn.groupBy("vendor_id", "line_item_id").agg(F.count(F.lit(1)).alias("m"))
        rows = rows.join(mult, ["vendor_id", "line_item_id"], "inner")
    else:
        rows = rows.withColumn("m", F.lit(1).cast("bigint"))
    v = t.vendors.select("company_id", "company_name", "relationship_manager_id",
                         "relationship_manager", "company_type_code")
    m = F.col("m")
    orders = F.col("orders")

    def wsum(x: Column) -> Column:
        return F.sum(x * m)

    sums = rows.groupBy("vendor_id", "month_end").agg(
        wsum(F.col("requests")).cast("bigint").alias("total_requests"),
        wsum(orders).cast("bigint").alias("total_orders"),
        to_double(wsum(units(F.col("oem_price_e2") * F.col("quantity"))), 2).alias("oem_list"),
        to_double(wsum(units("spend_e6")), 6).alias("parts_cost"),
        wsum(F.col("smart_price_selected") * F.col("requests")).cast("bigint").alias("smart_priced_requests"),
        wsum(F.col("smart_sourced") * F.col("requests")).cast("bigint").alias("smart_sourced_requests"),
        wsum(F.col("photo_shown") * F.col("requests")).cast("bigint").alias("photo_requests"),
        wsum(F.when(F.col("auto_label") == "Y", orders).otherwise(0)).cast("bigint").alias("auto_label"),
        wsum(F.when(F.col("backorder_ship_date").isNotNull()
                    & (F.col("class_id").isNull() | ~F.col("class_id").isin(6, 24, 42)), orders)
             .otherwise(0)).cast("bigint").alias("back_order"),
        wsum(F.when(F.col("tracking_number").isNotNull(), orders).otherwise(0)).cast("bigint").alias("tracking_provided"),
        wsum(F.when(F.col("return_required") == "Y", orders).otherwise(0)).cast("bigint").alias("sold_on_exchange"),
        wsum(F.when(F.col("smart_order_po") == 1, orders).otherwise(0)).cast("bigint").alias("smart_po"),
    )
    # names come after the aggregation: a hot vendor is combined in every task first
    return v.join(sums, v.company_id == sums.vendor_id, "inner").drop("vendor_id")


# ---------------------------------------------------------------------------
# K2 vendor returns
# ---------------------------------------------------------------------------

# Responsibility code -> label; quality reason ids.
RESPONSIBILITY = {"C": "Customer", "P": "House", "V": "Vendor", "N": "Vendor", "S": "Shipping"}
QUALITY_REASONS = (3, 27, 23, 9, 54, 10, 4, 43, 42, 52)


def vendor_returns(t: Warehouse, start, end, mode: str = "distinct") -> DataFrame:
    """K2: returns by responsibility and quality, count and revenue, vendor x month."""
    _check(mode)
    r = t.returns.filter(
        period_pred("created_timestamp", start, end)
        & in_list(F.col("rga_type_id"), (2, 4))
        & (F.col("active") == "Y")
        & ne_keep_missing(F.col("status_id"), 7))
    q = t.txn.filter(F.col("orders") == 1).select(
        F.col("line_item_id").alias("q_line"), "vendor_id", "price_e2")
    rows = (r.join(q, r.line_item_id == q.q_line, "left")
            .join(_months(t), to_day(F.col("created_timestamp")) == F.col("date_key"), "left")
            .select(
                F.col("vendor_id").alias("company_id"), "line_item_id", "rga_number", "month_end",
                map_codes(F.col("responsibility"), RESPONSIBILITY, "other").alias("resp"),
                F.when(F.col("return_reason_id").isin(*QUALITY_REASONS), "Quality Issue")
                .otherwise("Other").alias("quality"),
                (F.col("quantity") * F.col("price_e2")).alias("rev")))  # cents
    # vendor id only survives where the vendor exists (left join to vendors)
    ven = t.vendors.select(F.col("company_id").alias("vid"))
    rows = rows.join(ven, rows.company_id == ven.vid, "left").withColumn("company_id", F.col("vid")).drop("vid")
    # per return line and label: n rows of the fact join, s their revenue
    line = ["company_id", "line_item_id", "rga_number", "month_end"]
    g = rows.groupBy(*line, "resp", "quality").agg(F.count("line_item_id").alias("n"), F.sum(units("rev")).alias("s"))
    if mode == "reference":
        # a row counts its whole return line (remerge), whatever the labels of the line's other rows
        whole = g.groupBy(*line).agg(F.sum("n").alias("ln"), F.sum("s").alias("ls"))
        g = g.join(whole.select(*[F.col(c).alias("l_" + c) for c in line], "ln", "ls"),
                   reduce(and_, (F.col(c).eqNullSafe(F.col("l_" + c)) for c in line)), "inner")
        counted, valued = F.col("n") * F.col("ln"), F.col("n") * F.col("ls")
    else:
        counted, valued = F.col("n"), F.col("s")

    def cnt(cond: Column) -> Column:
        return F.sum(F.when(cond, counted).otherwise(0)).cast("bigint")

    def rev(cond: Column) -> Column:
        return to_double(F.sum(F.when(cond, valued).otherwise(0)), 2)

    resp = F.col("resp")
    qual = (F.col("quality") == "Quality Issue") & (resp == "Vendor")
    out = g.groupBy("company_id", "month_end").agg(
        F.sum(counted).cast("bigint").alias("total_returns"),
        to_double(F.sum("s"), 2).alias("total_rtn_rev"),
        cnt(resp == "Customer").alias("customer_returns"),
        cnt(resp == "House").alias("house_returns"),
        cnt(resp == "Vendor").alias("vendor_returns"),
        cnt(resp == "Shipping").alias("shipping_returns"),
        cnt(qual).alias("quality_returns"),
        rev(resp == "Customer").alias("customer_returns_rev"),
        rev(resp == "House").alias("house_returns_rev"),
        rev(resp == "Vendor").alias("vendor_returns_rev"),
        rev(resp == "Shipping").alias("shipping_returns_rev"),
        rev(qual).alias("quality_returns_rev"),
    )
    return out.withColumn("process_rtns", F.col("vendor_returns") - F.col("quality_returns"))


# ---------------------------------------------------------------------------
# K3 research funnel
# ---------------------------------------------------------------------------

def research_funnel(t: Warehouse, start, end) -> DataFrame:
    """K3: research lines, quotes with a part, automated quotes per vendor x month."""
    res = t.research.filter(period_pred("created_date", start, end))
    lid = _non_contract(t).select("line_item_id")
    ven = t.vendors.select(F.col("company_id").alias("vendor_id"), "company_name")
    req = t.requestors.select("requestor_id")
    rows = (res.join(lid, "line_item_id", "inner")
            .join(_months(t), F.col("created_date") == F.col("date_key"), "left")
            .join(req, F.col("created_user_id") == F.col("requestor_id"), "left"))
    has_part = in_list(F.col("result_code"), ("HP", "EHP"))
    auto = in_list(F.col("research_type_code"), ("SP", "SS", "SPP")) | (F.col("requestor_id").isNotNull() & has_part)
    counts = rows.groupBy("vendor_id", "month_end").agg(
        F.count("line_item_id").alias("research_lines"),
        F.count(F.when(has_part, F.col("line_item_id"))).alias("has_part_research_line"),
        F.count(F.when(auto, F.col("line_item_id"))).alias("ss_research_line"),
    )
    return counts.join(ven, "vendor_id", "left")


# ---------------------------------------------------------------------------
# K4 supplier speciality
# ---------------------------------------------------------------------------

def supplier_type(t: Warehouse) -> DataFrame:
    """K4: share of category-2 orders, all time, banded (missing share -> Imaging, S1)."""
    q = t.once("txn").select("line_item_id", "vendor_id", "product_category_id", "orders")
    lid = _non_contract(t).select("line_item_id")
    ven = t.vendors.select(F.col("company_id").alias("vendor_id"), "company_name")
    rows = q.join(lid, "line_item_id", "inner")
    share = ratio(F.sum(F.when(F.col("product_category_id") == 2, F.col("orders"))), F.sum("orders"))
    g = rows.groupBy("vendor_id").agg(share.alias("bio_pct")).join(ven, "vendor_id", "left")
    g = g.select(F.col("vendor_id").alias("company_id"), "company_name", "bio_pct")
    return g.withColumn("supplier_type", band(F.col("bio_pct"), 0.5, ("Biomed", "Biomed/Imaging", "Imaging")))


# ---------------------------------------------------------------------------
# K5 on-time delivery
# ---------------------------------------------------------------------------

def on_time_lines(t: Warehouse, start) -> DataFrame:
    """Per fact row of K5 up to the on-time flag (steps before the vendor re-join)."""
    ls = t.once("line_status").filter(to_day(F.col("first_ordered_timestamp")) >= F.lit(start).cast("date"))
    lid = _non_contract(t).select("line_item_id")
    setup = ls.join(lid, "line_item_id", "inner").select(
        "line_item_id", F.col("first_closed_timestamp").alias("closed_dt"),
        F.col("first_ordered_timestamp").alias("ordered_dt"))
    cut = t.vendors.filter(F.col("active") == "Y").select(
        F.col("company_id").alias("vendor_id"), F.col("vend_cutoff_est").alias("cutoff"))
    trk = t.once("tracking").filter(F.col("shipment_leg_id") == 1).select(
        "line_item_id", "tracking_number", to_day(F.col("date_delivered")).alias("delivered"))
    ship = t.once("shipping_info").join(bounded(t.ship_methods), "shipping_method", "left")
    q = t.once("txn").filter((F.col("requests") == 1) & (F.col("transaction_date") >= F.lit(start).cast("date")))
    b = (q.select("line_item_id", "vendor_id")
         .join(t.once("line_detail").select("line_item_id", "backorder_ship_date"), "line_item_id", "left")
         .join(trk, "line_item_id", "left")
         .join(ship, "line_item_id", "left")
         .join(setup, "line_item_id", "inner")
         .join(cut, "vendor_id", "left"))
    ctime = to_day(F.col("closed_dt"))
    pre = (F.col("backorder_ship_date").isNull()
           & (sas_le(seconds_of_day(F.col("closed_dt")), F.col("cutoff")) | F.col("cutoff").isNull())
           & F.col("delivered").isNotNull())
    b = b.withColumn("ctime", ctime).withColumn("before_cutoff", pre)
    b = workdays_between(b, "ctime", "delivered", t.calendar, "clo_del_days")
    days = (F.when(F.col("ctime").eqNullSafe(F.col("delivered")) & F.col("before_cutoff"), F.lit(0))
            .when(sas_lt(F.col("delivered"), F.col("ctime")), F.lit(None))
            .when(F.col("before_cutoff"), F.col("clo_del_days"))
            .otherwise(F.col("clo_del_days") - 1))
    days = F.when(days == -1, F.lit(0)).otherwise(days)
    b = b.withColumn("days_to_deliver", days).withColumn("transit_days", transit_days(F.col("shipping_method_id")))
    ontime = (F.coalesce(F.col("days_to_deliver") == 0, F.lit(False))
              | sas_le(F.col("days_to_deliver"), F.col("transit_days")))
    return (b.filter(F.col("tracking_number").isNotNull())
            .withColumn("ontime_id", F.when(ontime, 1).otherwise(0))
            .join(_months(t), to_day(F.col("ordered_dt")) == F.col("date_key"), "left"))


def on_time(t: Warehouse, start, mode: str = "distinct") -> DataFrame:
    """K5: on-time deliveries per vendor name x month of order.

    Reference mode reproduces the two fact re-joins (vendor by line, then
    orders by line) as multiplicities: per line the on-time sum A, per
    (line, vendor) the count c of request rows, per line the count k of
    order rows; the vendor's total adds A * c * max(k, 1).
    """
    _check(mode)
    b = on_time_lines(t, start)
    ven = t.vendors.select(F.col("company_id").alias("vendor_id"), F.col("company_name").alias("vendor_name"))
    if mode == "distinct":
        rows = b.join(ven, "vendor_id", "left")
        return rows.groupBy("vendor_name", "month_end").agg(F.sum("ontime_id").cast("bigint").alias("total_orders_ontime"))
    per_line = b.groupBy("line_item_id", "month_end").agg(F.sum("ontime_id").alias("a"))
    fact = t.txn.select("line_item_id", "vendor_id", "requests", "orders")
    c = (fact.filter(F.col("requests") == 1).groupBy("line_item_id", "vendor_id").agg(F.count(F.lit(1)).alias("c"))
         .join(ven, "vendor_id", "left"))
    k = fact.filter(F.col("orders") == 1).groupBy("line_item_id").agg(F.count(F.lit(1)).alias("k"))
    rows = (per_line.join(c, "line_item_id", "left")
            .join(k, "line_item_id", "left")
            .withColumn("w", F.coalesce(F.col("c"), F.lit(1)) * F.greatest(F.coalesce(F.col("k"), F.lit(0)), F.lit(1))))
    return rows.groupBy("vendor_name", "month_end").agg(
        F.sum(F.col("a") * F.col("w")).cast("bigint").alias("total_orders_ontime"))


# ---------------------------------------------------------------------------
# K6 best price
# ---------------------------------------------------------------------------

def _best_price_quotes(t: Warehouse, since) -> DataFrame:
    vr = t.research.filter(in_list(F.col("result_code"), ("HP", "EHP"))
                           & (F.col("created_date") >= F.lit(since).cast("date")))
    lid = _non_contract(t).select("line_item_id")
    ven = t.vendors.select(F.col("company_id").alias("vendor_id"), "company_name")
    # costs as exact doubles of integer thousandths: comparisons and equality
    # agree with the decimal values
    ex, out = row_double("exchange_e3", 3), row_double("outright_e3", 3)
    sor = (vr.join(lid, "line_item_id", "inner").join(ven, "vendor_id", "left")
           .withColumn("new_cost", effective_cost(ex, out, 0.01))
           .filter(F.coalesce(out > 0.01, F.lit(False)) | F.coalesce(ex > 0.01, F.lit(False))))
    # minimum per line x condition (equal to the reference's per-month minimum,
    # as every quote of a line meets every month of that line)
    best = sor.groupBy("line_item_id", "condition_code").agg(F.min("new_cost").alias("best_cost"))
    return (sor.join(best, ["line_item_id", "condition_code"], "left")
            .withColumn("is_best", F.coalesce(F.col("new_cost") == F.col("best_cost"), F.lit(False))))


def best_price(t: Warehouse, since, mode: str = "distinct") -> DataFrame:
    """K6: share of quotes at the line's best cost, per vendor name x month."""
    _check(mode)
    sor = _best_price_quotes(t, since)
    q = (t.once("txn").filter(F.col("requests") == 1).select("line_item_id", "transaction_date")
         .join(_months(t), F.col("transaction_date") == F.col("date_key"), "left"))
    if mode == "distinct":
        months = q.select("line_item_id", "month_end").distinct()
        rows = sor.join(months, "line_item_id", "left")
        g = rows.groupBy("company_name", "month_end").agg(
            F.count("condition_code").cast("bigint").alias("total_lines"),
            F.count(F.when(F.col("is_best") & F.col("condition_code").isNotNull(), 1)).cast("bigint").alias("best_cost_ind"))
    else:
        # q rows per (line, month) and distinct months per line
        qm = q.groupBy("line_item_id", "month_end").agg(F.count(F.lit(1)).alias("qlm"))
        d = qm.groupBy("line_item_id").agg(F.count("month_end").alias("d"))
        r = (sor.join(d, "line_item_id", "left")
             .withColumn("mult", F.when(F.col("is_best") & F.col("condition_code").isNotNull(),
                                        F.greatest(F.coalesce(F.col("d"), F.lit(0)), F.lit(1))).otherwise(1)))
        per_r = r.groupBy("line_item_id", "condition_code", "company_name").agg(
            F.sum("mult").alias("sm"),
            F.sum(F.when(F.col("is_best") & F.col("condition_code").isNotNull(), F.col("mult")).otherwise(0)).alias("sb"))
        g0 = per_r.join(qm, "line_item_id", "left").withColumn("qlm", F.coalesce(F.col("qlm"), F.lit(1)))
        rows_g = F.col("qlm") * F.col("sm")
        cnt_g = F.when(F.col("condition_code").isNotNull(), rows_g).otherwise(0)
        g = g0.groupBy("company_name", "month_end").agg(
            F.sum(units(cnt_g) * units(rows_g)).cast("bigint").alias("total_lines"),
            F.sum(F.col("qlm") * F.col("sb")).cast("bigint").alias("best_cost_ind"))
    return g.withColumn("best_cost_rate", ratio(F.col("best_cost_ind"), F.col("total_lines")))


# ---------------------------------------------------------------------------
# K7 scorecard
# ---------------------------------------------------------------------------

def supplier_scorecard(t: Warehouse, start, end, mode: str = "distinct", best_price_since=None) -> DataFrame:
    """K7: the 29-column scorecard (output names as labelled columns).

    On-time counts lines ordered since ``start``; best price counts quotes
    since ``best_price_since`` (a fixed date in the reference).
    """
    met = vendor_metrics(t, start, end, mode)
    ret = vendor_returns(t, start, end, mode)
    res = research_funnel(t, start, end).withColumnRenamed("vendor_id", "company_id").drop("company_name")
    typ = supplier_type(t).select("company_id", "supplier_type")
    ot = on_time(t, start, mode).withColumnRenamed("vendor_name", "company_name")
    bp = best_price(t, best_price_since or start, mode).select("company_name", "month_end", "best_cost_ind")
    j = (met.join(ret, ["company_id", "month_end"], "left")
         .join(res, ["company_id", "month_end"], "left")
         .join(typ, "company_id", "left")
         .join(ot, ["company_name", "month_end"], "left")
         .join(bp, ["company_name", "month_end"], "left"))
    return j.select(
        F.col("company_id").alias("Supplier Id"),
        F.col("company_name").alias("Supplier Name"),
        F.col("relationship_manager_id").alias("Relationship Manager Id"),
        F.col("relationship_manager").alias("Relationship Manager"),
        F.col("month_end").alias("Month End"),
        F.col("company_type_code").alias("Supplier Type"),
        F.col("supplier_type").alias("Supplier Specialty"),
        F.col("research_lines").alias("Opportunities"),
        F.col("has_part_research_line").alias("Quotes Provided"),
        F.col("best_cost_ind").alias("Best Price"),
        F.col("ss_research_line").alias("Auto Quote"),
        F.col("photo_requests").alias("Photo Shown"),
        F.col("total_orders").alias("Total Orders"),
        F.col("auto_label").alias("Shipping Labels Used"),
        F.col("tracking_provided").alias("Tracking Provided"),
        F.col("smart_po").alias("Automated Order"),
        F.col("total_orders_ontime").alias("Orders Delivered on Time"),
        F.col("back_order").alias("Backorders"),
        F.col("total_returns").alias("Total Returns"),
        F.col("customer_returns").alias("Customer Fault"),
        F.col("shipping_returns").alias("Shipping Courier Fault"),
        F.col("process_rtns").alias("Return - Process Related Issue"),
        F.col("quality_returns").alias("Return - Quality Related Issue"),
        F.col("sold_on_exchange").alias("Total Exchanges"),
        F.col("oem_list").alias("Total OEM List"),
        F.col("parts_cost").alias("Total Cost"),
        F.col("total_rtn_rev").alias("Total RTN Rev"),
        F.col("vendor_returns_rev").alias("Vendor Coded RTN rev"),
        F.col("quality_returns_rev").alias("Quality RTN rev"),
    )
