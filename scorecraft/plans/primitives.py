"""One runnable query per generic operator of the survey (sections 2.A-2.J).

Each query applies the operator to role tables over the whole data, so its
work grows with the data; the reports (2.K) compose the same operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.functions import codes, display, scalar
from scorecraft.functions.semantics import chop_last, exists_flag, in_list, ratio, sas_le, stable
from scorecraft.operators import aggregates as agg
from scorecraft.operators import filters as flt
from scorecraft.operators import joins as jn
from scorecraft.operators import project as prj
from scorecraft.operators import windows as win
from scorecraft.plans import catalogue, compliance, dashboard, line_items, scorecard
from scorecraft.plans import params as P
from scorecraft.sources import tables
from scorecraft.sources.roles import ROLE_BUILDERS, Warehouse

# ---------------------------------------------------------------------------
# 2.A sources and sinks
# ---------------------------------------------------------------------------

def a1_named_scan(t: Warehouse) -> DataFrame:
    """A1: every bound role table scanned by name; row count per role."""
    parts = [t.once(r).select(F.lit(r).alias("role")).groupBy("role").agg(F.count(F.lit(1)).alias("row_count"))
             for r in ROLE_BUILDERS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def a2_source_query(t: Warehouse) -> DataFrame:
    """A2: a whole SELECT run at the source (taxonomy parent codes)."""
    return catalogue.parent_child(t, 2)


def a4_full_refresh(t: Warehouse) -> DataFrame:
    """A4: fill a table in the shared checkpoint folder anew (an own folder for each call), then read it back."""
    path = tables.own_path(t.spark, "vendor_compliance")
    tables.full_refresh(compliance.vendor_compliance(t, P.PERIOD_START, P.PERIOD_END), path)
    return tables.current(t.spark, path)


def a5_report(t: Warehouse) -> DataFrame:
    """Output selection, order and labels with spaces."""
    df = compliance.backorder_vendor_summary(t, P.PERIOD_START, P.PERIOD_END)
    return tables.report(df, ["vendor_id", "vendor_name", "backorders", "requests", "backorder_percent"],
                         {"vendor_id": "Vendor ID", "vendor_name": "Vendor Name", "backorders": "Backorders",
                          "requests": "Requests", "backorder_percent": "Backorder Percent"})


def a7_split_by(t: Warehouse) -> DataFrame:
    """One output per category (both product types), written by one job and read back one by one."""
    df = dashboard.daily_by_category(t, P.ASOF)
    kinds = ["Biomed", "Imaging"]
    path = tables.write_split(df.filter(F.col("product_type").isin(kinds)), "product_type", tables.own_path(t.spark, "category_days"))
    parts = [t.spark.read.parquet(f"{path}/product_type={k}").withColumn("product_type", F.lit(k)).select(*df.columns) for k in kinds]
    return parts[0].unionByName(parts[1])


# ---------------------------------------------------------------------------
# 2.B projections, filters, predicates
# ---------------------------------------------------------------------------

def b1_derive(t: Warehouse) -> DataFrame:
    """B1: computed projection between measures (cost and list value per fact row)."""
    q = t.txn
    return q.select("line_item_id", "vendor_id", "item_id",
                    (F.col("revenue") - F.col("margin")).cast("double").alias("parts_cost"),
                    (F.col("oem_price") * F.col("quantity")).cast("double").alias("oem_list"))


def b2_keep(t: Warehouse) -> DataFrame:
    """B2: keep two calendar columns (the calendar_convert step)."""
    return prj.keep(t.calendar, ["date_key", "workday_ind"])


def b3_derive_star(t: Warehouse) -> DataFrame:
    """All vendor columns plus a derived terms flag."""
    return prj.derive(t.vendors, terms=F.when(flt.has_text("payment_term_code", "NET"), "Y").otherwise("N"))


def b4_in_period(t: Warehouse) -> DataFrame:
    """Inclusive date range, counted per vendor."""
    return t.during("txn", P.PERIOD_START, P.PERIOD_END).groupBy("vendor_id").agg(
        F.count(F.lit(1)).alias("rows_in_period"))


def b5_since(t: Warehouse) -> DataFrame:
    """Open-ended date filter on first-ordered time, counted per order month."""
    ls = flt.since(t.line_status, "first_ordered_timestamp", P.PERIOD_START)
    return ls.groupBy(scalar.month_end(scalar.to_day(F.col("first_ordered_timestamp"))).alias("month_end")).agg(
        F.count(F.lit(1)).alias("lines"))


def b6_not_in(t: Warehouse) -> DataFrame:
    """NOT IN keeps missing parents (facts of unknown customers stay)."""
    q = t.txn.join(t.customers.select(F.col("company_id").alias("customer_id"), "lvl1_company_id"),
                   "customer_id", "left")
    kept = flt.keep_not_in(q, "lvl1_company_id", [3, 5])
    return kept.groupBy("product_category_id").agg(F.count(F.lit(1)).alias("rows"),
                                                   F.sum("revenue").cast("double").alias("revenue"))


def b7_ne(t: Warehouse) -> DataFrame:
    """Not-equal keeps missing sub-segments."""
    d = flt.keep_ne(t.daily_actuals, "sub_segment", "ARAMARK")
    return d.groupBy("segment", "sub_segment").agg(F.count(F.lit(1)).alias("rows"),
                                                   F.sum("actual_revenue").cast("double").alias("revenue"))


def b8_missing_lowest(t: Warehouse) -> DataFrame:
    """Exchange cost <= 0.01 counts missing costs as lowest."""
    r = t.research
    return r.groupBy(sas_le(F.col("exchange_cost"), F.lit(0.01)).alias("exchange_at_floor"),
                     sas_le(F.col("outright_cost"), F.lit(0.01)).alias("outright_at_floor")).agg(
        F.count(F.lit(1)).alias("quotes"))


def b9_present(t: Warehouse) -> DataFrame:
    """Present / missing delivery dates per leg."""
    trk = t.tracking
    return trk.groupBy("shipment_leg_id").agg(
        F.count(F.when(F.col("date_delivered").isNotNull(), 1)).alias("delivered"),
        F.count(F.when(F.col("date_delivered").isNull(), 1)).alias("not_delivered"))


def b10_large_only(t: Warehouse) -> DataFrame:
    """Lines whose revenue is at least 100,000 either way."""
    g = t.txn.groupBy("line_item_id").agg(F.sum("revenue").cast("double").alias("ext_price"))
    return flt.large_only(g, "ext_price", P.LARGE_THRESHOLD)


def b11_active_only(t: Warehouse) -> DataFrame:
    """Chain of flag filters (active contacts of vendors), counted per company."""
    c = flt.active_only(t.contacts, {"active": "Y", "cc_active": "Y", "vendor_ind": "Y"})
    return c.groupBy("company_id").agg(F.count(F.lit(1)).alias("contacts"))


def b12_by_filter(t: Warehouse) -> DataFrame:
    """The catalogue switch, filtering by structure: the structures of one group, taken from the data."""
    df = catalogue._pim_items(t)
    ids = t.product_structure.filter(F.col("parent_name") == "Group 2").select("structure_id")
    return flt.by_filter(df, "structure", ids, catalogue.FILTER_COLUMNS).select(
        "search_item_number", "ps_structure_id", "vendor_id", "oem_id", "taxonomy_id")


def b13_has_text(t: Warehouse) -> DataFrame:
    """Payment terms containing NET (missing terms -> no)."""
    return t.vendors.select("company_id", flt.has_text("payment_term_code", "NET").alias("net_terms"))


def b14_having(t: Warehouse) -> DataFrame:
    """HAVING on an aggregate alias (vendors with backorders)."""
    return compliance.backorder_vendor_summary(t, P.PERIOD_START, P.PERIOD_END)


def b15_distinct(t: Warehouse) -> DataFrame:
    """Distinct price rules that name a product-segment part."""
    from scorecraft.plans.targeting import pricing_rule_list

    return pricing_rule_list(t)


def b16_distinct_wide(t: Warehouse) -> DataFrame:
    """DISTINCT over the wide joined row of the line-item load (97 columns)."""
    return line_items.line_item_details(t, P.PERIOD_START)


def b17_tag(t: Warehouse) -> DataFrame:
    """Literal marker column (vendors with catalogue items, coun = 1)."""
    return compliance._vend_im(t)


def b18_scalar(t: Warehouse) -> DataFrame:
    """Values computed by a query and kept in the plan (workdays, week start), on the as-of day's row."""
    sc = dashboard.scalars(t, P.ASOF)
    return t.calendar.filter(F.col("date_key") == F.lit(P.ASOF)).select(
        sc["month_workdays"].alias("month_workdays"), sc["week_workdays"].alias("week_workdays"),
        sc["wk_start"].alias("wk_start"))


def b19_classify(t: Warehouse) -> DataFrame:
    """Status x research type -> sourcing flags, counted."""
    df = line_items.line_item_details(t, P.PERIOD_START)
    return df.groupBy("smart_price_selected", "smart_sourced", "smart_sourcing_alternative", "manual_research").agg(
        F.count(F.lit(1)).alias("lines"))


def b20_map_codes(t: Warehouse) -> DataFrame:
    """Code -> label CASE (return responsibility)."""
    r = t.returns
    return r.groupBy(codes.map_codes(F.col("responsibility"), scorecard.RESPONSIBILITY, "other").alias("label")).agg(
        F.count(F.lit(1)).alias("returns"))


def b21_transit_days(t: Warehouse) -> DataFrame:
    """Shipping method id -> allowed transit days, lines per allowance."""
    s = t.shipping_info.join(jn.bounded(t.ship_methods), "shipping_method", "left")
    return s.groupBy(codes.transit_days(F.col("shipping_method_id")).alias("transit_days")).agg(
        F.count(F.lit(1)).alias("lines"))


def b22_band(t: Warehouse) -> DataFrame:
    """Supplier speciality bands, vendors per band."""
    return scorecard.supplier_type(t).groupBy("supplier_type").agg(F.count(F.lit(1)).alias("vendors"))


def b23_exists_flag(t: Warehouse) -> DataFrame:
    """Existence flag from an outer join (lines with a leg-2 tracking row)."""
    leg2 = t.tracking.filter(F.col("shipment_leg_id") == 2).select(F.col("line_item_id").alias("l2"))
    j = t.line_detail.select("line_item_id").join(leg2, F.col("line_item_id") == F.col("l2"), "left")
    return j.groupBy(exists_flag(F.col("l2")).alias("has_leg2")).agg(F.count(F.lit(1)).alias("lines"))


def b24_first_present(t: Warehouse) -> DataFrame:
    """First non-missing part number per line."""
    return t.line_detail.select("line_item_id", scalar.first_present(
        "replacement_part_number_stripped", "requested_part_number_stripped").alias("clean_part"))


def b25_effective_cost(t: Warehouse) -> DataFrame:
    """Lowest valid of exchange / outright cost per quote (quotes with a valid cost)."""
    r = t.research.filter(F.coalesce(F.col("outright_cost") > 0.01, F.lit(False))
                          | F.coalesce(F.col("exchange_cost") > 0.01, F.lit(False)))
    return r.select("line_item_id", "vendor_id", "item_id",
                    codes.effective_cost(F.col("exchange_cost"), F.col("outright_cost"), 0.01)
                    .cast("double").alias("new_cost"))


def b26_txn_type(t: Warehouse) -> DataFrame:
    """Transaction type from order / return sums, lines per type."""
    g = t.txn.groupBy("line_item_id", "transaction_date").agg(F.sum("orders").alias("orders"),
                                                              F.sum("returns").alias("returns"))
    return g.groupBy(codes.txn_type(F.col("orders"), F.col("returns")).alias("type")).agg(
        F.count(F.lit(1)).alias("lines"))


def b27_segment(t: Warehouse) -> DataFrame:
    """Segment normalisation (trim + upper of two columns -> label, sort)."""
    label, sort = codes.segment_label(F.col("segment"), F.col("sub_segment"))
    return t.customers.groupBy(label.alias("segment"), sort.alias("segment_sort")).agg(
        F.count(F.lit(1)).alias("customers"))


# ---------------------------------------------------------------------------
# 2.C joins
# ---------------------------------------------------------------------------

def c1_inner(t: Warehouse) -> DataFrame:
    """Inner equi-join (returns x line details), returns per vendor."""
    j = jn.inner(t.returns.select("line_item_id", "rga_number"), t.line_detail.select("line_item_id", "vendor_id"),
                 "line_item_id")
    return j.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("returns"))


def c2_left(t: Warehouse) -> DataFrame:
    """Left join keeps vendors without research (count 0)."""
    r = t.research.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("quotes"))
    v = t.vendors.select(F.col("company_id").alias("vendor_id"), "company_name")
    return jn.left(v, r, "vendor_id").select("vendor_id", "company_name",
                                             F.coalesce("quotes", F.lit(0).cast("bigint")).alias("quotes"))


def c3_star(t: Warehouse) -> DataFrame:
    """Fact + dimensions (vendors, customers, OEMs, modalities, classes, categories)."""
    q = t.txn
    dims = [
        (t.vendors.select(F.col("company_id").alias("vendor_id"), "company_type_code"), "vendor_id", "left"),
        (t.customers.select(F.col("company_id").alias("customer_id"), "lvl1_company_name"), "customer_id", "left"),
        (t.oems.select(F.col("company_id").alias("oem_id"), F.col("company_name").alias("oem_name")), "oem_id", "left"),
        (jn.bounded(t.modalities), "modality_id", "left"),
        (t.product_classes, "class_id", "left"),
        (jn.bounded(t.product_categories), "product_category_id", "inner"),
    ]
    j = jn.star(q, dims)
    return j.groupBy("company_type_code", "product_category_description", "modality_code").agg(
        F.sum("orders").cast("bigint").alias("orders"), F.sum("revenue").cast("double").alias("revenue"))


def c4_wide_star(t: Warehouse) -> DataFrame:
    """C4: the wide line-item star (K24), lines per condition and warranty."""
    df = line_items.line_item_details(t, P.PERIOD_START)
    return df.groupBy("condition_code", "warranty_description", "urgency_code").agg(F.count(F.lit(1)).alias("lines"))


def c5_full_merge(t: Warehouse) -> DataFrame:
    """Full outer join of the order and research sides with one coalesced key."""
    v = compliance._vend_orders(t, P.PERIOD_START, P.PERIOD_END).select("vendor_id", F.lit(1).alias("has_orders"))
    r = compliance._vend_research(t, P.PERIOD_START, P.PERIOD_END).select("vendor_id", F.lit(1).alias("has_research"))
    return jn.full_merge(v, r, "vendor_id")


def c6_left_where(t: Warehouse) -> DataFrame:
    """Outer join with a filter inside ON (leg-1 tracking), tracked orders per vendor."""
    j = jn.left_where(t.txn.select("line_item_id", "vendor_id", "orders"), t.tracking, "line_item_id",
                      F.col("shipment_leg_id") == 1)
    return j.groupBy("vendor_id").agg(
        F.sum(F.when(F.col("tracking_number").isNotNull(), F.col("orders")).otherwise(0)).cast("bigint")
        .alias("tracking_provided"))


def c7_join_on_expr(t: Warehouse) -> DataFrame:
    """Join on a computed key (date part of the return timestamp)."""
    j = jn.join_on_expr(t.returns, jn.bounded(t.calendar.select("date_key", "month_end")),
                        scalar.to_day(F.col("created_timestamp")), F.col("date_key"), "left")
    return j.groupBy("month_end").agg(F.count(F.lit(1)).alias("returns"))


def c8_self_match(t: Warehouse) -> DataFrame:
    """Fact self-join on vendor + line, counted without emitting pairs (sum of m^2)."""
    m = t.txn.groupBy("vendor_id", "line_item_id").agg(F.count(F.lit(1)).alias("m"))
    return m.groupBy("vendor_id").agg(F.sum(F.col("m") * F.col("m")).cast("bigint").alias("pairs"))


def c9_role_join(t: Warehouse) -> DataFrame:
    """Calendar joined three times (closed, ordered, delivered) per line."""
    ls = t.line_status.select("line_item_id", scalar.to_day(F.col("first_closed_timestamp")).alias("closed"),
                              scalar.to_day(F.col("first_ordered_timestamp")).alias("ordered"))
    trk = t.tracking.filter(F.col("shipment_leg_id") == 1).select(
        "line_item_id", scalar.to_day(F.col("date_delivered")).alias("delivered"))
    df = ls.join(trk, "line_item_id", "left")
    cal = jn.bounded(t.calendar)
    out = jn.role_join(df, cal, {"clo": "closed", "ord": "ordered", "del": "delivered"}, "date_key", ["workday_ind"])
    return out.select("line_item_id", F.col("clo_workday_ind").alias("closed_workday"),
                      F.col("ord_workday_ind").alias("ordered_workday"),
                      F.col("del_workday_ind").alias("delivered_workday"))


def c10_with_parent(t: Warehouse) -> DataFrame:
    """Product -> taxonomy code -> parent code and parent name."""
    tax = catalogue.taxonomy(t)
    p = t.oem_structure_products.filter(F.col("oem_id") == 2)
    return p.join(tax, "structure_id", "left").select("product_number", "structure_id", "parent_structure_id",
                                                      "parent_name")


def c11_workdays_between(t: Warehouse) -> DataFrame:
    """C11: business days from close to delivery per on-time line (prefix sums, no range join)."""
    b = scorecard.on_time_lines(t, P.PERIOD_START)
    return b.select("line_item_id", "vendor_id", "ctime", "delivered", "clo_del_days")


def c12_slots(t: Warehouse) -> DataFrame:
    """Five priority settings per company as slot columns (one pivot, one join)."""
    keys = t.auto_order.select("vendor_id").distinct()
    return jn.slots(keys, t.auto_order, key="vendor_id", rank="ship_priority_id", value="settings", k=5,
                    prefix="priority_")


def c13_keep_extreme(t: Warehouse) -> DataFrame:
    """Latest confirmation per line, ties kept."""
    return line_items.latest_confirmation(t)


def c14_only_in(t: Warehouse) -> DataFrame:
    """C14: semi-join to a filtered summary (only vendors with backorders)."""
    b = compliance.backorder_base(t, P.PERIOD_START, P.PERIOD_END)
    vs = compliance.backorder_vendor_summary(t, P.PERIOD_START, P.PERIOD_END).select("vendor_id")
    return jn.only_in(b, vs, ["vendor_id"]).groupBy("vendor_id").agg(F.count(F.lit(1)).alias("rows"))


def c15_prior_year(t: Warehouse) -> DataFrame:
    """Monthly revenue next to the same month one year earlier."""
    m = t.txn.groupBy(F.year("transaction_date").alias("year"), F.month("transaction_date").alias("month")).agg(
        F.sum("revenue").alias("revenue"))
    prior = m.withColumnRenamed("revenue", "py_revenue")
    out = jn.join_prior_year(m, prior, "year", ["month"], "left")
    return out.select("year", "month", F.col("revenue").cast("double").alias("revenue"),
                      F.col("py_revenue").cast("double").alias("py_revenue"))


def c16_lookup_agg(t: Warehouse) -> DataFrame:
    """Four calendar look-ups per month end (aggregate + left join, no correlated subquery)."""
    cal = t.calendar
    months = cal.select("month_end").distinct()
    at = cal.select(F.col("date_key").alias("month_end"), F.col("workday_nbr_mtd").alias("workdays"),
                    F.col("workday_nbr_ytd").alias("workdays_ytd"))
    per_month = cal.groupBy("year", "month").agg(F.max("workday_nbr_mtd").alias("w"))
    cy = per_month.withColumnRenamed("w", "workdays_cy_mtd")
    py = per_month.withColumn("year", F.col("year") + 1).withColumnRenamed("w", "workdays_py_mtd")
    out = (months.join(at, "month_end", "left")
           .withColumn("year", F.year("month_end")).withColumn("month", F.month("month_end"))
           .join(cy, ["year", "month"], "left").join(py, ["year", "month"], "left"))
    return out.select("month_end", "workdays", "workdays_ytd", "workdays_py_mtd", "workdays_cy_mtd")


def c17_filter_before_join(t: Warehouse) -> DataFrame:
    """C17: derived table filtered inside (research in period) before its joins."""
    return compliance._vend_research(t, P.PERIOD_START, P.PERIOD_END)


def c18_join_ns(t: Warehouse) -> DataFrame:
    """Missing-matches-missing join of backorder rows to per-part descriptions."""
    b = compliance.backorder_base(t, P.PERIOD_START, P.PERIOD_END)
    d = win.first_per_key(b.select("vendor_id", "clean_part", "ordered_date", "line_item_id", "description"),
                          ["vendor_id", "clean_part"], ["ordered_date", "line_item_id", "description"]) \
        .select("vendor_id", "clean_part", F.col("description").alias("best_description"))
    j = jn.join_ns(b.select("vendor_id", "clean_part", "requests"), d, ["vendor_id", "clean_part"], "left")
    return j.groupBy("best_description").agg(F.sum("requests").cast("bigint").alias("requests"))


# ---------------------------------------------------------------------------
# 2.D aggregations
# ---------------------------------------------------------------------------

def _monthly(t: Warehouse) -> DataFrame:
    return t.txn.withColumn("month_end", F.last_day("transaction_date"))


def d1_sum_by(t: Warehouse) -> DataFrame:
    """Grouped sums of several measures (vendor x month)."""
    return agg.sum_by(_monthly(t), ["vendor_id", "month_end"], {
        "requests": F.sum("requests").cast("bigint"), "orders": F.sum("orders").cast("bigint"),
        "quantity": F.sum("quantity").cast("bigint"), "revenue": agg.dsum("revenue"), "margin": agg.dsum("margin")})


def d2_sum_if(t: Warehouse) -> DataFrame:
    """Conditional sums (smart orders) per vendor."""
    j = t.once("txn").join(t.once("line_detail").select("line_item_id", "smart_order_conf", "smart_order_po"), "line_item_id")
    return j.groupBy("vendor_id").agg(
        agg.sum_if(F.col("smart_order_conf") == 1, "orders").cast("bigint").alias("smart_conf_total"),
        agg.sum_if(F.col("smart_order_po") == 1, "orders").cast("bigint").alias("smart_po_total"),
        agg.sum_when(F.col("product_category_id") == 2, "orders").cast("bigint").alias("biomed_orders"))


def d3_weighted_sum(t: Warehouse) -> DataFrame:
    """D3: flag-weighted sums (sum(flag * requests)) per vendor."""
    j = t.once("txn").join(t.once("line_detail").select("line_item_id", "smart_price_selected", "smart_sourced", "photo_shown"),
                           "line_item_id")
    return j.groupBy("vendor_id").agg(
        agg.weighted_sum("smart_price_selected", "requests").cast("bigint").alias("smart_priced_requests"),
        agg.weighted_sum("smart_sourced", "requests").cast("bigint").alias("smart_sourced_requests"),
        agg.weighted_sum("photo_shown", "requests").cast("bigint").alias("photo_requests"))


def d4_count_if(t: Warehouse) -> DataFrame:
    """Conditional count of non-missing values per vendor."""
    r = t.research
    return r.groupBy("vendor_id").agg(
        agg.count_if(in_list(F.col("result_code"), ("HP", "EHP")), "line_item_id").alias("has_part"),
        agg.count_if(F.col("outright_cost").isNotNull(), "outright_cost").alias("priced"))


def d5_distinct_count(t: Warehouse) -> DataFrame:
    """Four exact distinct counts per vendor."""
    return compliance._vend_map(t)


def d6_row_count(t: Warehouse) -> DataFrame:
    """Row count per item (photos)."""
    return t.pim_images.groupBy("item_number").agg(agg.row_count().alias("photos"))


def d7_extremes(t: Warehouse) -> DataFrame:
    """First and last transaction date per vendor."""
    return t.txn.groupBy("vendor_id").agg(F.min("transaction_date").alias("first_date"),
                                          F.max("transaction_date").alias("last_date"))


def d8_any_flag(t: Warehouse) -> DataFrame:
    """Min / max type and any-flags per line."""
    return line_items.research_ids(t)


def d9_sum_over_mean(t: Warehouse) -> DataFrame:
    """Monthly revenue divided by the mean selling-day count of its rows."""
    cal = jn.bounded(t.calendar.select("date_key", "month_end", "workday_nbr_mtd"))
    j = t.txn.join(cal, t.txn.transaction_date == cal.date_key, "inner")
    return j.groupBy("month_end").agg(
        F.try_divide(F.sum("revenue").cast("double"), F.avg(F.col("workday_nbr_mtd").cast("double")))
        .alias("revenue_per_mean_workday"))


def d10_ratio(t: Warehouse) -> DataFrame:
    """Margin % as a ratio of sums per vendor (missing on zero revenue)."""
    return t.txn.groupBy("vendor_id").agg(agg.ratio_of_sums(F.sum("margin"), F.sum("revenue")).alias("margin_pct"))


def d11_flag_share(t: Warehouse) -> DataFrame:
    """Share of Y among non-missing flags, per vendor tier."""
    return t.vendors.groupBy("tier_code").agg(agg.flag_share("smart_order_enabled").alias("smart_order_share"),
                                              agg.flag_share("payment_term_code", "NET30").alias("net30_share"))


def d12_wavg(t: Warehouse) -> DataFrame:
    """Order-weighted label share per vendor type (over the compliance table)."""
    df = compliance.vendor_compliance(t, P.PERIOD_START, P.PERIOD_END)
    return df.groupBy("vendor_type").agg(stable(agg.wavg("smart_label_pct", "orders"), 12).alias("smart_label_pct"))


def d13_grand_total(t: Warehouse) -> DataFrame:
    """One-row grand total of the fact."""
    return agg.grand_total(t.txn, {"requests": F.sum("requests").cast("bigint"),
                                   "orders": F.sum("orders").cast("bigint"),
                                   "revenue": agg.dsum("revenue"), "margin": agg.dsum("margin"),
                                   "margin_pct": ratio(F.sum("margin"), F.sum("revenue"))})


def d14_with_total(t: Warehouse) -> DataFrame:
    """Segment sums plus an 'Estimated Total' row sorted 99 (one rollup)."""
    label, sort = codes.segment_label(F.col("segment"), F.col("sub_segment"))
    d = t.daily_actuals.select(label.alias("segment"), sort.alias("segment_sort"), "actual_revenue", "budget_revenue")
    out = agg.with_total(d, ["segment", "segment_sort"],
                         {"actual_revenue": F.sum("actual_revenue"), "budget_revenue": F.sum("budget_revenue")},
                         "segment", "Estimated Total", "segment_sort", 99)
    return out.select("segment", "segment_sort", F.col("actual_revenue").cast("double").alias("actual_revenue"),
                      F.col("budget_revenue").cast("double").alias("budget_revenue"))


def d15_metric_grid(t: Warehouse) -> DataFrame:
    """Overlapping segments (Total, Biomed, Imaging) x metrics over all days, one scan."""
    d = t.daily_actuals
    seg = F.explode(F.array(F.lit("Total"), F.when(in_list(F.col("product_category_description"),
                                                           ("Biomed", "Stryker")), "Biomed").otherwise("Imaging")))
    g = d.select("*", seg.alias("customer_segment")).groupBy("customer_segment").agg(
        *[F.sum(c).cast("double").alias(c) for c in ("actual_revenue", "budget_revenue", "actual_margin",
                                                     "budget_margin")])
    c = F.col
    wide = g.select(
        "customer_segment",
        c("actual_revenue").alias("r_a"), c("budget_revenue").alias("r_b"),
        F.try_divide(c("actual_revenue") - c("budget_revenue"), c("budget_revenue")).alias("r_p"),
        c("actual_margin").alias("m_a"), c("budget_margin").alias("m_b"),
        F.try_divide(c("actual_margin") - c("budget_margin"), c("budget_margin")).alias("m_p"),
        F.try_divide(c("actual_margin"), c("actual_revenue")).alias("g_a"),
        F.try_divide(c("budget_margin"), c("budget_revenue")).alias("g_b"),
        F.lit(None).cast("double").alias("g_p"))
    return wide.select("customer_segment", F.expr(
        "stack(3, 'Revenue', r_a, r_b, r_p, 'Margin', m_a, m_b, m_p, 'GM %', g_a, g_b, g_p) "
        "AS (metric, actual, budget, var_pct)"))


def d16_best_day(t: Warehouse) -> DataFrame:
    """Daily sums re-aggregated to months with the best (max) day, whole history."""
    daily = t.txn.groupBy(F.last_day("transaction_date").alias("month_end"), "transaction_date").agg(
        F.sum("orders").alias("orders"), F.sum("margin").alias("margin"))
    out = agg.best_day(daily, ["month_end"], ["orders", "margin"])
    return out.select("month_end", F.col("orders").cast("bigint").alias("orders"),
                      F.col("best_orders").cast("bigint").alias("best_orders"),
                      F.col("margin").cast("double").alias("margin"),
                      F.col("best_margin").cast("double").alias("best_margin"))


def d17_period_to_date(t: Warehouse) -> DataFrame:
    """Current / prior year, month / year to date, in one pass (as of the report date)."""
    bfa = dashboard.budget_forecast_actual(t, P.ASOF)
    return bfa.select("segment", "product_category_description",
                      *[F.col(c).cast("double").alias(c) for c in bfa.columns if c.startswith(("cy_", "py_"))])


def d18_per_workday(t: Warehouse) -> DataFrame:
    """Month revenue per workday of the month."""
    cal = t.calendar.groupBy("month_end").agg(F.sum("workday_ind").alias("workdays"))
    m = t.txn.groupBy(F.last_day("transaction_date").alias("month_end")).agg(F.sum("revenue").alias("revenue"))
    j = m.join(jn.bounded(cal), "month_end", "left")
    return j.select("month_end", "workdays", ratio(F.col("revenue"), F.col("workdays")).alias("revenue_per_workday"))


def d19_remerge(t: Warehouse) -> DataFrame:
    """Remerge - every return row keeps its group count and group revenue (one window)."""
    r = t.returns.filter(F.col("rga_type_id").isin(2, 4) & (F.col("active") == "Y"))
    q = t.txn.filter(F.col("orders") == 1).select(F.col("line_item_id").alias("q_line"), "vendor_id", "price")
    rows = r.join(q, r.line_item_id == q.q_line, "left").select(
        "vendor_id", "line_item_id", "rga_number", (F.col("quantity") * F.col("price")).alias("rev"))
    out = agg.remerge(rows, ["vendor_id", "line_item_id", "rga_number"],
                      {"rtn_count": F.count("line_item_id"), "group_rev": F.sum("rev")})
    return out.select("vendor_id", "line_item_id", "rga_number", F.col("rev").cast("double").alias("rev"),
                      "rtn_count", F.col("group_rev").cast("double").alias("group_rev"))


def d20_group_by_exprs(t: Warehouse) -> DataFrame:
    """Grouping by computed expressions (year, quarter, category label)."""
    cat = F.when(F.col("product_category_id") == 2, "Biomed").otherwise("Imaging")
    return agg.sum_by(t.txn, [F.year("transaction_date").alias("year"), F.quarter("transaction_date").alias("quarter"),
                              cat.alias("product_type")],
                      {"orders": F.sum("orders").cast("bigint"), "revenue": agg.dsum("revenue")})


# ---------------------------------------------------------------------------
# 2.E windows, 2.F sorts, 2.G set operations
# ---------------------------------------------------------------------------

def e1_first_per_key(t: Warehouse) -> DataFrame:
    """First receipt per line (date, then contact id)."""
    return win.first_per_key(t.received_parts, ["line_item_id"], ["date_received", "received_by_contact_id"])


def e2_rank_in_group(t: Warehouse) -> DataFrame:
    """Running counter within a sorted by-group (model rank per vendor item)."""
    vitems = t.items.filter(F.col("item_type") == "V").select("item_number", "product_number")
    ranked = win.rank_in_lists(vitems, t.once("pim_models"), "product_number", ["item_number"], ["model_code"], "rank")
    return ranked.select("item_number", "model_code", "product_number", "rank")


def e3_first_of_group(t: Warehouse) -> DataFrame:
    """First row of each vendor x part by order date (best description)."""
    b = compliance.backorder_base(t, P.PERIOD_START, P.PERIOD_END)
    return win.first_per_key(b.select("vendor_id", "clean_part", "ordered_date", "line_item_id", "description"),
                             ["vendor_id", "clean_part"], ["ordered_date", "line_item_id", "description"]) \
        .select("vendor_id", "clean_part", "description")


def e4_latest_ties(t: Warehouse) -> DataFrame:
    """Latest return per line, ties kept."""
    return jn.keep_extreme(t.returns.select("line_item_id", "rga_number", "created_timestamp"),
                           ["line_item_id"], "created_timestamp", "max")


def e5_top_slots(t: Warehouse) -> DataFrame:
    """E5: first ten references per item as columns plus a 'more exist' flag."""
    refs = t.pim_searches.select("search_item_number", "part_number").distinct()
    out = win.top_slots(refs, "search_item_number", "part_number", ["part_number"], 10, "reference_", "more")
    return out.withColumn("more_references", F.when(F.col("more") == 1, "Y").otherwise("N")).drop("more")


def e6_workday_numbers(t: Warehouse) -> DataFrame:
    """Workday number month-to-date and year-to-date (running sums)."""
    return win.workday_numbers(t.calendar).select("date_key", "workday_nbr_mtd", "workday_nbr_ytd")


def f1_sort_by(t: Warehouse) -> DataFrame:
    """multi-key output sort (backorder rows by vendor, part, order date)."""
    b = compliance.backorder_base(t, P.PERIOD_START, P.PERIOD_END)
    return b.select("vendor_id", "clean_part", "ordered_date", "line_item_id").orderBy(
        F.col("vendor_id").asc_nulls_first(), "clean_part", "ordered_date", "line_item_id")


def f2_sort_desc(t: Warehouse) -> DataFrame:
    """sort by an aggregate alias descending, missing last."""
    df = compliance.vendor_compliance(t, P.PERIOD_START, P.PERIOD_END)
    return df.select("vendor_id", "vendor", "spend").orderBy(F.col("spend").desc_nulls_last(), "vendor_id")


def f3_sort_before_by(t: Warehouse) -> DataFrame:
    """sort ahead of by-group processing, folded into the window order (reference ranks)."""
    refs = t.pim_searches.groupBy("search_item_number", "part_number").agg(F.count(F.lit(1)).alias("uses"))
    return win.rank_in_group(refs, ["search_item_number"], ["part_number"], "rank")


def f4_display_order(t: Warehouse) -> DataFrame:
    """display order by the segment sort key (total = 99 last)."""
    return dashboard.daily_budget(t, P.ASOF).select("segment", "segment_sort", "actual_revenue_year") \
        .orderBy("segment_sort", "segment")


def g1_stack_rows(t: Warehouse) -> DataFrame:
    """G1: UNION ALL of differently sourced aggregates (warehouse actuals + spread supplement)."""
    a = t.daily_actuals.groupBy(F.year("transaction_date").alias("year")).agg(
        F.sum("budget_revenue").cast("double").alias("budget_revenue")).select(
        F.lit("actuals").alias("source"), "year", "budget_revenue")
    cal = jn.bounded(t.calendar.select("month_end", "date_key", "workday_ind"))
    s = (cal.join(t.budget_supplement, "month_end", "inner")
         .select(F.year("date_key").alias("year"),
                 (F.col("budget_revenue").cast("double") / F.col("days") * F.col("workday_ind")).alias("b"))
         .groupBy("year").agg(stable(F.sum("b")).alias("budget_revenue"))
         .select(F.lit("supplement").alias("source"), "year", "budget_revenue"))
    return a.unionByName(s)


def g2_detail_and_total(t: Warehouse) -> DataFrame:
    """Detail groups stacked with their total row."""
    d = t.txn.groupBy("product_category_id").agg(F.sum("revenue").alias("revenue"))
    total = t.txn.agg(F.sum("revenue").alias("revenue")).withColumn("product_category_id", F.lit(99))
    u = d.unionByName(total)
    return u.select("product_category_id", F.col("revenue").cast("double").alias("revenue"))


def g3_metric_rows(t: Warehouse) -> DataFrame:
    """The twelve metric rows of the summary grid from one scan."""
    return dashboard.summary_statistics(t, P.ASOF)


# ---------------------------------------------------------------------------
# 2.H scalar functions
# ---------------------------------------------------------------------------

def h1_to_day(t: Warehouse) -> DataFrame:
    """H1: datetime -> date (closed date per line)."""
    return t.line_status.select("line_item_id", scalar.to_day("first_closed_timestamp").alias("closed_date"))


def h2_seconds_of_day(t: Warehouse) -> DataFrame:
    """H2: time of day in seconds (closed time per line)."""
    return t.line_status.select("line_item_id", scalar.seconds_of_day("first_closed_timestamp").alias("closed_seconds"))


def h3_year_month(t: Warehouse) -> DataFrame:
    """H3: year() and month() of the fact date, rows per year x month."""
    return t.txn.groupBy(F.year("transaction_date").alias("year"), F.month("transaction_date").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"))


def h4_period_start(t: Warehouse) -> DataFrame:
    """H4: month and year start of each calendar day."""
    return t.calendar.select("date_key", scalar.period_start("date_key", "month").alias("month_start"),
                             scalar.period_start("date_key", "year").alias("year_start"))


def h5_month_end(t: Warehouse) -> DataFrame:
    """H5: month end of each shipped line's date."""
    return t.txn.select("line_item_id", "vendor_id", "item_id", scalar.month_end("transaction_date").alias("month_end"))


def h6_trend_start(t: Warehouse) -> DataFrame:
    """H6: first day of the month twelve months back, per month end."""
    return t.calendar.select("month_end").distinct().select(
        "month_end", scalar.trend_start("month_end", 12).alias("trend_start"))


def h7_default_asof(t: Warehouse) -> DataFrame:
    """H7: default as-of date (yesterday): facts dated on or before it."""
    return t.txn.filter(F.col("transaction_date") <= scalar.default_asof()).groupBy("vendor_id").agg(
        F.count(F.lit(1)).alias("rows"))


def h8_is_workday(t: Warehouse) -> DataFrame:
    """H8: Monday-Friday and not a holiday, days per weekday."""
    cal = t.calendar
    return cal.groupBy("dow").agg(F.sum(F.when(scalar.is_workday("date_key", F.col("ps_hol_ind") == 1), 1)
                                        .otherwise(0)).alias("workdays"),
                                  F.count(F.lit(1)).alias("days"))


def h9_week_start(t: Warehouse) -> DataFrame:
    """H9: week start (Monday) of each fact date, rows per week."""
    return t.txn.groupBy(scalar.week_start("transaction_date").alias("week_start")).agg(
        F.count(F.lit(1)).alias("rows"))


def h10_coalesce(t: Warehouse) -> DataFrame:
    """First present of manager name and a fallback."""
    return t.vendors.select("company_id", scalar.first_present(F.col("relationship_manager"), F.lit("Unassigned"))
                            .alias("manager"))


def h11_norm_text(t: Warehouse) -> DataFrame:
    """upper(left(x)) of segment texts."""
    return t.customers.select("company_id", scalar.norm_text("segment").alias("segment_norm"),
                              scalar.norm_text("sub_segment").alias("sub_segment_norm"))


def h12_chop_last(t: Warehouse) -> DataFrame:
    """Replacement part number without its last character (empty -> missing)."""
    return t.line_detail.select("line_item_id", chop_last(F.col("replacement_part_number_stripped")).alias("chopped"))


def h13_parent_code(t: Warehouse) -> DataFrame:
    """Locate + substr + concat: parent code of each taxonomy code."""
    return t.oem_structure.select("structure_id", scalar.parent_code("structure_id").alias("parent_structure_id"))


def h14_fixed_width(t: Warehouse) -> DataFrame:
    """put(x, $w.): vendor names cut to 10 characters."""
    return t.vendors.select("company_id", scalar.fixed_width("company_name", 10).alias("name10"))


def h15_to_number(t: Warehouse) -> DataFrame:
    """Text -> number (contact last names that are numbers; others missing)."""
    return t.contacts.select("requestor_id", scalar.to_number("last_name").alias("last_name_number"),
                             scalar.to_number("position_description").alias("position_number"))


def h16_to_int(t: Warehouse) -> DataFrame:
    """INTEGER(quantity + return quantity)."""
    return t.once("line_items").select("id_no", scalar.to_int(F.col("quantity") + F.col("return_quantity"))
                               .alias("requested_quantity"))


def h17_arithmetic(t: Warehouse) -> DataFrame:
    """Arithmetic with missing propagation: research cost spread (missing if either is missing)."""
    r = t.research
    return r.select("line_item_id", "vendor_id", "item_id",
                    (F.col("outright_cost") - F.col("exchange_cost")).cast("double").alias("cost_gap"),
                    ratio(F.col("exchange_cost"), F.col("outright_cost")).alias("exchange_share"))


def h18_position(t: Warehouse) -> DataFrame:
    """index(text, sub): position of NET in payment terms (0 when absent)."""
    return t.vendors.select("company_id", scalar.position("payment_term_code", "NET").alias("net_position"))


# ---------------------------------------------------------------------------
# 2.I reshape, 2.J presentation
# ---------------------------------------------------------------------------

def i1_transpose(t: Warehouse) -> DataFrame:
    """Measures become rows, months become columns (13-month trend)."""
    return dashboard.monthly_trend(t, P.ASOF)


def i3_spread_budget(t: Warehouse) -> DataFrame:
    """Each month's supplement budget spread over its workdays (adds back to the month)."""
    cal = jn.bounded(t.calendar.select("month_end", "date_key", "workday_ind"))
    s = cal.join(t.budget_supplement, "month_end", "inner")
    return s.select("date_key", (F.col("budget_revenue").cast("double") / F.col("days") * F.col("workday_ind"))
                    .alias("budget_revenue_day"))


def i4_spread_prior_year(t: Warehouse) -> DataFrame:
    """I4: last year's month actuals spread over this year's workdays up to the as-of date."""
    py = dashboard.prior_year_spread(t, P.ASOF)
    return py.select("date_key", "product_type", *dashboard.PY)


def j1_fmt(t: Warehouse) -> DataFrame:
    """Currency, comma, percent and date display next to the numbers."""
    g = t.txn.groupBy("vendor_id").agg(F.sum("revenue").cast("decimal(20,2)").alias("revenue"),
                                       F.sum("orders").alias("orders"), F.max("transaction_date").alias("last_date"),
                                       ratio(F.sum("margin"), F.sum("revenue")).alias("margin_pct"))
    return g.select("vendor_id", display.fmt(F.col("revenue"), "dollar").alias("revenue_text"),
                    display.fmt(F.col("orders"), "comma").alias("orders_text"),
                    display.fmt(F.col("margin_pct").cast("decimal(10,6)"), "percent").alias("margin_pct_text"),
                    display.fmt(F.col("last_date"), "date").alias("last_date_text"))


def j2_fmt_signed(t: Warehouse) -> DataFrame:
    """Negative amounts in parentheses with a flag (daily revenue variance)."""
    df = dashboard.daily_by_category(t, P.ASOF)
    v = F.col("rev_variance").cast("decimal(20,0)")
    return df.select("date_key", "product_type", display.fmt_signed(v).alias("rev_variance_text"),
                     display.is_negative(F.col("rev_variance")).alias("is_negative"),
                     display.fmt_signed_percent(F.col("gm_percent_variance")).alias("gm_variance_text"),
                     display.is_negative(F.col("margin_variance")).alias("margin_is_negative"),
                     display.is_negative(F.col("gm_percent_variance")).alias("gm_is_negative"))


def j4_daily_ratios(t: Warehouse) -> DataFrame:
    """Render-time ratios as columns (close rate, revenue / PO, GM % ...)."""
    df = dashboard.daily_by_category(t, P.ASOF)
    return df.select("date_key", "product_type", "actual_close_rate", "actual_sales_po", "actual_gm_po",
                     "actual_gm_percent", "budget_gm_percent", "gm_percent_variance")


def j5_blank_zero(t: Warehouse) -> DataFrame:
    """Zero shown as blank (missing)."""
    g = t.txn.groupBy("vendor_id", F.year("transaction_date").alias("year")).agg(
        F.sum("returns").alias("returns"))
    return g.select("vendor_id", "year", display.blank_zero(F.col("returns")).cast("bigint").alias("returns"))


def j6_pct_rows(t: Warehouse) -> DataFrame:
    """Ratio-type rows shown as percent, the others as currency."""
    df = dashboard.summary_statistics(t, P.ASOF)
    return df.select("customer_segment", "metric", display.pct_rows(
        F.col("mtd_actual").cast("decimal(20,6)"), F.col("metric")).alias("mtd_actual_text"))


def i2_rows_to_slots(t: Warehouse) -> DataFrame:
    """Rows -> fixed slots with ``pivot`` on a declared value list (no extra pass for the values)."""
    w = (t.auto_order.groupBy("vendor_id").pivot("ship_priority_id", [1, 2, 3, 4, 5])
         .agg(F.first("settings")))
    return w.select("vendor_id", *[F.col(str(i)).alias(f"priority_{i}") for i in range(1, 6)])
