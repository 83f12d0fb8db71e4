"""Registry of runnable queries: one entry per operator / report of the survey.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
role tables bound to that directory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scorecraft.plans import params as P
from scorecraft.plans import scorecard as sc
from scorecraft.plans import targeting as tg
from scorecraft.session import configure
from scorecraft.sources.roles import Warehouse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _run(fn: Callable[[Warehouse], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)  # UTC session time zone; AQE and size-checked broadcast unless the session says otherwise
    return fn(Warehouse(spark, sf_dir).prepare())


def register(name: str):
    def deco(fn: Callable[[Warehouse], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: _run(fn, spark, sf_dir)
        QUERIES[name].__doc__ = fn.__doc__
        return fn
    return deco


# --- K: reports -----------------------------------------------------------------
register("K1_vendor_metrics")(lambda t: sc.vendor_metrics(t, P.PERIOD_START, P.PERIOD_END, "reference"))
register("K2_vendor_returns")(lambda t: sc.vendor_returns(t, P.PERIOD_START, P.PERIOD_END, "reference"))
register("K3_research_funnel")(lambda t: sc.research_funnel(t, P.PERIOD_START, P.PERIOD_END))
register("K4_supplier_type")(lambda t: sc.supplier_type(t))
register("K5_on_time")(lambda t: sc.on_time(t, P.PERIOD_START, "reference"))
register("K6_best_price")(lambda t: sc.best_price(t, P.BEST_PRICE_SINCE, "reference"))
register("K7_supplier_scorecard")(
    lambda t: sc.supplier_scorecard(t, P.PERIOD_START, P.PERIOD_END, "distinct", P.BEST_PRICE_SINCE))
register("K7_supplier_scorecard_reference")(
    lambda t: sc.supplier_scorecard(t, P.PERIOD_START, P.PERIOD_END, "reference", P.BEST_PRICE_SINCE))
register("K14_item_returns")(lambda t: tg.item_returns(t, P.PERIOD_START, P.PERIOD_END))
register("K15_formulary_rules")(lambda t: tg.formulary_rules(t))
register("K16_pricing_rules")(lambda t: tg.pricing_rules(t))

from scorecraft.plans import compliance as cp  # noqa: E402

register("K8_vendor_compliance")(lambda t: cp.vendor_compliance(t, P.PERIOD_START, P.PERIOD_END))
register("K9_compliance_totals")(lambda t: cp.compliance_totals(t, P.PERIOD_START, P.PERIOD_END))
register("K10_compliance_details")(lambda t: cp.compliance_details(t, P.PERIOD_START, P.PERIOD_END))
register("K11_backorder_trends")(lambda t: cp.backorder_trends(t, P.PERIOD_START, P.PERIOD_END))
register("K12_vendor_sales")(lambda t: cp.vendor_sales(t, P.SALES_VENDOR, P.PERIOD_START, P.PERIOD_END,
                                                        P.HOUSE_VENDOR))
register("K13_vendor_contacts")(lambda t: cp.vendor_contacts(t))

from scorecraft.plans import catalogue as cat  # noqa: E402

register("K17_taxonomy")(lambda t: cat.taxonomy(t))
register("K18_catalogue_sheet")(
    # every group that the taxonomy holds
    lambda t: cat.catalogue_sheet(t, "parent_taxonomy", cat.taxonomy(t).select("parent_structure_id").distinct(),
                                  P.PERIOD_START, P.PERIOD_END))

import datetime as _dt  # noqa: E402

from scorecraft.plans import dashboard as dash  # noqa: E402

K20_START, K20_END = _dt.date(1995, 1, 1), _dt.date(2001, 12, 31)

register("K19_daily_budget")(lambda t: dash.daily_budget(t, P.ASOF))
register("J3_budget_status")(lambda t: dash.daily_budget_status(t, P.ASOF))
register("K20_large_transactions")(lambda t: dash.large_transactions(t, K20_START, K20_END, P.LARGE_THRESHOLD))
register("K21_summary_statistics")(lambda t: dash.summary_statistics(t, P.ASOF))
register("K22_daily_by_category")(lambda t: dash.daily_by_category(t, P.ASOF))
register("K23_monthly_trend")(lambda t: dash.monthly_trend(t, P.ASOF))

from scorecraft.plans import line_items as li  # noqa: E402

register("K24_line_item_details")(lambda t: li.line_item_details(t, P.PERIOD_START))

from scorecraft.plans import primitives as pr  # noqa: E402

for _name, _fn in [
    ("A1_named_scan", pr.a1_named_scan), ("A2_source_query", pr.a2_source_query),
    ("A4_full_refresh", pr.a4_full_refresh), ("A5_report", pr.a5_report), ("A7_split_by", pr.a7_split_by),
    ("B1_derive", pr.b1_derive), ("B2_keep", pr.b2_keep), ("B3_derive_star", pr.b3_derive_star),
    ("B4_in_period", pr.b4_in_period), ("B5_since", pr.b5_since), ("B6_not_in", pr.b6_not_in),
    ("B7_ne", pr.b7_ne), ("B8_missing_lowest", pr.b8_missing_lowest), ("B9_present", pr.b9_present),
    ("B10_large_only", pr.b10_large_only), ("B11_active_only", pr.b11_active_only),
    ("B12_by_filter", pr.b12_by_filter), ("B13_has_text", pr.b13_has_text), ("B14_having", pr.b14_having),
    ("B15_distinct", pr.b15_distinct), ("B16_distinct_wide", pr.b16_distinct_wide), ("B17_tag", pr.b17_tag),
    ("B18_scalar", pr.b18_scalar), ("B19_classify", pr.b19_classify), ("B20_map_codes", pr.b20_map_codes),
    ("B21_transit_days", pr.b21_transit_days), ("B22_band", pr.b22_band), ("B23_exists_flag", pr.b23_exists_flag),
    ("B24_first_present", pr.b24_first_present), ("B25_effective_cost", pr.b25_effective_cost),
    ("B26_txn_type", pr.b26_txn_type), ("B27_segment", pr.b27_segment),
]:
    register(_name)(_fn)

for _name, _fn in [
    ("C1_inner", pr.c1_inner), ("C2_left", pr.c2_left), ("C3_star", pr.c3_star), ("C4_wide_star", pr.c4_wide_star),
    ("C5_full_merge", pr.c5_full_merge), ("C6_left_where", pr.c6_left_where),
    ("C7_join_on_expr", pr.c7_join_on_expr), ("C8_self_match", pr.c8_self_match),
    ("C9_role_join", pr.c9_role_join), ("C10_with_parent", pr.c10_with_parent),
    ("C11_workdays_between", pr.c11_workdays_between), ("C12_slots", pr.c12_slots),
    ("C13_keep_extreme", pr.c13_keep_extreme), ("C14_only_in", pr.c14_only_in),
    ("C15_prior_year", pr.c15_prior_year), ("C16_lookup_agg", pr.c16_lookup_agg),
    ("C17_filter_before_join", pr.c17_filter_before_join), ("C18_join_ns", pr.c18_join_ns),
]:
    register(_name)(_fn)

for _name, _fn in [
    ("D1_sum_by", pr.d1_sum_by), ("D2_sum_if", pr.d2_sum_if), ("D3_weighted_sum", pr.d3_weighted_sum),
    ("D4_count_if", pr.d4_count_if), ("D5_distinct_count", pr.d5_distinct_count), ("D6_row_count", pr.d6_row_count),
    ("D7_extremes", pr.d7_extremes), ("D8_any_flag", pr.d8_any_flag), ("D9_sum_over_mean", pr.d9_sum_over_mean),
    ("D10_ratio", pr.d10_ratio), ("D11_flag_share", pr.d11_flag_share), ("D12_wavg", pr.d12_wavg),
    ("D13_grand_total", pr.d13_grand_total), ("D14_with_total", pr.d14_with_total),
    ("D15_metric_grid", pr.d15_metric_grid), ("D16_best_day", pr.d16_best_day),
    ("D17_period_to_date", pr.d17_period_to_date), ("D18_per_workday", pr.d18_per_workday),
    ("D19_remerge", pr.d19_remerge), ("D20_group_by_exprs", pr.d20_group_by_exprs),
]:
    register(_name)(_fn)

for _name, _fn in [
    ("E1_first_per_key", pr.e1_first_per_key), ("E2_rank_in_group", pr.e2_rank_in_group),
    ("E3_first_of_group", pr.e3_first_of_group), ("E4_latest_ties", pr.e4_latest_ties),
    ("E5_top_slots", pr.e5_top_slots), ("E6_workday_numbers", pr.e6_workday_numbers),
    ("F1_sort_by", pr.f1_sort_by), ("F2_sort_desc", pr.f2_sort_desc), ("F3_sort_before_by", pr.f3_sort_before_by),
    ("F4_display_order", pr.f4_display_order), ("G1_stack_rows", pr.g1_stack_rows),
    ("G2_detail_and_total", pr.g2_detail_and_total), ("G3_metric_rows", pr.g3_metric_rows),
    ("H1_to_day", pr.h1_to_day), ("H2_seconds_of_day", pr.h2_seconds_of_day), ("H3_year_month", pr.h3_year_month),
    ("H4_period_start", pr.h4_period_start), ("H5_month_end", pr.h5_month_end), ("H6_trend_start", pr.h6_trend_start),
    ("H7_default_asof", pr.h7_default_asof), ("H8_is_workday", pr.h8_is_workday), ("H9_week_start", pr.h9_week_start),
    ("H10_coalesce", pr.h10_coalesce), ("H11_norm_text", pr.h11_norm_text), ("H12_chop_last", pr.h12_chop_last),
    ("H13_parent_code", pr.h13_parent_code), ("H14_fixed_width", pr.h14_fixed_width),
    ("H15_to_number", pr.h15_to_number), ("H16_to_int", pr.h16_to_int), ("H17_arithmetic", pr.h17_arithmetic),
    ("H18_position", pr.h18_position), ("I1_transpose", pr.i1_transpose), ("I3_spread_budget", pr.i3_spread_budget),
    ("I4_spread_prior_year", pr.i4_spread_prior_year), ("J1_fmt", pr.j1_fmt), ("J2_fmt_signed", pr.j2_fmt_signed),
    ("J4_daily_ratios", pr.j4_daily_ratios), ("J5_blank_zero", pr.j5_blank_zero), ("J6_pct_rows", pr.j6_pct_rows),
]:
    register(_name)(_fn)
register("I2_rows_to_slots")(pr.i2_rows_to_slots)
