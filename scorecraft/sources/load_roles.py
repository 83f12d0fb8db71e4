"""Role tables that only the line-item load reads (K24): origins, packages, orders, fees, messages, shipping estimates.

Bound over the driver tables like ``roles``; tables keyed by line hold one
row per line they know.  ``ROLE_BUILDERS`` of ``roles`` includes them.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from scorecraft.sources.roles import Warehouse

# Line origins of the load.
LINE_ORIGINS = (1, 2, 3, 4, 5, 100)
PAYMENT_CODES = ("CC", "PO", "ACH")


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _text(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def line_item_extras() -> list[Column]:
    """Further columns of the operational line rows (over line rows joined with orders and part)."""
    ln, ok, pk = F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_partkey")
    day = F.col("o_orderdate").cast("date")
    return [
        ok.alias("order_id"),
        _text("PO", ok).alias("line_item_po"),
        _text("WO", ok).alias("work_order_number"),
        (pk % 900).alias("equipment_number"),
        _text("SE", pk).alias("serial_number_equipment"),
        F.when(ln % 2 == 0, _text("SN", ok)).alias("serial_number"),
        F.when(ln % 3 == 0, _text("SC", ok)).alias("serial_number_core"),
        F.concat(F.col("p_brand"), F.lit("-"), F.col("p_size").cast("string")).alias("model_number"),
        _text("HPO", ok).alias("house_po_number"),
        _text("CC", pk % 20).alias("cost_center"),
        F.date_add(day, 1).alias("sourced_date"),
        F.date_add(day, 2).alias("quoted_date"),
        F.when(ln != 5, F.date_add(day, 3)).alias("closed_date"),
        F.date_add(day, 4).alias("confirmed_date"),
        F.date_add(day, 5).alias("po_date"),
        F.when(F.col("p_size") % 4 == 0, "Y").otherwise("N").alias("gsa_item"),
        F.when(ln == 6, pk % 9).alias("nosale_reason_id"),
        F.when(ln % 3 == 0, "Y").otherwise("N").alias("had_smartsourced_research"),
        _pick(LINE_ORIGINS, (ok + ln) % 6).alias("line_origin_id"),
        F.col("p_size").alias("class_id"),
        (F.col("p_size") % 7).alias("modality_id"),
        F.col("p_brand").alias("oem_id"),
        F.when(F.col("l_discount") >= 0.09, F.date_add(F.col("l_shipdate").cast("date"), 7)).alias("backorder_followup_date"),
    ]


def research_extras() -> list[Column]:
    """Further columns of a quote (over lineitem)."""
    ln, pk = F.col("l_linenumber"), F.col("l_partkey")
    return [
        F.when(ln % 2 == 0, F.concat(F.lit("P-"), pk.cast("string"), F.lit("X"))).alias("replacement_part_number"),
        (pk % 100).alias("vrm_score"),
        (ln * 2).alias("lead_time_days"),
        F.when(pk % 2 == 0, "Y").otherwise("N").alias("is_formulary_outright_option"),
        F.when(pk % 3 == 0, "Y").otherwise("N").alias("is_formulary_exchange_option"),
        F.when(ln % 2 == 1, F.lit(50)).otherwise(F.lit(0)).cast("double").alias("core_charge"),
    ]


def _line_origins(w: Warehouse) -> DataFrame:
    """Origin code, and its subscription for origins 4 and 5 (fixed codes)."""
    i = w.spark.range(len(LINE_ORIGINS)).select(_pick(LINE_ORIGINS, F.col("id")).alias("line_origin_id"))
    return i.select("line_origin_id", _text("ORIGIN", F.col("line_origin_id")).alias("status_code"),
                    F.when(F.col("line_origin_id").isin(4, 5), F.col("line_origin_id")).alias("subscription_id"))


def _subscriptions(w: Warehouse) -> DataFrame:
    return w.base("nation").select(F.col("n_nationkey").alias("subscription_id"), (F.col("n_nationkey") % 5).alias("package_id"))


def _packages(w: Warehouse) -> DataFrame:
    return w.base("region").select(F.col("r_regionkey").alias("package_id"), F.concat(F.lit("Package "), F.col("r_name")).alias("package_name"),
                                   (F.col("r_regionkey") % 2).alias("type_id"))


def _package_types(w: Warehouse) -> DataFrame:
    ids = w.base("region").select((F.col("r_regionkey") % 2).alias("type_id")).distinct()
    return ids.select("type_id", _text("Type ", F.col("type_id")).alias("type_name"))


def _lines(w: Warehouse, keep: Column, *cols: Column) -> DataFrame:
    return w.role("line_rows").filter(keep).select("line_item_id", *cols)


def _customer_line_keys(w: Warehouse) -> DataFrame:
    return _lines(w, F.col("l_linenumber") % 2 == 0, (F.col("l_suppkey") % 25).cast("int").alias("subscription_id"))


def _function_locations(w: Warehouse) -> DataFrame:
    return _lines(w, F.col("l_linenumber") == 4, _text("LOC", F.col("l_suppkey")).alias("field_value"))


def _order_headers(w: Warehouse) -> DataFrame:
    return w.base("orders").select(
        F.col("o_orderkey").alias("order_id"), F.when(F.col("o_orderstatus") == "P", "Y").otherwise("N").alias("hero_kit"),
        F.col("o_custkey").alias("company_id"), (F.col("o_custkey") % 150).alias("requestor_id"))


def research_pricing_rows(w: Warehouse) -> DataFrame:
    """The rule of a quote, told once or more."""
    from scorecraft.sources.roles import _research_key

    rule = F.col("l_partkey") % 500
    return w.base("lineitem").filter(F.col("l_partkey") % 2 == 0).select(
        _research_key().alias("vendor_research_id"), rule.alias("pricing_rule_id"), _text("Rule ", rule).alias("pricing_rule_description"),
        (F.col("l_partkey") - F.col("l_partkey") % 3).alias("oem_item_number"))


def _research_pricing(w: Warehouse) -> DataFrame:
    return research_pricing_rows(w).distinct()


def _order_confirmations(w: Warehouse) -> DataFrame:
    return _lines(w, F.col("l_quantity") > 20)


def _purchase_orders(w: Warehouse) -> DataFrame:
    def percent(c: str) -> Column:
        return (F.col(c).cast("decimal(4,2)") * 100).cast("double")

    flat = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0)).cast("double")
    return _lines(
        w, F.col("l_linestatus") == "F", _text("P", F.col("l_orderkey")).alias("purchase_id"),
        _pick(PAYMENT_CODES, F.col("l_partkey") % 3).alias("payment_code"), percent("l_tax").alias("oem_shipping_handling_fee"),
        flat(F.col("l_returnflag") == "R", 25).alias("exchange_fee"), F.lit(5).cast("double").alias("processing_fee"),
        flat(F.col("l_quantity") < 5, 10).alias("minimum_order_fee"),
        F.when(F.col("l_linenumber") % 2 == 0, "Y").otherwise("N").alias("transit_coverage"), percent("l_discount").alias("program_fee"))


def _customer_requests(w: Warehouse) -> DataFrame:
    return _lines(w, F.col("l_linenumber") == 2)


def _vendor_messages(w: Warehouse) -> DataFrame:
    return _lines(w, F.col("l_linenumber").isin(1, 3), F.when(F.col("l_linenumber") == 1, "850").alias("vendor_850"),
                  F.when(F.col("l_partkey") % 2 == 0, "855").alias("vendor_855"), F.when(F.col("l_orderkey") % 2 == 0, "856").alias("vendor_856"))


def _customer_messages(w: Warehouse) -> DataFrame:
    return _lines(w, F.col("l_linenumber").isin(2, 3), (F.col("l_partkey") % 2).alias("edi855"), (F.col("l_orderkey") % 2).alias("edi856"))


def _direct_order_lines(w: Warehouse) -> DataFrame:
    return _lines(w, F.col("l_linenumber") == 7)


def _ship_estimates(w: Warehouse) -> DataFrame:
    return _lines(w, F.col("l_linenumber").isin(4, 5), _text("ESD ", F.col("l_linenumber")).alias("description"),
                  F.date_add(F.col("l_shipdate").cast("date"), 2).alias("esd"), _text("user", F.col("l_partkey") % 10).alias("user_name"),
                  F.when(F.col("l_partkey") % 2 == 0, "Y").otherwise("N").alias("active"))


def _product_relations(w: Warehouse) -> DataFrame:
    sizes = w.base("part").select(F.col("p_size").alias("product_type_id")).distinct().filter(F.col("product_type_id") % 3 != 0)
    return sizes.select((F.col("product_type_id") % 7).alias("modality_id"), "product_type_id", (F.col("product_type_id") % 5 + 1).alias("product_subcategory_id"))


LOAD_ROLES = {
    "line_origins": _line_origins, "subscriptions": _subscriptions, "packages": _packages, "package_types": _package_types,
    "customer_line_keys": _customer_line_keys, "function_locations": _function_locations, "order_headers": _order_headers,
    "research_pricing": _research_pricing, "order_confirmations": _order_confirmations, "purchase_orders": _purchase_orders,
    "customer_requests": _customer_requests, "vendor_messages": _vendor_messages, "customer_messages": _customer_messages,
    "direct_order_lines": _direct_order_lines, "ship_estimates": _ship_estimates, "product_relations": _product_relations,
}
