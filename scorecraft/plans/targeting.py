"""Product targeting counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.operators.filters import in_period
from scorecraft.sources.roles import Warehouse

ITEM_KEYS = ["item_number", "company_id", "company_name", "description"]


def _item_vendor(lid: DataFrame, t: Warehouse) -> DataFrame:
    items = t.items.select("item_number", "description")
    vendors = t.vendors.select("company_id", "company_name")
    return (lid.join(items, lid.pim_item_number == items.item_number, "inner")
            .join(vendors, lid.vendor_id == vendors.company_id, "inner"))


def item_returns(t: Warehouse, start, end) -> DataFrame:
    """Distinct return numbers per item x vendor x description."""
    r = t.returns.filter(F.col("rga_type_id").isin(2, 4) & (F.col("active") == "Y"))
    r = in_period(r, "created_timestamp", start, end).select("line_item_id", "rga_number")
    lid = t.line_detail.select("line_item_id", "pim_item_number", "vendor_id")
    j = _item_vendor(r.join(lid, "line_item_id", "inner"), t)
    return j.groupBy(*ITEM_KEYS).agg(F.countDistinct("rga_number").alias("num_of_returns"))


def formulary_rules(t: Warehouse) -> DataFrame:
    """Distinct formulary documents per OEM item.

    The price table is joined only to test that the OEM item has a price
    row, so it becomes a semi-join on the distinct OEM item numbers (no
    fan-out of documents by the vendor items that share one OEM item).
    Documents are counted per OEM item before the names come in: the item is
    one of the report's keys, so its documents are those of each of its rows,
    and no document row carries a description through a join or a sort.
    """
    f = t.formulary.select("document_id", "o_string").distinct()
    f = f.groupBy("o_string").agg(F.count("document_id").alias("num_of_rules_involved"))
    priced = t.item_prices.select(F.col("oem_item_number").alias("o_string"))
    f = f.join(priced, "o_string", "left_semi")
    items = t.items.select("item_number", "description", "company_id")
    vendors = t.vendors.select("company_id", "company_name")
    named = items.join(vendors, "company_id", "inner").select(*ITEM_KEYS).distinct()
    return (f.join(named, f.o_string == named.item_number, "inner")
            .select(*ITEM_KEYS, "num_of_rules_involved"))


def pricing_rule_list(t: Warehouse) -> DataFrame:
    """K16 (second form): distinct rules that name a product-segment part."""
    return (t.pricing_rules.filter(F.col("prod_seg_part_number").isNotNull())
            .select("price_rule_id").distinct())


def pricing_rules(t: Warehouse) -> DataFrame:
    """Distinct price rules per item; the rule table acts as a semi-join."""
    lid = t.line_detail.select("line_item_id", "pim_item_number", "vendor_id", "price_rule_id")
    lid = lid.join(pricing_rule_list(t), "price_rule_id", "left_semi")
    j = _item_vendor(lid, t)
    return j.groupBy(*ITEM_KEYS).agg(F.countDistinct("price_rule_id").alias("num_of_lists_involved"))
