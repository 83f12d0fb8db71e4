"""Catalogue taxonomy (K17) and the item catalogue sheet."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.functions.money import to_double, total
from scorecraft.functions.scalar import parent_code
from scorecraft.operators.filters import by_filter
from scorecraft.operators.joins import slots, with_parent
from scorecraft.operators.windows import top_slots
from scorecraft.sources.roles import Warehouse
from scorecraft.sources.tables import query

# Which column each catalogue filter applies to (the reference's switch).
FILTER_COLUMNS = {
    "structure": "ps_structure_id",
    "parent_structure": "structure_parent_name",
    "taxonomy": "taxonomy_id",
    "parent_taxonomy": "taxonomy_parent_id",
    "vendor": "vendor_id",
    "oem": "oem_id",
}


def parent_child(t: Warehouse, oem_id: int = 2) -> DataFrame:
    """A2: source-side query for one taxonomy (parent code from the child code)."""
    return query(t.spark, """
        SELECT structure_id, name,
               concat(substring(structure_id, 1, locate('.', structure_id)), '0.0.0.0.0.0') AS parent_structure_id
        FROM {oem_structure} WHERE oem_id = {oem_id}""", oem_structure=t.oem_structure, oem_id=int(oem_id))


def taxonomy(t: Warehouse, oem_id: int = 2) -> DataFrame:
    """Taxonomy codes with parent code and parent name (C10 self join)."""
    pc = t.oem_structure.filter(F.col("oem_id") == oem_id).select("structure_id", "name")
    return with_parent(pc, "structure_id", parent_code(F.col("structure_id")), "parent_structure_id", ["name"])


def _pim_items(t: Warehouse) -> DataFrame:
    pip = t.item_prices.drop("item_number", "condition_code", "list_price", "sell_price")
    i = t.items.select(F.col("item_number").alias("i_item"), F.col("company_id").alias("vendor_id"),
                       F.col("part_number").alias("vendor_part_number"), "description", "ps_structure_id")
    s = t.product_structure.select(F.col("structure_id").alias("ps_structure_id"),
                                   F.col("parent_name").alias("structure_parent_name"),
                                   F.col("name").alias("structure_name"))
    v = t.vendors.select(F.col("company_id").alias("vendor_id"), F.col("company_name").alias("vendor_name"))
    io = t.items.select(F.col("item_number").alias("io_item"), F.col("oem_name").alias("oem_id"),
                        F.col("part_number").alias("oem_part_number"))
    o = t.oems.select(F.col("company_id").alias("oem_id"), F.col("company_name").alias("oem_name"))
    p = t.oem_structure_products.filter(F.col("oem_id") == 2).select("product_number", F.col("structure_id").alias("tx"))
    tx = taxonomy(t).select(F.col("structure_id").alias("tx"), F.col("name").alias("taxonomy_name"),
                            F.col("parent_structure_id").alias("taxonomy_parent_id"),
                            F.col("parent_name").alias("taxonomy_parent"))
    j = (pip.join(i, pip.search_item_number == i.i_item, "left")
         .join(s, "ps_structure_id", "left")
         .join(v, "vendor_id", "left")
         .join(io, pip.oem_item_number == io.io_item, "left")
         .join(o, "oem_id", "left")
         .join(p, "product_number", "left")
         .join(tx, "tx", "left")
         .withColumnRenamed("tx", "taxonomy_id"))
    return j


def _money(c: str):
    return F.col(c).cast("double").alias(c)


def catalogue_sheet(t: Warehouse, kind: str, ids: Iterable, start, end) -> DataFrame:
    """One row per catalogue price row of the selected items.

    Slot columns (10 models, 10 references, 2 alternatives) come from one
    ranked, limited aggregate per child table (E5/C12) instead of 24 joins.
    """
    p = by_filter(_pim_items(t), kind, ids, FILTER_COLUMNS)
    attrs = t.once("item_attributes").groupBy("item_number").agg(F.count(F.lit(1)).alias("attribute_count"))
    logi = t.item_logistics.select("item_number", F.col("condition_code").alias("condition"), "uom_quantity",
                                   "cust_notes", "quantity_on_hand", F.col("package_weight").alias("pim_weight"))
    photos = t.once("pim_images").groupBy(F.col("item_number").alias("oem_item_number")).agg(
        F.count(F.lit(1)).alias("photo_count"))
    q = t.during("txn", start, end, once=True)
    lid = t.once("line_detail").filter(F.col("contract_pro_id").isNull() & F.col("pim_item_number").isNotNull()).select(
        "line_item_id", "pim_item_number", "condition_code")
    trx = (q.join(lid, "line_item_id", "inner")
           .groupBy(F.col("pim_item_number").alias("item_number"), F.col("condition_code").alias("condition"))
           .agg(F.sum("requests").cast("bigint").alias("requests"), F.sum("orders").cast("bigint").alias("orders"),
                F.sum("quantity").cast("bigint").alias("quantity"),
                to_double(total("revenue_e4"), 4).alias("revenue"),
                to_double(total("spend_e6"), 6).alias("ext_cost"), to_double(total("margin_e6"), 6).alias("margin")))
    # every vendor item of a product lists that product's models: rank the
    # models once per product, then attach the ten slots to the items (no
    # items x models fan-out)
    vitems = t.items.filter(F.col("item_type") == "V").select("item_number", "product_number")
    pslots = top_slots(t.once("pim_models"), "product_number", "model_code", ["model_code"], 10, "model_",
                       "more_models_flag")
    mslots = vitems.join(pslots, "product_number", "inner").drop("product_number")
    refs = t.once("pim_searches").select("search_item_number", "part_number").distinct()
    rslots = top_slots(refs, "search_item_number", "part_number", ["part_number"], 10, "reference_",
                       "more_references_flag").withColumnRenamed("search_item_number", "oem_item_number")
    also = t.item_references.filter((F.col("type") == "C") & F.col("sequence").isin(1, 2)).select(
        F.col("owner"), F.col("to"), F.col("sequence"))
    out = (p.withColumnRenamed("search_item_number", "item_number")
           .join(attrs, "item_number", "left")
           .join(logi, ["item_number", "condition"], "left")
           .join(photos, "oem_item_number", "left")
           .join(trx, ["item_number", "condition"], "left")
           .join(rslots, "oem_item_number", "left")
           .join(mslots, "item_number", "left"))
    out = slots(out, also, key="oem_item_number", rank="sequence", value="to", k=2, prefix="also_consider_",
                child_key="owner")
    return out.select(
        "structure_parent_name", "structure_name", "taxonomy_id", "taxonomy_name", "taxonomy_parent_id",
        "taxonomy_parent", "vendor_id", "vendor_name", "vendor_part_number",
        F.col("item_number").alias("vendor_item_number"), F.col("sub_type").alias("item_subtype"), "description",
        "oem_id", "oem_name", "oem_part_number", "oem_item_number", "product_number",
        *[_money(c) for c in ("exchange_oem_price", "outright_oem_price", "exchange_cost", "outright_cost",
                              "exchange_price", "outright_price", "cost_core_charge")],
        "uom_code", "uom_quantity", "condition", "cost_warranty_description", "cust_notes", "is_returnable",
        "quantity_on_hand", "lead_time_days", "attribute_count", "photo_count",
        F.col("pim_weight").cast("double").alias("pim_weight"),
        *[F.col(f"model_{i}") for i in range(1, 11)],
        F.when(F.col("more_models_flag") == 1, "Y").otherwise("N").alias("more_models"),
        *[F.col(f"reference_{i}") for i in range(1, 11)],
        F.when(F.col("more_references_flag") == 1, "Y").otherwise("N").alias("more_references"),
        "also_consider_1", "also_consider_2", "requests", "orders", "quantity",
        "revenue", "ext_cost", "margin",
    )
