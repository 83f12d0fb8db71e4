"""Line-item detail load (K24): a wide dimension built from operational tables.

DB2 semantics (ANSI nulls) apply here, not the SAS missing-value rules.
Code tables of fixed size are broadcast.  The line table and the large tables
keyed by line are stored in buckets of the line id: the wide row grows by hash
joins inside its bucket and is never exchanged; there must be enough buckets (the
session's shuffle partitions) for a bucket of each table to fit a task's memory.  Quote and order are found by
their own keys for a narrow row (line, quote, order), which alone goes back to
the line's bucket; a quote travels as the few columns of its row of lineitem, from
which its other columns are computed there.

The DISTINCT over all 97 columns is the reference's; it needs no exchange, as equal
rows lie in one bucket.  Tables that may hold several rows for a line are made
distinct in the columns that the result shows before they are joined, so that
little is left for it (rows of a quote that is told twice).  The shipping documents
join of the reference selects no column and is dropped (the DISTINCT hid its fan-out).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecraft.functions.codes import classify_sourcing
from scorecraft.functions.money import row_double
from scorecraft.functions.scalar import first_present, to_int
from scorecraft.functions.semantics import exists_flag
from scorecraft.operators.joins import bounded, keep_extreme
from scorecraft.operators.windows import first_per_key
from scorecraft.sources.roles import Warehouse, research_columns
from scorecraft.sources.tables import current, full_refresh

SYSTEM_USER = 3


def latest_confirmation(t: Warehouse) -> DataFrame:
    """Confirmations at the line's latest timestamp (ties kept), with the confirmer's name."""
    c = keep_extreme(t.once("confirmations"), ["line_item_id"], "created_timestamp", "max")
    org = t.organization.select(F.col("organization_id").alias("confirmed_by_id"), "user_name")
    return c.join(org, "confirmed_by_id", "left").select("line_item_id", "user_name", "confirmation_notes").repartition("line_item_id").distinct()


def research_ids(t: Warehouse) -> DataFrame:
    """Min / max research type and any-flags per line."""
    r = t.research
    return r.groupBy("line_item_id").agg(
        F.max("research_type_id").alias("researchtypemax"),
        F.min("research_type_id").alias("researchtypemin"),
        F.max(F.when(F.col("research_type_id").isin(2, 3), 1).otherwise(0)).alias("sppresearch"),
        F.max(F.when(F.col("created_user_id") == SYSTEM_USER, 1).otherwise(0)).alias("system_flag"))


def _flag(col: str) -> Column:
    return exists_flag(F.col(col))


def _flags(**marked: DataFrame) -> DataFrame:
    """One row per line that any of some tables (column line_item_id) holds, with a 0/1 column for each table."""
    rows = None
    for name, df in marked.items():
        one = df.select(F.col("line_item_id").alias("id_no"), *[F.lit(int(n == name)).alias(n) for n in marked])
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("id_no").agg(*[F.max(n).alias(n) for n in marked])


def _by_line(df: DataFrame, **cols: Column | str) -> DataFrame:
    """The distinct rows of a line-keyed table in the chosen columns, under new names."""
    return df.select(F.col("line_item_id").alias("id_no"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in cols.items()]).distinct()


def _packages(t: Warehouse, prefix: str) -> DataFrame:
    """Subscription -> package and its type (C9: joined once by origin, once by the customer's key)."""
    p = (t.subscriptions.join(t.packages, "package_id", "left").join(t.package_types, "type_id", "left"))
    return bounded(p.select(F.col("subscription_id").alias(prefix + "subscription_id"), F.col("package_id").alias(prefix + "package_id"),
                            F.col("package_name").alias(prefix + "package_name"), F.col("type_name").alias(prefix + "type_name")))


#: Columns of the chosen quote in the load, by their names among a quote's columns.
QUOTE_COLUMNS = {c: c for c in (
    "vendor_id", "research_type_id", "rs_item_number", "replacement_part_number", "replacement_part_number_stripped", "condition_id", "warranty_id",
    "add_bill_unit_e4", "contract_pro_id", "vrm_score", "lead_time_days", "is_formulary_outright_option", "is_formulary_exchange_option", "core_charge")}
QUOTE_COLUMNS |= {"created_user_id": "quoted_by"}


def _chosen_quote(t: Warehouse) -> DataFrame:
    """The quote a line was sold from as its row of lineitem (``_quote_columns`` computes its columns), with its price rule."""
    quote = t.rows("research").withColumnRenamed("research_id", "vendor_research_id").withColumn("has_quote", F.lit(1))
    return quote.join(t.rows("research_pricing").repartition("vendor_research_id").distinct(), "vendor_research_id", "left")


def _quote_columns(t: Warehouse, df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """``df``, which carries quotes as rows of lineitem, with some of a quote's columns under new names (missing without a quote)."""
    column = dict(zip(t.research.columns, research_columns(), strict=True))
    return df.select("*", *[F.when(F.col("has_quote") == 1, column[c]).alias(n) for c, n in names.items()])


def line_item_details(t: Warehouse, since: dt.date) -> DataFrame:
    """97 columns, one row per line (more where a joined table has several rows for it), no row twice."""
    lines = t.line_items.filter(F.col("created_timestamp") >= F.lit(since).cast("timestamp"))
    origin = bounded(t.line_origins)
    own_origin = origin.filter(~F.col("line_origin_id").isin(1, 2)).select(
        F.col("line_origin_id").alias("o_id"), F.col("status_code").alias("o_status"), F.col("subscription_id").alias("o_subscription_id"))
    catalog = origin.select(F.col("line_origin_id").alias("c_id"), F.col("status_code").alias("catalog"))
    head = t.order_headers.select("order_id", "hero_kit", F.col("company_id").alias("customer_id"), "requestor_id")
    relation = bounded(t.product_relations).withColumnRenamed("product_type_id", "class_id")
    invoices = (t.invoices.filter(F.coalesce(F.col("line_number"), F.lit(0)) > 0)
                .select(F.col("line_item_id").alias("id_no"), "invoice_number").distinct())
    received = first_per_key(t.received_parts, ["line_item_id"], ["date_received", "received_by_contact_id"])
    estimate = t.ship_estimates.filter(F.col("active") == "Y")  # inside ON: lines without an active one stay (C6)
    # a customer's own package shows on lines of origin 100 only
    own_package = (lines.filter(F.col("line_origin_id") == 100).select("id_no").join(_by_line(t.customer_line_keys, k_subscription_id="subscription_id"), "id_no")
                   .join(_packages(t, "k_"), "k_subscription_id").select("id_no", "k_package_name", "k_type_name").distinct())
    narrow = lines.select("id_no", "order_id", "vendor_research_id").join(head, "order_id", "left").join(_chosen_quote(t), "vendor_research_id", "left")
    # the catalogue is asked for the quotes that lines were sold from, not for all quotes
    item = t.items.select(F.col("item_number").alias("inv_item_cost_id"), F.col("item_number").cast("string").alias("catalogue_item"))
    narrow = _quote_columns(t, narrow, {"inv_item_cost_id": "inv_item_cost_id"}).join(item, "inv_item_cost_id", "left")
    by_line = [
        narrow.drop("order_id", "vendor_research_id"),
        research_ids(t).withColumnRenamed("line_item_id", "id_no"),
        latest_confirmation(t).withColumnRenamed("line_item_id", "id_no"),
        own_package,
        invoices,
        _flags(has_conf=t.order_confirmations, has_backorder=t.line_status.filter(F.col("first_backordered_timestamp").isNotNull()),
               has_request=t.customer_requests, has_smart_po=t.admin_actions.filter(F.col("action_type_id").isin(3, 4)), has_direct=t.direct_order_lines),
        _by_line(t.function_locations, functional_location="field_value"),
        _by_line(t.purchase_orders, purchase_id="purchase_id", payment_method="payment_code", manufacturer_fee="oem_shipping_handling_fee",
                 exchange_fee="exchange_fee", customer_ship_fee="processing_fee", minimum_order_fee="minimum_order_fee",
                 transit_coverage="transit_coverage", program_fee="program_fee"),
        _by_line(t.vendor_messages, **{f"vend_{n}": _flag(f"vendor_{n}") for n in (850, 855, 856)}),
        received.select(F.col("line_item_id").alias("id_no"), "received_by_contact_id", "date_received"),
        _by_line(t.customer_messages, **{f"cust_{n}": F.when(F.col(f"edi{n}") > 0, 1).otherwise(0) for n in (855, 856)}),
        _by_line(estimate, esd_description="description", estimated_shipping_date="esd", last_esd_updated_by="user_name"),
    ]
    j = lines
    for side in by_line:  # hash joins inside a bucket: no table keyed by line is broadcast or sorted
        j = j.join(side.hint("shuffle_hash"), "id_no", "left")
    warranty = bounded(t.warranty_codes).withColumnRenamed("description", "warranty_description")
    j = _quote_columns(t, j, QUOTE_COLUMNS).join(bounded(t.condition_codes), "condition_id", "left").join(warranty, "warranty_id", "left")
    j = (j.join(own_origin, F.col("line_origin_id") == F.col("o_id"), "left")
         .join(catalog, F.when(F.col("line_origin_id").isin(3, 4), 2).otherwise(F.col("line_origin_id")) == F.col("c_id"), "left")
         .join(_packages(t, "o_"), "o_subscription_id", "left")
         .join(bounded(t.urgency_codes), "urgency_id", "left").join(relation, ["modality_id", "class_id"], "left"))
    flags = classify_sourcing(F.col("status_id"), F.col("research_type_id"), F.col("researchtypemin"),
                              F.col("researchtypemax"), F.col("system_flag") == 1)
    repair = F.col("order_type_id").isin(3, 4)
    maker = F.concat(F.lit("V"), F.col("vendor_id").cast("string"), F.lit("-"))
    fallback = (F.when(F.col("catalogue_item").isNull() & F.col("inv_item_cost_id").isNotNull() & ~repair,
                       F.concat(maker, F.col("replacement_part_number_stripped")))
                .when(repair & (F.col("quoted_by") == SYSTEM_USER) & F.col("research_type_id").isin(2, 3, 4),
                      F.concat(maker, F.col("part_number_stripped"))))
    qty = to_int(F.col("quantity") + F.col("return_quantity"))
    one = lambda cond: F.when(cond, 1).otherwise(0)
    flag = lambda c: F.coalesce(F.col(c), F.lit(0))
    named = {
        "line_item_id": "id_no", "requested_part_number": "part_number", "requested_part_number_stripped": "part_number_stripped",
        "requested_condition_id": "condition_id", "line_item_description": "description", "confirmed_by_name": "user_name",
        "package_id": "o_package_id", "asset_id": "equipment_number", "line_item_status_id": "status_id",
    }
    plain = [
        "replacement_part_number", "replacement_part_number_stripped", "condition_code", "photo_shown", "return_required",
        "warranty_description", "line_item_po", "work_order_number", "serial_number_equipment", "serial_number", "serial_number_core",
        "model_number", "vrm_score", "urgency_code", "house_po_number", "invoice_number", "lead_time_days", "backorder_ship_date",
        "functional_location", "created_user_id", "created_timestamp", "sourced_date", "quoted_date", "closed_date", "confirmed_date",
        "po_date", "gsa_item", "hero_kit", "catalog", "pricing_rule_id", "pricing_rule_description", "nosale_reason_id",
        "oem_item_number", "purchase_id", "received_by_contact_id", "date_received", "payment_method", "manufacturer_fee",
        "exchange_fee", "customer_ship_fee", "minimum_order_fee", "confirmation_notes", "transit_coverage", "cost_center",
        "program_fee", "is_formulary_outright_option", "is_formulary_exchange_option", "contract_pro_id", "web_display_code",
        "esd_description", "estimated_shipping_date", "last_esd_updated_by", "customer_id", "vendor_id", "modality_id", "class_id",
        "oem_id", "requestor_id", "core_charge", "vendor_research_id", "backorder_followup_date",
    ]
    made = {
        "smart_price_selected": flags["smart_price_selected"], "smart_sourced": flags["smart_sourced"],
        "smart_sourcing_alternative": flags["alternative_offered"], "manual_research": flags["manual_sourced"],
        "smart_price_presented": one(F.col("had_smartpriced_research") == "Y"),
        "smart_source_presented": one(F.col("had_smartsourced_research") == "Y"),
        "subscription_name": F.when(F.col("o_id").isin(3, 4), F.col("o_status")).when(F.col("o_id") == 100, F.col("k_package_name"))
        .otherwise(F.col("o_package_name")),
        "subscription_type": F.when(F.col("o_id") == 100, F.col("k_type_name")).otherwise(F.col("o_type_name")),
        "smart_order_po": flag("has_smart_po"), "smart_order_conf": flag("has_conf"), "ever_backordered": flag("has_backorder"),
        "cust_edi_request": flag("has_request"), "vend_edi_request": flag("vend_850"), "vend_edi_conf": flag("vend_855"),
        "vend_edi_ship": flag("vend_856"), "oemdirect_ind": flag("has_direct"),
        "cust_edi_conf": flag("cust_855"), "cust_edi_ship": flag("cust_856"),
        "pim_item_number": first_present(F.col("rs_item_number"), F.col("catalogue_item"), fallback),
        "requested_quantity": qty, "catalog_part": F.when(F.col("inv_item_cost_id").isNotNull(), "Y").otherwise("N"),
        "repair_ind": one(repair), "service_ind": one((F.col("order_type_id") == 17) | (F.col("class_id") == 24)),
        "loaner_ind": one((F.col("order_type_id") == 37) | (F.col("class_id") == 17)),
        "product_category_id": F.coalesce("product_subcategory_id", F.lit(2)),
        "exchange_fee_charged": one(F.col("exchange_fee") > 0),
        "estimated_add_bill": row_double(F.when(F.col("return_required") == "Y", F.col("add_bill_unit_e4") * qty).otherwise(F.lit(0)), 4),
    }
    return j.select(*[F.col(c).alias(n) for n, c in named.items()], *plain, *[c.alias(n) for n, c in made.items()]).distinct()


def load_line_item_details(t: Warehouse, since: dt.date, path: str) -> DataFrame:
    """A4: full refresh of the dimension at ``path``; returns the table read back."""
    full_refresh(line_item_details(t, since), path)
    return current(t.spark, path)
