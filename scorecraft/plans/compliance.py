"""Vendor compliance (K8-K10), backorder trends (K11), vendor sales (K12), contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecraft.functions.codes import band
from scorecraft.functions.money import row_double, to_decimal, to_double, total
from scorecraft.functions.scalar import fixed_width, to_day
from scorecraft.functions.semantics import chop_last, ne_keep_missing, ratio
from scorecraft.operators.filters import has_text, period_pred
from scorecraft.operators.joins import full_merge, only_in, slots
from scorecraft.operators.windows import first_per_key
from scorecraft.sources.roles import Warehouse
from scorecraft.sources.tables import stage

MONEY = ("spend", "revenue", "margin")


def _non_contract(t: Warehouse) -> DataFrame:
    return t.line_detail.filter(F.col("contract_pro_id").isNull())


def _smart(lid_conf: str = "smart_order_conf") -> Column:
    return (F.col(lid_conf) == 1) & (F.col("smart_order_po") == 1) & (F.col("smart_price_presented") == 1)


def _sum_orders_if(cond: Column) -> Column:
    return F.sum(F.when(cond, F.col("orders")).otherwise(0))


# ---------------------------------------------------------------------------
# K8 / K9
# ---------------------------------------------------------------------------

def _vend_im(t: Warehouse) -> DataFrame:
    """Vendors with at least one vendor-type catalogue item."""
    return (t.items.filter(F.col("item_type") == "V")
            .select(F.col("company_id").alias("vendor_id")).distinct()
            .withColumn("coun", F.lit(1)))


def _vend_research(t: Warehouse, start, end) -> DataFrame:
    res = t.research.filter(period_pred("created_date", start, end)).select(
        "line_item_id", "research_type_code", "created_user_id", "vendor_id")
    lid = _non_contract(t).select("line_item_id")
    org = t.organization.select("organization_id", "user_name")
    ve = t.vendors.select(F.col("company_id").alias("vendor_id"), "company_name")
    rows = (res.join(lid, "line_item_id", "inner")
            .join(org, F.col("created_user_id") == F.col("organization_id"), "left"))
    entered = F.sum(F.when(F.col("user_name").isNull(), 1).otherwise(0))
    ss = F.sum(F.when(F.col("research_type_code") == "SS", 1).otherwise(0))
    sp = F.sum(F.when(F.col("research_type_code").isin("SP", "SPP"), 1).otherwise(0))
    n = F.count(F.lit(1))
    shares = rows.groupBy("vendor_id").agg(
        ratio(ss, n).alias("ss_research_pct"), ratio(sp, n).alias("sp_research_pct"),
        ratio(entered, n).alias("epv_research_pct"))
    # names after the aggregation: a hot vendor is combined in every task first
    return shares.join(ve, "vendor_id", "left").withColumn("vendor", fixed_width(F.col("company_name"), 100)).drop("company_name")


def _vend_orders(t: Warehouse, start, end) -> DataFrame:
    q = t.during("txn", start, end).filter(ne_keep_missing(F.col("vendor_id"), 0))
    v = t.vendors.select(
        F.col("company_id").alias("vendor_id"), "company_name", "smart_order_enabled", "smart_label_enabled",
        "payment_term_code", "company_type_code", "tier_code", "epv_member", "choice_level",
        "suspend_vendor", "redirect_shipments")
    lid = _non_contract(t).select("line_item_id", "smart_order_conf", "smart_order_po", "smart_price_presented")
    trk = t.tracking.filter(F.col("shipment_leg_id") == 1).select("line_item_id", "auto_label")
    rows = q.join(lid, "line_item_id", "inner").join(trk, "line_item_id", "left")
    orders = F.sum("orders")
    g = rows.groupBy("vendor_id").agg(
        ratio(F.sum(F.when(F.col("product_category_id") == 2, F.col("orders"))), orders).alias("bio_pct"),
        to_decimal(total("spend_e6"), 6, 38).alias("spend"),
        to_decimal(total("revenue_e4"), 4, 38).alias("revenue"),
        to_decimal(total("margin_e6"), 6, 38).alias("margin"),
        ratio(to_double(total("margin_e6"), 6), to_double(total("revenue_e4"), 4)).alias("margin_pct"),
        orders.cast("bigint").alias("orders"),
        ratio(_sum_orders_if(_smart()), orders).alias("smart_order_pct"),
        _sum_orders_if(_smart()).cast("bigint").alias("smart_order_total"),
        ratio(_sum_orders_if(F.col("smart_order_conf") == 1), orders).alias("smart_conf_pct"),
        _sum_orders_if(F.col("smart_order_conf") == 1).cast("bigint").alias("smart_conf_total"),
        ratio(_sum_orders_if(F.col("smart_order_po") == 1), orders).alias("smart_po_pct"),
        _sum_orders_if(F.col("smart_order_po") == 1).cast("bigint").alias("smart_po_total"),
        ratio(_sum_orders_if(F.col("auto_label") == "Y"), orders).alias("smart_label_pct"),
        _sum_orders_if(F.col("auto_label") == "Y").cast("bigint").alias("smart_label_total"),
    )
    g = g.filter(F.col("orders") > 0)  # HAVING on the alias (S8)
    measures = [c for c in g.columns if c != "vendor_id"]
    return g.join(v, "vendor_id", "left").join(_vend_im(t), "vendor_id", "left").select(
        "vendor_id", fixed_width(F.col("company_name"), 75).alias("vendor"),
        F.when(F.col("coun") == 1, "Y").otherwise("N").alias("vendor_in_im"),
        "smart_order_enabled", "smart_label_enabled",
        F.when(has_text("payment_term_code", "NET"), "Y").otherwise("N").alias("terms"),
        "company_type_code", "tier_code", F.col("epv_member").alias("epv_activated"),
        "choice_level", "suspend_vendor", "redirect_shipments", *measures)


def _vend_map(t: Warehouse) -> DataFrame:
    return t.vendor_mapping.groupBy("vendor_id").agg(
        F.countDistinct("oem_id").alias("oem_maps"), F.countDistinct("model_id").alias("model_maps"),
        F.countDistinct("modality_id").alias("modality_maps"), F.countDistinct("class_id").alias("class_maps"))


def _compliance(t: Warehouse, start, end) -> DataFrame:
    """K8 with money kept in decimal (exact totals for K9)."""
    v = _vend_orders(t, start, end).withColumnRenamed("vendor", "v_vendor")
    vr = _vend_research(t, start, end).withColumnRenamed("vendor", "vr_vendor")
    j = full_merge(v, vr, "vendor_id")
    vend = t.vendors.select(
        F.col("company_id").alias("vendor_id"), "relationship_manager_id", "relationship_manager",
        F.col("smart_label_enabled").alias("d_smart_label_enabled"), F.col("payment_term_code").alias("d_terms"),
        F.col("company_type_code").alias("d_type"), F.col("tier_code").alias("d_tier"),
        F.col("epv_member").alias("d_epv"), F.col("choice_level").alias("d_choice"),
        F.col("suspend_vendor").alias("d_suspend"), F.col("redirect_shipments").alias("d_redirect"))
    vim = _vend_im(t).withColumnRenamed("coun", "im_coun")
    vm = _vend_map(t).select("vendor_id", F.lit(1).alias("vm_present"))
    ao = (t.auto_order.filter(F.col("is_auto_order") == "Y")
          .select("vendor_id", "is_auto_order").distinct())
    j = (j.join(vend, "vendor_id", "left").join(vim, "vendor_id", "left")
         .join(vm, "vendor_id", "left").join(ao, "vendor_id", "left"))
    z = F.lit(0)
    zd = F.lit(0).cast("decimal(38,6)")
    return j.select(
        "vendor_id",
        F.coalesce("v_vendor", "vr_vendor").alias("vendor"),
        "relationship_manager_id", "relationship_manager",
        F.coalesce(F.col("bio_pct"), z.cast("double")).alias("bio_pct"),
        band(F.col("bio_pct"), 0.5, ("Biomed Supplier", "Biomed/Imaging Supplier", "Imaging Supplier")).alias("supplier_type"),
        F.when(F.col("vm_present").isNotNull(), "Y").otherwise("N").alias("mapping_exists"),
        F.coalesce(F.col("spend"), zd).alias("spend"),
        F.coalesce(F.col("revenue"), zd).alias("revenue"),
        F.coalesce(F.col("margin"), zd).alias("margin"),
        F.coalesce(F.col("margin_pct"), z.cast("double")).alias("margin_pct"),
        F.coalesce(F.col("orders"), z.cast("bigint")).alias("orders"),
        F.coalesce(F.col("vendor_in_im"), F.when(F.col("im_coun") == 1, "Y").otherwise("N")).alias("vendor_in_im"),
        F.coalesce(F.col("ss_research_pct"), z.cast("double")).alias("ss_research_pct"),
        F.coalesce(F.col("sp_research_pct"), z.cast("double")).alias("sp_research_pct"),
        F.coalesce(F.col("ss_research_pct") + F.col("sp_research_pct"), z.cast("double")).alias("im_research_pct"),
        F.coalesce(F.col("is_auto_order"), F.lit("N")).alias("smart_order_enabled"),
        F.coalesce(F.col("smart_order_total"), z.cast("bigint")).alias("number_of_smart_orders"),
        F.coalesce(F.col("smart_order_pct"), z.cast("double")).alias("smart_order_pct"),
        F.coalesce(F.col("smart_conf_total"), z.cast("bigint")).alias("number_of_smart_conf"),
        F.coalesce(F.col("smart_conf_pct"), z.cast("double")).alias("smart_conf_pct"),
        F.coalesce(F.col("smart_po_total"), z.cast("bigint")).alias("number_of_smart_po"),
        F.coalesce(F.col("smart_po_pct"), z.cast("double")).alias("smart_po_pct"),
        F.coalesce("smart_label_enabled", "d_smart_label_enabled").alias("smart_label_enabled"),
        F.coalesce(F.col("smart_label_pct"), z.cast("double")).alias("smart_label_pct"),
        F.coalesce(F.col("terms"), F.when(has_text("d_terms", "NET"), "Y").otherwise("N")).alias("terms"),
        F.coalesce("company_type_code", "d_type").alias("vendor_type"),
        F.coalesce("tier_code", "d_tier").alias("vendor_tier"),
        F.coalesce("epv_activated", "d_epv").alias("epv_activated"),
        F.coalesce(F.col("epv_research_pct"), z.cast("double")).alias("spv_research_pct"),
        F.coalesce("choice_level", "d_choice").alias("choice_level"),
        F.coalesce("suspend_vendor", "d_suspend").alias("suspended"),
        F.coalesce("redirect_shipments", "d_redirect").alias("no_drop_ship"),
        F.col("smart_label_total").alias("number_of_smart_labels"),
    )


def vendor_compliance(t: Warehouse, start, end) -> DataFrame:
    """K8: compliance summary per vendor (full join of order and research sides)."""
    df = _compliance(t, start, end).drop("number_of_smart_labels")
    return df.withColumns({c: F.col(c).cast("double") for c in MONEY})


def compliance_totals(t: Warehouse, start, end) -> DataFrame:
    """K9: one row of company totals over K8."""
    df = _compliance(t, start, end)
    orders = F.sum("orders")

    def yshare(c: str) -> Column:
        return ratio(F.sum(F.when(F.col(c) == "Y", 1)), F.count(c))

    return df.agg(
        F.lit("Company Totals").alias("totals"),
        F.sum("spend").cast("double").alias("spend"),
        F.sum("revenue").cast("double").alias("revenue"),
        F.sum("margin").cast("double").alias("margin"),
        ratio(F.sum("margin"), F.sum("revenue")).alias("margin_pct"),
        orders.cast("bigint").alias("orders"),
        yshare("vendor_in_im").alias("vendor_in_im_pct"),
        yshare("smart_order_enabled").alias("smart_order_enabled_pct"),
        F.sum("number_of_smart_orders").cast("bigint").alias("number_of_smart_orders"),
        ratio(F.sum("number_of_smart_orders"), orders).alias("smart_order_pct"),
        F.sum("number_of_smart_conf").cast("bigint").alias("number_of_smart_conf"),
        ratio(F.sum("number_of_smart_conf"), orders).alias("smart_conf_pct"),
        F.sum("number_of_smart_po").cast("bigint").alias("number_of_smart_po"),
        ratio(F.sum("number_of_smart_po"), orders).alias("smart_po_pct"),
        yshare("smart_label_enabled").alias("smart_label_enabled_pct"),
        # weighted by orders, each vendor's share times its orders is its labelled orders again: exact
        ratio(F.sum("number_of_smart_labels"), orders).alias("smart_label_pct"),
        yshare("terms").alias("terms_pct"),
    )


# ---------------------------------------------------------------------------
# K10
# ---------------------------------------------------------------------------

def compliance_details(t: Warehouse, start, end) -> DataFrame:
    """Compliance at line level (ordered lines only)."""
    q = t.during("txn", start, end).filter(ne_keep_missing(F.col("vendor_id"), 0) & (F.col("orders") == 1))
    v = t.vendors.select(F.col("company_id").alias("vendor_id"), F.col("company_name").alias("vendor"),
                         "relationship_manager_id", "relationship_manager")
    lid = _non_contract(t).select("line_item_id", "line_item_description", "smart_order_conf",
                                  "smart_order_po", "smart_price_presented")
    ship = t.shipping_info
    c = t.customers.select(F.col("company_id").alias("site_id"), F.col("company_name").alias("site_name"),
                           F.col("lvl1_company_id").alias("parent_id"), F.col("lvl1_company_name").alias("parent_name"))
    rows = q.join(lid, "line_item_id", "inner").join(ship, "line_item_id", "left")
    sums = rows.groupBy("vendor_id", "customer_id", "line_item_id", "line_item_description", "shipping_method").agg(
        to_double(total("spend_e6"), 6).alias("spend"),
        to_double(total("revenue_e4"), 4).alias("revenue"),
        to_double(total("margin_e6"), 6).alias("margin"),
        F.sum("orders").cast("bigint").alias("orders"),
        _sum_orders_if(_smart()).cast("bigint").alias("smart_order_total"),
        _sum_orders_if(F.col("smart_order_conf") == 1).cast("bigint").alias("smart_conf_total"),
        _sum_orders_if(F.col("smart_order_po") == 1).cast("bigint").alias("smart_po_total"),
    )
    # a line has one customer, so names can come after the aggregation
    return (sums.join(v, "vendor_id", "left").join(c, F.col("customer_id") == F.col("site_id"), "left")
            .drop("customer_id"))


# ---------------------------------------------------------------------------
# K11 backorder trends
# ---------------------------------------------------------------------------

def backorder_base(t: Warehouse, start, end) -> DataFrame:
    q = t.txn.filter(F.col("requests") == 1).select("line_item_id", "vendor_id", "requests")
    lid = t.line_detail.filter(ne_keep_missing(F.col("line_item_status_id"), 5)).select(
        "line_item_id", "ever_backordered", F.col("line_item_description").alias("description"),
        F.coalesce("replacement_part_number_stripped", "requested_part_number_stripped").alias("clean_part"))
    ls = t.line_status.filter(F.col("first_ordered_timestamp").isNotNull()
                              & period_pred("first_ordered_timestamp", start, end))
    v = t.vendors.select(F.col("company_id"), F.col("company_name").alias("vendor_name"),
                         "relationship_manager_id", "relationship_manager")
    cal = F.broadcast(t.calendar.select("date_key", "month_end"))
    rows = (q.join(lid, "line_item_id", "inner").join(ls, "line_item_id", "inner")
            .join(v, F.col("vendor_id") == F.col("company_id"), "left")
            .withColumn("ordered_date", to_day(F.col("first_ordered_timestamp")))
            .join(cal, F.col("ordered_date") == F.col("date_key"), "left"))
    return rows.select("line_item_id", "ordered_date", "month_end", "requests", "ever_backordered", "description",
                       F.col("company_id").alias("vendor_id"), "vendor_name", "relationship_manager_id",
                       "relationship_manager", "clean_part")


def backorder_vendor_summary(t: Warehouse, start, end, base: DataFrame | None = None) -> DataFrame:
    """K11 vendor summary: vendors with backorders (HAVING on the alias)."""
    b = base if base is not None else backorder_base(t, start, end)
    g = b.groupBy("vendor_id", "vendor_name", "relationship_manager_id", "relationship_manager").agg(
        F.sum("ever_backordered").cast("bigint").alias("backorders"),
        F.sum("requests").cast("bigint").alias("requests"),
        ratio(F.sum("ever_backordered"), F.sum("requests")).alias("backorder_percent"))
    return g.filter(F.col("backorders") > 0)


def backorder_trends(t: Warehouse, start, end) -> DataFrame:
    """Backorders per vendor x month x part, for vendors that have any.

    The backorder base is an intermediate table read three times (A3): it is
    staged once instead of re-joined for each use.
    """
    b = stage(t.spark, backorder_base(t, start, end), "backorders", f"{t.sf_dir}|{start}|{end}")
    # first description per vendor x part by order date (ties: line id, text)
    desc = first_per_key(b.select("vendor_id", "clean_part", "ordered_date", "line_item_id", "description"),
                         ["vendor_id", "clean_part"], ["ordered_date", "line_item_id", "description"])
    desc = desc.select(F.col("vendor_id").alias("e_vendor_id"), F.col("clean_part").alias("e_clean_part"),
                       F.col("description").alias("best_description"))
    vs = backorder_vendor_summary(t, start, end, b).select("vendor_id")
    b = only_in(b, vs, ["vendor_id"])
    j = b.join(desc, b.vendor_id.eqNullSafe(desc.e_vendor_id) & b.clean_part.eqNullSafe(desc.e_clean_part), "left")
    return j.groupBy("vendor_id", "vendor_name", "relationship_manager_id", "relationship_manager", "month_end",
                     "clean_part", F.col("best_description").alias("description")).agg(
        F.sum("ever_backordered").cast("bigint").alias("backorders"),
        F.sum("requests").cast("bigint").alias("requests"))


# ---------------------------------------------------------------------------
# K12 vendor sales
# ---------------------------------------------------------------------------

def vendor_sales(t: Warehouse, vendor: int, start, end, house_vendor: int) -> DataFrame:
    """One vendor's sales with 29 grouping columns; rows with any non-zero sum."""
    q = t.during("txn", start, end).filter(F.col("vendor_id") == vendor)
    lid = _non_contract(t).select(
        "line_item_id", "line_item_po", "replacement_part_number_stripped", "requested_part_number_stripped",
        "replacement_part_number", "requested_part_number", "line_item_description", "model_number",
        "photo_shown", "warranty_description", "condition_code")
    cust = t.customers.select(F.col("company_id").alias("customer_id"), F.col("company_name").alias("site_name"),
                              F.col("lvl1_company_id").alias("parent_id"),
                              F.col("lvl1_company_name").alias("parent_name"))
    v = t.vendors.select(F.col("company_id").alias("vendor_id"), F.col("company_name").alias("vendor_name"),
                         "relationship_manager_id", "relationship_manager")
    oem = t.oems.select(F.col("company_id").alias("oem_id"), F.col("company_name").alias("oem_name"))
    mod = F.broadcast(t.modalities)
    pcl = t.product_classes
    pca = F.broadcast(t.product_categories)
    org = t.organization.select(F.col("organization_id").alias("sourced_by_id"), F.col("user_name").alias("sourcer"))
    rows = (q.join(lid, "line_item_id", "inner").join(cust, "customer_id", "left").join(v, "vendor_id", "left")
            .join(oem, "oem_id", "left").join(mod, "modality_id", "left").join(pcl, "class_id", "left")
            .join(pca, "product_category_id", "inner").join(org, "sourced_by_id", "left"))
    house = F.col("vendor_id") == house_vendor
    clean_s = F.when(house, F.coalesce(chop_last(F.col("replacement_part_number_stripped")),
                                       F.col("requested_part_number_stripped"))) \
        .otherwise(F.coalesce("replacement_part_number_stripped", "requested_part_number_stripped"))
    clean = F.when(house, F.coalesce(chop_last(F.col("replacement_part_number")), F.col("requested_part_number"))) \
        .otherwise(F.coalesce("replacement_part_number", "requested_part_number"))
    keys = [
        F.col("line_item_id").alias("Line Item ID"), F.col("line_item_po").alias("House PO Number"),
        F.col("transaction_date").alias("PO Date"), F.col("customer_id").alias("Site ID"),
        F.col("site_name").alias("Site Name"), F.col("parent_id").alias("Parent ID"),
        F.col("parent_name").alias("Parent Name"), F.col("vendor_id").alias("Vendor ID"),
        F.col("vendor_name").alias("Vendor Name"), F.col("relationship_manager_id").alias("Relationship Manager ID"),
        F.col("relationship_manager").alias("Relationship Manager"), F.col("oem_id").alias("OEM ID"),
        F.col("oem_name").alias("OEM Name"), clean_s.alias("Clean Part Number Stripped"),
        clean.alias("Clean Part Number"), F.col("requested_part_number").alias("Requested Part Number"),
        F.col("replacement_part_number").alias("Replacement Part Number"),
        F.col("line_item_description").alias("Description"),
        F.col("product_category_description").alias("Product Category"),
        F.col("modality_code").alias("Modality"), F.col("class_code").alias("Product Type"),
        F.col("model_number").alias("Model"), F.col("photo_shown").alias("Photo Shown"),
        F.col("warranty_description").alias("Warranty"), F.col("sourcer").alias("Sourcer"),
        F.col("condition_code").alias("Condition"), row_double("oem_price_e2", 2).alias("Unit OEM List"),
        row_double("price_e2", 2).alias("Unit Price"), row_double("cost_e3", 3).alias("Unit Cost"),
    ]
    g = rows.groupBy(*keys).agg(
        F.sum("orders").cast("bigint").alias("Orders"), F.sum("quantity").cast("bigint").alias("Quantity"),
        total("revenue_e4").alias("rev"), total("margin_e6").alias("mar"), total("spend_e6").alias("spd"))
    keep = ((F.col("Orders") != 0) | (F.col("Quantity") != 0) | (F.col("rev") != 0) | (F.col("mar") != 0))
    return g.filter(keep).select(
        *[c for c in g.columns if c not in ("rev", "mar", "spd")],
        to_double("rev", 4).alias("Revenue"), to_double("mar", 6).alias("Margin"),
        to_double("spd", 6).alias("Spend"))


# ---------------------------------------------------------------------------
# K13 vendor contacts
# ---------------------------------------------------------------------------

TRANSMISSION_SLOTS = ("next_am_transmission", "next_day_transmission", "second_day_transmission",
                      "ground_transmission", "other_transmission")


CONTACT_FIELDS = ("email", "sales_representative", "fax", "direct_line", "website", "cell_phone", "alternate_phone",
                  "alternate_fax", "pager", "emergency_phone")


def vendor_contacts(t: Warehouse) -> DataFrame:
    """Active vendor contacts with five auto-order settings (one pivot, one join)."""
    cr = t.contacts.filter((F.col("active") == "Y") & (F.col("cc_active") == "Y") & (F.col("vendor_ind") == "Y"))
    v = t.vendors.select(F.col("company_id").alias("v_company_id"), "relationship_manager_id",
                         "relationship_manager", "smart_order_enabled", "smart_label_enabled")
    r = t.requestors.select(F.col("requestor_id").alias("r_id"), "requestor_name")
    j = (cr.join(v, cr.company_id == v.v_company_id, "left")
         .join(r, cr.requestor_id == r.r_id, "left"))
    j = slots(j, t.auto_order, key="company_id", rank="ship_priority_id", value="settings", k=5,
              prefix="slot_", child_key="vendor_id")
    return j.select(
        F.col("requestor_id").alias("contact_id"), "company_id", "company_name", "relationship_manager_id",
        "relationship_manager", F.col("requestor_name").alias("name"), "first_name", "last_name",
        "smart_order_enabled", "smart_label_enabled", F.col("position_description").alias("position"),
        F.col("main_phone").alias("phone"), *CONTACT_FIELDS,
        *[F.col(f"slot_{i + 1}").alias(n) for i, n in enumerate(TRANSMISSION_SLOTS)])
