"""DuckDB oracle SQL for the operator-level queries (sections 2.A-2.J)."""

from __future__ import annotations

from oracle import queries as Q
from oracle.queries import ASOF, END, START, q
from oracle.roles import ROLE_CTES

ORACLE = Q.ORACLE_SQL

# --- 2.A --------------------------------------------------------------------
_roles = [name for name, _ in ROLE_CTES if name != "cal_days"]
q("A1_named_scan", "\nUNION ALL\n".join(f"SELECT '{r}' AS role, count(*) AS row_count FROM {r}" for r in _roles))
q("A2_source_query", "SELECT * FROM codes", Q.K17_CTES)
ORACLE["A4_full_refresh"] = ORACLE["K8_vendor_compliance"]
q("A5_report", """
SELECT vendor_id AS "Vendor ID", vendor_name AS "Vendor Name", backorders AS "Backorders", requests AS "Requests",
       backorder_percent AS "Backorder Percent"
FROM late_vendors""", Q.K11_CTES)
q("A7_split_by", "SELECT * FROM k22out WHERE product_type <> 'Total'", Q.K22_CTES + [("k22out", Q.K22_MAIN)])

# --- 2.B --------------------------------------------------------------------
q("B1_derive", """
SELECT line_item_id, vendor_id, item_id, CAST(revenue - margin AS DOUBLE) AS parts_cost,
       CAST(oem_price * quantity AS DOUBLE) AS oem_list
FROM txn""")
q("B2_keep", "SELECT date_key, workday_ind FROM calendar")
q("B3_derive_star", "SELECT *, CASE WHEN payment_term_code LIKE '%NET%' THEN 'Y' ELSE 'N' END AS terms FROM vendors")
q("B4_in_period", f"""
SELECT vendor_id, count(*) AS rows_in_period FROM txn
WHERE transaction_date BETWEEN {START} AND {END} GROUP BY vendor_id""")
q("B5_since", f"""
SELECT last_day(CAST(first_ordered_timestamp AS DATE)) AS month_end, count(*) AS lines FROM line_status
WHERE CAST(first_ordered_timestamp AS DATE) >= {START} GROUP BY 1""")
q("B6_not_in", """
SELECT q.product_category_id, count(*) AS rows, CAST(sum(q.revenue) AS DOUBLE) AS revenue
FROM txn q LEFT JOIN customers c ON c.company_id = q.customer_id
WHERE c.lvl1_company_id IS NULL OR c.lvl1_company_id NOT IN (3, 5)
GROUP BY 1""")
q("B7_ne", """
SELECT segment, sub_segment, count(*) AS rows, CAST(sum(actual_revenue) AS DOUBLE) AS revenue
FROM daily_actuals WHERE sub_segment IS DISTINCT FROM 'ARAMARK' GROUP BY 1, 2""")
q("B8_missing_lowest", """
SELECT (exchange_cost IS NULL OR exchange_cost <= 0.01) AS exchange_at_floor,
       (outright_cost IS NULL OR outright_cost <= 0.01) AS outright_at_floor, count(*) AS quotes
FROM research GROUP BY 1, 2""")
q("B9_present", """
SELECT shipment_leg_id, count(CASE WHEN date_delivered IS NOT NULL THEN 1 END) AS delivered,
       count(CASE WHEN date_delivered IS NULL THEN 1 END) AS not_delivered
FROM tracking GROUP BY 1""")
q("B10_large_only", """
SELECT * FROM (SELECT line_item_id, CAST(sum(revenue) AS DOUBLE) AS ext_price FROM txn GROUP BY 1)
WHERE ext_price >= 100000 OR ext_price IS NULL OR ext_price <= -100000""")
q("B11_active_only", """
SELECT company_id, count(*) AS contacts FROM contacts
WHERE active = 'Y' AND cc_active = 'Y' AND vendor_ind = 'Y' GROUP BY 1""")
q("B12_by_filter", """
SELECT pip.search_item_number, i.ps_structure_id, i.company_id AS vendor_id, io.oem_name AS oem_id,
       t.structure_id AS taxonomy_id
FROM item_prices pip
LEFT JOIN items i ON i.item_number = pip.search_item_number
LEFT JOIN items io ON io.item_number = pip.oem_item_number
LEFT JOIN (SELECT product_number, structure_id FROM oem_structure_products WHERE oem_id = 2) t
       ON t.product_number = pip.product_number
WHERE i.ps_structure_id IN (SELECT structure_id FROM product_structure WHERE parent_name = 'Group 2')""")
q("B13_has_text", "SELECT company_id, coalesce(payment_term_code LIKE '%NET%', false) AS net_terms FROM vendors")
q("B14_having", "SELECT * FROM late_vendors", Q.K11_CTES)
q("B15_distinct", "SELECT DISTINCT price_rule_id FROM pricing_rules WHERE prod_seg_part_number IS NOT NULL")
ORACLE["B16_distinct_wide"] = ORACLE["K24_line_item_details"]
q("B17_tag", "SELECT DISTINCT company_id AS vendor_id, 1 AS coun FROM items WHERE item_type = 'V'")
q("B18_scalar", "SELECT CAST(month_workdays AS BIGINT) AS month_workdays, CAST(week_workdays AS BIGINT) "
  "AS week_workdays, week_start AS wk_start FROM now_", Q.K19_CTES[:1])
q("B19_classify", """
SELECT smart_price_selected, smart_sourced, smart_sourcing_alternative, manual_research, count(*) AS lines
FROM loaded GROUP BY 1, 2, 3, 4""", Q.K24_CTES)
q("B20_map_codes", """
SELECT CASE WHEN responsibility = 'C' THEN 'Customer' WHEN responsibility = 'P' THEN 'House'
            WHEN responsibility IN ('V', 'N') THEN 'Vendor' WHEN responsibility = 'S' THEN 'Shipping'
            ELSE 'other' END AS label, count(*) AS returns
FROM returns GROUP BY 1""")
q("B21_transit_days", f"""
SELECT {Q.TRANSIT_CASE} AS transit_days, count(*) AS lines
FROM shipping_info s LEFT JOIN ship_methods sm ON sm.shipping_method = s.shipping_method GROUP BY 1""")
q("B22_band", "SELECT supplier_type, count(*) AS vendors FROM k4 GROUP BY 1", [Q.SALES, ("k4", Q.K4_SQL)])
q("B23_exists_flag", """
SELECT CASE WHEN t.line_item_id IS NOT NULL THEN 1 ELSE 0 END AS has_leg2, count(*) AS lines
FROM line_detail l LEFT JOIN (SELECT line_item_id FROM tracking WHERE shipment_leg_id = 2) t
  ON t.line_item_id = l.line_item_id
GROUP BY 1""")
q("B24_first_present", """
SELECT line_item_id, coalesce(replacement_part_number_stripped, requested_part_number_stripped) AS clean_part
FROM line_detail""")
q("B25_effective_cost", """
SELECT line_item_id, vendor_id, item_id,
       CAST(CASE WHEN exchange_cost IS NULL OR exchange_cost <= 0.01 THEN outright_cost
                 WHEN outright_cost IS NULL OR outright_cost <= 0.01 THEN exchange_cost
                 WHEN exchange_cost < outright_cost THEN exchange_cost ELSE outright_cost END AS DOUBLE) AS new_cost
FROM research WHERE outright_cost > 0.01 OR exchange_cost > 0.01""")
q("B26_txn_type", """
SELECT CASE WHEN orders > 0 AND returns = 0 THEN 'O' WHEN orders = 0 AND returns > 0 THEN 'R'
            WHEN orders > 0 AND returns > 0 THEN 'O/R' WHEN orders = 0 AND returns = 0 THEN 'PC'
            ELSE 'N/A' END AS type, count(*) AS lines
FROM (SELECT line_item_id, transaction_date, sum(orders) AS orders, sum(returns) AS returns FROM txn GROUP BY 1, 2)
GROUP BY 1""")
q("B27_segment", f"""
SELECT {Q._segment(2, repr('Provider'))} AS segment, {Q._segment(3, '3')} AS segment_sort, count(*) AS customers FROM customers GROUP BY 1, 2""")

# --- 2.C --------------------------------------------------------------------
q("C1_inner", """
SELECT l.vendor_id, count(*) AS returns FROM returns r JOIN line_detail l ON l.line_item_id = r.line_item_id
GROUP BY 1""")
q("C2_left", """
SELECT v.company_id AS vendor_id, v.company_name, coalesce(r.quotes, 0) AS quotes
FROM vendors v LEFT JOIN (SELECT vendor_id, count(*) AS quotes FROM research GROUP BY 1) r
  ON r.vendor_id = v.company_id""")
q("C3_star", """
SELECT v.company_type_code, pc.product_category_description, m.modality_code,
       CAST(sum(q.orders) AS BIGINT) AS orders, CAST(sum(q.revenue) AS DOUBLE) AS revenue
FROM txn q
LEFT JOIN vendors v ON v.company_id = q.vendor_id
LEFT JOIN customers c ON c.company_id = q.customer_id
LEFT JOIN oems o ON o.company_id = q.oem_id
LEFT JOIN modalities m ON m.modality_id = q.modality_id
LEFT JOIN product_classes pcl ON pcl.class_id = q.class_id
JOIN product_categories pc ON pc.product_category_id = q.product_category_id
GROUP BY 1, 2, 3""")
q("C4_wide_star", """
SELECT condition_code, warranty_description, urgency_code, count(*) AS lines FROM loaded GROUP BY 1, 2, 3""",
  Q.K24_CTES)
q("C5_full_merge", """
SELECT coalesce(v.vendor_id, r.vendor_id) AS vendor_id, v.has_orders, r.has_research
FROM (SELECT vendor_id, 1 AS has_orders FROM ordering) v
FULL JOIN (SELECT vendor_id, 1 AS has_research FROM quoting) r ON r.vendor_id = v.vendor_id""", Q.K8_CTES)
q("C6_left_where", """
SELECT q.vendor_id, CAST(sum(CASE WHEN t.tracking_number IS NOT NULL THEN q.orders ELSE 0 END) AS BIGINT)
         AS tracking_provided
FROM txn q LEFT JOIN tracking t ON t.line_item_id = q.line_item_id AND t.shipment_leg_id = 1
GROUP BY 1""")
q("C7_join_on_expr", """
SELECT c.month_end, count(*) AS returns FROM returns r
LEFT JOIN calendar c ON c.date_key = CAST(r.created_timestamp AS DATE) GROUP BY 1""")
q("C8_self_match", """
SELECT a.vendor_id, count(*) AS pairs FROM txn a JOIN txn b
  ON a.vendor_id = b.vendor_id AND a.line_item_id = b.line_item_id
GROUP BY 1""")
q("C9_role_join", """
SELECT ls.line_item_id, clo.workday_ind AS closed_workday, ord.workday_ind AS ordered_workday,
       del.workday_ind AS delivered_workday
FROM line_status ls
LEFT JOIN (SELECT line_item_id, date_delivered FROM tracking WHERE shipment_leg_id = 1) t
  ON t.line_item_id = ls.line_item_id
LEFT JOIN calendar clo ON clo.date_key = CAST(ls.first_closed_timestamp AS DATE)
LEFT JOIN calendar ord ON ord.date_key = CAST(ls.first_ordered_timestamp AS DATE)
LEFT JOIN calendar del ON del.date_key = CAST(t.date_delivered AS DATE)""")
q("C10_with_parent", """
SELECT p.product_number, p.structure_id, t.parent_structure_id, t.parent_name
FROM oem_structure_products p LEFT JOIN taxonomy t ON t.structure_id = p.structure_id
WHERE p.oem_id = 2""", Q.K17_CTES)
q("C11_workdays_between", """
SELECT line_item_id, own_vendor AS vendor_id, ctime, delivered, CAST(clo_del_days AS BIGINT) AS clo_del_days FROM deliveries""", Q.K5_CTES)
q("C12_slots", """
SELECT k.vendor_id, a1.settings AS priority_1, a2.settings AS priority_2, a3.settings AS priority_3,
       a4.settings AS priority_4, a5.settings AS priority_5
FROM (SELECT DISTINCT vendor_id FROM auto_order) k
LEFT JOIN auto_order a1 ON a1.vendor_id = k.vendor_id AND a1.ship_priority_id = 1
LEFT JOIN auto_order a2 ON a2.vendor_id = k.vendor_id AND a2.ship_priority_id = 2
LEFT JOIN auto_order a3 ON a3.vendor_id = k.vendor_id AND a3.ship_priority_id = 3
LEFT JOIN auto_order a4 ON a4.vendor_id = k.vendor_id AND a4.ship_priority_id = 4
LEFT JOIN auto_order a5 ON a5.vendor_id = k.vendor_id AND a5.ship_priority_id = 5""")
q("C13_keep_extreme", """
SELECT c.line_item_id, o.user_name, c.confirmation_notes
FROM confirmations c LEFT JOIN organization o ON o.organization_id = c.confirmed_by_id
WHERE c.created_timestamp = (SELECT max(x.created_timestamp) FROM confirmations x WHERE x.line_item_id = c.line_item_id)""")
q("C14_only_in", """
SELECT b.vendor_id, count(*) AS rows FROM requested b
WHERE EXISTS (SELECT 1 FROM late_vendors v WHERE v.vendor_id IS NOT DISTINCT FROM b.vendor_id)
GROUP BY 1""", Q.K11_CTES)
q("C15_prior_year", """
SELECT a.year, a.month, CAST(a.revenue AS DOUBLE) AS revenue, CAST(b.revenue AS DOUBLE) AS py_revenue
FROM c15m a LEFT JOIN c15m b ON a.year = b.year + 1 AND a.month = b.month""",
  [("c15m", "SELECT CAST(year(transaction_date) AS INTEGER) AS year, CAST(month(transaction_date) AS INTEGER) "
            "AS month, sum(revenue) AS revenue "
            "FROM txn GROUP BY 1, 2")])
q("C16_lookup_agg", """
SELECT me.month_end,
  (SELECT max(workday_nbr_mtd) FROM calendar c WHERE c.date_key = me.month_end) AS workdays,
  (SELECT max(workday_nbr_ytd) FROM calendar c WHERE c.date_key = me.month_end) AS workdays_ytd,
  (SELECT max(workday_nbr_mtd) FROM calendar c
    WHERE year(c.date_key) = year(me.month_end) - 1 AND month(c.date_key) = month(me.month_end)) AS workdays_py_mtd,
  (SELECT max(workday_nbr_mtd) FROM calendar c
    WHERE year(c.date_key) = year(me.month_end) AND month(c.date_key) = month(me.month_end)) AS workdays_cy_mtd
FROM (SELECT DISTINCT month_end FROM calendar) me""")
q("C17_filter_before_join", "SELECT r.*, left(v.company_name, 100) AS vendor FROM quoting r LEFT JOIN vendors v ON v.company_id = r.vendor_id", Q.K8_CTES)
q("C18_join_ns", """
SELECT d.description AS best_description, CAST(sum(b.requests) AS BIGINT) AS requests
FROM requested b LEFT JOIN part_texts d
  ON d.vendor_id IS NOT DISTINCT FROM b.vendor_id AND d.clean_part IS NOT DISTINCT FROM b.clean_part
GROUP BY 1""", Q.K11_CTES)

# --- 2.D --------------------------------------------------------------------
q("D1_sum_by", """
SELECT vendor_id, last_day(transaction_date) AS month_end, CAST(sum(requests) AS BIGINT) AS requests,
       CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(quantity) AS BIGINT) AS quantity,
       CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(margin) AS DOUBLE) AS margin
FROM txn GROUP BY 1, 2""")
q("D2_sum_if", """
SELECT q.vendor_id,
       CAST(sum(CASE WHEN l.smart_order_conf = 1 THEN q.orders ELSE 0 END) AS BIGINT) AS smart_conf_total,
       CAST(sum(CASE WHEN l.smart_order_po = 1 THEN q.orders ELSE 0 END) AS BIGINT) AS smart_po_total,
       CAST(sum(CASE WHEN q.product_category_id = 2 THEN q.orders END) AS BIGINT) AS biomed_orders
FROM txn q JOIN line_detail l ON l.line_item_id = q.line_item_id GROUP BY 1""")
q("D3_weighted_sum", """
SELECT q.vendor_id, CAST(sum(l.smart_price_selected * q.requests) AS BIGINT) AS smart_priced_requests,
       CAST(sum(l.smart_sourced * q.requests) AS BIGINT) AS smart_sourced_requests,
       CAST(sum(l.photo_shown * q.requests) AS BIGINT) AS photo_requests
FROM txn q JOIN line_detail l ON l.line_item_id = q.line_item_id GROUP BY 1""")
q("D4_count_if", """
SELECT vendor_id, count(CASE WHEN result_code IN ('HP', 'EHP') THEN line_item_id END) AS has_part,
       count(CASE WHEN outright_cost IS NOT NULL THEN outright_cost END) AS priced
FROM research GROUP BY 1""")
q("D5_distinct_count", """
SELECT vendor_id, count(DISTINCT oem_id) AS oem_maps, count(DISTINCT model_id) AS model_maps,
       count(DISTINCT modality_id) AS modality_maps, count(DISTINCT class_id) AS class_maps
FROM vendor_mapping GROUP BY 1""")
q("D6_row_count", "SELECT item_number, count(*) AS photos FROM pim_images GROUP BY 1")
q("D7_extremes", """
SELECT vendor_id, min(transaction_date) AS first_date, max(transaction_date) AS last_date FROM txn GROUP BY 1""")
q("D8_any_flag", """
SELECT line_item_id, max(research_type_id) AS researchtypemax, min(research_type_id) AS researchtypemin,
       CAST(bool_or(research_type_id IN (2, 3)) AS INTEGER) AS sppresearch, CAST(bool_or(created_user_id = 3) AS INTEGER) AS system_flag
FROM research GROUP BY 1""")
q("D9_sum_over_mean", """
SELECT c.month_end, CAST(sum(q.revenue) AS DOUBLE) / nullif(avg(CAST(c.workday_nbr_mtd AS DOUBLE)), 0)
         AS revenue_per_mean_workday
FROM txn q JOIN calendar c ON c.date_key = q.transaction_date GROUP BY 1""")
q("D10_ratio", """
SELECT vendor_id, CAST(sum(margin) AS DOUBLE) / nullif(CAST(sum(revenue) AS DOUBLE), 0) AS margin_pct
FROM txn GROUP BY 1""")
q("D11_flag_share", """
SELECT tier_code,
       CAST(sum(CASE WHEN smart_order_enabled = 'Y' THEN 1 END) AS DOUBLE)
         / nullif(CAST(count(smart_order_enabled) AS DOUBLE), 0) AS smart_order_share,
       CAST(sum(CASE WHEN payment_term_code = 'NET30' THEN 1 END) AS DOUBLE)
         / nullif(CAST(count(payment_term_code) AS DOUBLE), 0) AS net30_share
FROM vendors GROUP BY 1""")
q("D12_wavg", """
SELECT vendor_type, CAST(CAST(sum(smart_label_pct * orders) / nullif(CAST(sum(orders) AS DOUBLE), 0)
                              AS DECIMAL(38,12)) AS DOUBLE) AS smart_label_pct
FROM compliance GROUP BY 1""", Q.K8_CTES)
q("D13_grand_total", """
SELECT CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(orders) AS BIGINT) AS orders,
       CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(margin) AS DOUBLE) AS margin,
       CAST(sum(margin) AS DOUBLE) / nullif(CAST(sum(revenue) AS DOUBLE), 0) AS margin_pct
FROM txn""")
q("D14_with_total", f"""
SELECT {Q._segment(2, repr('Provider'))} AS segment, {Q._segment(3, '3')} AS segment_sort,
       CAST(sum(actual_revenue) AS DOUBLE) AS actual_revenue, CAST(sum(budget_revenue) AS DOUBLE) AS budget_revenue
FROM daily_actuals GROUP BY 1, 2
UNION ALL
SELECT 'Estimated Total', 99, CAST(sum(actual_revenue) AS DOUBLE), CAST(sum(budget_revenue) AS DOUBLE)
FROM daily_actuals""")
_d15 = []
for seg, where in [("Total", ""),
                   ("Biomed", "WHERE product_category_description IN ('Biomed', 'Stryker')"),
                   ("Imaging", "WHERE product_category_description IS NULL "
                               "OR product_category_description NOT IN ('Biomed', 'Stryker')")]:
    ar, br = "CAST(sum(actual_revenue) AS DOUBLE)", "CAST(sum(budget_revenue) AS DOUBLE)"
    am, bm = "CAST(sum(actual_margin) AS DOUBLE)", "CAST(sum(budget_margin) AS DOUBLE)"
    _d15.append(f"SELECT '{seg}' AS customer_segment, 'Revenue' AS metric, {ar} AS actual, {br} AS budget, "
                f"({ar} - {br}) / nullif({br}, 0) AS var_pct FROM daily_actuals {where}")
    _d15.append(f"SELECT '{seg}', 'Margin', {am}, {bm}, ({am} - {bm}) / nullif({bm}, 0) FROM daily_actuals {where}")
    _d15.append(f"SELECT '{seg}', 'GM %', {am} / nullif({ar}, 0), {bm} / nullif({br}, 0), CAST(NULL AS DOUBLE) "
                f"FROM daily_actuals {where}")
q("D15_metric_grid", "\nUNION ALL\n".join(_d15))
q("D16_best_day", """
SELECT month_end, CAST(sum(orders) AS BIGINT) AS orders, CAST(max(orders) AS BIGINT) AS best_orders,
       CAST(sum(margin) AS DOUBLE) AS margin, CAST(max(margin) AS DOUBLE) AS best_margin
FROM (SELECT last_day(transaction_date) AS month_end, transaction_date, sum(orders) AS orders,
             sum(margin) AS margin FROM txn GROUP BY 1, 2)
GROUP BY 1""")
q("D17_period_to_date", "SELECT segment, product_category_description, "
  + ", ".join(f"CAST({p}_{k}_{m} AS DOUBLE) AS {p}_{k}_{m}" for p in ("cy_mtd", "cy_ytd", "py_mtd", "py_ytd")
              for k in ("actual", "budget") for m in ("revenue", "margin"))
  + " FROM spans", Q.K21_CTES[:1])
q("D18_per_workday", """
SELECT m.month_end, c.workdays, CAST(m.revenue AS DOUBLE) / nullif(CAST(c.workdays AS DOUBLE), 0)
         AS revenue_per_workday
FROM (SELECT last_day(transaction_date) AS month_end, sum(revenue) AS revenue FROM txn GROUP BY 1) m
LEFT JOIN (SELECT month_end, CAST(sum(workday_ind) AS BIGINT) AS workdays FROM calendar GROUP BY 1) c
  ON c.month_end = m.month_end""")
q("D19_remerge", """
SELECT r.vendor_id, r.line_item_id, r.rga_number, CAST(r.rev AS DOUBLE) AS rev, g.rtn_count,
       CAST(g.group_rev AS DOUBLE) AS group_rev
FROM d19rows r
JOIN (SELECT vendor_id, line_item_id, rga_number, count(line_item_id) AS rtn_count, sum(rev) AS group_rev
      FROM d19rows GROUP BY ALL) g
  ON g.vendor_id IS NOT DISTINCT FROM r.vendor_id AND g.line_item_id = r.line_item_id
 AND g.rga_number = r.rga_number""",
  [("d19rows", """
SELECT q.vendor_id, r.line_item_id, r.rga_number, r.quantity * q.price AS rev
FROM returns r LEFT JOIN txn q ON q.line_item_id = r.line_item_id AND q.orders = 1
WHERE r.rga_type_id IN (2, 4) AND r.active = 'Y'""")])
q("D20_group_by_exprs", """
SELECT CAST(year(transaction_date) AS INTEGER) AS year, CAST(quarter(transaction_date) AS INTEGER) AS quarter,
       CASE WHEN product_category_id = 2 THEN 'Biomed' ELSE 'Imaging' END AS product_type,
       CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(revenue) AS DOUBLE) AS revenue
FROM txn GROUP BY 1, 2, 3""")

# --- 2.E / 2.F / 2.G ----------------------------------------------------------
q("E1_first_per_key", """
SELECT line_item_id, received_by_contact_id, date_received FROM received_parts
QUALIFY row_number() OVER (PARTITION BY line_item_id ORDER BY date_received, received_by_contact_id) = 1""")
q("E2_rank_in_group", """
SELECT item_number, model_code, product_number,
       CAST(row_number() OVER (PARTITION BY item_number ORDER BY model_code) AS INTEGER) AS rank
FROM item_models""", Q.K18_CTES)
q("E3_first_of_group", "SELECT * FROM part_texts", Q.K11_CTES)
q("E4_latest_ties", """
SELECT r.line_item_id, r.rga_number, r.created_timestamp FROM returns r
JOIN (SELECT line_item_id, max(created_timestamp) AS m FROM returns GROUP BY 1) x
  ON x.line_item_id = r.line_item_id AND x.m = r.created_timestamp""")
q("E5_top_slots", f"SELECT search_item_number, {Q._slots('ref_list', 'reference')} FROM ref_list", Q.K18_CTES)
q("E6_workday_numbers", "SELECT date_key, workday_nbr_mtd, workday_nbr_ytd FROM calendar")
q("F1_sort_by", """
SELECT vendor_id, clean_part, ordered_date, line_item_id FROM requested
ORDER BY vendor_id NULLS FIRST, clean_part, ordered_date, line_item_id""", Q.K11_CTES)
q("F2_sort_desc", """
SELECT vendor_id, vendor, CAST(spend AS DOUBLE) AS spend FROM compliance ORDER BY spend DESC NULLS LAST, vendor_id""",
  Q.K8_CTES)
q("F3_sort_before_by", """
SELECT *, CAST(row_number() OVER (PARTITION BY search_item_number ORDER BY part_number) AS INTEGER) AS rank FROM item_refs""", Q.K18_CTES)
q("F4_display_order", """
SELECT segment, segment_sort, actual_revenue_year FROM k19out ORDER BY segment_sort, segment""",
  Q.K19_CTES + [("k19out", Q.K19_MAIN)])
q("G1_stack_rows", f"""
SELECT 'actuals' AS source, CAST(year(transaction_date) AS INTEGER) AS year, CAST(sum(budget_revenue) AS DOUBLE) AS budget_revenue
FROM daily_actuals GROUP BY 2
UNION ALL
SELECT 'supplement', CAST(year(c.date_key) AS INTEGER), {Q.stable('sum(CAST(b.budget_revenue AS DOUBLE) / b.days * c.workday_ind)')}
FROM calendar c JOIN budget_supplement b ON b.month_end = c.month_end GROUP BY 2""")
q("G2_detail_and_total", """
SELECT product_category_id, CAST(sum(revenue) AS DOUBLE) AS revenue FROM txn GROUP BY 1
UNION ALL
SELECT 99, CAST(sum(revenue) AS DOUBLE) FROM txn""")
ORACLE["G3_metric_rows"] = ORACLE["K21_summary_statistics"]

# --- 2.H --------------------------------------------------------------------
q("H1_to_day", "SELECT line_item_id, CAST(first_closed_timestamp AS DATE) AS closed_date FROM line_status")
q("H2_seconds_of_day", """
SELECT line_item_id, CAST(hour(first_closed_timestamp) * 3600 + minute(first_closed_timestamp) * 60
       + second(first_closed_timestamp) AS INTEGER) AS closed_seconds FROM line_status""")
q("H3_year_month", """
SELECT CAST(year(transaction_date) AS INTEGER) AS year, CAST(month(transaction_date) AS INTEGER) AS month,
       count(*) AS rows FROM txn GROUP BY 1, 2""")
q("H4_period_start", """
SELECT date_key, CAST(date_trunc('month', date_key) AS DATE) AS month_start,
       CAST(date_trunc('year', date_key) AS DATE) AS year_start FROM calendar""")
q("H5_month_end", "SELECT line_item_id, vendor_id, item_id, last_day(transaction_date) AS month_end FROM txn")
q("H6_trend_start", """
SELECT month_end, CAST(date_trunc('month', month_end) - INTERVAL 12 MONTH AS DATE) AS trend_start
FROM (SELECT DISTINCT month_end FROM calendar)""")
q("H7_default_asof", """
SELECT vendor_id, count(*) AS rows FROM txn WHERE transaction_date <= current_date - 1 GROUP BY 1""")
q("H8_is_workday", """
SELECT dow, CAST(sum(CASE WHEN dow BETWEEN 2 AND 6 AND NOT ps_hol_ind = 1 THEN 1 ELSE 0 END) AS BIGINT) AS workdays,
       count(*) AS days
FROM calendar GROUP BY 1""")
q("H9_week_start", """
SELECT CAST(date_trunc('week', transaction_date) AS DATE) AS week_start, count(*) AS rows FROM txn GROUP BY 1""")
q("H10_coalesce", "SELECT company_id, coalesce(relationship_manager, 'Unassigned') AS manager FROM vendors")
q("H11_norm_text", """
SELECT company_id, upper(ltrim(segment)) AS segment_norm, upper(ltrim(sub_segment)) AS sub_segment_norm
FROM customers""")
q("H12_chop_last", """
SELECT line_item_id, nullif(left(rtrim(replacement_part_number_stripped),
                                 greatest(length(rtrim(replacement_part_number_stripped)) - 1, 0)), '') AS chopped
FROM line_detail""")
q("H13_parent_code", """
SELECT structure_id, split_part(structure_id, '.', 1) || '.0.0.0.0.0.0' AS parent_structure_id FROM oem_structure""")
q("H14_fixed_width", "SELECT company_id, substr(company_name, 1, 10) AS name10 FROM vendors")
q("H15_to_number", """
SELECT requestor_id, TRY_CAST(last_name AS DOUBLE) AS last_name_number,
       TRY_CAST(position_description AS DOUBLE) AS position_number
FROM contacts""")
q("H16_to_int", "SELECT id_no, CAST(trunc(quantity + return_quantity) AS INTEGER) AS requested_quantity FROM line_items")
q("H17_arithmetic", """
SELECT line_item_id, vendor_id, item_id, CAST(outright_cost - exchange_cost AS DOUBLE) AS cost_gap,
       CAST(exchange_cost AS DOUBLE) / nullif(CAST(outright_cost AS DOUBLE), 0) AS exchange_share
FROM research""")
q("H18_position", "SELECT company_id, CAST(strpos(payment_term_code, 'NET') AS INTEGER) AS net_position FROM vendors")

# --- 2.I / 2.J ----------------------------------------------------------------
ORACLE["I1_transpose"] = ORACLE["K23_monthly_trend"]
q("I3_spread_budget", """
SELECT c.date_key, CAST(b.budget_revenue AS DOUBLE) / b.days * c.workday_ind AS budget_revenue_day
FROM calendar c JOIN budget_supplement b ON b.month_end = c.month_end""")
q("I4_spread_prior_year", "SELECT date_key, product_type, "
  + ", ".join(Q.K22_PY) + " FROM last_year", Q.K22_CTES)
q("J1_fmt", """
SELECT vendor_id, '$' || format('{:,.2f}', CAST(CAST(revenue AS DECIMAL(38,2)) AS DOUBLE)) AS revenue_text,
       format('{:,.0f}', CAST(CAST(orders AS DECIMAL(38,0)) AS DOUBLE)) AS orders_text,
       format('{:,.1f}', CAST(CAST(CAST(margin_pct AS DECIMAL(10,6)) * 100 AS DECIMAL(38,1)) AS DOUBLE)) || '%'
         AS margin_pct_text,
       strftime(last_date, '%m/%d/%Y') AS last_date_text
FROM (SELECT vendor_id, CAST(sum(revenue) AS DECIMAL(20,2)) AS revenue, sum(orders) AS orders,
             max(transaction_date) AS last_date,
             CAST(sum(margin) AS DOUBLE) / nullif(CAST(sum(revenue) AS DOUBLE), 0) AS margin_pct
      FROM txn GROUP BY 1)""")
q("J2_fmt_signed", """
SELECT date_key, product_type,
       CASE WHEN CAST(rev_variance AS DECIMAL(20,0)) < 0
            THEN '($' || format('{:,.0f}', CAST(CAST(abs(CAST(rev_variance AS DECIMAL(20,0))) AS DECIMAL(38,0)) AS DOUBLE)) || ')'
            ELSE '$' || format('{:,.0f}', CAST(CAST(abs(CAST(rev_variance AS DECIMAL(20,0))) AS DECIMAL(38,0)) AS DOUBLE))
       END AS rev_variance_text,
       coalesce(rev_variance < 0, false) AS is_negative,
       CASE WHEN gm_percent_variance < 0 THEN '(' || gm_text || ')' ELSE gm_text END AS gm_variance_text,
       coalesce(margin_variance < 0, false) AS margin_is_negative, coalesce(gm_percent_variance < 0, false) AS gm_is_negative
FROM (SELECT *, format('{:,.1f}', CAST(CAST(abs(gm_percent_variance * 100) AS DECIMAL(38,1)) AS DOUBLE)) || '%' AS gm_text FROM k22out)""", Q.K22_CTES + [("k22out", Q.K22_MAIN)])
q("J4_daily_ratios", """
SELECT date_key, product_type, actual_close_rate, actual_sales_po, actual_gm_po, actual_gm_percent,
       budget_gm_percent, gm_percent_variance FROM k22out""", Q.K22_CTES + [("k22out", Q.K22_MAIN)])
q("J5_blank_zero", """
SELECT vendor_id, CAST(year(transaction_date) AS INTEGER) AS year, CAST(nullif(sum(returns), 0) AS BIGINT) AS returns
FROM txn GROUP BY 1, 2""")
q("J6_pct_rows", """
SELECT customer_segment, metric,
       CASE WHEN metric = 'GM %'
            THEN format('{:,.1f}', CAST(CAST(CAST(mtd_actual AS DECIMAL(20,6)) * 100 AS DECIMAL(38,1)) AS DOUBLE)) || '%'
            ELSE '$' || format('{:,.2f}', CAST(CAST(CAST(mtd_actual AS DECIMAL(20,6)) AS DECIMAL(38,2)) AS DOUBLE))
       END AS mtd_actual_text
FROM k21out""", Q.K21_CTES + [("k21out", Q.K21_MAIN)])
ORACLE["I2_rows_to_slots"] = ORACLE["C12_slots"]
