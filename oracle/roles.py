"""Role tables written in DuckDB SQL, independently of the Spark bindings.

``with_roles(sql)`` prefixes a query with the role definitions as common
table expressions over the pre-registered driver views.
"""

from __future__ import annotations

ROLE_CTES: list[tuple[str, str]] = [
    ("txn", """
SELECT l_orderkey * 10 + l_linenumber AS line_item_id,
       l_suppkey AS vendor_id, o_custkey AS customer_id, l_partkey AS item_id,
       CASE WHEN p_size <= 25 THEN 2 WHEN p_size > 45 THEN 3 ELSE 1 END AS product_category_id,
       p_size AS class_id, p_size % 7 AS modality_id, p_brand AS oem_id,
       CAST(l_shipdate AS DATE) AS transaction_date,
       1 AS requests,
       CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS orders,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returns,
       CAST(l_quantity AS BIGINT) AS quantity,
       CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS revenue,
       CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
         * CAST(l_tax AS DECIMAL(4,2)) AS margin,
       CAST(p_retailprice AS DECIMAL(15,2)) AS oem_price,
       CAST(l_extendedprice AS DECIMAL(15,2)) AS price,
       CAST(l_extendedprice AS DECIMAL(15,2)) * 0.8 AS cost,
       l_partkey % 40 AS sourced_by_id,
       CAST(o_custkey % 25 AS INTEGER) AS sales_rep_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""),
    ("line_rows", """
SELECT * EXCLUDE (rn) FROM (
  SELECT l_orderkey * 10 + l_linenumber AS line_item_id, lineitem.*,
         row_number() OVER (PARTITION BY l_orderkey * 10 + l_linenumber
                            ORDER BY l_partkey, l_suppkey) AS rn
  FROM lineitem) WHERE rn = 1"""),
    ("line_detail", """
SELECT line_item_id, l_partkey AS item_id, l_partkey AS pim_item_number, l_suppkey AS vendor_id,
       l_linenumber % 2 AS smart_price_selected,
       CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS smart_sourced,
       p_size % 2 AS photo_shown,
       CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END AS smart_order_po,
       CASE WHEN l_quantity > 20 THEN 1 ELSE 0 END AS smart_order_conf,
       l_linenumber % 2 AS smart_price_presented,
       CASE WHEN l_linenumber = 7 THEN 7 END AS contract_pro_id,
       CASE WHEN l_discount >= 0.08 THEN CAST(l_shipdate AS DATE) END AS backorder_ship_date,
       CASE WHEN l_discount >= 0.08 THEN 1 ELSE 0 END AS ever_backordered,
       l_returnflag || l_linestatus AS condition_code,
       CASE WHEN l_returnflag = 'R' THEN 'Y' ELSE 'N' END AS return_required,
       p_name AS requested_part_number,
       upper(replace(p_name, ' ', '')) AS requested_part_number_stripped,
       CASE WHEN l_linenumber % 2 = 0 THEN p_name || 'X' END AS replacement_part_number,
       CASE WHEN l_linenumber % 2 = 0 THEN upper(replace(p_name, ' ', '')) || 'X' END
         AS replacement_part_number_stripped,
       p_type AS line_item_description,
       l_linenumber AS line_item_status_id,
       'PO' || CAST(l_orderkey AS VARCHAR) AS line_item_po,
       p_brand || '-' || CAST(p_size AS VARCHAR) AS model_number,
       CASE WHEN l_linenumber <= 2 THEN '90 DAY' ELSE 'NONE' END AS warranty_description,
       (l_partkey + l_linenumber) % 500 AS price_rule_id
FROM line_rows JOIN part ON l_partkey = p_partkey"""),
    ("line_status", """
SELECT line_item_id, o_orderdate AS first_ordered_timestamp,
       CASE WHEN l_linenumber = 5 THEN NULL
            ELSE o_orderdate + to_hours(CAST(l_linenumber * 3 AS BIGINT)) END AS first_closed_timestamp,
       CASE WHEN l_discount >= 0.08 THEN o_orderdate + INTERVAL 1 DAY END AS first_backordered_timestamp
FROM line_rows JOIN orders ON l_orderkey = o_orderkey"""),
    ("tracking", """
SELECT line_item_id, 1 AS shipment_leg_id,
       CASE WHEN l_linenumber = 3 THEN NULL ELSE 'TRK' || CAST(line_item_id AS VARCHAR) END AS tracking_number,
       CASE WHEN l_orderkey % 2 = 0 THEN 'Y' ELSE 'N' END AS auto_label,
       CASE WHEN l_shipdate >= o_orderdate THEN l_shipdate END AS date_delivered
FROM line_rows JOIN orders ON l_orderkey = o_orderkey
UNION ALL
SELECT line_item_id, 2, 'RTN' || CAST(line_item_id AS VARCHAR), 'Y', l_shipdate
FROM line_rows JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1"""),
    ("shipping_info", """
SELECT line_item_id, o_orderpriority AS shipping_method
FROM line_rows JOIN orders ON l_orderkey = o_orderkey"""),
    ("ship_methods", """
SELECT * FROM (
  SELECT DISTINCT o_orderpriority AS shipping_method,
         CASE o_orderpriority WHEN '1-URGENT' THEN 11 WHEN '2-HIGH' THEN 6
              WHEN '3-MEDIUM' THEN 59 WHEN '4-NOT SPECIFIED' THEN 24 END AS shipping_method_id
  FROM orders) WHERE shipping_method_id IS NOT NULL"""),
    ("returns", """
SELECT l_orderkey * 10 + l_linenumber AS line_item_id,
       'RGA-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS rga_number,
       CAST(l_partkey % 4 + 1 AS INTEGER) AS rga_type_id,
       substr('CPVNSX', CAST(l_suppkey % 6 + 1 AS INTEGER), 1) AS responsibility,
       CAST(l_partkey % 60 AS INTEGER) AS return_reason_id,
       CAST(l_quantity AS BIGINT) AS quantity,
       CASE WHEN l_tax < 0.07 THEN 'Y' ELSE 'N' END AS active,
       l_linenumber AS status_id,
       l_shipdate + INTERVAL 36 HOUR AS created_timestamp,
       CASE WHEN l_returnflag = 'A' THEN l_orderkey * 10 + (l_linenumber % 7 + 1) END AS salvage_line_item_id
FROM lineitem WHERE l_returnflag IN ('R', 'A')"""),
    ("research", """
SELECT l_orderkey * 10 + l_linenumber AS line_item_id, l_suppkey AS vendor_id,
       l_partkey % 150 AS created_user_id,
       CAST(l_shipdate AS DATE) - l_linenumber AS created_date,
       (['SP', 'SS', 'SPP', 'MAN', 'EX'])[(l_partkey + l_linenumber) % 5 + 1] AS research_type_code,
       CAST((l_partkey + l_linenumber) % 4 + 1 AS INTEGER) AS research_type_id,
       (['HP', 'EHP', 'NP', 'NQ'])[(l_partkey + l_suppkey) % 4 + 1] AS result_code,
       CAST(CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 0
                 ELSE CAST(l_extendedprice AS DECIMAL(15,2)) * 0.9 END AS DECIMAL(17,3)) AS outright_cost,
       CAST(CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN 0.01
                 ELSE CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_tax AS DECIMAL(4,2)) * 10)
            END AS DECIMAL(17,3)) AS exchange_cost,
       l_returnflag AS condition_code, l_partkey AS part_number_id, l_partkey AS item_id,
       'R-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS research_id,
       CASE WHEN l_partkey % 3 = 0 THEN l_partkey END AS inv_item_cost_id,
       CASE WHEN l_partkey % 5 = 0 THEN 'PIM' || CAST(l_partkey AS VARCHAR) END AS rs_item_number,
       CASE WHEN l_linenumber % 2 = 0 THEN 'P' || CAST(l_partkey AS VARCHAR) || 'X' END
         AS replacement_part_number_stripped,
       l_linenumber % 4 AS condition_id, l_linenumber % 3 AS warranty_id,
       CAST(l_extendedprice AS DECIMAL(15,2)) AS outright_price,
       CAST(l_extendedprice AS DECIMAL(15,2)) * 0.75 AS exchange_price,
       CASE WHEN l_linenumber = 7 THEN 7 END AS contract_pro_id,
       CASE WHEN l_linenumber % 2 = 0 THEN 'P-' || l_partkey || 'X' END AS replacement_part_number,
       l_partkey % 100 AS vrm_score, l_linenumber * 2 AS lead_time_days,
       CASE WHEN l_partkey % 2 = 0 THEN 'Y' ELSE 'N' END AS is_formulary_outright_option,
       CASE WHEN l_partkey % 3 = 0 THEN 'Y' ELSE 'N' END AS is_formulary_exchange_option,
       CAST(CASE WHEN l_linenumber % 2 = 1 THEN 50 ELSE 0 END AS DOUBLE) AS core_charge
FROM lineitem"""),
    ("line_items", """
SELECT line_item_id AS id_no, p_name AS part_number, upper(replace(p_name, ' ', '')) AS part_number_stripped,
       p_size % 2 AS photo_shown, p_type AS description,
       CAST((l_partkey + l_linenumber) % 27 + 1 AS INTEGER) AS status_id,
       'R-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS vendor_research_id,
       CAST(l_orderkey % 5 + 1 AS INTEGER) AS order_type_id,
       CASE WHEN l_returnflag = 'R' THEN 'Y' ELSE 'N' END AS return_required,
       CAST(l_quantity AS INTEGER) AS quantity, l_linenumber % 2 AS return_quantity,
       o_orderdate AS created_timestamp, l_partkey % 150 AS created_user_id,
       CASE WHEN l_discount >= 0.08 THEN CAST(l_shipdate AS DATE) END AS backorder_ship_date,
       CASE WHEN l_linenumber % 2 = 1 THEN 'Y' ELSE 'N' END AS had_smartpriced_research,
       l_linenumber % 3 AS urgency_id,
       l_orderkey AS order_id, 'PO' || l_orderkey AS line_item_po, 'WO' || l_orderkey AS work_order_number,
       l_partkey % 900 AS equipment_number, 'SE' || l_partkey AS serial_number_equipment,
       CASE WHEN l_linenumber % 2 = 0 THEN 'SN' || l_orderkey END AS serial_number,
       CASE WHEN l_linenumber % 3 = 0 THEN 'SC' || l_orderkey END AS serial_number_core,
       p_brand || '-' || p_size AS model_number, 'HPO' || l_orderkey AS house_po_number,
       'CC' || (l_partkey % 20) AS cost_center,
       CAST(o_orderdate AS DATE) + 1 AS sourced_date, CAST(o_orderdate AS DATE) + 2 AS quoted_date,
       CASE WHEN l_linenumber <> 5 THEN CAST(o_orderdate AS DATE) + 3 END AS closed_date,
       CAST(o_orderdate AS DATE) + 4 AS confirmed_date, CAST(o_orderdate AS DATE) + 5 AS po_date,
       CASE WHEN p_size % 4 = 0 THEN 'Y' ELSE 'N' END AS gsa_item,
       CASE WHEN l_linenumber = 6 THEN l_partkey % 9 END AS nosale_reason_id,
       CASE WHEN l_linenumber % 3 = 0 THEN 'Y' ELSE 'N' END AS had_smartsourced_research,
       ([1, 2, 3, 4, 5, 100])[(l_orderkey + l_linenumber) % 6 + 1] AS line_origin_id,
       p_size AS class_id, p_size % 7 AS modality_id, p_brand AS oem_id,
       CASE WHEN l_discount >= 0.09 THEN CAST(l_shipdate AS DATE) + 7 END AS backorder_followup_date
FROM line_rows JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""),
    ("confirmations", """
SELECT l_orderkey * 10 + l_linenumber AS line_item_id, l_shipdate AS created_timestamp,
       l_partkey % 150 AS confirmed_by_id, 'conf ' || CAST(l_suppkey AS VARCHAR) AS confirmation_notes
FROM lineitem"""),
    ("invoices", """
SELECT l_orderkey * 10 + l_linenumber AS line_item_id, 'INV' || CAST(l_orderkey AS VARCHAR) AS invoice_number,
       l_linenumber - 1 AS line_number
FROM lineitem"""),
    ("received_parts", """
SELECT l_orderkey * 10 + l_linenumber AS line_item_id, l_suppkey AS received_by_contact_id,
       CAST(l_shipdate AS DATE) + 3 AS date_received
FROM lineitem WHERE l_returnflag = 'N'"""),
    ("admin_actions", """
SELECT l_orderkey * 10 + l_linenumber AS line_item_id, l_linenumber % 5 AS action_type_id FROM lineitem"""),
    ("condition_codes", """
SELECT DISTINCT l_linenumber % 4 AS condition_id, (['NO', 'NF', 'RF', 'AF'])[l_linenumber % 4 + 1] AS condition_code,
       'W' || (['NO', 'NF', 'RF', 'AF'])[l_linenumber % 4 + 1] AS web_display_code
FROM lineitem"""),
    ("warranty_codes", """
SELECT DISTINCT l_linenumber % 3 AS warranty_id, (['30 DAY', '90 DAY', '1 YEAR'])[l_linenumber % 3 + 1] AS description
FROM lineitem"""),
    ("urgency_codes", """
SELECT DISTINCT l_linenumber % 3 AS urgency_id, (['LOW', 'MED', 'HIGH'])[l_linenumber % 3 + 1] AS urgency_code
FROM lineitem"""),
    ("vendors", """
SELECT s_suppkey AS company_id, s_name AS company_name,
       CASE WHEN s_suppkey % 5 <> 4 THEN s_nationkey END AS relationship_manager_id,
       CASE WHEN s_suppkey % 5 <> 4 THEN 'Manager ' || CAST(s_nationkey AS VARCHAR) END AS relationship_manager,
       (['OEM', 'IND', 'REF'])[s_suppkey % 3 + 1] AS company_type_code,
       'T' || CAST(s_suppkey % 4 AS VARCHAR) AS tier_code,
       CASE s_suppkey % 4 WHEN 0 THEN 'NET30' WHEN 1 THEN '2%10 NET 45' WHEN 2 THEN 'COD' END AS payment_term_code,
       CASE WHEN s_suppkey % 6 = 5 THEN NULL ELSE CAST(25200 + (s_suppkey % 9) * 3600 AS INTEGER) END
         AS vend_cutoff_est,
       CASE WHEN s_suppkey % 10 = 9 THEN 'N' ELSE 'Y' END AS active,
       CASE WHEN s_suppkey % 2 = 0 THEN 'Y' ELSE 'N' END AS smart_order_enabled,
       CASE WHEN s_suppkey % 3 = 0 THEN 'Y' ELSE 'N' END AS smart_label_enabled,
       CASE WHEN s_acctbal > 0 THEN 'Y' ELSE 'N' END AS epv_member,
       CAST(s_suppkey % 3 + 1 AS INTEGER) AS choice_level,
       CASE WHEN s_acctbal < -500 THEN 'Y' ELSE 'N' END AS suspend_vendor,
       CASE WHEN s_nationkey % 4 = 0 THEN 'Y' ELSE 'N' END AS redirect_shipments
FROM supplier"""),
    ("customers", """
SELECT c_custkey AS company_id, c_name AS company_name,
       CAST(c_nationkey AS BIGINT) AS lvl1_company_id, n_name AS lvl1_company_name,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN ' enterprise' WHEN 'BUILDING' THEN 'SODEXO'
            ELSE 'Healthcare' END AS segment,
       CASE WHEN c_mktsegment = 'FURNITURE' THEN 'provider'
            WHEN c_mktsegment = 'HOUSEHOLD' THEN ' ISO'
            WHEN c_mktsegment = 'MACHINERY' THEN CASE WHEN c_nationkey % 2 = 0 THEN 'Government' END
            WHEN c_mktsegment = 'AUTOMOBILE' THEN CASE WHEN c_custkey % 10 = 0 THEN 'ARAMARK' ELSE 'Direct' END
            ELSE 'Direct' END AS sub_segment
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""),
    ("organization", """
SELECT c_custkey AS organization_id, 'user' || CAST(c_custkey AS VARCHAR) AS user_name
FROM customer WHERE c_mktsegment = 'MACHINERY'"""),
    ("requestors", """
SELECT DISTINCT user_id AS requestor_id, 'Requestor ' || CAST(user_id AS VARCHAR) AS requestor_name
FROM events WHERE event_type = 'signup'"""),
    ("part_numbers", """
SELECT p_partkey AS part_number_id, upper(replace(p_name, ' ', '')) AS part_number_stripped FROM part"""),
    ("vendor_mapping", """
SELECT DISTINCT l_suppkey AS vendor_id, p_brand AS oem_id, p_size AS model_id,
       p_size % 7 AS modality_id, p_size AS class_id
FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    ("auto_order", """
SELECT vendor_id, ship_priority_id, settings,
       CASE WHEN settings = 'F' THEN 'Y' ELSE 'N' END AS is_auto_order
FROM (SELECT o_custkey AS vendor_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS ship_priority_id,
             min(o_orderstatus) AS settings
      FROM orders GROUP BY 1, 2)"""),
    ("contacts", """
SELECT c_custkey AS requestor_id, CAST(c_nationkey * 4 + c_custkey % 4 AS BIGINT) AS company_id,
       c_name AS company_name, 'First' AS first_name,
       split_part(c_name, '#', 2) AS last_name,
       c_mktsegment AS position_description,
       '555-' || CAST(c_custkey % 10000 AS VARCHAR) AS main_phone,
       CASE WHEN c_custkey % 3 <> 0 THEN 'contact' || c_custkey || '@example.com' END AS email,
       'Rep ' || c_nationkey AS sales_representative,
       CASE WHEN c_custkey % 4 = 0 THEN 'www.site' || c_nationkey || '.example' END AS website,
       CASE WHEN c_custkey % 2 <> 0 THEN '556-' || (c_custkey % 10000) END AS fax,
       CASE WHEN c_custkey % 3 <> 0 THEN '557-' || (c_custkey % 10000) END AS direct_line,
       CASE WHEN c_custkey % 4 <> 0 THEN '558-' || (c_custkey % 10000) END AS cell_phone,
       CASE WHEN c_custkey % 5 <> 0 THEN '559-' || (c_custkey % 10000) END AS alternate_phone,
       CASE WHEN c_custkey % 6 <> 0 THEN '560-' || (c_custkey % 10000) END AS alternate_fax,
       CASE WHEN c_custkey % 7 <> 0 THEN '561-' || (c_custkey % 10000) END AS pager,
       CASE WHEN c_custkey % 8 <> 0 THEN '562-' || (c_custkey % 10000) END AS emergency_phone,
       CASE WHEN c_acctbal > 0 THEN 'Y' ELSE 'N' END AS active,
       CASE WHEN c_custkey % 7 = 0 THEN 'N' ELSE 'Y' END AS cc_active,
       CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN 'Y' ELSE 'N' END AS vendor_ind
FROM customer"""),
    ("items", """
SELECT p_partkey AS item_number, p_partkey % 100 AS company_id,
       upper(replace(p_name, ' ', '')) AS part_number, p_name AS description,
       CASE WHEN p_partkey % 3 = 0 THEN 'O' ELSE 'V' END AS item_type,
       p_brand || '-' || CAST(p_size AS VARCHAR) AS product_number,
       p_brand AS oem_name, p_size AS ps_structure_id
FROM part"""),
    ("item_prices", """
SELECT p_partkey AS item_number, p_partkey AS search_item_number, p_partkey - p_partkey % 3 AS oem_item_number,
       p_brand || '-' || CAST(p_size AS VARCHAR) AS product_number,
       CAST(p_retailprice AS DECIMAL(15,2)) AS list_price,
       CAST(p_retailprice AS DECIMAL(15,2)) * 0.70 AS sell_price,
       CAST(p_retailprice AS DECIMAL(15,2)) * 1.00 AS exchange_oem_price,
       CAST(p_retailprice AS DECIMAL(15,2)) * 1.20 AS outright_oem_price,
       CAST(p_retailprice AS DECIMAL(15,2)) * 0.50 AS exchange_cost,
       CAST(p_retailprice AS DECIMAL(15,2)) * 0.60 AS outright_cost,
       CAST(p_retailprice AS DECIMAL(15,2)) * 0.70 AS exchange_price,
       CAST(p_retailprice AS DECIMAL(15,2)) * 0.80 AS outright_price,
       CAST(CASE WHEN p_size % 3 = 0 THEN 100 ELSE 0 END AS DECIMAL(15,2)) AS cost_core_charge,
       'EA' AS uom_code,
       (['NO', 'NF', 'RF', 'AF'])[p_partkey % 4 + 1] AS condition,
       CASE WHEN p_partkey % 2 = 0 THEN 'EX' ELSE 'OR' END AS condition_code,
       '90 DAY' AS cost_warranty_description,
       CASE WHEN p_size % 5 = 0 THEN 'N' ELSE 'Y' END AS is_returnable,
       p_size % 10 AS lead_time_days,
       p_type AS sub_type
FROM part"""),
    ("product_structure", """
SELECT DISTINCT p_size AS structure_id, 'Structure ' || CAST(p_size AS VARCHAR) AS name,
       'Group ' || CAST(CAST(floor(p_size / 10) AS BIGINT) AS VARCHAR) AS parent_name
FROM part"""),
    ("oem_structure", """
SELECT structure_id, 'Taxonomy ' || structure_id AS name, 2 AS oem_id FROM (
  SELECT DISTINCT 'd' || CAST(CAST(floor(p_size / 10) AS BIGINT) AS VARCHAR) || '.' || CAST(p_size AS VARCHAR)
         || '.0.0.0.0.0' AS structure_id FROM part
  UNION ALL
  SELECT DISTINCT 'd' || CAST(CAST(floor(p_size / 10) AS BIGINT) AS VARCHAR) || '.0.0.0.0.0.0' FROM part)"""),
    ("oem_structure_products", """
SELECT DISTINCT p_brand || '-' || CAST(p_size AS VARCHAR) AS product_number,
       'd' || CAST(CAST(floor(p_size / 10) AS BIGINT) AS VARCHAR) || '.' || CAST(p_size AS VARCHAR)
         || '.0.0.0.0.0' AS structure_id,
       CASE WHEN p_size % 10 = 0 THEN 1 ELSE 2 END AS oem_id
FROM part"""),
    ("pim_images", """
SELECT l_partkey AS item_number, l_orderkey * 10 + l_linenumber AS image_id FROM lineitem WHERE l_linenumber <= 2"""),
    ("pim_models", """
SELECT DISTINCT p_brand || '-' || CAST(p_size AS VARCHAR) AS product_number,
       'MDL' || CAST(l_suppkey AS VARCHAR) AS model_code
FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    ("pim_searches", """
SELECT l_partkey AS search_item_number, 'REF' || CAST(l_suppkey AS VARCHAR) AS part_number FROM lineitem"""),
    ("item_logistics", """
SELECT p_partkey AS item_number, 'Note ' || p_type AS cust_notes, p_size * 3 AS quantity_on_hand,
       1 AS uom_quantity, CAST(p_size AS DECIMAL(10,1)) * 0.5 AS package_weight,
       (['NO', 'NF', 'RF', 'AF'])[p_partkey % 4 + 1] AS condition_code
FROM part"""),
    ("item_attributes", """
SELECT l_partkey AS item_number, l_linenumber AS attribute_id FROM lineitem WHERE l_returnflag = 'N'"""),
    ("item_references", """
SELECT p_partkey AS owner, p_partkey + s AS "to", s AS sequence, CASE WHEN s = 3 THEN 'X' ELSE 'C' END AS type
FROM part CROSS JOIN (SELECT unnest([1, 2, 3]) AS s)"""),
    ("formulary", """
SELECT l_orderkey AS document_id, l_partkey - l_partkey % 3 AS o_string FROM lineitem"""),
    ("pricing_rules", """
SELECT p_partkey % 500 AS price_rule_id,
       CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_name END AS prod_seg_part_number
FROM part"""),
    ("oems", "SELECT DISTINCT p_brand AS company_id, 'OEM ' || p_brand AS company_name FROM part"),
    ("modalities", """
SELECT DISTINCT p_size % 7 AS modality_id, 'MOD' || CAST(p_size % 7 AS VARCHAR) AS modality_code FROM part"""),
    ("product_classes", """
SELECT DISTINCT p_size AS class_id, 'CLASS' || CAST(p_size AS VARCHAR) AS class_code FROM part"""),
    ("product_categories", """
SELECT DISTINCT CASE WHEN p_size <= 25 THEN 2 WHEN p_size > 45 THEN 3 ELSE 1 END AS product_category_id,
       CASE WHEN p_size <= 25 THEN 'Biomed' WHEN p_size > 45 THEN 'Stryker' ELSE 'Imaging' END
         AS product_category_description
FROM part"""),
    ("daily_actuals", """
SELECT accounting_date, accounting_date AS transaction_date, segment, sub_segment, product_category_description,
       actual_requests, actual_orders, actual_revenue, actual_margin,
       actual_requests AS budget_requests, actual_orders AS budget_orders,
       actual_revenue * (CASE WHEN product_category_description = 'Biomed' THEN 1.05
                              WHEN product_category_description = 'Stryker' THEN 1.10 ELSE 0.95 END) AS budget_revenue,
       actual_margin * (CASE WHEN product_category_description = 'Biomed' THEN 1.05
                             WHEN product_category_description = 'Stryker' THEN 1.10 ELSE 0.95 END) AS budget_margin,
       actual_requests AS forecast_requests, actual_orders AS forecast_orders,
       actual_revenue * 0.98 AS forecast_revenue, actual_margin * 0.98 AS forecast_margin
FROM (SELECT q.transaction_date AS accounting_date, c.segment, c.sub_segment, pc.product_category_description,
             CAST(sum(q.requests) AS BIGINT) AS actual_requests, CAST(sum(q.orders) AS BIGINT) AS actual_orders,
             CAST(sum(q.revenue) AS DECIMAL(28,4)) AS actual_revenue,
             CAST(sum(q.margin) AS DECIMAL(28,6)) AS actual_margin
      FROM txn q LEFT JOIN customers c ON c.company_id = q.customer_id
      LEFT JOIN product_categories pc ON pc.product_category_id = q.product_category_id
      GROUP BY 1, 2, 3, 4)"""),
    ("cal_days", """
SELECT CAST(unnest(generate_series(CAST(date_trunc('year', lo) AS DATE),
                                   make_date(year(hi), 12, 31), INTERVAL 1 DAY)) AS DATE) AS date_key
FROM (SELECT min(d) AS lo, max(d) AS hi
      FROM (SELECT o_orderdate AS d FROM orders UNION ALL SELECT l_shipdate FROM lineitem))"""),
    ("calendar", """
SELECT *,
       CAST(sum(workday_ind) OVER (PARTITION BY year, month ORDER BY date_key
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS workday_nbr_mtd,
       CAST(sum(workday_ind) OVER (PARTITION BY year ORDER BY date_key
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS workday_nbr_ytd,
       CAST(sum(workday_ind) OVER (ORDER BY date_key
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_workdays
FROM (
  SELECT date_key, CAST(year(date_key) AS INTEGER) AS year, CAST(month(date_key) AS INTEGER) AS month,
         monthname(date_key) AS month_long, last_day(date_key) AS month_end,
         CAST(date_trunc('week', date_key) AS DATE) AS week_start,
         CAST(dayofweek(date_key) + 1 AS INTEGER) AS dow,
         CASE WHEN (month(date_key) = 1 AND day(date_key) = 1)
                OR (month(date_key) = 12 AND day(date_key) = 25) THEN 1 ELSE 0 END AS ps_hol_ind,
         CASE WHEN dayofweek(date_key) BETWEEN 1 AND 5
               AND NOT ((month(date_key) = 1 AND day(date_key) = 1)
                     OR (month(date_key) = 12 AND day(date_key) = 25)) THEN 1 ELSE 0 END AS workday_ind
  FROM cal_days)"""),
]


ROLE_CTES.append(("budget_supplement", """
SELECT 'Contingency' AS segment, 6 AS sort, m.month_end, budget_revenue, budget_margin,
       CAST(0 AS DECIMAL(15,2)) AS revenue, CAST(0 AS DECIMAL(15,2)) AS margin, d.days
FROM (SELECT last_day(transaction_date) AS month_end, CAST(sum(revenue) AS DECIMAL(28,4)) * 0.02 AS budget_revenue,
             CAST(sum(margin) AS DECIMAL(28,6)) * 0.02 AS budget_margin FROM txn GROUP BY 1) m
LEFT JOIN (SELECT month_end, CAST(sum(workday_ind) AS BIGINT) AS days FROM calendar GROUP BY 1) d ON d.month_end = m.month_end"""))


ROLE_CTES += [
    ("line_origins", """
SELECT o AS line_origin_id, 'ORIGIN' || o AS status_code, CASE WHEN o IN (4, 5) THEN o END AS subscription_id
FROM (SELECT unnest([1, 2, 3, 4, 5, 100]) AS o)"""),
    ("subscriptions", "SELECT n_nationkey AS subscription_id, n_nationkey % 5 AS package_id FROM nation"),
    ("packages", "SELECT r_regionkey AS package_id, 'Package ' || r_name AS package_name, r_regionkey % 2 AS type_id FROM region"),
    ("package_types", "SELECT DISTINCT r_regionkey % 2 AS type_id, 'Type ' || (r_regionkey % 2) AS type_name FROM region"),
    ("customer_line_keys", """
SELECT line_item_id, CAST(l_suppkey % 25 AS INTEGER) AS subscription_id FROM line_rows WHERE l_linenumber % 2 = 0"""),
    ("function_locations", "SELECT line_item_id, 'LOC' || l_suppkey AS field_value FROM line_rows WHERE l_linenumber = 4"),
    ("order_headers", """
SELECT o_orderkey AS order_id, CASE WHEN o_orderstatus = 'P' THEN 'Y' ELSE 'N' END AS hero_kit,
       o_custkey AS company_id, o_custkey % 150 AS requestor_id FROM orders"""),
    ("research_pricing", """
SELECT DISTINCT 'R-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS vendor_research_id,
       l_partkey % 500 AS pricing_rule_id, 'Rule ' || (l_partkey % 500) AS pricing_rule_description,
       l_partkey - l_partkey % 3 AS oem_item_number
FROM lineitem WHERE l_partkey % 2 = 0"""),
    ("order_confirmations", "SELECT line_item_id FROM line_rows WHERE l_quantity > 20"),
    ("purchase_orders", """
SELECT line_item_id, 'P' || l_orderkey AS purchase_id, (['CC', 'PO', 'ACH'])[l_partkey % 3 + 1] AS payment_code,
       CAST(CAST(l_tax AS DECIMAL(4,2)) * 100 AS DOUBLE) AS oem_shipping_handling_fee,
       CAST(CASE WHEN l_returnflag = 'R' THEN 25 ELSE 0 END AS DOUBLE) AS exchange_fee, CAST(5 AS DOUBLE) AS processing_fee,
       CAST(CASE WHEN l_quantity < 5 THEN 10 ELSE 0 END AS DOUBLE) AS minimum_order_fee,
       CASE WHEN l_linenumber % 2 = 0 THEN 'Y' ELSE 'N' END AS transit_coverage,
       CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS DOUBLE) AS program_fee
FROM line_rows WHERE l_linestatus = 'F'"""),
    ("customer_requests", "SELECT line_item_id FROM line_rows WHERE l_linenumber = 2"),
    ("vendor_messages", """
SELECT line_item_id, CASE WHEN l_linenumber = 1 THEN '850' END AS vendor_850,
       CASE WHEN l_partkey % 2 = 0 THEN '855' END AS vendor_855, CASE WHEN l_orderkey % 2 = 0 THEN '856' END AS vendor_856
FROM line_rows WHERE l_linenumber IN (1, 3)"""),
    ("customer_messages", """
SELECT line_item_id, l_partkey % 2 AS edi855, l_orderkey % 2 AS edi856 FROM line_rows WHERE l_linenumber IN (2, 3)"""),
    ("direct_order_lines", "SELECT line_item_id FROM line_rows WHERE l_linenumber = 7"),
    ("ship_estimates", """
SELECT line_item_id, 'ESD ' || l_linenumber AS description, CAST(l_shipdate AS DATE) + 2 AS esd,
       'user' || (l_partkey % 10) AS user_name, CASE WHEN l_partkey % 2 = 0 THEN 'Y' ELSE 'N' END AS active
FROM line_rows WHERE l_linenumber IN (4, 5)"""),
    ("product_relations", """
SELECT DISTINCT p_size % 7 AS modality_id, p_size AS product_type_id, p_size % 5 + 1 AS product_subcategory_id
FROM part WHERE p_size % 3 <> 0"""),
]


def with_roles(sql: str, ctes: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``sql`` with the role CTEs plus optional query-specific CTEs."""
    parts = ROLE_CTES + list(ctes or [])
    body = ",\n".join(f"{name} AS ({text}\n)" for name, text in parts)
    return f"WITH {body}\n{sql}"
