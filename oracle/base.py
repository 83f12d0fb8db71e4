"""Shared pieces of the oracle: registration, parameters, and facts that several reports read.

The oracle states each report from its rule (SURVEY, "Report rules in
detail"): facts per row first (``sales``, ``sold``), then one aggregation over
them.  Nothing follows the order of the reference's steps.
"""

from __future__ import annotations

from oracle.roles import with_roles

START, END, SINCE, ASOF = "DATE '1996-01-01'", "DATE '2000-12-31'", "DATE '1996-01-01'", "DATE '2000-06-15'"
ORACLE_SQL: dict[str, str] = {}

Part = tuple[str, str]


def q(name: str, sql: str, ctes: list[Part] | None = None) -> None:
    ORACLE_SQL[name] = with_roles(sql, ctes)


def stable(x: str, scale: int = 6) -> str:
    return f"CAST(CAST({x} AS DECIMAL(38,{scale})) AS DOUBLE)"


def share(a: str, b: str) -> str:
    """a / b as double, missing when b is 0 or missing."""
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def when(cond: str, value: str, other: str = "0") -> str:
    return f"CASE WHEN {cond} THEN {value} ELSE {other} END"


# Every fact row with its line's details (lines of a contract programme excluded),
# its leg-1 tracking, its month, and how many fact rows share its vendor and line.
SALES: Part = ("sales", """
SELECT f.*, m.month_end, d.* EXCLUDE (line_item_id, item_id, vendor_id, contract_pro_id),
       leg.tracking_number, leg.auto_label, f.revenue - f.margin AS spend,
       d.smart_order_conf = 1 AND d.smart_order_po = 1 AND d.smart_price_presented = 1 AS smart
FROM (SELECT *, count(*) OVER (PARTITION BY vendor_id, line_item_id) AS same_line FROM txn) f
JOIN line_detail d USING (line_item_id)
LEFT JOIN (FROM tracking WHERE shipment_leg_id = 1) leg USING (line_item_id)
LEFT JOIN calendar m ON m.date_key = f.transaction_date
WHERE d.contract_pro_id IS NULL""")

IN_PERIOD = f"transaction_date BETWEEN {START} AND {END}"
