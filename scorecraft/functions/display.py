"""Presentation columns, data-bearing part only.

Display strings are extra columns; numeric columns are never rounded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorecraft.functions.semantics import ratio, sas_lt


def fmt(col: Column, kind: str) -> Column:
    """Currency, comma, percent or date display text."""
    # rounding happens in the decimal cast (half up); format_number only groups digits
    if kind == "dollar":
        return F.concat(F.lit("$"), F.format_number(col.cast("decimal(38,2)"), 2))
    if kind == "comma":
        return F.format_number(col.cast("decimal(38,0)"), 0)
    if kind == "percent":
        return F.concat(F.format_number((col * 100).cast("decimal(38,1)"), 1), F.lit("%"))
    if kind == "date":
        return F.date_format(col, "MM/dd/yyyy")
    raise ValueError(f"unknown display kind {kind!r}")


def fmt_signed(col: Column) -> Column:
    """Negative amounts in parentheses: ($1,234) / $1,234."""
    txt = F.format_number(F.abs(col).cast("decimal(38,0)"), 0)
    return F.when(col < 0, F.concat(F.lit("($"), txt, F.lit(")"))).otherwise(F.concat(F.lit("$"), txt))


def fmt_signed_percent(col: Column) -> Column:
    """Negative shares in parentheses: (1.2%) / 1.2%."""
    txt = F.concat(F.format_number(F.abs(col * 100).cast("decimal(38,1)"), 1), F.lit("%"))
    return F.when(col < 0, F.concat(F.lit("("), txt, F.lit(")"))).otherwise(txt)


def is_negative(col: Column) -> Column:
    """J2 flag used to colour a cell."""
    return F.coalesce(col < 0, F.lit(False))


# Budget status thresholds and labels.
GREEN_AT = 0.98
AMBER_ABOVE = 0.92
ALWAYS_GREEN_SEGMENT = "Contingency"


def budget_status(actual: Column, budget: Column, segment: Column) -> Column:
    """>= 98% of budget green, > 92% amber, else red (missing ratio -> red, S1)."""
    r = ratio(actual, budget)
    return (F.when(segment == ALWAYS_GREEN_SEGMENT, "green")
            .when(~sas_lt(r, F.lit(GREEN_AT)), "green")
            .when(F.coalesce(r > AMBER_ABOVE, F.lit(False)), "amber")
            .otherwise("red"))


def blank_zero(col: Column) -> Column:
    """Zero shown as blank."""
    return F.nullif(col, F.lit(0))


def pct_rows(value: Column, metric: Column, pct_metric: str = "GM %") -> Column:
    """Ratio-type rows get percent display, the others currency."""
    return F.when(metric == pct_metric, fmt(value, "percent")).otherwise(fmt(value, "dollar"))
