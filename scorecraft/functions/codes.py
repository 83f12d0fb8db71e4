"""Code mappings and classification expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorecraft.functions.semantics import sas_le, sas_lt


def map_codes(col: Column, mapping: Mapping, default=None) -> Column:
    """Code -> label CASE (first matching arm wins)."""
    out = F.lit(default)
    for code, label in reversed(list(mapping.items())):
        out = F.when(col == code, F.lit(label)).otherwise(out)
    return out


# Shipping method id -> allowed transit days.
TRANSIT_DAYS = (
    ((11,), 0),
    ((6, 8, 18, 19, 20, 21, 26, 27, 30, 31, 32, 36, 37, 38, 57), 1),
    ((59, 60, 61, 62, 63, 69, 70, 71, 72), 2),
    ((24, 34, 64, 65), 3),
    ((28, 66, 68), 4),
    ((39, 40), 5),
    ((25, 35, 43), 6),
    ((42,), 7),
    ((58, 67), 8),
    ((73, 74), 10),
)


def transit_days(method_id: Column) -> Column:
    """Code list -> number; missing for unlisted ids."""
    out = F.lit(None).cast("int")
    for ids, days in reversed(TRANSIT_DAYS):
        out = F.when(method_id.isin(*ids), F.lit(days)).otherwise(out)
    return out


def band(x: Column, cut: float, labels: Sequence[str]) -> Column:
    """Above / equal / below a cut; missing counts as below."""
    above, equal, below = labels
    return (F.when(F.coalesce(x > cut, F.lit(False)), F.lit(above))
            .when(F.coalesce(x == cut, F.lit(False)), F.lit(equal))
            .when(sas_lt(x, F.lit(cut)), F.lit(below)))


def effective_cost(exchange: Column, outright: Column, floor: float) -> Column:
    """Lowest valid of two prices, ignoring those <= floor (missing counts as <= floor)."""
    return (F.when(sas_le(exchange, F.lit(floor)), outright)
            .when(sas_le(outright, F.lit(floor)), exchange)
            .when(sas_lt(exchange, outright), exchange)
            .otherwise(outright))


def txn_type(orders: Column, returns: Column) -> Column:
    """Transaction type from measure signs."""
    return (F.when((orders > 0) & (returns == 0), "O")
            .when((orders == 0) & (returns > 0), "R")
            .when((orders > 0) & (returns > 0), "O/R")
            .when((orders == 0) & (returns == 0), "PC")
            .otherwise("N/A"))


# Segment rules (segment names, sub-segment names, sort keys).
SEGMENT_RULES = (
    ("segment", "ENTERPRISE", "Enterprise", 1),
    ("segment", "SODEXO", "Sodexo", 2),
    ("sub_segment", "PROVIDER", "Provider", 3),
    ("sub_segment", "ISO", "ISO", 4),
    ("sub_segment", "GOVERNMENT", "Government", 5),
)
DEFAULT_SEGMENT = ("Provider", 3)


def segment_label(segment: Column, sub_segment: Column) -> tuple[Column, Column]:
    """Trim + upper of two columns -> (label, sort key)."""
    cols = {"segment": F.upper(F.ltrim(segment)), "sub_segment": F.upper(F.ltrim(sub_segment))}
    label, sort = F.lit(DEFAULT_SEGMENT[0]), F.lit(DEFAULT_SEGMENT[1])
    for which, value, name, key in reversed(SEGMENT_RULES):
        hit = F.coalesce(cols[which] == value, F.lit(False))
        label = F.when(hit, F.lit(name)).otherwise(label)
        sort = F.when(hit, F.lit(key)).otherwise(sort)
    return label, sort


# Research status sets of the line-item load.
STATUS_SET_A = (7, 8, 13, 25, 27)
STATUS_SET_B = (1, 2, 3, 4, 5, 9, 10, 12, 26)


def classify_sourcing(status: Column, rtype: Column, min_type: Column, max_type: Column,
                      system_user: Column) -> dict[str, Column]:
    """Status x research type -> sourcing flags (nested CASE, ANSI nulls).

    Set A statuses use the chosen quote's type; set B statuses use the
    min / max type over all quotes of the line; other statuses give missing
    (the alternative flag gives 0).
    """
    in_a = status.isin(*STATUS_SET_A)
    in_b = status.isin(*STATUS_SET_B)
    both_23 = min_type.isin(2, 3) & max_type.isin(2, 3)
    price_selected = (F.when(in_a, F.when(rtype.isin(2, 3), 1).otherwise(0))
                      .when(in_b, F.when(both_23, 1).otherwise(0)))
    sourced = (F.when(in_a, F.when(rtype.isin(4), 1).otherwise(0))
               .when(in_b, F.when((min_type == 1) & (max_type == 1), 0)
                     .when(max_type.isin(4), 1)
                     .when(min_type.isin(1) & max_type.isin(2, 3), 1)
                     .when(system_user & ~both_23, 1)
                     .otherwise(0)))
    alternative = (F.when(in_a, F.when(rtype == 1, F.when(max_type == 1, 0).when(max_type > 1, 1))
                          .otherwise(0))
                   .otherwise(0))
    manual = (F.when(in_a, F.when(rtype == 1, 1).otherwise(0))
              .when(in_b, F.when((min_type == 1) & (max_type == 1), 1).otherwise(0)))
    return {"smart_price_selected": price_selected, "smart_sourced": sourced,
            "alternative_offered": alternative, "manual_sourced": manual}
