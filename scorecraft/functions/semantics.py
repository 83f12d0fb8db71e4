"""Missing-value semantics of the reference's SQL dialect (S1-S13), as Column helpers.

All helpers return built-in Spark expressions (no UDF), so they stay inside
whole-stage codegen and can be pushed into scans where Spark allows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# Missing is lower than every value -----------------------------------
def sas_lt(a, b) -> Column:
    """a < b where a missing is less than any present b (never null)."""
    a, b = _c(a), _c(b)
    return (a.isNull() & b.isNotNull()) | F.coalesce(a < b, F.lit(False))


def sas_le(a, b) -> Column:
    """a <= b where a missing is <= anything (never null)."""
    a, b = _c(a), _c(b)
    return a.isNull() | F.coalesce(a <= b, F.lit(False))


def sas_gt(a, b) -> Column:
    return ~sas_le(a, b)


def sas_ge(a, b) -> Column:
    return ~sas_lt(a, b)


def sas_eq(a, b) -> Column:
    """Equality where missing equals missing (S3)."""
    return _c(a).eqNullSafe(_c(b))


# Ne / not in keep missing ---------------------------------------------
def ne_keep_missing(col, value) -> Column:
    return ~_c(col).eqNullSafe(_c(value))


def not_in_keep_missing(col, values: Iterable) -> Column:
    col = _c(col)
    return col.isNull() | ~col.isin(list(values))


def in_list(col, values: Iterable) -> Column:
    return F.coalesce(_c(col).isin(list(values)), F.lit(False))


# Division by zero or missing gives missing ----------------------------
def ratio(num, den) -> Column:
    """num / den as double; missing when den is 0 or missing."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


# Text -----------------------------------------------------------
def blank_to_null(col) -> Column:
    col = F.rtrim(_c(col))
    return F.when(col == "", F.lit(None)).otherwise(col)


def chop_last(col) -> Column:
    """substr(x, 1, length(x)-1) with trailing blanks ignored; empty -> missing."""
    x = F.rtrim(_c(col))
    cut = F.left(x, F.greatest(F.length(x) - 1, F.lit(0)))
    return F.when(cut == "", F.lit(None)).otherwise(cut)


# S7 helpers ------------------------------------------------------------------
def row_count() -> Column:
    return F.count(F.lit(1))


def exists_flag(col) -> Column:
    """1 when the outer-joined key is present."""
    return F.when(_c(col).isNotNull(), 1).otherwise(0)


def stable(x, scale: int = 6) -> Column:
    """Fix a double to ``scale`` decimals through a decimal cast.

    Sums of doubles depend on the order partitions are combined in; casting
    through ``decimal(38, scale)`` makes a report value reproducible across
    partitionings (and equal to the SQL oracle) without changing its meaning.
    """
    return _c(x).cast(f"decimal(38,{scale})").cast("double")
