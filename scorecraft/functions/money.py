"""Exact money arithmetic on scaled integers.

Money is carried per row as ``long`` counts of 10^-scale units (``revenue_e4``
is revenue in 1/10,000): products within a row are 64-bit integer arithmetic
inside whole-stage codegen.  Sums over rows are decimal (``total``): a vendor
with hundreds of millions of rows passes 2^63 units, a decimal of 30 digits
doesn't.  Sums become ``double`` by one correctly rounded conversion of the
exact decimal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = "decimal(20,0)"  # holds any 64-bit count


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def scaled(col: Column, scale: int) -> Column:
    """Exact fixed-point value of a column holding at most ``scale`` decimals."""
    return F.round(col * (10 ** scale)).cast("long")


def units(col: Column | str) -> Column:
    """A row's scaled integer as a decimal: products with large counts and sums of it can't overflow."""
    return _c(col).cast(UNITS)


def total(col: Column | str) -> Column:
    """Exact sum of scaled integers over any number of rows."""
    return F.sum(units(col))


def to_decimal(col: Column | str, scale: int, precision: int = 38) -> Column:
    """Scaled integer or total -> exact decimal(precision, scale)."""
    return (_c(col).cast("decimal(38,0)") / (10 ** scale)).cast(f"decimal({precision},{scale})")


def to_double(col: Column | str, scale: int) -> Column:
    """Total of scaled integers -> the double nearest to the exact value."""
    return to_decimal(col, scale).cast("double")


def row_double(col: Column | str, scale: int) -> Column:
    """A single row's scaled integer -> double; nearest to the exact value below 2^53 units."""
    return _c(col).cast("double") / float(10 ** scale)
