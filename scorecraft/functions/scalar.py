"""Scalar functions of the reference's dialects (H1-H18) as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_day(ts) -> Column:
    """H1 ``datepart``: timestamp -> date."""
    return F.to_date(_c(ts))


def seconds_of_day(ts) -> Column:
    """H2 ``timepart``: seconds since midnight (missing stays missing)."""
    t = _c(ts)
    return F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def period_start(d, unit: str) -> Column:
    """H4 ``intnx(unit, d, 0, 'b')``; unit 'month' or 'year'."""
    return F.trunc(_c(d), {"month": "MM", "year": "YEAR"}[unit])


def month_end(d) -> Column:
    """H5 ``intnx('month', d, 0, 'e')``."""
    return F.last_day(_c(d))


def trend_start(d, months: int = 12) -> Column:
    """H6 ``intnx('month', d, -12, 'b')``."""
    return F.add_months(F.trunc(_c(d), "MM"), -months)


def default_asof() -> Column:
    """H7 ``today()-1``."""
    return F.date_sub(F.current_date(), 1)


def is_workday(d, holiday: Column | None = None) -> Column:
    """H8: Monday-Friday and not a holiday."""
    wd = F.dayofweek(_c(d)).between(2, 6)
    return wd & ~holiday if holiday is not None else wd


def week_start(d) -> Column:
    """H9: Monday of the week."""
    return F.date_trunc("week", _c(d)).cast("date")


def first_present(*cols) -> Column:
    """H10/B24 ``coalesce``."""
    return F.coalesce(*[_c(c) for c in cols])


def norm_text(col) -> Column:
    """H11 ``upper(left(x))``: left-align then upper-case."""
    return F.upper(F.ltrim(_c(col)))


def parent_code(col, zeros: str = "0.0.0.0.0.0") -> Column:
    """Text up to the first dot, then a dot and the zero segments."""
    c = _c(col)
    head = F.substring_index(c, ".", 1)
    return F.concat(head, F.lit("." + zeros))


def fixed_width(col, w: int) -> Column:
    """H14 ``put(x, $w.)``: cut to w characters."""
    return F.substring(_c(col), 1, w)


def to_number(col) -> Column:
    """H15 ``input(x, 12.)``: text -> number, missing when not numeric."""
    return _c(col).cast("string").try_cast("double")


def to_int(col) -> Column:
    """H16 ``INTEGER(x)``: truncates toward zero."""
    return _c(col).cast("int")


def position(col, sub: str) -> Column:
    """H18 ``index(text, sub)``: 1-based position, 0 when absent."""
    return F.instr(_c(col), sub)
