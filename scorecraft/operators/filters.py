"""Row filters and predicates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecraft.functions.semantics import ne_keep_missing, not_in_keep_missing, sas_le


def _d(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("date")


def in_period(df: DataFrame, col: str, start, end) -> DataFrame:
    """Date (or the date part of a timestamp) within [start, end]."""
    return df.filter(F.col(col).cast("date").between(_d(start), _d(end)))


def period_pred(col: str | Column, start, end) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("date").between(_d(start), _d(end))


def since(df: DataFrame, col: str, start) -> DataFrame:
    """Open-ended date filter."""
    return df.filter(F.col(col).cast("date") >= _d(start))


def keep_not_in(df: DataFrame, col: str, values: Iterable) -> DataFrame:
    """NOT IN that keeps missing values."""
    return df.filter(not_in_keep_missing(F.col(col), values))


def keep_ne(df: DataFrame, col: str, value) -> DataFrame:
    """Not-equal that keeps missing values."""
    return df.filter(ne_keep_missing(F.col(col), value))


def present(df: DataFrame, col: str) -> DataFrame:
    """B9."""
    return df.filter(F.col(col).isNotNull())


def missing(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNull())


def large_only(df: DataFrame, col: str, threshold) -> DataFrame:
    """|x| >= t with the missing-lowest rule on the negative side."""
    c = F.col(col)
    return df.filter(F.coalesce(c >= threshold, F.lit(False)) | sas_le(c, -threshold))


def active_only(df: DataFrame, flags: Mapping[str, str]) -> DataFrame:
    """Chain of flag equalities."""
    cond = F.lit(True)
    for c, v in flags.items():
        cond = cond & (F.col(c) == v)
    return df.filter(cond)


def by_filter(df: DataFrame, kind: str, ids: Iterable | DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Caller picks which column the ids apply to; ids are a list or a one-column table."""
    if kind not in columns:
        raise ValueError(f"unknown filter kind {kind!r}; expected one of {sorted(columns)}")
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(columns[kind])), columns[kind], "left_semi")
    return df.filter(F.col(columns[kind]).isin(list(ids)))


def has_text(col: str | Column, sub: str) -> Column:
    """Substring predicate; false for missing text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.contains(sub), F.lit(False))
