"""Projections."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame


def derive(df: DataFrame, **exprs: Column) -> DataFrame:
    """``*`` plus computed columns."""
    return df.withColumns(exprs)


def keep(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """B2."""
    return df.select(*cols)
