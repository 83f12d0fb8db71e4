"""Aggregations.

All aggregates are built-in, so Spark runs them as partial (map-side)
aggregation followed by one shuffle on the grouping keys; a hot key is
pre-aggregated in every task before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecraft.functions.semantics import ratio


def dsum(c) -> Column:
    """Sum of a money column, exact in decimal, returned as double."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c).cast("double")


def isum(c) -> Column:
    """Sum of a count or flag column as bigint."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c).cast("bigint")


def sum_by(df: DataFrame, keys: Sequence, cols: Mapping[str, Column]) -> DataFrame:
    """Grouped sums; keys may be names or expressions."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in cols.items()])


def sum_if(cond: Column, x) -> Column:
    """``sum(case when cond then x else 0 end)``."""
    x = F.col(x) if isinstance(x, str) else x
    return F.sum(F.when(cond, x).otherwise(F.lit(0)))


def sum_when(cond: Column, x) -> Column:
    """D2 without ELSE: missing when no row matches."""
    x = F.col(x) if isinstance(x, str) else x
    return F.sum(F.when(cond, x))


def weighted_sum(flag, x) -> Column:
    """D3: ``sum(flag * x)``."""
    f = F.col(flag) if isinstance(flag, str) else flag
    x = F.col(x) if isinstance(x, str) else x
    return F.sum(f * x)


def count_if(cond: Column, x) -> Column:
    """``count(case when cond then x end)`` - counts non-missing x."""
    x = F.col(x) if isinstance(x, str) else x
    return F.count(F.when(cond, x))


def distinct_count(*cols) -> Column:
    """Exact distinct count."""
    return F.countDistinct(*cols)


def row_count() -> Column:
    """``sum(1)``."""
    return F.count(F.lit(1))


def any_flag(cond: Column) -> Column:
    """``max(case when cond then 1 else 0 end)``."""
    return F.max(F.when(cond, 1).otherwise(0))


def ratio_of_sums(num: Column, den: Column) -> Column:
    """Share / margin % as a ratio of sums; missing on zero divisor."""
    return ratio(num, den)


def flag_share(col: str, yes: str = "Y") -> Column:
    """Share of Y among non-missing flags."""
    return ratio(F.sum(F.when(F.col(col) == yes, 1)), F.count(col))


def wavg(x: str, w: str) -> Column:
    """``sum(x*w)/sum(w)``."""
    return ratio(F.sum(F.col(x) * F.col(w)), F.sum(w))


def grand_total(df: DataFrame, aggs: Mapping[str, Column]) -> DataFrame:
    """One row (global aggregate: per-task partials, one final merge)."""
    return df.agg(*[c.alias(n) for n, c in aggs.items()])


def with_total(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column],
               label_col: str, label: str, sort_col: str, sort_value: int) -> DataFrame:
    """Groups plus a total row labelled ``label`` with sort key ``sort_value``.

    ``rollup`` computes groups and total from one scan and one shuffle.
    """
    agg_cols = [c.alias(n) for n, c in aggs.items()]
    r = df.rollup(*keys).agg(*agg_cols, F.grouping_id().alias("__g"))
    r = r.filter((F.col("__g") == 0) | (F.col("__g") == (1 << len(keys)) - 1))
    return (r.withColumn(label_col, F.when(F.col("__g") == 0, F.col(label_col)).otherwise(F.lit(label)))
            .withColumn(sort_col, F.when(F.col("__g") == 0, F.col(sort_col)).otherwise(F.lit(sort_value)))
            .drop("__g"))


def remerge(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """D19 (S4): every input row kept, group aggregates repeated on it.

    Aggregate (partial, map-side) and join back on the keys (missing keys
    match, as in a group).  A window over the keys would hold a whole group
    in one task; the join lets AQE split a hot group across tasks.
    """
    keys = list(keys)
    g = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    g = g.select(*[F.col(k).alias("__g_" + k) for k in keys], *aggs.keys())
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(g["__g_" + k])
        cond = c if cond is None else cond & c
    return df.join(g, cond, "inner").drop(*["__g_" + k for k in keys])


def best_day(daily: DataFrame, keys: Sequence[str], measures: Iterable[str]) -> DataFrame:
    """Second-level aggregate: period sums and best (max) daily value."""
    aggs = []
    for m in measures:
        aggs += [F.sum(m).alias(m), F.max(m).alias(f"best_{m}")]
    return daily.groupBy(*keys).agg(*aggs)
