"""Joins (C1-C18).

Broadcast policy: only sides whose size is bounded by construction (calendar
days in the span, nations, ship-method and other code tables) get an explicit
``broadcast`` hint.  Every other dimension (vendors, customers, items, ...)
grows with the data, so its strategy is left to the optimizer: it is
broadcast only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` (checked again at runtime by AQE
from real shuffle sizes), otherwise it is a shuffle join, with AQE splitting
skewed partitions of hot keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded(df: DataFrame) -> DataFrame:
    """Broadcast hint for a side whose row count is bounded by construction."""
    return F.broadcast(df)


def _keys(on) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def inner(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """C1."""
    return a.join(b, on=on, how="inner")


def left(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """C2."""
    return a.join(b, on=on, how="left")


def star(fact: DataFrame, dims: Sequence[tuple[DataFrame, object, str]]) -> DataFrame:
    """Chain of (dimension, condition, how) joins onto a fact."""
    out = fact
    for dim, cond, how in dims:
        out = out.join(dim, on=cond, how=how)
    return out


def join_ns(a: DataFrame, b: DataFrame, keys: Iterable[str], how: str = "inner",
            b_prefix: str = "r_") -> DataFrame:
    """C18 (S3): equi-join where missing matches missing (``<=>``).

    The right side's key columns are renamed with ``b_prefix`` and dropped
    after the join; Spark still plans a hash or sort-merge join on ``<=>``.
    """
    keys = list(keys)
    b2 = b.select(*[F.col(k).alias(b_prefix + k) if k in keys else F.col(k) for k in b.columns])
    cond = None
    for k in keys:
        c = a[k].eqNullSafe(b2[b_prefix + k])
        cond = c if cond is None else cond & c
    return a.join(b2, on=cond, how=how).drop(*[b_prefix + k for k in keys])


def full_merge(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full outer join and one coalesced key column."""
    a2 = a.withColumnRenamed(key, "__ka")
    b2 = b.withColumnRenamed(key, "__kb")
    return (a2.join(b2, a2["__ka"].eqNullSafe(b2["__kb"]), "full")
            .withColumn(key, F.coalesce("__ka", "__kb")).drop("__ka", "__kb"))


def left_where(a: DataFrame, b: DataFrame, on, right_filter: Column) -> DataFrame:
    """Outer join with a filter inside ON: filter the right side first."""
    return a.join(b.filter(right_filter), on=on, how="left")


def join_on_expr(a: DataFrame, b: DataFrame, key_a: Column, key_b: Column, how: str = "inner",
                 name: str = "__jk") -> DataFrame:
    """Join on computed keys: materialise them as columns, then equi-join."""
    a2 = a.withColumn(name, key_a)
    b2 = b.withColumn(name, key_b)
    return a2.join(b2, on=name, how=how).drop(name)


def role_join(df: DataFrame, dim: DataFrame, roles: Mapping[str, str], dim_key: str,
              cols: Sequence[str]) -> DataFrame:
    """Join one dimension several times, once per role, with prefixed columns."""
    out = df
    for prefix, key in roles.items():
        d = dim.select(F.col(dim_key).alias(f"{prefix}_{dim_key}"),
                       *[F.col(c).alias(f"{prefix}_{c}") for c in cols])
        out = out.join(d, out[key] == d[f"{prefix}_{dim_key}"], "left").drop(f"{prefix}_{dim_key}")
    return out


def only_in(df: DataFrame, summary: DataFrame, keys: Iterable[str]) -> DataFrame:
    """C14: semi-join with missing-matches-missing keys."""
    keys = list(keys)
    s = summary.select(*[F.col(k).alias("__s_" + k) for k in keys])
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(s["__s_" + k])
        cond = c if cond is None else cond & c
    return df.join(s, on=cond, how="left_semi")


def join_prior_year(cur: DataFrame, prior: DataFrame, year: str, keys: Iterable[str],
                    how: str = "left") -> DataFrame:
    """Match each row with the same keys one year earlier (shifted key)."""
    keys = list(keys)
    p = prior.withColumn(year, F.col(year) + 1)
    return cur.join(p, on=[year, *keys], how=how)


def workdays_between(df: DataFrame, start: str, end: str, cal: DataFrame, out: str) -> DataFrame:
    """Sum of workday flags over [start, end] without a range join.

    Uses the calendar prefix sum W(d): the sum over [a, b] is
    W(b) - W(a) + workday(a), minus 1 as in the reference.  b missing ->
    missing; b < a -> missing (the sum over an empty range); a missing ->
    open lower bound (S1: missing is lowest), i.e. W(b) - 1.  Two equi-joins
    against the bounded calendar replace the correlated range subquery.
    """
    c = bounded(cal.select("date_key", "cum_workdays", "workday_ind"))
    ca = c.select(F.col("date_key").alias("__da"), F.col("cum_workdays").alias("__wa"),
                  F.col("workday_ind").alias("__ia"))
    cb = c.select(F.col("date_key").alias("__db"), F.col("cum_workdays").alias("__wb"))
    j = (df.join(ca, F.col(start) == F.col("__da"), "left")
         .join(cb, F.col(end) == F.col("__db"), "left"))
    val = (F.when(F.col(end).isNull(), F.lit(None))
           .when(F.col(start).isNull(), F.col("__wb") - 1)
           .when(F.col(end) < F.col(start), F.lit(None))
           .otherwise(F.col("__wb") - F.col("__wa") + F.col("__ia") - 1))
    return j.withColumn(out, val.cast("bigint")).drop("__da", "__wa", "__ia", "__db", "__wb")


def slots(df: DataFrame, child: DataFrame, key: str, rank: str, value: str, k: int,
          prefix: str, child_key: str | None = None) -> DataFrame:
    """K joins to the same child on rank = 1..k, as one pivot + one join.

    ``groupBy(key).agg(max(when(rank == i, value)))`` builds all k slot
    columns in one shuffle of the child table; the result is then joined
    once (left) to ``df``.
    """
    child_key = child_key or key
    aggs = [F.max(F.when(F.col(rank) == i, F.col(value))).alias(f"{prefix}{i}") for i in range(1, k + 1)]
    wide = (child.filter(F.col(rank).between(1, k))
            .groupBy(F.col(child_key).alias("__slot_key")).agg(*aggs))
    return df.join(wide, df[key] == wide["__slot_key"], "left").drop("__slot_key")


def keep_extreme(df: DataFrame, keys: Sequence[str], col: str, how: str = "max") -> DataFrame:
    """Rows whose ``col`` equals the per-key extreme; ties kept.

    Aggregate (partial, map-side) then join back on the keys and value:
    no window sort of whole groups, so a hot key costs a running extreme.
    """
    agg = F.max(col) if how == "max" else F.min(col)
    ext = df.groupBy(*keys).agg(agg.alias("__ext"))
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(ext[k])
        cond = c if cond is None else cond & c
    cond = cond & (df[col] == ext["__ext"])
    return df.join(ext, cond, "left_semi")


def with_parent(df: DataFrame, code: str, parent_expr: Column, parent_col: str,
                cols: Sequence[str]) -> DataFrame:
    """Parent code from child code, then a self left join for parent attributes."""
    child = df.withColumn(parent_col, parent_expr)
    par = df.select(F.col(code).alias("__pcode"), *[F.col(c).alias(f"parent_{c}") for c in cols])
    return child.join(par, child[parent_col] == par["__pcode"], "left").drop("__pcode")
