"""Windows (E1-E6)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each key by a total order.

    Implemented as a grouped ``min`` over a struct whose leading fields are
    the order columns: a partial aggregate per task and one shuffle, instead
    of sorting every group.  ``order`` must make the order total (S10).
    """
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"__o{i}" for i in range(len(order_cols))]
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[c.alias(n) for c, n in zip(order_cols, names)],
                      *[F.col(c) for c in rest]).alias("__r")
    return df.groupBy(*keys).agg(F.min(packed).alias("__r")).select(*keys, *[F.col("__r." + c).alias(c) for c in rest])


def rank_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rank",
                  partitions: int | None = None) -> DataFrame:
    """Running counter within a sorted by-group (row number under a total order).

    A plain ``Window.partitionBy(keys)`` would put a whole group into one
    task.  Instead the rows are range-partitioned on (keys, order), so a hot
    group is spread over many partitions in order; the cut rows are written
    once to the shared folder with their partition's number, and everything
    after reads that one cut (range boundaries are sampled: a second sampling
    would cut elsewhere).  Each slice is numbered locally and adds the row
    count of its group's earlier slices (a small table).  ``order`` must be a
    total order.
    """
    from scorecraft.sources.tables import stored

    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *keys, *order).withColumn("__pid", F.spark_partition_id())
    cut = stored(cut, "ranked")
    local = Window.partitionBy("__pid", *keys).orderBy(*order)
    ranged = cut.withColumn("__rn", F.row_number().over(local))
    counts = cut.groupBy("__pid", *keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__pid").alias("__opid"), *[F.col(k).alias("__o_" + k) for k in keys],
                            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    cond = F.col("__pid") == F.col("__opid")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col("__o_" + k))
    j = ranged.join(offsets, cond, "inner")
    return j.select(*df.columns, (F.col("__off") + F.col("__rn")).cast("int").alias(out))


def rank_in_lists(members: DataFrame, lists: DataFrame, on: str, keys: Sequence[str], order: Sequence[str],
                  out: str = "rank") -> DataFrame:
    """E2 over a join: running counter within the by-groups ``keys`` of ``members`` joined to ``lists`` on ``on``.

    Members times list entries grows with the square of the tables, so the joined
    rows are neither dealt nor stored: a group of one member row shows its list in
    the list's own order, so every list is ranked once and its ranks are joined to
    all members that name it.  Groups of several member rows (their lists meet in
    one order) are ranked over their joined rows.
    """
    packed = F.struct(*[c for c in members.columns if c not in keys])
    groups = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min(packed).alias("__r"))
    single = groups.filter(F.col("__n") == 1).select(*keys, "__r.*")
    more = groups.filter(F.col("__n") > 1).select(*[F.col(k).alias("__g_" + k) for k in keys])
    same = reduce(and_, (F.col(k).eqNullSafe(F.col("__g_" + k)) for k in keys))
    columns = [*members.columns, *[c for c in lists.columns if c != on]]
    alone = single.join(rank_in_group(lists, [on], order, out), on, "inner").select(*columns, out)
    joined = members.join(more, same, "left_semi").join(lists, on, "inner").select(*columns)
    return alone.unionByName(rank_in_group(joined, keys, order, out))


def top_slots(df: DataFrame, key: str, value: str, order: Sequence[Column | str], k: int,
              prefix: str, more_col: str) -> DataFrame:
    """E5: first k values as columns plus a flag telling a (k+1)-th exists.

    ``row_number <= k+1`` right after the window lets Spark insert a
    WindowGroupLimit, so each task keeps at most k+1 rows per key before
    the shuffle; then one conditional aggregate pivots the slots.
    """
    w = Window.partitionBy(key).orderBy(*order)
    ranked = df.select(key, value, F.row_number().over(w).alias("__rn")).filter(F.col("__rn") <= k + 1)
    aggs = [F.max(F.when(F.col("__rn") == i, F.col(value))).alias(f"{prefix}{i}") for i in range(1, k + 1)]
    aggs.append(F.max(F.when(F.col("__rn") == k + 1, 1).otherwise(0)).alias(more_col))
    return ranked.groupBy(key).agg(*aggs)


def workday_numbers(cal: DataFrame) -> DataFrame:
    """Workday number month-to-date and year-to-date (running sums)."""
    mtd = Window.partitionBy("year", "month").orderBy("date_key").rowsBetween(Window.unboundedPreceding, 0)
    ytd = Window.partitionBy("year").orderBy("date_key").rowsBetween(Window.unboundedPreceding, 0)
    return cal.select("date_key", "year", "month", "workday_ind",
                      F.sum("workday_ind").over(mtd).alias("workday_nbr_mtd"),
                      F.sum("workday_ind").over(ytd).alias("workday_nbr_ytd"))
