"""Calendar dimension.

One row per day over whole years that cover every order and ship date.
The table is bounded by the date span (366 rows a year), never by the
data volume, so joining it with ``broadcast`` is safe at any scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Holidays as (month, day).
HOLIDAYS = ((1, 1), (12, 25))


def workday_expr(d: F.Column) -> F.Column:
    """Monday-Friday and not a holiday (Spark dayofweek: Sunday = 1)."""
    hol = holiday_expr(d)
    return F.when(F.dayofweek(d).between(2, 6) & ~hol, 1).otherwise(0)


def holiday_expr(d: F.Column) -> F.Column:
    cond = F.lit(False)
    for m, day in HOLIDAYS:
        cond = cond | ((F.month(d) == m) & (F.dayofmonth(d) == day))
    return cond


def build_calendar(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    # one-row span over every order and ship date (partial min/max per task)
    dates = (orders.select(F.col("o_orderdate").alias("d"))
             .unionByName(lineitem.select(F.col("l_shipdate").alias("d"))))
    span = dates.agg(F.min("d").alias("lo"), F.max("d").alias("hi")).select(
        F.trunc(F.col("lo").cast("date"), "YEAR").alias("start"),
        F.last_day(F.make_date(F.year("hi"), F.lit(12), F.lit(1))).alias("stop"),
    )
    days = span.select(F.explode(F.sequence("start", "stop")).alias("date_key"))
    d = F.col("date_key")
    cal = days.select(
        d,
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.date_format(d, "MMMM").alias("month_long"),
        F.last_day(d).alias("month_end"),
        F.date_trunc("week", d).cast("date").alias("week_start"),
        F.dayofweek(d).alias("dow"),
        F.when(holiday_expr(d), 1).otherwise(0).alias("ps_hol_ind"),
        workday_expr(d).alias("workday_ind"),
    )
    mtd = Window.partitionBy("year", "month").orderBy("date_key").rowsBetween(Window.unboundedPreceding, 0)
    ytd = Window.partitionBy("year").orderBy("date_key").rowsBetween(Window.unboundedPreceding, 0)
    # prefix sum over the whole span: one partition, bounded by the span in days
    allw = Window.orderBy("date_key").rowsBetween(Window.unboundedPreceding, 0)
    return (cal.withColumn("workday_nbr_mtd", F.sum("workday_ind").over(mtd))
            .withColumn("workday_nbr_ytd", F.sum("workday_ind").over(ytd))
            .withColumn("cum_workdays", F.sum("workday_ind").over(allw)))
