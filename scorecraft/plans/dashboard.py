"""Daily sales dashboard.

All period bounds derive from one as-of date; values the reference reads
into macro variables (workday counts, week start) are one-row calendar
aggregates joined into the plan, never collected to the driver.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecraft.functions.codes import segment_label, txn_type
from scorecraft.functions.display import budget_status
from scorecraft.functions.money import to_decimal, to_double, total
from scorecraft.functions.scalar import period_start, trend_start
from scorecraft.functions.semantics import in_list, ne_keep_missing, not_in_keep_missing, ratio, sas_le, stable
from scorecraft.operators.aggregates import with_total
from scorecraft.operators.joins import bounded, join_prior_year
from scorecraft.sources.roles import Warehouse, budget_supplement

def _d(x) -> Column:
    return F.lit(x).cast("date")


def _dbl(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


# ---------------------------------------------------------------------------
# K19 daily budget table
# ---------------------------------------------------------------------------

def scalars(t: Warehouse, asof: dt.date) -> dict[str, Column]:
    """Week start, week and month workdays to date as scalar subqueries.

    Each value is a query over the calendar that Spark runs once and uses as
    a constant (``select ... into :m``); no driver round trip, no join.
    """
    cal = t.calendar
    a = _d(asof)
    wk_start = cal.filter(F.col("date_key") == a).select(F.max("week_start")).scalar()
    month_wd = cal.filter(F.col("date_key").between(period_start(a, "month"), a)).select(
        F.sum("workday_ind")).scalar()
    week_wd = cal.filter(F.col("date_key").between(wk_start, a)).select(F.sum("workday_ind")).scalar()
    return {"wk_start": wk_start, "month_workdays": month_wd, "week_workdays": week_wd}


def _period_sums(date: Column, asof: dt.date, actual: Column, budget: Column, prefix: str,
                 sc: dict[str, Column]) -> list[Column]:
    a = _d(asof)
    day = date == a
    week = date.between(sc["wk_start"], a)
    month = date.between(period_start(a, "month"), a)

    def s(cond, x):
        # decimal inputs are summed exactly, then cast
        return F.sum(F.when(cond, x).otherwise(F.lit(0))).cast("double")

    return [
        s(day, actual).alias(f"actual_{prefix}_day"),
        s(day, budget).alias(f"budget_{prefix}_day"),
        ratio(s(week, actual), sc["week_workdays"]).alias(f"actual_{prefix}_week_avg"),
        ratio(s(month, actual), sc["month_workdays"]).alias(f"actual_{prefix}_month_avg"),
        F.sum(actual).cast("double").alias(f"actual_{prefix}_year"),
        F.sum(budget).cast("double").alias(f"budget_{prefix}_year"),
    ]


K19_MEASURES = ["actual_revenue_day", "budget_revenue_day", "actual_revenue_week_avg", "actual_revenue_month_avg",
                "actual_margin_day", "budget_margin_day", "actual_margin_week_avg", "actual_margin_month_avg",
                "actual_revenue_year", "budget_revenue_year", "actual_margin_year", "budget_margin_year"]


def daily_budget(t: Warehouse, asof: dt.date) -> DataFrame:
    """Day / week average / month average / year to date by segment, plus the estimated total."""
    a = _d(asof)
    sc = scalars(t, asof)
    ys = period_start(a, "year")
    act = t.during("daily_actuals", ys, a)
    label, sort = segment_label(F.col("segment"), F.col("sub_segment"))
    p1 = act.groupBy(label.alias("segment"), sort.alias("segment_sort")).agg(
        *_period_sums(F.col("transaction_date"), asof, F.col("actual_revenue"), F.col("budget_revenue"), "revenue", sc),
        *_period_sums(F.col("transaction_date"), asof, F.col("actual_margin"), F.col("budget_margin"), "margin", sc))
    # Spread each month's supplement budget over that month's workdays
    cal = bounded(t.calendar.filter(F.year("date_key") == F.year(a)).select("month_end", "date_key", "workday_ind"))
    sup = budget_supplement(t, t.during("txn", ys, F.last_day(a)))  # whole months, up to the as-of date's
    spread = cal.join(sup, "month_end", "left").select(
        "segment", F.col("sort").alias("segment_sort"), F.col("date_key").alias("transaction_date"),
        *[(_dbl(c) / F.col("days") * F.col("workday_ind")).alias(c)
          for c in ("budget_revenue", "budget_margin", "revenue", "margin")])
    spread = spread.filter(F.col("transaction_date").between(ys, a))
    p2 = spread.groupBy("segment", "segment_sort").agg(
        *_period_sums(F.col("transaction_date"), asof, F.col("revenue"), F.col("budget_revenue"), "revenue", sc),
        *_period_sums(F.col("transaction_date"), asof, F.col("margin"), F.col("budget_margin"), "margin", sc))
    gathered = p1.unionByName(p2)  # G1
    out = with_total(gathered, ["segment", "segment_sort"], {m: F.sum(m) for m in K19_MEASURES},
                     "segment", "Estimated Total", "segment_sort", 99)
    return out.select("segment", "segment_sort", *[stable(F.col(m)).alias(m) for m in K19_MEASURES])


def daily_budget_status(t: Warehouse, asof: dt.date) -> DataFrame:
    """J3 over K19: green / amber / red per period, revenue and margin."""
    df = daily_budget(t, asof)
    cols = []
    for m in ("revenue", "margin"):
        day = f"budget_{m}_day"  # the week's and the month's daily averages are judged against it too
        for per, act, bud in (("day", f"actual_{m}_day", day), ("week", f"actual_{m}_week_avg", day),
                              ("month", f"actual_{m}_month_avg", day),
                              ("year", f"actual_{m}_year", f"budget_{m}_year")):
            cols.append(budget_status(F.col(act), F.col(bud), F.col("segment")).alias(f"{m}_{per}_status"))
    return df.select("segment", "segment_sort", *cols)


# ---------------------------------------------------------------------------
# K20 large billing transactions
# ---------------------------------------------------------------------------

def large_transactions(t: Warehouse, start: dt.date, end: dt.date, threshold: float) -> DataFrame:
    """Transactions (per line and day) whose revenue is at least ``threshold`` either way.

    The reference runs it for a single as-of day (start = end).  Note: the
    reference joins product classes on the modality id; here on the class id.
    """
    r = t.returns.filter(F.col("active") == "Y")
    salv = r.groupBy("salvage_line_item_id").agg(F.min("created_timestamp").alias("salvaged_po_date"))
    rv = t.during("txn", start, end)
    cu = t.customers.select(F.col("company_id").alias("customer_id"), F.col("company_name").alias("customer_name"))
    li = t.line_detail.select("line_item_id", F.col("line_item_description"), F.col("line_item_po").alias("customer_po"))
    org = t.organization.select(F.col("organization_id").alias("sales_rep_id"), F.col("user_name").alias("salesrep_name"))
    mod = bounded(t.modalities).select("modality_id", F.col("modality_code").alias("modality"))
    cls = t.product_classes.select("class_id", F.col("class_code").alias("product_type"))
    cat = bounded(t.product_categories).select("product_category_id",
                                               F.col("product_category_description").alias("product_category"))
    ven = t.vendors.select(F.col("company_id").alias("vendor_id"), F.col("company_name").alias("vendor_name"))
    j = (rv.join(cu, "customer_id", "left").join(li, "line_item_id", "left").join(org, "sales_rep_id", "left")
         .join(salv, rv.line_item_id == salv.salvage_line_item_id, "left")
         .join(mod, "modality_id", "left").join(cls, "class_id", "left").join(cat, "product_category_id", "left")
         .join(ven, "vendor_id", "left"))
    keys2 = ["line_item_id", "txn_date", "vendor_name", "customer_name", "line_item_description", "customer_po",
             "salesrep_name", "modality", "product_type", "product_category", "salvaged_po_date"]
    b1 = j.withColumnRenamed("transaction_date", "txn_date").groupBy(*keys2[:6], "oem_price_e2", *keys2[6:]).agg(
        F.sum("quantity").alias("quantity"), total("revenue_e4").alias("ext_price"),
        total("spend_e6").alias("ext_cost"), total("margin_e6").alias("ext_margin"),
        F.sum("requests").alias("requests"), F.sum("orders").alias("orders"), F.sum("returns").alias("returns"))
    b2 = b1.groupBy(*keys2).agg(
        F.sum("quantity").alias("quantity"), total("oem_price_e2").alias("oem_price"), F.sum("ext_price").alias("ext_price"),
        F.sum("ext_cost").alias("ext_cost"), F.sum("ext_margin").alias("ext_margin"),
        F.sum("requests").alias("requests"), F.sum("orders").alias("orders"), F.sum("returns").alias("returns"))
    b2 = b2.withColumn("ext_price", to_double("ext_price", 4))
    big = b2.filter(F.coalesce(F.col("ext_price") >= threshold, F.lit(False)) | sas_le(F.col("ext_price"), -threshold))
    return big.select(
        F.col("line_item_id").alias("ref_no"),
        txn_type(F.col("orders"), F.col("returns")).alias("type"),
        F.col("txn_date").alias("trx_date"), F.col("vendor_name").alias("vendor"),
        F.col("customer_name").alias("customer"), F.col("line_item_description").alias("description"),
        "customer_po", F.col("quantity").cast("bigint").alias("qty"),
        to_double("oem_price", 2).alias("oem_price"), F.col("ext_price").alias("revenue"),
        to_double("ext_cost", 6).alias("cost"), to_double("ext_margin", 6).alias("margin"),
        ratio(to_double("ext_margin", 6), F.col("ext_price")).alias("margin_pct"),
        F.col("salesrep_name").alias("am"),
        F.when(F.col("salvaged_po_date").isNotNull(), "Y").otherwise("").alias("salvage"))


# ---------------------------------------------------------------------------
# K21 summary statistics grid
# ---------------------------------------------------------------------------

def budget_forecast_actual(t: Warehouse, asof: dt.date) -> DataFrame:
    """BUDGET_FORECAST_AND_ACTUAL as of a date: cy / py x mtd / ytd, one pass."""
    a = _d(asof)
    ms, ys = period_start(a, "month"), period_start(a, "year")
    pa, pms, pys = F.add_months(a, -12), F.add_months(ms, -12), F.add_months(ys, -12)
    da = t.during("daily_actuals", pys, a)
    d = F.col("accounting_date")
    periods = {"cy_mtd": d.between(ms, a), "cy_ytd": d.between(ys, a),
               "py_mtd": d.between(pms, pa), "py_ytd": d.between(pys, pa)}
    aggs = []
    for p, cond in periods.items():
        for kind in ("actual", "budget"):
            for m in ("revenue", "margin"):
                aggs.append(F.sum(F.when(cond, F.col(f"{kind}_{m}"))).alias(f"{p}_{kind}_{m}"))
    return (da.groupBy("segment", "product_category_description").agg(*aggs)
            .withColumn("report_date", a))


def workday_lookups(t: Warehouse, asof: dt.date) -> dict[str, Column]:
    """The four calendar look-ups of the report date, each a scalar subquery."""
    a = _d(asof)
    cal = t.calendar
    at = cal.filter(F.col("date_key") == a)
    same_month = F.month("date_key") == F.month(a)
    return {
        "workdays": at.select(F.max("workday_nbr_mtd")).scalar(),
        "workdays_ytd": at.select(F.max("workday_nbr_ytd")).scalar(),
        "workdays_py_mtd": cal.filter(same_month & (F.year("date_key") == F.year(a) - 1))
        .select(F.max("workday_nbr_mtd")).scalar(),
        "workdays_cy_mtd": cal.filter(same_month & (F.year("date_key") == F.year(a)))
        .select(F.max("workday_nbr_mtd")).scalar(),
    }


GRID_COLS = ["mtd_actual", "mtd_var", "mtd_var_pct", "mtd_var_pri_mtd", "mtd_var_pri_mtd_pct",
             "ytd_actual", "ytd_var", "ytd_var_pct", "ytd_var_pri_ytd", "ytd_var_pri_ytd_pct"]


def summary_statistics(t: Warehouse, asof: dt.date) -> DataFrame:
    """3 overlapping segments x 4 metrics, one scan (grouping by an exploded segment, then stack).

    Biomed = categories Biomed and Stryker; Imaging = every other (missing too).
    """
    bfa = budget_forecast_actual(t, asof)
    look = workday_lookups(t, asof)
    seg = F.explode(F.array(F.lit("Total"), F.when(in_list(F.col("product_category_description"),
                                                           ("Biomed", "Stryker")), "Biomed").otherwise("Imaging")))
    rows = bfa.select("*", seg.alias("customer_segment"))
    sums = [F.sum(c).cast("double").alias(c) for c in bfa.columns if c.startswith(("cy_", "py_"))]
    # every row carries the same report date, so the mean of a look-up is the look-up
    means = [look[c].cast("double").alias(c) for c in look]
    g = rows.groupBy("customer_segment").agg(*sums).select("*", *means)
    c = F.col

    def dv(x, y):
        return F.try_divide(x, y)

    def money_metric(m: str) -> list[Column]:
        cm, cb, pm = c(f"cy_mtd_actual_{m}"), c(f"cy_mtd_budget_{m}"), c(f"py_mtd_actual_{m}")
        cy, cyb, py = c(f"cy_ytd_actual_{m}"), c(f"cy_ytd_budget_{m}"), c(f"py_ytd_actual_{m}")
        return [cm, cm - cb, dv(cm - cb, cb), cm - pm, dv(cm - pm, pm),
                cy, cy - cyb, dv(cy - cyb, cyb), cy - py, dv(cy - py, py)]

    def gm_metric() -> list[Column]:
        def r(p, k):
            return dv(c(f"{p}_{k}_margin"), c(f"{p}_{k}_revenue"))
        null = F.lit(None).cast("double")
        return [r("cy_mtd", "actual"), r("cy_mtd", "actual") - r("cy_mtd", "budget"), null,
                r("cy_mtd", "actual") - r("py_mtd", "actual"), null,
                r("cy_ytd", "actual"), r("cy_ytd", "actual") - r("cy_ytd", "budget"), null,
                r("cy_ytd", "actual") - r("py_ytd", "actual"), null]

    def avg_metric() -> list[Column]:
        cm, cb, pm = c("cy_mtd_actual_revenue"), c("cy_mtd_budget_revenue"), c("py_mtd_actual_revenue")
        cy, cyb, py = c("cy_ytd_actual_revenue"), c("cy_ytd_budget_revenue"), c("py_ytd_actual_revenue")
        wd, wy, wp, wc = c("workdays"), c("workdays_ytd"), c("workdays_py_mtd"), c("workdays_cy_mtd")
        py_rescaled = dv(dv(pm, wd), wp) * wc
        return [dv(cm, wd), dv(cm - cb, wd), dv(cm - cb, cb), dv(cm, wd) - py_rescaled,
                F.lit(1) - dv(py_rescaled, dv(cm, wd)),
                dv(cy, wy), dv(cy - cyb, wy), dv(cy - cyb, cyb), dv(cy - py, wy), dv(cy - py, py)]

    metrics = {"Revenue": money_metric("revenue"), "Margin": money_metric("margin"),
               "GM %": gm_metric(), "AVG REV": avg_metric()}
    wide = g.select("customer_segment", *[v.alias(f"m{i}_{j}") for i, vals in enumerate(metrics.values())
                                          for j, v in enumerate(vals)])
    stack_args = ", ".join(
        f"'{name}', " + ", ".join(f"m{i}_{j}" for j in range(len(GRID_COLS)))
        for i, name in enumerate(metrics))
    out = wide.select("customer_segment", F.expr(
        f"stack({len(metrics)}, {stack_args}) AS (metric, {', '.join(GRID_COLS)})"))
    # every value is IEEE arithmetic on exact decimal sums: deterministic without rounding
    return out.select("customer_segment", "metric", *GRID_COLS)


# ---------------------------------------------------------------------------
# K22 daily statistics by category with prior-year spread
# ---------------------------------------------------------------------------

K22_SUMS = ["actual_requests", "actual_orders", "actual_revenue", "actual_margin", "budget_requests",
            "budget_orders", "budget_revenue", "budget_margin", "forecast_requests", "forecast_orders",
            "forecast_revenue", "forecast_margin"]
PY = ["daily_py_requests", "daily_py_orders", "daily_py_revenue", "daily_py_margin"]


def prior_year_spread(t: Warehouse, asof: dt.date, excluded_parents=(3,)) -> DataFrame:
    """I4: last year's month actuals x (workday / workdays of this year's month), up to the as-of date."""
    a = _d(asof)
    cal = t.calendar.filter(F.col("year") == F.year(a))
    wd = F.when(F.col("dow").isin(2, 3, 4, 5, 6) & (F.col("ps_hol_ind") == 0), 1).otherwise(0)
    factors = cal.groupBy("year", "month").agg(F.try_divide(F.lit(1.0), F.sum(wd).cast("double")).alias("workday_factor"))
    daily = bounded(cal.select("date_key", "year", "month", wd.alias("wd"))
                    .join(factors, ["year", "month"], "left")
                    .select("date_key", "year", "month", (F.col("wd") * F.col("workday_factor")).alias("factor")))
    q = t.during("txn", F.add_months(period_start(a, "year"), -12), F.date_sub(period_start(a, "year"), 1))
    c = t.customers.select(F.col("company_id").alias("customer_id"), "lvl1_company_id")
    ptype = F.when(F.col("product_category_id") == 2, "Biomed").otherwise("Imaging")
    prior = (q.join(c, "customer_id", "inner")
             .filter(not_in_keep_missing(F.col("lvl1_company_id"), excluded_parents))
             .groupBy(F.year("transaction_date").alias("year"), F.month("transaction_date").alias("month"),
                      ptype.alias("product_type"))
             .agg(F.sum("requests").cast("double").alias("requests"), F.sum("orders").cast("double").alias("orders"),
                  to_double(total("revenue_e4"), 4).alias("revenue"), to_double(total("margin_e6"), 6).alias("margin")))
    j = join_prior_year(daily.filter(F.col("date_key") <= a), prior, "year", ["month"], "inner")
    return j.groupBy("date_key", "product_type").agg(
        *[F.sum(F.col("factor") * F.col(x)).alias(f"daily_py_{x}") for x in ("requests", "orders", "revenue", "margin")])


def daily_by_category(t: Warehouse, asof: dt.date, excluded_sub_segment: str = "ARAMARK",
                      excluded_parents=(3,)) -> DataFrame:
    """Month-to-date days by product type (Biomed / Imaging) and their total, with ratios."""
    a = _d(asof)
    bfa = t.during("daily_actuals", period_start(a, "month"), a).filter(ne_keep_missing(F.col("sub_segment"), excluded_sub_segment))
    ptype = F.when(in_list(F.col("product_category_description"), ("Biomed", "Stryker")), "Biomed").otherwise("Imaging")
    unions = bfa.groupBy(F.col("accounting_date").alias("date_key"), ptype.alias("product_type")).agg(
        *[F.sum(x).alias(x) for x in K22_SUMS])
    py = prior_year_spread(t, asof, excluded_parents)
    grp = unions.join(py, ["date_key", "product_type"], "left")
    tot = grp.groupBy("date_key").agg(*[F.sum(x).alias(x) for x in K22_SUMS + PY]) \
        .withColumn("product_type", F.lit("Total"))
    allrows = grp.unionByName(tot)
    out = allrows.select(
        "date_key", "product_type",
        *[F.col(x).cast("bigint").alias(x) for x in K22_SUMS if x.endswith(("requests", "orders"))],
        *[_dbl(x).alias(x) for x in K22_SUMS if x.endswith(("revenue", "margin"))],
        *[F.col(x) for x in PY],
        (F.col("actual_requests") - F.col("budget_requests")).cast("bigint").alias("requests_variance"),
        (F.col("actual_orders") - F.col("budget_orders")).cast("bigint").alias("orders_variance"),
        F.nullif(_dbl("actual_revenue") - _dbl("budget_revenue"), F.lit(0.0)).alias("rev_variance"),
        F.nullif(_dbl("actual_margin") - _dbl("budget_margin"), F.lit(0.0)).alias("margin_variance"),
    )
    return daily_ratios(out)


# measures a reader sees: a zero is shown as blank
SHOWN = ("actual_requests", "actual_orders", "actual_revenue", "actual_margin", "budget_revenue", "budget_margin")


def daily_ratios(df: DataFrame) -> DataFrame:
    """J4 + J5: render-time ratios as columns; zero shown as blank (null)."""
    def z(x: Column) -> Column:
        return F.nullif(x, F.lit(0.0))

    agm = ratio(F.col("actual_margin"), F.col("actual_revenue"))
    bgm = ratio(F.col("budget_margin"), F.col("budget_revenue"))
    return df.select(
        *[F.nullif(F.col(c), F.lit(0).cast(t)).alias(c) if c in SHOWN else F.col(c) for c, t in df.dtypes],
        z(ratio(F.col("actual_orders"), F.col("actual_requests"))).alias("actual_close_rate"),
        z(ratio(F.col("actual_revenue"), F.col("actual_orders"))).alias("actual_sales_po"),
        z(ratio(F.col("actual_margin"), F.col("actual_orders"))).alias("actual_gm_po"),
        z(agm).alias("actual_gm_percent"),
        z(bgm).alias("budget_gm_percent"),
        z(agm - bgm).alias("gm_percent_variance"),
    )


# ---------------------------------------------------------------------------
# K23 13-month trend, transposed
# ---------------------------------------------------------------------------

TREND_ROWS = ["Month", "Monthly Requests", "Monthly Orders", "Net Revenue", "Net Margin", "GM %",
              "Requests per Day", "Orders per Day", "Revenue per Day", "GM per Day", "Max Request Day",
              "Max Order Day", "Max GM Day", "Revenue per Order", "GM per Order", "Selling Days"]


def _txt(x: Column, scale: int = 2) -> Column:
    return x.cast(f"decimal(38,{scale})").cast("string")


def monthly_trend_table(t: Warehouse, asof: dt.date, excluded_parents=(3,)) -> DataFrame:
    """K23 before transposition: one row per month (daily sums, then month sums and best day)."""
    a = _d(asof)
    start = trend_start(a, 12)
    q = t.during("txn", start, a)
    cal = bounded(t.calendar.select("date_key", "year", "month", "month_end", "month_long", "workday_nbr_mtd"))
    cust = t.customers.select(F.col("company_id").alias("customer_id"), "lvl1_company_id")
    rows = (q.join(cal, q.transaction_date == cal.date_key, "inner").join(cust, "customer_id", "left")
            .filter(not_in_keep_missing(F.col("lvl1_company_id"), excluded_parents)))
    daily = rows.groupBy("year", "month", "month_end", "month_long", "transaction_date").agg(
        F.sum("requests").alias("requests"), F.sum("orders").alias("orders"),
        total("revenue_e4").alias("revenue"), total("margin_e6").alias("margin"),
        F.max("workday_nbr_mtd").alias("workdays"))
    monthly = daily.groupBy("year", "month", "month_end", "month_long").agg(
        F.sum("requests").alias("requests"), F.sum("orders").alias("orders"), F.sum("revenue").alias("revenue"),
        F.sum("margin").alias("margin"), F.max("workdays").alias("workdays"),
        F.max("requests").alias("max_requests"), F.max("orders").alias("max_orders"), F.max("margin").alias("max_margin"))
    # money back to exact decimals once per month
    monthly = monthly.withColumns({"revenue": to_decimal("revenue", 4, 38), "margin": to_decimal("margin", 6, 38),
                                   "max_margin": to_decimal("max_margin", 6, 38)})
    return monthly.withColumn("col", (F.col("year") * 12 + F.col("month"))
                              - (F.year(start) * 12 + F.month(start)) + 1)


def monthly_trend(t: Warehouse, asof: dt.date, excluded_parents=(3,)) -> DataFrame:
    """16 measure rows x 13 month columns, all as text (I1 transpose)."""
    m = monthly_trend_table(t, asof, excluded_parents)
    c = F.col
    vals = {
        "Month": c("month_long"),
        "Monthly Requests": c("requests").cast("string"),
        "Monthly Orders": c("orders").cast("string"),
        "Net Revenue": _txt(c("revenue")),
        "Net Margin": _txt(c("margin")),
        "GM %": _txt(ratio(c("margin"), c("revenue")), 6),
        "Requests per Day": _txt(ratio(c("requests"), c("workdays"))),
        "Orders per Day": _txt(ratio(c("orders"), c("workdays"))),
        "Revenue per Day": _txt(ratio(c("revenue"), c("workdays"))),
        "GM per Day": _txt(ratio(c("margin"), c("workdays"))),
        "Max Request Day": c("max_requests").cast("string"),
        "Max Order Day": c("max_orders").cast("string"),
        "Max GM Day": _txt(c("max_margin")),
        "Revenue per Order": _txt(ratio(c("revenue"), c("orders"))),
        "GM per Order": _txt(ratio(c("margin"), c("orders"))),
        "Selling Days": c("workdays").cast("string"),
    }
    long = m.select("col", F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("row_order"), F.lit(k).alias("source"), v.alias("value"))
        for i, (k, v) in enumerate(vals.items())])).alias("r")).select("col", "r.*")
    wide = long.groupBy("row_order", "source").pivot("col", list(range(1, 14))).agg(F.first("value"))
    return wide.select("row_order", "source", *[F.col(str(i)).alias(f"column{i}") for i in range(1, 14)])
