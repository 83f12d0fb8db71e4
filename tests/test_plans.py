"""Physical-plan guards: no pair-producing joins, no Python UDFs, pushed-down filters, month folders."""

import datetime as dt
import re
import shutil

import pytest
from pyspark.sql import functions as F

from scorecraft.registry import QUERIES
from scorecraft.sources.roles import MONTHLY, Warehouse

FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("A4")))
def test_no_pairs_no_udfs(spark, small_dir, name):
    plan = _plan(QUERIES[name](spark, small_dir))
    for op in FORBIDDEN:
        assert op not in plan, (name, op)


def test_period_filter_reaches_the_scan(spark, small_dir):
    plan = _plan(QUERIES["B4_in_period"](spark, small_dir))
    assert "PushedFilters: [IsNotNull(transaction_date), GreaterThanOrEqual(transaction_date" in plan \
        or "GreaterThanOrEqual(l_shipdate" in plan


def test_top_slots_limit_runs_before_the_shuffle(spark, small_dir):
    plan = _plan(QUERIES["E5_top_slots"](spark, small_dir))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def _monthly_scans(spark, df) -> list[str]:
    """Partition filters of every scan of a table in month folders."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [x for x in text.splitlines() if "FileScan" in x and any(f"/stage/{n}-" in x for n in MONTHLY)]
    return [re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", x).group(1) for x in scans]


@pytest.mark.parametrize("name", ["K19_daily_budget", "K20_large_transactions", "K22_daily_by_category", "K23_monthly_trend", "I4_spread_prior_year"])
def test_reports_read_their_months_only(spark, small_dir, name):
    found = _monthly_scans(spark, QUERIES[name](spark, small_dir))
    assert found and all("month_start" in x and ">=" in x and "<=" in x for x in found), found


def test_other_months_are_not_opened(spark, small_dir, tmp_path):
    """Folders outside the period are broken on purpose: the period's rows are still read, and equal the plain filter's."""
    start, end = dt.date(1996, 2, 10), dt.date(1996, 4, 2)
    spark.conf.set("scorecraft.warehouse.path", str(tmp_path / "shared"))
    folder = tmp_path / "sf"
    shutil.copytree(small_dir, folder)
    try:
        t = Warehouse(spark, str(folder)).prepare()
        want = sorted(map(tuple, t.role("txn").filter(F.col("transaction_date").between(start, end)).select("line_item_id", "transaction_date").collect()))
        assert t.during("txn", start, end).columns == t.role("txn").columns
        broken = set()
        for path in t._cache["monthly:txn"].inputFiles():
            path = path.removeprefix("file://")
            month = re.search(r"month_start=([0-9-]+)", path).group(1)
            if not "1996-02-01" <= month <= "1996-04-01":
                broken.add(month)
                with open(path, "wb") as f:
                    f.write(b"not parquet")
        assert len(broken) > 12 and want
        spark.conf.set("spark.sql.files.ignoreCorruptFiles", "false")
        got = t.during("txn", start, end).select("line_item_id", "transaction_date")
        assert sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.unset("scorecraft.warehouse.path")


def test_a_range_of_subqueries_and_missing_days(spark, small_dir):
    """Bounds from a query give the same rows; rows without a day lie in a folder of their own and in no period."""
    for t in (Warehouse(spark, small_dir), Warehouse(spark, small_dir).prepare()):
        t.role("txn")
        cal = t.calendar
        first, last = (cal.filter(F.col("date_key").between("1997-03-05", "1997-05-20")).select(f("date_key")).scalar() for f in (F.min, F.max))
        want = t.txn.filter(F.col("transaction_date").between("1997-03-05", "1997-05-20")).count()
        assert t.during("txn", first, last).count() == want > 0
        assert t.during("txn", dt.date(1997, 5, 20), dt.date(1997, 3, 5)).count() == 0
    from scorecraft.sources.roles import MONTH, _by_month

    rows = spark.createDataFrame([(1, dt.date(1997, 3, 5)), (2, None)], "line_item_id long, transaction_date date")
    assert {(r["line_item_id"], r[MONTH]) for r in _by_month(rows, "transaction_date", ()).collect()} == {(1, dt.date(1997, 3, 1)), (2, None)}
