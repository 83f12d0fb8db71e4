"""Randomised checks of the rewrites against brute force on small inputs."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorecraft.operators.joins import workdays_between
from scorecraft.operators.windows import first_per_key, rank_in_group
from scorecraft.sources.calendar import build_calendar

START = dt.date(2020, 1, 1)
DAYS = 120
HOLIDAYS = {(1, 1), (12, 25)}


def _is_workday(d: dt.date) -> int:
    return int(d.weekday() < 5 and (d.month, d.day) not in HOLIDAYS)


dates = st.one_of(st.none(), st.integers(0, DAYS - 1).map(lambda i: START + dt.timedelta(days=i)))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(dates, dates), min_size=1, max_size=25))
def test_workdays_between_equals_range_sum(spark, pairs):
    orders = spark.createDataFrame([(dt.datetime(2020, 1, 1),)], "o_orderdate timestamp")
    lines = spark.createDataFrame([(dt.datetime(2020, 4, 30),)], "l_shipdate timestamp")
    cal = build_calendar(orders, lines)
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a date, b date")
    got = {r["i"]: r["d"] for r in workdays_between(df, "a", "b", cal, "d").collect()}
    for i, (a, b) in enumerate(pairs):
        if b is None:
            want = None
        else:
            lo = a or dt.date(2020, 1, 1)
            if b < lo:
                want = None
            else:
                want = sum(_is_workday(lo + dt.timedelta(days=k)) for k in range((b - lo).days + 1)) - 1
        assert got[i] == want, (a, b)


rows = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 50), st.text("ab", max_size=3)), min_size=1,
                max_size=60, unique_by=lambda r: (r[0], r[1], r[2]))


@settings(max_examples=5, deadline=None)
@given(rows)
def test_rank_in_group_matches_sorted_position(spark, data):
    df = spark.createDataFrame(data, "k int, o int, s string")
    got = {(r["k"], r["o"], r["s"]): r["rank"] for r in rank_in_group(df, ["k"], ["o", "s"], "rank", 4).collect()}
    for k in {r[0] for r in data}:
        ordered = sorted((r for r in data if r[0] == k), key=lambda r: (r[1], r[2]))
        for pos, r in enumerate(ordered, start=1):
            assert got[r] == pos


@settings(max_examples=5, deadline=None)
@given(rows)
def test_first_per_key_matches_min(spark, data):
    df = spark.createDataFrame(data, "k int, o int, s string")
    got = {r["k"]: (r["o"], r["s"]) for r in first_per_key(df, ["k"], ["o", "s"]).collect()}
    for k in {r[0] for r in data}:
        assert got[k] == min((r[1], r[2]) for r in data if r[0] == k)
