"""Missing-value semantics (S1-S13) on hand-made rows; expected values by hand."""

import datetime as dt

from pyspark.sql import functions as F

from scorecraft.functions.codes import band, effective_cost, segment_label, transit_days, txn_type
from scorecraft.functions.scalar import parent_code, seconds_of_day
from scorecraft.functions.semantics import (chop_last, ne_keep_missing, not_in_keep_missing, ratio, sas_le,
                                            sas_lt, stable)
from scorecraft.operators.joins import full_merge, join_ns, keep_extreme, workdays_between
from scorecraft.sources.calendar import build_calendar


def _rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_missing_is_lowest(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, None), (None, None), (1.0, 2.0), (2.0, 1.0), (1.0, 1.0)],
                               "a double, b double")
    got = _rows(df.select(sas_lt(F.col("a"), F.col("b")).alias("lt"), sas_le(F.col("a"), F.col("b")).alias("le")), "lt", "le")
    assert got == [(True, True), (False, False), (False, True), (True, True), (False, False), (False, True)]


def test_ne_and_not_in_keep_missing(spark):
    df = spark.createDataFrame([(None,), (7,), (5,)], "x int")
    assert _rows(df.select(ne_keep_missing(F.col("x"), 7).alias("r")), "r") == [(True,), (False,), (True,)]
    assert _rows(df.select(not_in_keep_missing(F.col("x"), [5, 6]).alias("r")), "r") == [(True,), (True,), (False,)]


def test_missing_matches_missing_in_join(spark):
    a = spark.createDataFrame([(None, 1), (2, 2)], "k int, va int")
    b = spark.createDataFrame([(None, 10), (2, 20), (3, 30)], "k int, vb int")
    got = sorted(_rows(join_ns(a, b, ["k"]), "va", "vb"))
    assert got == [(1, 10), (2, 20)]


def test_zero_divisor_is_missing(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "n double, d double")
    assert _rows(df.select(ratio(F.col("n"), F.col("d")).alias("r")), "r") == [(None,), (None,), (1.5,)]


def test_chop_last(spark):
    df = spark.createDataFrame([("ABCX",), ("A",), ("  ",), (None,), ("AB  ",)], "s string")
    assert _rows(df.select(chop_last(F.col("s")).alias("r")), "r") == [("ABC",), (None,), (None,), (None,), ("A",)]


def test_band_missing_counts_below(spark):
    df = spark.createDataFrame([(0.6,), (0.5,), (0.4,), (None,)], "x double")
    got = _rows(df.select(band(F.col("x"), 0.5, ("hi", "eq", "lo")).alias("b")), "b")
    assert got == [("hi",), ("eq",), ("lo",), ("lo",)]


def test_effective_cost(spark):
    df = spark.createDataFrame([(None, 5.0), (5.0, None), (0.01, 4.0), (3.0, 4.0), (4.0, 3.0)],
                               "ex double, out double")
    got = _rows(df.select(effective_cost(F.col("ex"), F.col("out"), 0.01).alias("c")), "c")
    assert got == [(5.0,), (5.0,), (4.0,), (3.0,), (3.0,)]


def test_transit_and_type(spark):
    df = spark.createDataFrame([(11, 1, 0), (6, 0, 1), (99, 1, 1), (None, 0, 0)], "m int, o int, r int")
    got = _rows(df.select(transit_days(F.col("m")).alias("t"), txn_type(F.col("o"), F.col("r")).alias("y")), "t", "y")
    assert got == [(0, "O"), (1, "R"), (None, "O/R"), (None, "PC")]


def test_segment_label(spark):
    df = spark.createDataFrame([(" enterprise", None), ("x", " iso"), ("x", None), ("SODEXO", "ISO")],
                               "segment string, sub_segment string")
    lab, srt = segment_label(F.col("segment"), F.col("sub_segment"))
    assert _rows(df.select(lab.alias("l"), srt.alias("s")), "l", "s") == [
        ("Enterprise", 1), ("ISO", 4), ("Provider", 3), ("Sodexo", 2)]


def test_parent_code_and_timepart(spark):
    df = spark.createDataFrame([("d1.12.0.0.0.0.0", dt.datetime(2020, 1, 1, 13, 30, 5))], "c string, ts timestamp")
    got = _rows(df.select(parent_code(F.col("c")).alias("p"), seconds_of_day(F.col("ts")).alias("s")), "p", "s")
    assert got == [("d1.0.0.0.0.0.0", 13 * 3600 + 30 * 60 + 5)]


def test_workdays_between_matches_range_sum(spark):
    orders = spark.createDataFrame([(dt.datetime(2020, 1, 1),)], "o_orderdate timestamp")
    lines = spark.createDataFrame([(dt.datetime(2020, 3, 31),)], "l_shipdate timestamp")
    cal = build_calendar(orders, lines)
    pairs = spark.createDataFrame([
        (dt.date(2020, 1, 6), dt.date(2020, 1, 10)),   # Mon..Fri: 5 workdays - 1
        (dt.date(2020, 1, 10), dt.date(2020, 1, 6)),   # reversed: missing
        (None, dt.date(2020, 1, 3)),                    # open start: Jan 2, 3 -> 2 - 1
        (dt.date(2020, 1, 4), None),                    # no end: missing
        (dt.date(2020, 1, 4), dt.date(2020, 1, 5)),     # weekend: 0 - 1
    ], "a date, b date")
    got = _rows(workdays_between(pairs, "a", "b", cal, "d"), "d")
    assert got == [(4,), (None,), (1,), (None,), (-1,)]


def test_keep_extreme_keeps_ties(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 3, "c"), (None, 2, "d")], "k int, t int, v string")
    assert sorted(_rows(keep_extreme(df, ["k"], "t"), "v")) == [("a",), ("b",), ("d",)]


def test_full_merge_keeps_both_key_sets(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, b string")
    assert sorted(_rows(full_merge(a, b, "k"), "k")) == [(1,), (2,), (3,)]


def test_stable_rounds_through_decimal(spark):
    df = spark.createDataFrame([(0.1 + 0.2,)], "x double")
    assert _rows(df.select(stable(F.col("x")).alias("s")), "s") == [(0.3,)]
