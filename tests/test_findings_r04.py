"""Work that large tables leave on disk: joined rows stored to be numbered, whole roles stored for one reader."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from scorecraft.plans import line_items, primitives
from scorecraft.plans import params as P
from scorecraft.registry import QUERIES
from scorecraft.sources import tables
from scorecraft.sources.roles import STORED_ROLES, Warehouse


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_a_list_is_ranked_once_for_all_its_items(spark, monkeypatch):
    """Items x models are not stored; an item told twice, of two products, or without a number keeps one counter."""
    items = [(i, "V", "P1" if i % 2 else "P2") for i in range(200)] + [(500, "V", "P1"), (500, "V", "P2"), (501, "V", "P2"), (501, "V", "P2")]
    items += [(None, "V", "P1"), (None, "V", "P2"), (502, "V", None), (503, "O", "P1"), (504, "V", "P9")]
    models = [("P1", "a"), ("P1", "c"), ("P1", "e"), ("P2", "b"), ("P2", "d"), ("P3", "z"), (None, "y")]
    kept = []
    real = tables.stored
    monkeypatch.setattr(tables, "stored", lambda df, name: kept.append(real(df, name)) or kept[-1])
    pim = spark.createDataFrame(models, "product_number string, model_code string")
    t = SimpleNamespace(items=spark.createDataFrame(items, "item_number long, item_type string, product_number string"), pim_models=pim, once=lambda name: pim)
    got = primitives.e2_rank_in_group(t)
    assert got.columns == ["item_number", "model_code", "product_number", "rank"]
    lists = {p: sorted(m for q, m in models if q == p) for p in ("P1", "P2")}
    groups = {}
    for i, kind, p in items:
        if kind == "V" and p in lists:
            groups.setdefault(i, []).extend((m, p) for m in lists[p])
    want = [str((i, m, p, n + 1)) for i, found in groups.items() for n, (m, p) in enumerate(sorted(found))]
    assert rows(got) == sorted(want)
    assert sum(df.count() for df in kept) <= len(models) + 5 + 4 + 5


def test_a_role_read_once_is_not_stored(spark, small_dir):
    """A query that reads a role once scans the columns it needs; where the role is stored already, it reads that."""
    Warehouse._shared.clear()
    t = Warehouse(spark, small_dir).prepare()
    view = t.once("txn").select("line_item_id", "orders")
    assert "txn" not in t._cache and "l_extendedprice" not in view._jdf.queryExecution().executedPlan().toString()
    assert rows(view) == rows(t.role("txn").select("line_item_id", "orders"))
    assert any("/stage/txn-" in f for f in t.once("txn").inputFiles())


@pytest.mark.parametrize("name, roles", [("h16_to_int", ["line_items"]), ("d2_sum_if", ["txn", "line_detail"]), ("d3_weighted_sum", ["txn", "line_detail"])])
def test_operators_that_read_a_role_once_store_none(spark, small_dir, name, roles):
    """The wide role is not written for a few of its columns, and the rows are those of the stored one."""
    Warehouse._shared.clear()
    t = Warehouse(spark, small_dir).prepare()
    got = rows(getattr(primitives, name)(t))
    assert not {"line_rows", *roles} & set(t._cache)
    for role in roles:
        t.role(role)
    assert rows(getattr(primitives, name)(t)) == got != []


@pytest.mark.parametrize("name, left_out, day", [("txn", {"revenue", "price_e2", "spend_e6", "cost"}, "transaction_date"), ("line_items", {"part_number_stripped", "work_order_number"}, None)])
def test_stored_rows_hold_each_value_once(spark, small_dir, name, left_out, day):
    """Columns that are computed from others are not dealt and written with them; readers see the role's own columns."""
    Warehouse._shared.clear()
    t, plain = Warehouse(spark, small_dir).prepare(), Warehouse(spark, small_dir).role(name)
    got = t.role(name)
    files = [f for f in got.inputFiles() if name in f]
    held = set(spark.read.parquet(*files[:1]).columns)
    assert files and not held & left_out and left_out < set(got.columns)
    assert got.dtypes == plain.dtypes and rows(got) == rows(plain)
    if day:
        start, end = "1996-02-10", "1996-04-02"
        assert rows(t.during(name, start, end)) == rows(plain.filter(F.col(day).between(start, end)))


def test_quotes_travel_as_their_row_of_lineitem(spark, small_dir):
    """No join of the wide load carries a quote's computed texts before the quote stands beside its line."""
    plan = line_items.line_item_details(Warehouse(spark, small_dir), P.PERIOD_START)._jdf.queryExecution().optimizedPlan()

    def joins(p):
        if p.nodeName() == "Join":
            yield p.output().mkString(",")
        for i in range(p.children().size()):
            yield from joins(p.children().apply(i))

    found = [o for o in joins(plan) if "l_extendedprice" in o or "replacement_part_number_stripped" in o]
    assert found and not [o for o in found if "replacement_part_number_stripped" in o and "id_no" not in o]


@pytest.mark.parametrize("name", ["A1_named_scan", "C11_workdays_between", "E2_rank_in_group", "K4_supplier_type", "K6_best_price", "K18_catalogue_sheet"])
def test_queries_that_read_roles_once_store_none(spark, small_dir, name):
    """Only the calendar, a table of days, is written for them."""
    Warehouse._shared.clear()
    QUERIES[name](spark, small_dir)
    made = {r for cache in Warehouse._shared.values() for r, df in cache.items() if r in STORED_ROLES and any("/stage/" in f for f in df.inputFiles())}
    assert made <= {"calendar"}
