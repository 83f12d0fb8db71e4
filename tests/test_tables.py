"""Loads that replace a table, stored tables in buckets, source queries of two folders."""

import pytest
from pyspark.sql import functions as F

from scorecraft.plans import line_items
from scorecraft.plans import params as P
from scorecraft.sources import tables
from scorecraft.sources.roles import Warehouse


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_readers_never_meet_an_empty_target(spark, tmp_path):
    path = f"file://{tmp_path}/dim"
    with pytest.raises(FileNotFoundError):
        tables.current(spark, path)
    tables.full_refresh(spark.range(5), path)
    held = tables.current(spark, path)  # a reader that keeps its version
    assert held.count() == 5
    tables.full_refresh(spark.range(3), path)
    assert rows(held) == rows(spark.range(5)) and rows(tables.current(spark, path)) == rows(spark.range(3))
    tables.full_refresh(spark.range(0), path)
    assert tables.current(spark, path).count() == 0 and tables.current(spark, path).columns == ["id"]


def test_a_failed_load_keeps_the_old_rows(spark, tmp_path):
    path = f"file://{tmp_path}/dim"
    tables.full_refresh(spark.range(5), path)
    bad = spark.range(100).repartition(4).withColumn("id", F.when(F.col("id") == 70, F.raise_error(F.lit("broken row")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken row"):
        tables.full_refresh(bad, path)
    assert rows(tables.current(spark, path)) == rows(spark.range(5))
    assert len([p for p in (tmp_path / "dim").iterdir() if p.name.startswith("load-")]) == 1  # nothing of it is left


def test_old_versions_go_and_numbers_are_taken_once(spark, tmp_path):
    path = f"file://{tmp_path}/dim"
    folders = [tables.full_refresh(spark.range(i), path) for i in range(5)]
    left = {p.name for p in (tmp_path / "dim").iterdir() if p.name.startswith("load-")}
    assert left == {f.rsplit("/", 1)[1] for f in folders[-2:]}
    one, two = (tables._publish(spark, path, f"load-{n}") for n in ("a", "b"))
    assert two == one + 1
    assert tables._published(spark, path, one) == "load-a" and tables._published(spark, path, two) == "load-b"


def test_partitioned_load(spark, tmp_path):
    path = f"file://{tmp_path}/dim"
    tables.full_refresh(spark.range(10).withColumn("m", F.col("id") % 3), path, ["m"])
    assert rows(tables.current(spark, path).select("id", "m")) == [(i, i % 3) for i in range(10)]


def test_bucketed_tables_join_without_exchange(spark):
    one = tables.bucketed(spark.range(1000).withColumn("a", F.lit("x")), "one", "id")
    two = tables.bucketed(spark.range(0, 2000, 2).withColumn("b", F.lit("y")), "two", "id")
    joined = one.join(two.hint("shuffle_hash"), "id", "left")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan
    assert joined.filter("b is not null").count() == 500


def test_wide_load_exchanges_no_wide_row(spark, small_dir):
    """The line table and its stored sides meet in their buckets: what is exchanged by line id are narrow sides."""
    plan = line_items.line_item_details(Warehouse(spark, small_dir).prepare(), P.PERIOD_START)._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert text.count("ShuffledHashJoin") >= 8
    widest = max(len(line.split("[", 1)[1].split(",")) if "[" in line else 0 for line in text.splitlines() if "Exchange hashpartitioning(id_no" in line or "Exchange hashpartitioning(line_item_id" in line)
    assert widest < 40


def test_intermediate_tables_go_at_the_end_of_a_report(spark, tmp_path):
    """A3: dropped when the block ends, by an error too; a block inside another drops its own only."""
    def there(df):
        where, fs = tables._file(spark, df.inputFiles()[0])
        return fs.exists(where)

    with tables.report_run(spark):
        outer = tables.stage(spark, spark.range(4), "outer", "a")
        with pytest.raises(ValueError), tables.report_run(spark):
            inner = tables.stage(spark, spark.range(3), "inner", "b")
            assert inner.count() == 3
            raise ValueError
        assert not there(inner) and there(outer) and outer.count() == 4
    assert not there(outer)
    kept = tables.stage(spark, spark.range(2), "kept", "c")
    assert there(kept)


def test_a_report_in_a_run_leaves_nothing_but_its_roles(spark, small_dir):
    from scorecraft.plans import compliance

    t = Warehouse(spark, small_dir).prepare()
    with tables.report_run(spark):
        one = rows(compliance.backorder_trends(t, P.PERIOD_START, P.PERIOD_END))
    assert rows(compliance.backorder_trends(t, P.PERIOD_START, P.PERIOD_END)) == one != []
    assert t.role("txn").count() > 0


def test_source_queries_name_no_view(spark, small_dir):
    """Two source queries made before either runs keep their own tables, and the session has no view afterwards."""
    ask = "SELECT max(id) AS most FROM {given} WHERE id < {below}"
    one = tables.query(spark, ask, given=spark.range(10), below=8)
    two = tables.query(spark, ask, given=spark.range(100, 200), below=150)
    assert (one.first()["most"], two.first()["most"]) == (7, 149)
    from scorecraft.plans import catalogue

    catalogue.parent_child(Warehouse(spark, small_dir))
    assert not [v for v in spark.catalog.listTables() if v.isTemporary and (v.name == "oem_structure" or v.name.startswith("_pyspark"))]
