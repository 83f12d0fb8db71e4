"""Every registered query equals its DuckDB oracle on the smallest data set."""

import pytest

import __spark_entry__ as entry
from scripts.compare import duck, table_hash

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


TYPES = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE", "StringType()": "VARCHAR",
         "DateType()": "DATE", "TimestampNTZType()": "TIMESTAMP", "BooleanType()": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, small_dir, con, name):
    df = QUERIES[name](spark, small_dir)
    srows = [tuple(r) for r in df.collect()]
    rel = con.sql(ORACLE[name])
    dtypes = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    for f in df.schema.fields:  # same column types, not only values
        assert TYPES.get(repr(f.dataType), repr(f.dataType)) == dtypes[f.name], (f.name, f.dataType, dtypes[f.name])
    cur = con.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert table_hash(df.columns, srows)[0] == table_hash(dcols, drows)[0]


def test_every_query_has_oracle_or_reason():
    missing = set(QUERIES) - set(ORACLE)
    # queries without SQL must say why in their docstring
    for name in missing:
        assert QUERIES[name].__doc__, name


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "Supplier Id"
    assert df.count() >= 0
