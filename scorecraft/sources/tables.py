"""Sources and sinks.

A1 (named-table scan) is ``Warehouse.base`` / ``Warehouse.role``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Codec of tables stored for later steps: written once, read a few times, and they fill the shared folder.
COMPRESSION = "zstd"

#: Paths of the intermediate tables of the open ``report_run``.
_staged: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def query(spark: SparkSession, sql: str, jdbc: Mapping[str, str] | None = None, **given) -> DataFrame:
    """A2: a whole SELECT run at the source, its result read as a table.

    With ``jdbc`` options the statement is pushed to the database
    (``format("jdbc").option("query", sql)``); otherwise it runs in this
    session.  There ``{name}`` in the text stands for ``given[name]``: a
    DataFrame (no view that another query of the session could replace) or a
    value, which becomes a literal.
    """
    if jdbc:
        reader = spark.read.format("jdbc").option("query", sql)
        for k, v in jdbc.items():
            reader = reader.option(k, v)
        return reader.load()
    return spark.sql(sql, **given)


def full_refresh(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet", keep: int = 2) -> str:
    """A4: replace the whole content of the table at ``path``; returns the folder of the new version.

    Every load writes a version beside the older ones (``path/v<number>-<id>``)
    and then publishes it: a small file ``path/_versions/<number>`` that names the
    folder, made by one rename.  A reader (``current``) follows the highest number,
    so it meets the old rows or the new ones, never an empty or half-written
    target; a load that fails publishes nothing and the old rows stay.  Two loads
    at once both write their own folders; the rename gives each number to one of
    them, the other takes the next.  Versions older than the last ``keep`` go after
    publishing (one more load later than a reader needs them).
    """
    spark = df.sparkSession
    folder = f"{path.rstrip('/')}/load-{uuid.uuid4().hex}"
    w = df.write.format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    try:
        w.save(folder)
    except Exception:
        _remove(spark, folder)
        raise
    number = _publish(spark, path, folder.rsplit("/", 1)[1])
    for old in range(number - keep, -1, -1):
        name = _published(spark, path, old)
        if name is None:
            break
        _remove(spark, f"{path.rstrip('/')}/{name}")
        _remove(spark, f"{path.rstrip('/')}/_versions/{old}")
    return folder


def current(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The rows that the last complete ``full_refresh`` of ``path`` left."""
    numbers = _numbers(spark, path)
    if not numbers:
        raise FileNotFoundError(f"no load of {path} is complete")
    return spark.read.format(fmt).load(f"{path.rstrip('/')}/{_published(spark, path, max(numbers))}")


def _file(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    where, fs = _file(spark, path)
    fs.delete(where, True)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    where, fs = _file(spark, f"{path.rstrip('/')}/_versions")
    if not fs.exists(where):
        return []
    return [int(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit()]


def _published(spark: SparkSession, path: str, number: int) -> str | None:
    """The folder that a version's file names."""
    where, fs = _file(spark, f"{path.rstrip('/')}/_versions/{number}")
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return stream.readUTF()
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, folder: str) -> int:
    """Give ``folder`` the next free number; a rename onto a taken one fails and the next is tried."""
    base = f"{path.rstrip('/')}/_versions"
    note, fs = _file(spark, f"{base}/.{folder}")
    stream = fs.create(note, True)
    stream.writeUTF(folder)
    stream.close()
    number = max(_numbers(spark, path), default=-1) + 1
    while True:
        target, _ = _file(spark, f"{base}/{number}")
        if not fs.exists(target) and fs.rename(note, target):
            return number
        number += 1


def report(df: DataFrame, columns: Sequence[str], labels: Mapping[str, str] | None = None) -> DataFrame:
    """Output column selection, order and labels (labels may hold spaces)."""
    labels = labels or {}
    return df.select(*[F.col(c).alias(labels.get(c, c)) for c in columns])


def split_by(df: DataFrame, col: str, values: Iterable) -> dict:
    """One lazy DataFrame per category value (filters share one plan prefix)."""
    return {v: df.filter(F.col(col) == v) for v in values}


def write_split(df: DataFrame, col: str, path: str) -> str:
    """A7 as a sink: one folder per category in a single write job."""
    df.write.mode("overwrite").partitionBy(col).parquet(path)
    return path


def own_path(spark: SparkSession, name: str) -> str:
    """A path of its own under ``spark.checkpoint.dir``, removed when the driver's JVM ends."""
    from scorecraft.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark)}/stage/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back (lineage is cut there)."""
    path = own_path(df.sparkSession, name)
    df.write.option("compression", COMPRESSION).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, path: str | None = None, dealt: bool = False) -> DataFrame:
    """``df`` written once in buckets of ``key``, sorted inside, and read back as a table of this session.

    Joins and groupings on ``key`` between such tables need no exchange.  There are
    as many buckets as the session has shuffle partitions, so that other tables meet
    them after one exchange of their own.  ``dealt``: the last step of ``df`` has an
    exchange on ``key`` alone (a grouping by it), so rows of a bucket are together already.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"bucketed_{name}_{uuid.uuid4().hex}"
    ((df if dealt else df.repartition(buckets, key)).write.bucketBy(buckets, key).sortBy(key).format("parquet").option("compression", COMPRESSION)
     .option("path", path or own_path(spark, name)).saveAsTable(table))
    return spark.table(table)


def stage(spark: SparkSession, df: DataFrame, name: str, key: str) -> DataFrame:
    """A3: an intermediate table (``create table ... as``) read by several later steps.

    Written once as parquet under ``spark.checkpoint.dir`` (shared storage on a
    cluster) and read back, so the steps that reuse it do not recompute its
    joins.  Every build has a path of its own: a second build never touches
    the files that readers of the first still hold.  ``key`` names the
    parameters in the path, for people who look there.
    """
    path = own_path(spark, f"{name}-{hashlib.sha1(key.encode()).hexdigest()[:12]}")
    made = _staged.get()
    if made is not None:
        made.append(path)
    df.write.option("compression", COMPRESSION).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def report_run(spark: SparkSession):
    """A3's end: the intermediate tables that ``stage`` makes in this block are dropped when it ends, also by an error.

    Write or collect the report inside it; shared role tables stay.  A block in
    a block drops its own tables only.  Outside of any, tables stay as long as
    the driver's JVM, for results that are read later.
    """
    made: list[str] = []
    token = _staged.set(made)
    try:
        yield
    finally:
        _staged.reset(token)
        for path in made:
            _remove(spark, path)
