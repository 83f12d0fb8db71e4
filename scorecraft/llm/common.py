"""Shared helpers of the corpus operators: tables, intermediate tables, folds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecraft.llm.text import slices, utf8
from scorecraft.session import ensure_checkpoint_dir

#: Folds of the labelled rows: fold 0 is held out.
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id`` and ``text`` of the whole table."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the driver's JVM ends."""
    path = f"{ensure_checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps don't
    compute it again, and a lost executor costs no more than its own tasks."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column) -> Column:
    """crc32 of the id in decimal, modulo ``FOLDS``; 0 is held out (a null id too)."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS, F.lit(0))


def map_text(df: DataFrame, fn: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], dict], schema: str, text: str = "text") -> DataFrame:
    """Run ``fn(bytes, offsets, rows)`` over slices of ``df``'s batches.

    ``fn`` returns columns for the slice as ``{name: values}``; ``rows`` holds
    the slice's other columns.  A slice is bounded in bytes, so memory is.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
            for i, j in slices(offsets):
                cols = fn(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], batch.slice(i, j - i))
                made = pa.RecordBatch.from_arrays([_array(cols[f.name], f.type) for f in out], schema=out)
                if made.num_rows:
                    yield made

    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, fn: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], dict], added: str, text: str = "text") -> DataFrame:
    """``df``, all its columns as they are, with the columns that ``fn`` gives for slices (see ``map_text``)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    new = _parse_datatype_string(added)
    extra, at = to_arrow_schema(new), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            for i, j in slices(offsets):
                part = batch.slice(i, j - i)
                cols = fn(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], part)
                yield pa.RecordBatch.from_arrays([*part.columns, *(_array(cols[f.name], f.type) for f in extra)], names=[*part.schema.names, *extra.names])

    return df.mapInArrow(run, StructType([*df.schema, *new]))


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def list_array(flat: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, type=kind))
