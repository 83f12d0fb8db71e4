"""Operator 6: byte-pair encoding and decoding of whole texts.

``encode`` and ``decode`` run the segment-tree encoder of ``bpe`` inside Spark
tasks.  Null text counts as empty and gives no ids; a null ``ids`` decodes to
the empty text; repeated rows each get their own result; an empty table gives
an empty one; columns beyond those named are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.bpe import codec
from scorecraft.llm.common import list_array, map_text
from scorecraft.llm.text import decode as to_str


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row."""

    def ids_of(data, offsets, rows):
        ids, offs = codec(path).encode(to_str(data, offsets))
        return {"row_id": rows.column("row_id"), "ids": list_array(ids.astype(np.int32), offs, pa.int32())}

    rows = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text"))
    return map_text(rows, ids_of, "row_id long, ids array<int>").withColumnRenamed("row_id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` beside ``id_col`` and ``ids``: the text the ids spell, special tokens kept."""

    def run(batches):
        for batch in batches:
            ids = batch.column(1)
            step = 1 << 10
            for k in range(0, batch.num_rows, step):
                part = ids.slice(k, step).fill_null([])
                flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                offs = np.concatenate([[0], np.cumsum(part.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                texts = [x.decode("utf-8", "replace") for x in codec(path).decode(flat, offs)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, step), part, pa.array(texts, pa.string())], names=["row_id", "ids", "decoded"])

    rows = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "row_id long, ids array<int>, decoded string").withColumnRenamed("row_id", id_col).withColumnRenamed("ids", ids_col)
