"""Operator 4: best-fit packing into sequences of a fixed length, certified by lower bounds.

1. Every document becomes ids plus one end id; only longer ones are cut, into
   full pieces and a last one that may be shorter (``pieces``).
2. Rows are dealt over partitions of about ``ROWS_PER_PART`` pieces; each is
   packed by best-fit decreasing and gets a lower bound on its number of bins
   from dual-feasible functions.  A partition whose number of bins equals the
   bound is certified.
3. Partitions with a gap give up their bins that aren't full, certified ones
   their least filled bin; the freed pieces meet in new, fewer partitions and
   are packed again.  This repeats until the whole number of bins equals the
   bound over all pieces, one partition holds all that is left, no piece is
   freed, or ``ROUNDS`` are over.

A partition holds a bounded number of rows whatever the data, and no row moves
by its document, so copies and hot sources don't gather.  Null text counts as
empty (one piece: the end id); repeated rows are packed each; an empty table
gives an empty one; other columns of the input are left out by ``pieces`` and
kept by ``pack`` (its own columns win over columns of the same names).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorecraft.llm.bpe import codec
from scorecraft.llm.common import map_text, stored
from scorecraft.llm.text import decode

CAPACITY = 2048
END_ID = 0
ROWS_PER_PART = 100_000
ROUNDS = 4


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, piece, start, length, ids (little-endian unsigned 32-bit) of every piece."""

    def cut(data, offsets, rows):
        ids, offs = codec(path).encode(decode(data, offsets))
        flat = np.insert(ids, offs[1:], end_id).astype("<u4")
        n = np.diff(offs) + 1
        begin = np.cumsum(n) - n
        parts = (n + capacity - 1) // capacity
        owner = np.repeat(np.arange(len(n)), parts)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = piece * capacity
        length = np.minimum(n[owner] - start, capacity)
        raw = flat.tobytes()
        at = (begin[owner] + start) * 4
        return {"row_id": rows.column("row_id").take(owner_array(owner)), "piece": piece, "start": start, "length": length,
                "ids": [raw[a:b] for a, b in zip(at.tolist(), (at + length * 4).tolist())]}

    rows = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text"))
    return map_text(rows, cut, "row_id long, piece int, start long, length long, ids binary").withColumnRenamed("row_id", id_col)


def owner_array(owner: np.ndarray):
    import pyarrow as pa

    return pa.array(owner, pa.int64())


# --- one partition -----------------------------------------------------------------
def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each size (in decreasing order): the fullest bin it fits, else a new one."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    out = np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                mask ^= 1 << room
        else:
            room, b, bins = capacity, bins, bins + 1
        out[i] = b
        left = room - size
        if left:
            if not open_bins[left]:
                mask |= 1 << left
            open_bins[left].append(b)
    return out


def lower_bound(histogram: np.ndarray, capacity: int, steps: int = 32) -> int:
    """The largest bound of the dual-feasible families; ``histogram[s]`` counts the pieces of size s.

    Thresholds t: sizes above ``capacity - t`` weigh a full bin, sizes below t
    nothing.  Steps k: a size weighs ``floor((k + 1) * s / capacity) / k`` of a
    bin, or its own share where that product is whole.
    """
    size = np.arange(capacity + 1, dtype=np.int64)
    count = histogram.astype(object) if histogram.sum() * capacity * steps > 2 ** 62 else histogram.astype(np.int64)
    upto, mass = np.cumsum(count), np.cumsum(count * size)
    best = -(-int(mass[-1]) // capacity)
    for t in range(1, capacity // 2 + 1):
        large = int(upto[-1] - upto[capacity - t])
        middle = int(mass[capacity - t] - mass[t - 1])
        best = max(best, large - (-middle // capacity))
    for k in range(1, steps + 1):
        whole = (k + 1) * size % capacity == 0
        weight = np.where(whole, size * k, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((count * weight).sum()) // (k * capacity)))
    return best


def _pack_part(capacity: int, columns: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf["_size"].to_numpy(np.int64)
        order = np.argsort(-size, kind="stable")
        pdf, size = pdf.iloc[order].reset_index(drop=True), size[order]
        bins = best_fit(size, capacity)
        fill = np.bincount(bins, weights=size).astype(np.int64)
        bound = lower_bound(np.bincount(size, minlength=capacity + 1), capacity)
        by_bin = np.argsort(bins, kind="stable")
        upto = np.cumsum(size[by_bin]) - size[by_bin]
        first = np.concatenate([[True], np.diff(bins[by_bin]) != 0])
        offset = np.empty(len(size), np.int64)
        offset[by_bin] = upto - np.maximum.accumulate(np.where(first, upto, 0))
        least = np.argmin(fill)
        gap = len(fill) > bound
        free = (fill < capacity) if gap else (np.arange(len(fill)) == least) & (fill < capacity)
        return pdf.assign(_bin=bins, _offset=offset, _free=free[bins], _bins=np.int64(len(fill)), _bound=np.int64(bound), _lead=offset == 0)[columns]

    return run


def pack(df: DataFrame, length_col: str = "length", capacity: int = CAPACITY, rows_per_part: int = ROWS_PER_PART, rounds: int = ROUNDS) -> DataFrame:
    """``df`` with sequence_id and offset: every row (1 <= length <= capacity) lies in one sequence, gapless from 0.

    Rows with a null length, or one outside that range, raise an error.
    """
    own = {"sequence_id", "offset", "_part", "_size", "_bin", "_offset", "_free", "_bins", "_bound", "_lead", "_kept"}
    kept = [c for c in df.columns if c not in own]
    size = F.col(length_col).cast("long")
    ok = size.isNotNull() & size.between(1, capacity)
    todo = stored(df.select(*kept, F.when(ok, size).otherwise(F.raise_error(F.lit("a length is missing or out of range")).cast("long")).alias("_size")), "pack-in")
    schema = T.StructType([*todo.schema, *(T.StructField(c, T.LongType()) for c in ("_part", "_bin", "_offset", "_bins", "_bound")), T.StructField("_free", T.BooleanType()), T.StructField("_lead", T.BooleanType())])
    columns = [f.name for f in schema]

    histogram = np.zeros(capacity + 1, np.int64)
    for r in todo.groupBy("_size").count().collect():  # at most ``capacity`` rows
        histogram[r["_size"]] = r["count"]
    target, n = lower_bound(histogram, capacity), int(histogram.sum())
    done: list[DataFrame] = []
    total_kept = 0
    for k in range(rounds):
        parts = max(1, math.ceil(n / rows_per_part))
        dealt = todo.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
        out = stored(dealt.groupBy("_part").applyInPandas(_pack_part(capacity, columns), schema), f"pack-{k}")
        counted = out.agg(F.count("*").alias("n"), F.sum(F.col("_lead").cast("long")).alias("bins"), F.sum((F.col("_lead") & F.col("_free")).cast("long")).alias("free"), F.sum(F.col("_free").cast("long")).alias("rows")).first()
        bins, free, freed = counted["bins"] or 0, counted["free"] or 0, counted["rows"] or 0
        settled = total_kept + bins == target or parts == 1 or k == rounds - 1 or not freed
        numbered = out.select(*kept, (F.lit(k) * (1 << 56) + F.col("_part") * (1 << 24) + F.col("_bin")).alias("sequence_id"), F.col("_offset").alias("offset"), "_free")
        if settled:
            done.append(numbered.drop("_free"))
            break
        done.append(numbered.filter(~F.col("_free")).drop("_free"))
        total_kept += bins - free
        todo, n = out.filter("_free").select(*todo.columns), freed
    result = done[0]
    for other in done[1:]:
        result = result.unionByName(other)
    return result
