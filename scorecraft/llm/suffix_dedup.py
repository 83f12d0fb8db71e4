"""Operator 8: removal of repeated byte strings by longest-previous-factor arrays.

A window is a string of ``length`` bytes.  Its anchor is the smallest hash of
its ``gram``-byte substrings: equal windows have equal anchors at equal
places, so only windows whose anchor occurs at two places can repeat.

1. ``runs``: consecutive windows with one anchor, with a digest of the bytes
   they cover.  No text moves.
2. Runs whose anchor occurs once go.  Equal runs (anchor and digest) form a
   class with its number of copies and first place: an exact copy of any size
   or number costs one row per task and class.
3. Anchors with several classes: one run of each class is fetched, and in each
   task the suffixes of its anchors' runs are sorted into a suffix array;
   previous and next smaller positions give the longest previous factors (and,
   with positions reversed, the longest following ones).
4. An anchor with more than ``HOT_CLASSES`` classes would fill a task: its
   windows are compared by two 64-bit digests in a grouped aggregation, which
   combines inside each task first.
5. Windows found go back to all runs of their class and to the documents.

``keep_first=False`` removes every window that occurs anywhere else;
``keep_first=True`` keeps the first place (smallest id, then place) of each.
Bytes of overlapping windows go once; all is judged on the input.

Null text counts as empty; texts under ``length`` bytes lose nothing; rows
equal in id and text count as two places of the same bytes (with
``keep_first`` they are treated alike); a null id sorts first; an empty table
gives an empty one; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorecraft.llm.common import add_columns, map_text, stored
from scorecraft.llm.lpf import longest_factors
from scorecraft.llm.text import flat_ranges, mix, prefix_hash, span_hash, utf8

HOT_CLASSES = 1000
CHUNK_BYTES = 1 << 20


def sliding(values: np.ndarray, width: int, fn) -> np.ndarray:
    """``fn`` (np.minimum or np.maximum) over every ``values[i:i+width]``."""
    n = len(values)
    if n < width:
        return values[:0]
    pad = -n % width
    edge = values[-1:] if pad else values[:0]
    blocks = np.concatenate([values, np.repeat(edge, pad)]).reshape(-1, width)
    head = fn.accumulate(blocks, axis=1).ravel()
    tail = fn.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return fn(tail[:m], head[width - 1:width - 1 + m])


def find_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """row, at (byte in the row), n (windows), anchor, digest, multi (the anchor stands twice in the run)."""
    window = length - gram + 1
    none = {c: np.zeros(0, np.int64) for c in ("row", "at", "n", "anchor", "digest", "multi")}
    size = np.diff(offsets)
    valid = np.repeat(offsets[1:] - length, size) >= np.arange(len(data)) if len(data) else np.zeros(0, bool)
    if len(data) < length or not valid.any():
        return none
    prefix = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    h = span_hash(prefix, at, at + gram)
    least = sliding(h, window, np.minimum)
    valid = valid[:len(least)]
    least = np.where(valid, least, np.uint64(0))
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    first_of_row = np.zeros(len(data) + 1, bool)
    first_of_row[offsets] = True
    begin |= valid & first_of_row[:len(valid)]
    s = np.flatnonzero(begin)
    stop = valid.copy()
    stop[:-1] = valid[:-1] & (begin[1:] | ~valid[1:])
    e = np.flatnonzero(stop)
    n = e - s + 1
    # places where some window's smallest gram stands
    around = sliding(np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)]), window, np.maximum)
    place = np.flatnonzero(h == around[:len(h)])
    lo, hi = np.searchsorted(place, s), np.searchsorted(place, e + window)
    owner = np.repeat(np.arange(len(s)), hi - lo)
    same = h[place[flat_ranges(lo, hi - lo)]] == least[s][owner]
    multi = np.bincount(owner[same], minlength=len(s)) > 1
    row = np.searchsorted(offsets, s, side="right") - 1
    return {"row": row, "at": s - offsets[row], "n": n, "anchor": least[s].view(np.int64), "digest": mix(span_hash(prefix, s, e + length)).view(np.int64), "multi": multi}


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("row_id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("uid"), text.alias("text"))


def runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def find(data, offsets, batch):
        found = find_runs(data, offsets, length, gram)
        row = pa.array(found.pop("row"), pa.int64())
        return {"row_id": batch.column("row_id").take(row), "uid": batch.column("uid").take(row), **found, "multi": found["multi"].astype(bool)}

    return map_text(rows, find, "row_id long, uid long, at long, n long, anchor long, digest long, multi boolean")


def _contents(rows: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """``classes`` with the bytes of one run each."""
    wanted = classes.groupBy(F.col("first.uid").alias("uid")).agg(F.sort_array(F.collect_list(F.struct(F.col("first.at").alias("at"), "n", "anchor", "digest", "hot"))).alias("w"))
    texts = rows.join(wanted, "uid")
    flat = texts.select("text", "uid", "row_id", *(F.col(f"w.{c}").alias(c) for c in ("at", "n", "anchor", "digest", "hot")))

    def cut(data, offsets, batch):
        lists = batch.column("at")
        count = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(count)), count)
        at, n = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("at", "n"))
        begin = offsets[row] + at
        raw = data.tobytes()
        own = pa.array(row, pa.int64())
        return {"anchor": batch.column("anchor").flatten(), "digest": batch.column("digest").flatten(), "hot": batch.column("hot").flatten(), "at": at, "n": n,
                "uid": batch.column("uid").take(own), "row_id": batch.column("row_id").take(own),
                "bytes": [raw[a:b] for a, b in zip(begin.tolist(), (begin + n + length - 1).tolist())]}

    return map_text(flat, cut, "anchor long, digest long, hot boolean, at long, n long, uid long, row_id long, bytes binary")


def _places(row_id: np.ndarray, uid: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Text positions of runs as one number each: order of (id, row, byte)."""
    order = np.lexsort((uid, row_id))
    new = np.ones(len(order), bool)
    new[1:] = (row_id[order][1:] != row_id[order][:-1]) | (uid[order][1:] != uid[order][:-1])
    doc = np.empty(len(order), np.int64)
    doc[order] = np.cumsum(new)
    return (doc << 36) + at


FOUND = "anchor long, digest long, lo long, hi long, earlier boolean"


def _intervals(run: np.ndarray, i: np.ndarray, earlier: np.ndarray):
    """Consecutive windows i of a run with one flag as (run, lo, hi, flag), hi inclusive."""
    if not len(run):
        return run, i, i, earlier
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (i[1:] != i[:-1] + 1) | (earlier[1:] != earlier[:-1])
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(run)) - 1
    return run[s], i[s], i[e], earlier[s]


def _suffix_task(length: int):
    """Windows of the classes in each chunk of whole anchors that occur in another place."""

    def work(t: pa.Table) -> pa.RecordBatch:
        data, offsets = utf8(t.column("bytes"))
        n = t.column("n").to_numpy().astype(np.int64)
        row_id = t.column("row_id").fill_null(np.iinfo(np.int64).min).to_numpy()
        place = _places(row_id, t.column("uid").to_numpy(), t.column("at").to_numpy())
        run = np.repeat(np.arange(len(n)), n)
        i = flat_ranges(np.zeros(len(n), np.int64), n)
        starts, pos = offsets[run] + i, place[run] + i
        earlier, later = (f >= length for f in longest_factors(data, starts, pos, length))
        hit = np.flatnonzero(earlier | later)
        r, lo, hi, flag = _intervals(run[hit], i[hit], earlier[hit])
        take = pa.array(r, pa.int64())
        return pa.RecordBatch.from_arrays([t.column("anchor").combine_chunks().take(take), t.column("digest").combine_chunks().take(take), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(flag, pa.bool_())],
                                          names=["anchor", "digest", "lo", "hi", "earlier"])

    def pieces(t: pa.Table, rest: bool):
        """Row ranges of whole anchors, about ``CHUNK_BYTES`` each; without ``rest`` the last anchor waits."""
        anchor = t.column("anchor").to_numpy()
        upto = utf8(t.column("bytes"))[1]
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        ends = np.append(first[1:], len(anchor)) if rest else first[1:]
        begin = 0
        for i, end in enumerate(ends.tolist()):
            following = ends[i + 1] if i + 1 < len(ends) else None
            if following is None or upto[following] - upto[begin] > CHUNK_BYTES:
                yield begin, end
                begin = end

    def task(batches):
        held = None
        for batch in batches:  # sorted by anchor
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            done = 0
            for begin, end in pieces(held, False):
                yield work(held.slice(begin, end - begin))
                done = end
            held = held.slice(done)
        if held is not None and held.num_rows:
            for begin, end in pieces(held, True):
                yield work(held.slice(begin, end - begin))

    return task


def _windows(length: int):
    """Two digests of every window of hot classes; each task sends one row per distinct window."""

    def task(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("bytes"))
            n = batch.column("n").to_numpy().astype(np.int64)
            step = 256
            for k in range(0, len(n), step):
                size = n[k:k + step]
                run = np.repeat(np.arange(len(size)), size)
                i = flat_ranges(np.zeros(len(size), np.int64), size)
                base = offsets[k]
                part = data[base:offsets[min(k + step, len(n))]]
                s = offsets[k:k + len(size)][run] - base + i
                one = span_hash(prefix_hash(part), s, s + length)
                two = span_hash(prefix_hash(np.bitwise_xor(part, np.uint8(0x5A)).astype(np.uint64) ** np.uint64(3)), s, s + length)
                own = pa.array(run + k, pa.int64())
                take = [batch.column(c).take(own) for c in ("anchor", "digest", "row_id", "uid")]
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *take, pa.array(batch.column("at").to_numpy()[run + k] + i), pa.array(i)],
                                                 names=["one", "two", "anchor", "digest", "row_id", "uid", "place", "i"])

    return task


def _joined(hit: DataFrame) -> DataFrame:
    """Consecutive windows i of a class with one flag as one row each (``FOUND``): every copy of the class then takes few intervals."""
    rank = F.dense_rank().over(Window.partitionBy("anchor", "digest", "earlier").orderBy("i"))
    stretch = hit.withColumn("stretch", F.col("i") - rank)
    return stretch.groupBy("anchor", "digest", "earlier", "stretch").agg(F.min("i").alias("lo"), F.max("i").alias("hi")).select("anchor", "digest", "lo", "hi", "earlier")


def repeated_windows(rows: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Candidate runs, and per class (anchor, digest) its copies, first place and windows found elsewhere."""
    found = stored(runs(rows, length, gram), "runs")
    again = found.groupBy("anchor").agg(F.count("*").alias("k"), F.max("multi").alias("m")).filter("k > 1 or m").select("anchor")
    found = stored(found.join(again, "anchor", "left_semi"), "runs-again")
    classes = found.groupBy("anchor", "digest", "n").agg(F.count("*").alias("copies"), F.max("multi").alias("multi"), F.min(F.struct("row_id", "uid", "at")).alias("first"))
    classes = stored(classes, "run-classes")
    open_anchors = classes.groupBy("anchor").agg(F.count("*").alias("k"), F.max("multi").alias("m")).filter("k > 1 or m")
    open_anchors = open_anchors.select("anchor", (F.col("k") > HOT_CLASSES).alias("hot"))
    contents = stored(_contents(rows, classes.join(open_anchors, "anchor"), length).dropDuplicates(["anchor", "digest", "n"]), "run-bytes")
    by_anchor = contents.filter("not hot").repartition("anchor").sortWithinPartitions("anchor")
    windows = by_anchor.mapInArrow(_suffix_task(length), FOUND)

    hot = contents.filter("hot")
    if hot.limit(1).count():
        each = stored(hot.mapInArrow(_windows(length), "one long, two long, anchor long, digest long, row_id long, uid long, place long, i long"), "hot-windows")
        shared = each.groupBy("one", "two").agg(F.count("*").alias("k"), F.min(F.struct("row_id", "uid", "place")).alias("first")).filter("k > 1")
        hit = each.join(shared, ["one", "two"]).select(
            "anchor", "digest", "i", (~F.col("first").eqNullSafe(F.struct("row_id", "uid", "place"))).alias("earlier"))
        windows = windows.unionByName(_joined(hit))
    found_in = windows.groupBy("anchor", "digest").agg(F.collect_list(F.struct("lo", "hi", "earlier")).alias("found"))
    return found, classes.join(stored(found_in, "windows-found"), ["anchor", "digest"], "left")


def repeats(rows: DataFrame, length: int, gram: int, keep_first: bool) -> DataFrame:
    """uid and its windows to remove (from, upto: bytes), as arrays."""
    found, classes = repeated_windows(rows, length, gram)
    known = classes.filter("copies > 1 or found is not null").select("anchor", "digest", "n", "copies", "first", "found")
    per_run = found.join(known, ["anchor", "digest", "n"])
    here = F.col("first").eqNullSafe(F.struct("row_id", "uid", "at"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), (F.col("n") - 1).alias("hi"), F.lit(True).alias("earlier")))
    some = F.coalesce("found", F.slice(whole, 1, 0))
    if keep_first:
        cut = F.when(here, F.filter(some, lambda x: x["earlier"])).otherwise(whole)
    else:
        cut = F.when(F.col("copies") > 1, whole).otherwise(some)
    spans = per_run.select("uid", "at", F.explode(cut).alias("x"))
    spans = spans.select("uid", F.struct((F.col("at") + F.col("x.lo")).alias("s"), (F.col("at") + F.col("x.hi") + length).alias("e")).alias("x"))
    grouped = spans.groupBy("uid").agg(F.sort_array(F.collect_set("x")).alias("x"))
    return grouped.select("uid", F.col("x.s").alias("s"), F.col("x.e").alias("e"))


def _cut(data: np.ndarray, offsets: np.ndarray, s: pa.Array, e: pa.Array, whole_chars: bool):
    """Bytes removed, maximal runs removed, and remaining bytes of each row."""
    cover = np.zeros(len(data) + 1, np.int32)
    s, e = s.fill_null([]), e.fill_null([])
    base = np.repeat(offsets[:-1], s.value_lengths().to_numpy(zero_copy_only=False))
    np.add.at(cover, base + s.flatten().to_numpy(zero_copy_only=False).astype(np.int64), 1)
    np.add.at(cover, base + e.flatten().to_numpy(zero_copy_only=False).astype(np.int64), -1)
    gone = np.cumsum(cover[:-1]) > 0
    if whole_chars and len(data):
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        gone = (np.bincount(char, weights=~gone) == 0)[char]
    upto = np.concatenate([[0], np.cumsum(gone)])
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = gone[inner]
    spans = np.concatenate([[0], np.cumsum(first)])
    raw = data[~gone].tobytes()
    left = offsets - upto[offsets]
    return np.diff(upto[offsets]), np.diff(spans[offsets]), [raw[a:b] for a, b in zip(left[:-1].tolist(), left[1:].tolist())]


def remove_repeats(df: DataFrame, length: int = 400, keep_first: bool = True, gram: int | None = None,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes) of every row."""
    rows = _rows(df, id_col, text_col)
    cuts = repeats(rows, length, gram or max(1, length // 4), keep_first)
    joined = rows.join(cuts, "uid", "left").select("row_id", "text", "s", "e")

    def apply(data, offsets, batch):
        removed, spans, kept = _cut(data, offsets, batch.column("s"), batch.column("e"), False)
        return {"row_id": batch.column("row_id"), "n_bytes": np.diff(offsets), "n_removed": removed, "n_spans": spans, "kept": kept}

    return map_text(joined, apply, "row_id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("row_id", id_col)


def without_repeats(df: DataFrame, length: int = 400, keep_first: bool = True, gram: int | None = None,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df``, all its columns, with the repeated strings cut out of ``text_col``; a character of several bytes goes only if all of it is covered."""
    cuts = repeats(_rows(df, id_col, text_col), length, gram or max(1, length // 4), keep_first)
    cuts = cuts.select(F.col("uid").alias("__uid"), F.col("s").alias("__s"), F.col("e").alias("__e"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.withColumn("__uid", F.xxhash64(F.col(id_col).cast("long"), text)).join(cuts, "__uid", "left")

    def apply(data, offsets, batch):
        kept = _cut(data, offsets, batch.column("__s"), batch.column("__e"), True)[2]
        return {"__kept": pa.array(kept, pa.binary()).cast(pa.string())}

    made = add_columns(rows, apply, "`__kept` string", text_col)
    clean = F.when(F.col("__s").isNull(), F.col(text_col)).otherwise(F.col("__kept"))
    return made.withColumn(text_col, clean).select(*df.columns)
