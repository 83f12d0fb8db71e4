"""Operator 5: bottom-k sketches of word shingles, in Spark SQL functions only.

A sketch is the sorted array of the ``K`` smallest 64-bit hashes among a
text's distinct ``SHINGLE``-word shingles (words end at U+0020 and
U+0009-U+000D).  Sketches of parts merge into the sketch of the whole;
``resemblance``, ``containment`` and ``distinct_shingles`` estimate from
sketches alone and are exact while a set has fewer than ``K`` shingles.

A text with fewer words has its whole sequence as one shingle; a text without
words (null and empty too) has the empty sketch.  Two empty sketches resemble
each other fully, an empty and another one not at all.

``fingerprints`` also compares each document with an edited copy of itself and
with the next document.  Neighbours by id are found inside id ranges of about
``ROWS_PER_RANGE`` rows; the first rows of a range also visit the range before
it.  Rows with one id follow each other by text, equal rows in any order; null
ids come first; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 128
SHINGLE = 5
ROWS_PER_RANGE = 4096
MOST_RANGES = 8192
BLANKS = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The bottom-k sketch of a text (array of long, ascending)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - shingle, F.lit(0)))
        # places past the end are null, which the hash skips
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(shingle)]))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.slice(F.sort_array(F.array_distinct(hashes)), 1, k))

    return let(F.transform(words, lambda x: F.xxhash64(x)), of)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that later steps read without working it out again (a projection alone may be merged into each of them)."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of two sets."""
    both = F.array_intersect(a, b)
    return F.when(a == b, F.lit(1.0)).otherwise(let(merge(a, b, k), lambda u: F.size(F.array_intersect(both, u)) / F.greatest(F.size(u), F.lit(1))).cast("double"))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: (k - 1) over the share of the hash space below the k-th value."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds too."""
    whole = distinct_shingles(merge(a, b, k), k)
    estimate = resemblance(a, b, k) * whole / F.greatest(distinct_shingles(a, k), F.lit(1.0))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(estimate, F.lit(1.0)))


def spelled(a: Column) -> Column:
    """A sketch as text: its values of 8 bytes in base 64."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def _ranges(rows: DataFrame, per_range: int) -> tuple[Column, list[int], int]:
    """Number of each row's id range, the ranges' smallest ids (None where empty), and the number of ranges."""
    n = rows.count()
    parts = max(1, min(MOST_RANGES, -(-n // per_range)))
    bounds: list[int] = []
    if parts > 1:
        marks = rows.agg(F.percentile_approx("row_id", [i / parts for i in range(1, parts)], max(10_000, 10 * parts)).alias("b")).first()["b"]
        bounds = sorted(set(marks or []))
    parts = len(bounds) + 1
    key = F.coalesce(F.col("row_id"), F.lit(-(2 ** 63)))
    if not bounds:
        where = F.lit(0)
    else:  # two steps of at most 64 + MOST_RANGES / 64 comparisons
        coarse = F.array(*[F.lit(b).cast("long") for b in bounds[63::64]]) if len(bounds) >= 64 else F.array().cast("array<bigint>")
        fine = F.lit(bounds).cast("array<bigint>")
        block = F.size(F.filter(coarse, lambda b: b <= key))
        where = let(block, lambda c: c * 64 + F.size(F.filter(F.slice(fine, c * 64 + 1, 64), lambda b: b <= key)))
    return where, bounds, parts


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE, per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``id_col``, n_chars, edited (text), sketch, edited_sketch, near_edited, near_next of every row.

    The edited text has its last quarter (of code points, rounded down)
    replaced by as many of the next document's first ones.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("row_id"), text.alias("text"))
    where, bounds, parts = _ranges(rows.select("row_id"), per_range)
    placed = rows.withColumn("range", where.cast("int"))
    key = F.coalesce(F.col("row_id"), F.lit(-(2 ** 63)))
    found = placed.select("range", key.alias("k")).groupBy("range").agg(F.min("k").alias("k")).orderBy("range").collect()  # a row per range
    lead_of = {r["range"]: r["k"] for r in found}
    order = sorted(lead_of)
    before = {r: order[i - 1] for i, r in enumerate(order)}  # the first range visits the last
    if order:
        firsts = F.lit([lead_of.get(i, 2 ** 63 - 1) for i in range(parts)]).cast("array<bigint>")
        host = F.lit([before.get(i, 0) for i in range(parts)]).cast("array<int>")
    else:
        firsts, host = F.array(F.lit(0).cast("long")), F.array(F.lit(0))
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.element_at(host, F.col("range") + 1).alias("range"), F.lit(True).alias("guest"))
    visits = F.when(key == F.element_at(firsts, F.col("range") + 1), F.array(own, guest)).otherwise(F.array(own))
    spread = placed.select("row_id", "text", F.explode(visits).alias("v")).select("row_id", "text", "v.range", "v.guest")
    dealt = once(spread.repartition(F.col("range")), "sketch", sketch(F.col("text"), k, shingle))
    line = Window.partitionBy("range").orderBy(F.col("guest"), F.col("row_id").asc_nulls_first(), F.col("text"))
    pair = dealt.withColumn("next", F.lead(F.struct("text", "sketch")).over(line)).filter("not guest")
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - quarter), F.substring(F.coalesce("next.text", F.lit("")), F.lit(1), quarter))
    made = pair.select("row_id", F.char_length("text").cast("long").alias("n_chars"), "sketch", F.col("next.sketch").alias("next_sketch"), edited.alias("edited"))
    made = once(once(made, "edited_text", F.col("edited")), "edited_sketch", sketch(F.col("edited_text"), k, shingle)).drop("edited").withColumnRenamed("edited_text", "edited")
    return made.select(F.col("row_id").alias(id_col), "n_chars", "edited", "sketch", "edited_sketch",
                       resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
                       resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"))
