"""Operator 7: token counts through a digest cache.

Each text has a digest of its normalised content (the model treats U+2581 as a
blank; nothing else changes) and the tokenizer has a digest of its file.  The
cache is a Parquet folder of (tokenizer, content digest, tokens).  Contents not
in it are encoded once each and appended; then every document takes its count
by a join on the digest.  The same cache path serves later runs and other
tables; another tokenizer file never meets the counts of this one.  Every run
appends in a folder of its own and nothing is ever deleted, so runs at the same
time don't disturb each other; at worst both encode a content and store the same count.

Copies of a content are dropped inside each task first, so a content that a
third of all rows hold sends one row per task to the task that encodes it.

Null text counts as empty (0 bytes, 0 tokens); repeated rows each get a row;
an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import functools
import hashlib
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.common import new_path
from scorecraft.llm.text import SpanCache, code_points, decode, prefix_hash, slices, span_hash, utf8
from scorecraft.session import ensure_checkpoint_dir

CACHE_SCHEMA = "tokenizer string, content binary, n_tokens long"
#: Folder of the lasting cache; the number rises when the counting itself changes.
LASTING = "llm/token-counts-1"


class PieceCounter:
    """Tokens per text of a sentencepiece model, word by word.

    No piece of the model holds a blank after another character (checked when
    it loads; otherwise whole texts are encoded), so a text's tokens are those
    of its words with the blanks before them.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.sp.id_to_piece(i) for i in range(len(self.sp)))
        plain = self.sp.encode("a b", out_type=str) == self.sp.encode("a", out_type=str) + self.sp.encode("b", out_type=str)
        self.by_word = plain and not any("▁" in p.lstrip("▁") for p in pieces) and len(self.sp.encode("a  b ")) > len(self.sp.encode("a b"))
        self.cache = SpanCache()

    def lengths(self, texts: list[str]) -> np.ndarray:
        return np.array([len(x) for x in self.sp.encode(texts, num_threads=1)] if texts else [], np.int64)

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        texts = [t.replace("▁", " ") for t in texts]
        whole = [i for i, t in enumerate(texts) if not self.by_word or t.endswith(" ") or "\0" in t]
        if whole:
            out[whole] = self.lengths([texts[i] for i in whole])
        rest = sorted(set(range(len(texts))) - set(whole))
        led = [" " + texts[i] for i in rest if texts[i]]
        rest = [i for i in rest if texts[i]]
        if not rest:
            return out
        cp, offs = code_points(led)
        blank = cp == 32
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start[offs[:-1]] = True
        s = np.flatnonzero(start)
        e = np.append(s[1:], len(cp))
        key, one, inverse = np.unique(span_hash(prefix_hash(cp), s, e), return_index=True, return_inverse=True)
        joined = "".join(led)

        def make(missing):
            at = one[missing]
            n = self.lengths([joined[a + 1:b] for a, b in zip(s[at].tolist(), e[at].tolist())])
            return n, np.ones(len(n), np.int64)

        slot = self.cache.resolve(key, make)[inverse]
        n = self.cache.flat[self.cache.at[slot]]
        upto = np.zeros(len(s) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        at = upto[np.searchsorted(s, offs)]
        out[rest] = at[1:] - at[:-1]
        return out


class JsonCounter:
    """Tokens per text of a ``tokenizers`` file with the segment-tree encoder."""

    def __init__(self, path: str):
        from scorecraft.llm.bpe import codec

        self.codec = codec(path)

    def counts(self, texts: list[str]) -> np.ndarray:
        return np.diff(self.codec.encode(texts)[1])


@functools.lru_cache(maxsize=4)
def counter(path: str):
    return PieceCounter(path) if path.endswith(".model") else JsonCounter(path)


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer's file: its version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def lasting_cache(spark) -> str:
    """The cache that all runs of a cluster share, under ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark)}/{LASTING}"


def token_counts(df: DataFrame, path: str, cache_path: str | None = None, limit: int = 4096,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of every row.

    ``cache_path``: the cache's folder; by default a new one in the shared folder.
    """
    spark = df.sparkSession
    cache_path = cache_path or new_path(spark, "token-cache")
    version = tokenizer_digest(path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(
        F.col(id_col).cast("long").alias("row_id"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(F.replace(text, F.lit("▁"), F.lit(" ")), 256)).alias("content"), text.alias("text"))

    known = _cache(spark, cache_path, version)
    contents = rows.select("content", "text").mapInArrow(_distinct, "content binary, text string")
    if known is not None:
        contents = contents.join(known.select("content"), "content", "left_anti")
    (contents.repartition("content").mapInArrow(functools.partial(_encode, path), "content binary, n_tokens long")
     .select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.parquet(f"{cache_path.rstrip('/')}/{uuid.uuid4().hex}"))
    counts = _cache(spark, cache_path, version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.select("row_id", "n_bytes", "content").join(counts, "content", "left").select(
        F.col("row_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _cache(spark, cache_path: str, version: str) -> DataFrame | None:
    """The tokenizer's part of the cache; None if the folder doesn't exist yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(CACHE_SCHEMA).option("recursiveFileLookup", "true").parquet(cache_path).filter(F.col("tokenizer") == version)


def _distinct(batches):
    """Rows whose content this task meets for the first time."""
    seen: set[bytes] = set()
    for batch in batches:
        digests = batch.column(0).to_pylist()
        fresh = []
        for i, d in enumerate(digests):
            if d not in seen:
                seen.add(d)
                fresh.append(i)
        if fresh:
            yield batch.take(pa.array(fresh, pa.int64()))


def _encode(path: str, batches):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    for batch in _distinct(batches):
        data, offsets = utf8(batch.column(1))
        for i, j in slices(offsets):
            n = counter(path).counts(decode(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64())], names=["content", "n_tokens"])
