import datetime as dt
import random

import pytest
from pyspark.sql import types as T

#: Extra columns: names that operators use themselves, to show that nothing clashes.
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
    T.StructField("row_id", T.DateType()), T.StructField("uid", T.StringType()), T.StructField("node", T.IntegerType()),
])


def prose(rng: random.Random, words: int, of: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(of) for _ in range(rng.randint(1, 7))) for _ in range(words))


def edge_texts() -> list:
    """Null, empty, blank, very long, repeated, near and exact copies, odd characters."""
    rng = random.Random(5)
    long = prose(rng, 9000)
    base = prose(rng, 120).split(" ")
    near = list(base)
    near[60] = "changed"
    passage = prose(rng, 80)
    return [
        None, "", " \t\n", "one", "one two", "One  TWO", "a" * 3000, "ab" * 1200, long, long, " ".join(base), " ".join(near), " ".join(base).upper(),
        "x " + passage + " y", passage, prose(rng, 30) + " " + passage + " " + prose(rng, 40), "  lead and trail  ", "é" * 500, "日本語 " * 300,
        "it's <|endoftext|> we'll go on\x1c!", "▁a ▁▁ b", "ΑΣ İ ﬁ", *[prose(rng, rng.randint(1, 200)) for _ in range(20)],
    ]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "z", dt.date(2020, 1, 1), "u", 7) for i, t in enumerate(edge_texts())]
    rows.append(rows[9])  # a repeated row
    rows.append((None, "a row without an id " * 30, *rows[0][2:]))
    rows.append((None, None, *[None] * 7))
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def texts(docs):
    """(doc_id, text) of every row, null text as empty."""
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]
