"""Operator 3: URL filtering by listed rules and mined association rules.

Listed rules (host, path) decide first: a rule fits its host and all
subdomains if the path starts with the rule's path; the longest wins.

For the other URLs, Spark's FP-growth mines combinations of URL tokens from the
URLs that listed rules label.  Combinations that lead to one label with at
least ``CONFIDENCE``, in at least ``SUPPORT`` of the labelled URLs, become rules;
a rule goes if a part of it is at least as sure.  All tokens of a URL count, so
what cannot alter the rules is kept from FP-growth: tokens under the support,
those that one label or all URLs have (only rules of that token alone remain),
and all but one of the tokens that stand in the same URLs.  Rules stand in an inverted
index from their rarest token; a URL meets only the rules of its own tokens
and takes the surest that it fulfils, else ``allow``.

Null URLs and those without ``://`` have empty host and path, fit no rule and
are allowed unless a mined rule of no such parts fits; repeated rows get equal
verdicts; an empty table (or one without labelled URLs) mines nothing; other
columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import product

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.common import stored

#: Listed rules: verdict, host, path (fixed values).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
SUPPORT = 0.01
CONFIDENCE = 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = "verdict="


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting listed rule as (rule, verdict), else null."""
    fit = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        hit = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fit = F.when(hit, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fit)
    return fit


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL: host labels, path words, names of parameters.

    The host's last two labels count as one token more; numbers all count as
    ``path=#``.
    """
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    site = F.concat(F.lit("site="), F.array_join(F.slice(F.reverse(labels), 1, 2), "."))
    hosts = F.transform(labels, lambda x: F.concat(F.lit("host="), x))
    parts = F.filter(F.split(path, r"[/._-]+"), lambda x: x != "")
    paths = F.transform(parts, lambda x: F.concat(F.lit("path="), F.when(x.rlike(r"^\d+$"), "#").otherwise(x)))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("ask="), F.split(x, "=")[0]))
    every = F.concat(F.when(F.size(labels) > 0, F.array(site)).otherwise(F.array().cast("array<string>")), F.reverse(hosts), paths, names)
    return F.array_distinct(every)


def _items(rows: DataFrame, n: int, least: int) -> tuple[list[tuple[str, str, int, int]], dict[str, list[str]]]:
    """Tokens that only make rules alone (token, verdict, URLs of the verdict, all URLs), and the others by the first that stands in the same URLs.

    The number of tokens depends on the support and the length of URLs, not on
    the number of rows.
    """
    row = F.xxhash64("row"), F.xxhash64("row", F.lit(MARK))
    each = rows.select("row", "verdict", F.explode("items").alias("token"))
    by_label = each.groupBy("token", "verdict").agg(F.count("*").alias("n"), *(F.bit_xor(h).alias(f"h{i}") for i, h in enumerate(row)))
    per_token = by_label.groupBy("token").agg(F.collect_list(F.struct("verdict", "n")).alias("labels"), F.sum("n").alias("every"), F.bit_xor("h0").alias("h0"), F.bit_xor("h1").alias("h1"))
    alone, places = [], defaultdict(list)
    for r in per_token.filter(F.exists("labels", lambda x: x["n"] >= least)).collect():
        if len(r["labels"]) == 1 or r["every"] == n:
            alone += [(r["token"], x["verdict"], x["n"], r["every"]) for x in r["labels"] if x["n"] >= least]
        else:
            places[r["every"], r["h0"], r["h1"]].append(r["token"])
    return alone, {min(ts): sorted(ts) for ts in places.values()}


def _combinations(rows: DataFrame, n: int, same: dict[str, list[str]], support: float, confidence: float) -> list[tuple[tuple[str, ...], str, float, float]]:
    """Rules from FP-growth over the keys of ``same``, with each key's equals in its place."""
    kept = F.array_intersect("items", F.array(*(F.lit(t) for t in sorted(same))))
    baskets = stored(rows.select(F.array_append(kept, F.concat(F.lit(MARK), F.col("verdict"))).alias("items")), "baskets")
    sets = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).freqItemsets
    marked = F.filter("items", lambda x: x.startswith(MARK))
    sets = stored(sets.select(F.sort_array(F.filter("items", lambda x: ~x.startswith(MARK))).alias("left"), F.element_at(F.concat(marked, F.array(F.lit(""))), 1).alias("mark"), "freq"), "itemsets")
    whole = sets.filter("mark = ''").select("left", F.col("freq").alias("all"))
    sure = sets.filter("mark != '' and size(left) > 0").join(whole, "left").filter(F.col("freq") >= confidence * F.col("all"))
    return [(tuple(sorted(left)), r["mark"][len(MARK):], r["freq"] / r["all"], r["freq"] / n) for r in sure.collect() for left in product(*(same[t] for t in r["left"]))]


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> list[tuple[tuple[str, ...], str, float, float]]:
    """(tokens, verdict, confidence, support) of the pruned rules, surest first.

    ``labelled``: items (tokens) and verdict.  The number of rules depends on
    ``support``, not on the number of rows.
    """
    rows = stored(labelled.select(F.monotonically_increasing_id().alias("row"), F.array_distinct("items").alias("items"), "verdict"), "labelled")
    n = rows.count()
    if not n:
        return []
    alone, same = _items(rows, n, max(1, math.ceil(support * n)))
    found = [((t,), v, hits / every, hits / n) for t, v, hits, every in alone if hits >= confidence * every]
    if same:
        found += _combinations(rows, n, same, support, confidence)
    found.sort(key=lambda r: (len(r[0]), -r[2], r[0]))
    kept: list[tuple[tuple[str, ...], str, float, float]] = []
    by_token: dict[str, list[int]] = defaultdict(list)
    for rule in found:
        mine_ = set(rule[0])
        smaller = {i for t in rule[0] for i in by_token[t]}
        if any(kept[i][1] == rule[1] and kept[i][2] >= rule[2] and set(kept[i][0]) <= mine_ for i in smaller):
            continue
        for t in rule[0]:
            by_token[t].append(len(kept))
        kept.append(rule)
    return sorted(kept, key=lambda r: (-r[2], -r[3], len(r[0]), r[0], r[1]))


def apply_mined(df: DataFrame, rules: list, items: str = "items") -> DataFrame:
    """``df`` with mined (verdict) and mined_rule, null where no rule is fulfilled."""
    often = Counter(t for r in rules for t in r[0])
    posting: dict[str, list[int]] = defaultdict(list)
    for i, r in enumerate(rules):
        posting[min(r[0], key=lambda t: (often[t], t))].append(i)
    sets = [frozenset(r[0]) for r in rules]
    shared = df.sparkSession.sparkContext.broadcast((dict(posting), sets, rules))
    at = df.columns.index(items)
    schema = f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, mined string, mined_rule string"

    def run(batches):
        index, need, rules = shared.value
        for batch in batches:
            verdict, text = [], []
            for own in batch.column(at).to_pylist():
                own = set(own or ())
                hit = min((i for t in own for i in index.get(t, ()) if need[i] <= own), default=None)
                verdict.append(None if hit is None else rules[hit][1])
                text.append(None if hit is None else " + ".join(rules[hit][0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(verdict, pa.string()), pa.array(text, pa.string())], names=[*batch.schema.names, "mined", "mined_rule"])

    return df.mapInArrow(run, schema)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``id_col``, host, path, rule, verdict, mined_rule of every row."""
    url = F.col(url_col).cast("string")
    host, path = host_path(url)
    rows = pages.select(F.col(id_col).cast("long").alias("row_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.select("row_id", "host", "path", listed(F.col("host"), F.col("path"), rules).alias("fit"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("items"))
    labelled = rows.filter("fit is not null").select("items", F.col("fit.verdict").alias("verdict"))
    flat = rows.select("row_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("known"), "items")
    out = apply_mined(flat, mine(labelled, support, confidence))
    verdict = F.coalesce("known", "mined", F.lit("allow"))
    return out.select(F.col("row_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("known").isNull(), F.col("mined_rule")).alias("mined_rule"))
