"""Operator 1: toxicity by the nearest labelled examples.

1. At most ``PER_CLASS`` labelled documents of each class are the examples.
   Terms are all their words in lower case.  Those whose presence depends on
   the label (likelihood-ratio test, the bound growing with the number of terms
   tried) are telling and weigh in full, all others ``LIGHT`` of it: a text
   without a telling term is compared by its other words.  Near copies of one
   text say no more than one of them: examples are gathered into families by
   MinHash, and a term counts once in each family.
2. Document frequencies of these terms are counted over all documents.
3. Examples become TF-IDF vectors in an inverted index whose posting lists are
   cut into blocks of ``BLOCK`` examples with the largest weight of each term
   and block.  A search adds up its short lists, bounds what the long ones can
   add to a block's examples by their block maxima, and scores in full only the
   examples that can still be among the ``NEIGHBOURS`` nearest: those of largest
   exact cosine of these vectors.
4. Neighbours vote, each by 1 / (1.02 - cosine), its inverse distance.  Votes
   of the examples themselves, each without its family, give a monotone
   calibration from vote to probability.

An example never votes on a text equal to its own, so no label is an input of
its own score.  A text without any term (null and empty ones too) has no
neighbours and takes the calibrated share of such examples.  With no labelled
rows, labels of one kind, or no words, every score is the smoothed share of
label 1.  The terms reported are the telling ones.  A text of any length is read
whole and alone in its slice if it is longer than one.  Equal texts get equal scores, ties go to the smaller
example id; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.bpe import LETTER, char_classes
from scorecraft.llm.common import add_columns, fold, list_array, map_text
from scorecraft.llm.examples import labelled_sample
from scorecraft.llm.text import code_points, decode, flat_ranges, mix, prefix_hash, slices, span_hash

PER_CLASS = 2000
LIGHT = 0.05
LEAST_DOCS = 3
NEIGHBOURS = 15
BLOCK = 64
#: Share of a search's entries that the short lists may hold.
SHORT = 0.7
NEAR = 1e-9
#: Examples that agree in one of so many triples of MinHash values are one family.
FAMILY_KEYS = 16
SEED = 3


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Hash and row of every letter run in lower case, the texts read, and the runs' places in them."""
    lower = [t.lower() for t in texts]
    parts, base = [], 0
    for i, j in slices(np.concatenate([[0], np.cumsum([len(t) for t in lower])]).astype(np.int64)):  # arrays of a slice's size only
        cp, offs = code_points(lower[i:j])
        if len(cp):
            letter = char_classes(cp) == LETTER
            edge = np.zeros(len(cp) + 1, bool)
            edge[offs] = True
            start, stop = letter.copy(), letter.copy()
            start[1:] &= ~letter[:-1] | edge[1:-1]
            stop[:-1] &= ~letter[1:] | edge[1:-1]
            s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
            row = np.repeat(np.arange(i, j), np.diff(np.searchsorted(s, offs)))
            parts.append((span_hash(prefix_hash(cp), s, e), row, s + base, e + base))
        base += len(cp)
    none = np.zeros(0, np.int64)
    h, row, s, e = (np.concatenate(x) for x in zip((none.astype(np.uint64), none, none, none), *parts))
    return h, row, lower, s, e


def text_key(text: str) -> int:
    """A digest of a whole text, to keep an example from voting on its own copy."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def families(texts: list[str]) -> np.ndarray:
    """A number for each text, the same for near copies: three-word shingles, unions of texts that share a triple of MinHash values."""
    h, row, *_ = words(texts)
    out = np.arange(len(texts))
    if len(h) < 3:
        return out
    inside = row[:-2] == row[2:]
    sh, owner = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:])[inside], row[:-2][inside]
    if not len(sh):
        return out
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    doc = owner[first]
    mult = np.random.default_rng(SEED).integers(1, 2 ** 63, 3 * FAMILY_KEYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def root(i: int) -> int:
        while out[i] != i:
            out[i] = out[out[i]]
            i = out[i]
        return i

    for k in range(FAMILY_KEYS):
        key = np.zeros(len(doc), np.uint64)
        for m in mult[3 * k:3 * k + 3]:
            key = mix(key + np.minimum.reduceat(mix(sh * m), first))
        order = np.argsort(key, kind="stable")
        for i in np.flatnonzero(key[order][1:] == key[order][:-1]).tolist():
            a, b = root(int(doc[order[i]])), root(int(doc[order[i + 1]]))
            out[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(len(texts))])


def example_terms(texts: list[str], y: np.ndarray, family: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Hashes (sorted) of all terms, places and spellings of those whose presence depends on the label; a family counts once under each label."""
    h, row, lower, s, e = words(texts)
    joined = "".join(lower)
    unit, unit_of = np.unique(family * 2 + y, return_inverse=True)
    pairs = np.unique(np.stack([h, unit_of[row].astype(np.uint64)], axis=1), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
    terms, inverse = np.unique(pairs[:, 0], return_inverse=True)
    label = unit[pairs[:, 1].astype(np.int64)] % 2
    n1, n0 = float((unit % 2 == 1).sum()), float((unit % 2 == 0).sum())
    k1 = np.bincount(inverse, weights=label == 1, minlength=len(terms))
    k0 = np.bincount(inverse, weights=label == 0, minlength=len(terms))
    often = k1 + k0 >= LEAST_DOCS

    def part(k, n, rate):
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.where(k > 0, k * np.log(k / (n * rate)), 0)
            b = np.where(n - k > 0, (n - k) * np.log((n - k) / (n * (1 - rate))), 0)
        return a + b

    rate = (k1 + k0) / (n1 + n0)
    g = 2 * (part(k1, n1, rate) + part(k0, n0, rate))
    bound = 2 * math.log(max(2, int(often.sum())) * 100) - 4
    telling = np.flatnonzero(often & (g >= bound))
    first = dict(zip(*(x.tolist() for x in np.unique(h, return_index=True)))) if len(h) else {}
    return terms, telling, [joined[s[first[t]]:e[first[t]]] for t in terms[telling].tolist()]


class Index:
    """Block-max inverted index over TF-IDF vectors of length 1."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, y: np.ndarray, keys: np.ndarray, n_terms: int):
        """``keys``: a search leaves out the examples of one key."""
        full = [i for i, (t, _) in enumerate(vectors) if len(t)]
        full.sort(key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), int(ids[i])))  # like beside like: tighter blocks
        self.ids, self.y, self.keys = ids[full], y[full], keys[full]
        self.blocks = -(-len(full) // BLOCK)
        size = [len(vectors[i][0]) for i in full]
        term = np.concatenate([vectors[i][0] for i in full]) if full else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in full]) if full else np.zeros(0)
        example = np.repeat(np.arange(len(full)), size)
        self.own_at, self.own_term, self.own_weight = np.concatenate([[0], np.cumsum(size)]).astype(np.int64), term, weight
        order = np.lexsort((example, term))
        term, self.example, self.weight = term[order], example[order], weight[order]
        self.at = np.searchsorted(term, np.arange(n_terms + 1))
        # largest weight of each term and block that meet
        cell = term * self.blocks + self.example // BLOCK
        new = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cell_at = np.searchsorted(term[new], np.arange(n_terms + 1))
        self.cell_block = self.example[new] // BLOCK
        self.most = np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0)
        self.asked = np.zeros(n_terms)

    def search(self, terms: np.ndarray, weights: np.ndarray, not_key: int, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine over 0 (ties: smaller id), and their cosines.

        The short lists (rare terms, most of the weight) are added up for all
        examples; the block maxima of the long ones bound what these can add to
        the examples of a block.  Only examples whose bound reaches the worst of
        the k best so far are scored in full, the most hopeful first.
        """
        none = np.zeros(0, np.int64), np.zeros(0)
        if not len(terms) or not self.blocks:
            return none

        def met(at, values, into, size, which):
            n = at[terms[which] + 1] - at[terms[which]]
            flat = flat_ranges(at[terms[which]], n)
            return np.bincount(into[flat], weights=values[flat] * np.repeat(weights[which], n), minlength=size)

        length = self.at[terms + 1] - self.at[terms]
        by = np.argsort(length, kind="stable")
        upto = np.cumsum(length[by])
        split = int(np.searchsorted(upto, max(SHORT * upto[-1], len(self.ids)), side="right"))
        short, long_ = by[:split], by[split:]
        sure = met(self.at, self.weight, self.example, len(self.ids), short)
        bound = sure + met(self.cell_at, self.most, self.cell_block, self.blocks, long_)[np.arange(len(self.ids)) // BLOCK]
        likely = np.flatnonzero((bound > 0) & (self.keys != not_key))
        if not len(likely):
            return none
        floor = np.partition(sure[likely], -k)[-k] if len(likely) > k else 0.0
        likely = likely[bound[likely] >= floor - NEAR]
        likely = likely[np.argsort(-bound[likely], kind="stable")]
        entries = self.own_at[likely + 1] - self.own_at[likely]
        score = np.empty(len(likely))
        if entries.sum() > 2 * (upto[-1] - (upto[split - 1] if split else 0)):  # so many that the long lists are shorter
            score = (sure + met(self.at, self.weight, self.example, len(self.ids), long_))[likely]
        else:
            self.asked[terms] = weights
            begin, step = 0, 4 * k
            while begin < len(likely) and bound[likely[begin]] >= floor - NEAR:
                some = slice(begin, min(begin + step, len(likely)))
                flat = flat_ranges(self.own_at[likely[some]], entries[some])
                score[some] = np.add.reduceat(self.asked[self.own_term[flat]] * self.own_weight[flat], np.cumsum(entries[some]) - entries[some])
                begin, step = some.stop, 2 * step
                if begin >= k:
                    floor = max(floor, np.partition(score[:begin], -k)[-k])
            self.asked[terms] = 0
            likely, score = likely[:begin], score[:begin]
        likely, score = likely[score > 0], score[score > 0]
        keep = np.lexsort((self.ids[likely], -np.round(score, 9)))[:k]
        return likely[keep], score[keep]

    def vote(self, best: np.ndarray, score: np.ndarray) -> float:
        w = 1 / (1.02 - np.minimum(score, 1.0))
        return float((w * self.y[best]).sum() / w.sum())


def _numbers(terms: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each hash in the sorted terms, and whether it is there."""
    kinds, of = np.unique(h, return_inverse=True)  # sorted ones are looked up from near to near
    at = np.minimum(np.searchsorted(terms, kinds), len(terms) - 1)
    return at[of], (terms[at] == kinds)[of]


def vectors(texts: list[str], terms: np.ndarray, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """TF-IDF vector of length 1 of each text: term numbers and weights (1 + ln tf) * idf."""
    h, row, *_ = words(texts)
    if not len(terms) or not len(h):
        return [(np.zeros(0, np.int64), np.zeros(0))] * len(texts)
    at, hit = _numbers(terms, h)
    cell, tf = np.unique(row[hit] * len(terms) + at[hit], return_counts=True)
    doc, term = cell // len(terms), cell % len(terms)
    w = (1 + np.log(tf)) * idf[term]
    upto = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
        v = w[a:b]
        out.append((term[a:b], v / math.sqrt(float((v * v).sum())) if b > a else v))
    return out


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling neighbours: block centres and (smoothed) levels."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of w*x, of w*y, of w
    for i in order.tolist():
        pools.append([w[i] * x[i], w[i] * y[i], w[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            a = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], a)]
    centre = np.array([p[0] / p[2] for p in pools])
    level = np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])
    return centre, np.maximum.accumulate(level)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> dict:
    """The model: examples' vectors, terms, document frequencies, calibration.  Its size is bounded by the parameters."""
    pdf = labelled_sample(docs, labels, label, per_class).select("row_id", "label", "share", "text")
    chosen = _in_one_task(pdf, _choose, "terms binary, telling array<long>, spellings array<string>")
    y = pdf.agg(F.sum(F.col("label") * F.col("share")).alias("ones"), F.sum("share").alias("n")).first()
    prior = ((y["ones"] or 0) + 1) / ((y["n"] or 0) + 2)
    terms = np.frombuffer(bytes(chosen["terms"]), np.uint64) if chosen else np.zeros(0, np.uint64)
    if not len(terms):
        return {"prior": prior, "terms": terms, "spellings": {}}
    telling = np.array(chosen["telling"], np.int64)
    weight = np.full(len(terms), LIGHT)
    weight[telling] = 1
    idf = _idf(docs, terms) * weight

    def build(batches):
        t = _sorted(batches)
        texts = t["text"].fillna("").tolist()
        vs = vectors(texts, terms, idf)
        keys = [text_key(x) for x in texts]
        y, family = t["label"].to_numpy(), families(texts)
        index = Index(vs, t["row_id"].to_numpy(), y, family, len(terms))
        votes = []
        for (term, w), own in zip(vs, family.tolist()):
            best, score = index.search(term, w, own)
            votes.append(index.vote(best, score) if len(best) else None)
        yield pa.RecordBatch.from_arrays([
            pa.array(t["row_id"].tolist(), pa.int64()), pa.array(t["label"].tolist(), pa.int32()), pa.array(t["share"].tolist(), pa.float64()), pa.array(keys, pa.int64()), pa.array(votes, pa.float64()),
            pa.array([v[0].tolist() for v in vs], pa.list_(pa.int64())), pa.array([v[1].tolist() for v in vs], pa.list_(pa.float64()))], names=["id", "y", "share", "key", "vote", "t", "w"])

    made = pdf.coalesce(1).mapInArrow(build, "id long, y int, share double, key long, vote double, t array<long>, w array<double>").toArrow().to_pandas()  # at most 2 * per_class rows
    model = {"prior": prior, "terms": terms, "spellings": dict(zip(telling.tolist(), chosen["spellings"])), "idf": idf,
             "vectors": [(np.array(t, np.int64), np.array(w, float)) for t, w in zip(made["t"], made["w"])],
             **{c + "s" if c != "y" else c: made[c].to_numpy() for c in ("id", "y", "key")}}
    share, votes = made["share"].to_numpy(), made["vote"].to_numpy(float)
    some = ~np.isnan(votes)
    none = ~some
    model["alone"] = float(((model["y"] * share)[none].sum() + prior) / (share[none].sum() + 1))
    model["curve"] = monotone(votes[some], model["y"][some].astype(float), share[some]) if some.any() else (np.zeros(1), np.full(1, prior))
    return model


def _sorted(batches) -> pd.DataFrame:
    frames = [b.to_pandas() for b in batches]
    return pd.concat(frames).sort_values("row_id").reset_index(drop=True) if frames else pd.DataFrame({"row_id": [], "label": [], "share": [], "text": []})


def _choose(batches):
    t = _sorted(batches)
    y = t["label"].to_numpy()
    texts = t["text"].fillna("").tolist()
    terms, telling, spellings = example_terms(texts, y, families(texts)) if len(set(y.tolist())) == 2 else (np.zeros(0, np.uint64), np.zeros(0, np.int64), [])
    yield pa.RecordBatch.from_arrays([pa.array([terms.tobytes()], pa.binary()), pa.array([telling.tolist()], pa.list_(pa.int64())), pa.array([spellings], pa.list_(pa.string()))], names=["terms", "telling", "spellings"])


def _in_one_task(df: DataFrame, fn, schema: str):
    return df.coalesce(1).mapInArrow(fn, schema).first()


def _idf(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Inverse document frequency of each term, over all documents."""

    def count(data, offsets, rows):
        h, row, *_ = words(decode(data, offsets))
        at, hit = _numbers(terms, h)
        cell = np.unique(row[hit] * len(terms) + at[hit])
        df_ = np.bincount(cell % len(terms), minlength=len(terms))
        some = np.flatnonzero(df_)
        return {"term": np.append(some, -1), "n": np.append(df_[some], len(offsets) - 1)}

    counts = map_text(docs.select(F.col("text").cast("string").alias("text")), count, "term long, n long")
    got = counts.groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # at most a row for each term of the examples, and one
    n = dict(zip(got["term"].to_pylist(), got["n"].to_pylist()))
    return np.array([math.log(1 + (n.get(-1, 0) + 1) / (n.get(i, 0) + 1)) for i in range(len(terms))])


def index_of(model: dict) -> Index:
    return Index(model["vectors"], model["ids"], model["y"], model["keys"], len(model["terms"]))


def add_scores(df: DataFrame, model: dict, prefix: str = "", text_col: str = "text") -> DataFrame:
    """``df`` with score, similarity (of the nearest), neighbours (ids, nearest first) and terms, each named with ``prefix``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(data, offsets, rows):
        model = shared.value
        texts = decode(data, offsets)
        n = len(texts)
        scores, near = np.full(n, model["prior"]), np.zeros(n)
        neighbours: list[list[int]] = [[]] * n
        found: list[list[str]] = [[]] * n
        if len(model["terms"]):
            if not hasattr(shared, "index"):
                shared.index = index_of(model)
                model["vectors"] = None  # this process's copy: the index holds them
            index, (centre, level) = shared.index, model["curve"]
            scores[:] = model["alone"]
            same: dict[str, int] = {}  # equal texts of a slice are searched once
            for i, (t, w) in enumerate(vectors(texts, model["terms"], model["idf"])):
                if not len(t):
                    continue
                j = same.setdefault(texts[i], i)
                if j < i:
                    scores[i], near[i], neighbours[i], found[i] = scores[j], near[j], neighbours[j], found[j]
                    continue
                best, cos = index.search(t, w, text_key(texts[i]))
                found[i] = [model["spellings"][x] for x in t.tolist() if x in model["spellings"]]
                if len(best):
                    scores[i] = np.interp(index.vote(best, cos), centre, level)
                    neighbours[i], near[i] = index.ids[best].tolist(), cos[0]
        flat = np.array([x for ids in neighbours for x in ids], np.int64)
        offs = np.concatenate([[0], np.cumsum([len(x) for x in neighbours])])
        return {prefix + "score": scores, prefix + "similarity": near, prefix + "neighbours": list_array(flat, offs, pa.int64()), prefix + "terms": pa.array(found, pa.list_(pa.string()))}

    names = ("score", "double"), ("similarity", "double"), ("neighbours", "array<long>"), ("terms", "array<string>")
    return add_columns(df, run, ", ".join(f"`{prefix}{n}` {t}" for n, t in names), text_col)


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, score, predicted and the evidence of every row."""
    rows = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text"))
    scored = add_scores(rows, model).drop("text")
    return scored.select(F.col("row_id").alias(id_col), (fold(F.col("row_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         "neighbours", "similarity", "terms")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
