"""Toxicity scores by a counterfactual-regularised linear classifier.

A document is its set of distinct words; a word's features are itself and its first 4, 5 and 6
characters, so that a stem counts with endings never seen; a feature counts as often as distinct words have it. Learning
takes labelled texts, screens features by the log-odds of their document counts, and fits a logistic regression with
penalties on the weights (which leaves words that many documents share) and on the squared change of the score under
counterfactual swaps: an identity term of a labelled sentence is replaced by another of its group, and a labelled
document of label 0 also names a group that it does not name. The first makes the terms of a group weigh alike, the second
keeps the mention of a group from raising the score by itself, in a corpus that names no groups too.

Features are counted and screened where the texts are; what the fit gets, in one task, are the screened features of a
bounded sample. Learning takes at most ``SAMPLE`` labelled rows of each label, chosen by a hash of doc_id; scores use whole
texts.

Cases: null and empty texts get the score of a text without known words; without labelled rows of both
labels every score is the share of label 1 (0 without any); labels other than 0 and 1 are not learned
from; repeated label rows count once, as do repeated documents (the
smallest text of a doc_id); an empty table gives an empty result; ties at 0.5
count as label 1; an input column with the name of a result column is an error that names it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiquarry.llm.langid import remainder
from lexiquarry.llm.shared import table, unwritten, written

#: Labelled rows of each label that are learned from, at most (about).
SAMPLE = 6_000
DIMS = 2**22
PREFIXES = (4, 5, 6)
#: Least z value of the log-odds of a feature (only evidence for label 1 is weighed), and least number of documents that hold it.
LEAST_Z, LEAST_DOCS = 2.0, 2
RIDGE, SWAP = 0.02, 4.0
#: The fit ends when no weight moves by this in a round.
STILL = 1e-4
#: A weight costs as much as so many documents of label 1 that are taken for the other label.
LASSO = 1.0
#: Terms that may replace each other without changing what is said about whom.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("gay", "straight", "lesbian", "transgender"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("immigrants", "refugees", "locals"),
)

_WORD = regex.compile(r"\p{L}+")
_SENTENCE = regex.compile(r"[^.!?\n]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(word: str) -> list[int]:
    """Hashed features of a word."""
    names = ["=" + word, *(f"{k}{word[:k]}" for k in PREFIXES if len(word) >= k)]
    return [int.from_bytes(blake2b(x.encode(), digest_size=4).digest(), "little") % DIMS for x in names]


def swaps_of(text: str, groups: Sequence[Sequence[str]]) -> list[tuple[str, str]]:
    """What the swap of an identity term in a sentence takes from the words of the text and adds to them.

    A term that other sentences keep is not taken ("" in its place), nor is one added that is there already.
    """
    other = {t: g for g in groups for t in g}
    sentences = [set(_WORD.findall(x)) for x in _SENTENCE.findall((text or "").lower())]
    holds: dict[str, int] = {}
    for words in sentences:
        for w in words & other.keys():
            holds[w] = holds.get(w, 0) + 1
    out = []
    for words in sentences:
        for term in sorted(words & other.keys()):
            gone = "" if holds[term] > 1 else term
            out += [(gone, "" if t in holds else t) for t in other[term] if t != term]
    return [pair for pair in out if pair != ("", "")]


def mention_of(text: str, groups: Sequence[Sequence[str]]) -> list[tuple[str, str]]:
    """The mention that a document of label 0 gets: the term of each group that its text chooses, if it names none of the group."""
    words, number = words_of(text), int.from_bytes(blake2b((text or "").encode("utf-8", "replace"), digest_size=4).digest(), "little")
    return [("", g[number % len(g)]) for g in groups if not words & set(g)]


class Model:
    """A bias and the weights of hashed features."""

    def __init__(self, bias: float, weights: dict[int, float]):
        self.bias, self.weights = bias, weights
        self.kept: dict[str, float] = {}

    def word(self, word: str) -> float:
        if word not in self.kept:
            if len(self.kept) >= 300_000:
                self.kept.clear()
            self.kept[word] = sum(self.weights.get(f, 0.0) for f in features_of(word))
        return self.kept[word]

    def score(self, text: str | None) -> float:
        total = self.bias + sum(map(self.word, sorted(words_of(text))))
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))

    def to_text(self) -> str:
        return json.dumps([self.bias, sorted(self.weights.items())])

    @classmethod
    def from_text(cls, text: str) -> Model:
        bias, weights = json.loads(text)
        return cls(bias, dict(map(tuple, weights)))


def z_value(on: Column, off: Column, ones: int, zeros: int) -> Column:
    """The z value of the log-odds of a feature that ``on`` documents of label 1 and ``off`` of label 0 hold."""
    odds = F.log((on + 0.5) / (ones - on + 0.5)) - F.log((off + 0.5) / (zeros - off + 0.5))
    return odds / F.sqrt(1 / (on + 0.5) + 1 / (off + 0.5))


def fit(chosen: np.ndarray, row: np.ndarray, col: np.ndarray, val: np.ndarray, toxic: np.ndarray, share: float, swaps: dict[tuple[str, str], int], swap: float = SWAP, rounds: int = 1000) -> Model:
    """Logistic regression, ``share`` of all rows having label 1.

    Document ``row`` has the feature ``chosen[col]`` (sorted) ``val`` times. ``swaps`` counts the swaps that take one
    term and add another.
    """
    n, m = len(toxic), len(chosen)
    ones = int(toxic.sum())
    if not ones or ones == n:
        bias = np.log(share / (1 - share)) if 0 < share < 1 else (40.0 if share >= 1 else -40.0)
        return Model(float(bias), {})
    gaps = []
    for (a, b), times in sorted(swaps.items()):
        gap = np.zeros(m)
        for sign, term in ((1, a), (-1, b)):
            for f in features_of(term) if term else ():
                at = np.searchsorted(chosen, f)
                if at < m and chosen[at] == f:
                    gap[at] += sign
        gaps.append(gap * np.sqrt(times))
    gaps = np.array(gaps).reshape(len(gaps), m)
    # Both labels weigh alike, as label 1 is rare; the bound of the curvature gives each weight's step.
    weight = np.where(toxic > 0, 0.5 / ones, 0.5 / (n - ones))
    size = np.bincount(row, weights=val, minlength=n) + 1
    curve = np.bincount(col, weights=0.25 * weight[row] * val * size[row], minlength=m) + RIDGE / n + swap * np.abs(gaps).T @ np.abs(gaps).sum(axis=1) / n
    curve_b = 0.25 * (weight * size).sum()
    w, b = np.zeros(m), 0.0
    v, vb, t = w.copy(), b, 1.0
    for k in range(rounds):  # gradient steps with momentum
        s = np.bincount(row, weights=val * v[col], minlength=n) + vb
        d = weight * (1 / (1 + np.exp(-np.clip(s, -40, 40))) - toxic)
        grad = np.bincount(col, weights=val * d[row], minlength=m) + RIDGE / n * v + swap * gaps.T @ (gaps @ v) / n
        new, new_b = v - grad / curve, vb - d.sum() / curve_b
        new = np.sign(new) * np.maximum(np.abs(new) - LASSO * 0.5 / ones / curve, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        moved = max(float(np.abs(new - w).max(initial=0.0)), abs(float(new_b) - b))
        w, b, t = new, float(new_b), t_new
        if moved < STILL and k > 50:
            break
    return Model(b, {int(f): float(x) for f, x in zip(chosen, w, strict=True) if abs(x) > 1e-4})


def _prepare(groups: Sequence[Sequence[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The features of each document with their counts, and its swaps."""
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200)
                features, swaps = [], []
                for toxic, t in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                    f, n = np.unique(np.array([f for w in words_of(t) for f in features_of(w)], dtype=np.int64), return_counts=True)
                    features.append([{"f": a, "n": b} for a, b in zip(f.tolist(), n.tolist(), strict=True)])
                    swaps.append(json.dumps(swaps_of(t, groups) + (mention_of(t, groups) if not toxic else [])))
                kind = pa.list_(pa.struct([("f", pa.int32()), ("n", pa.int32())]))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(features, kind), pa.array(swaps, pa.string())], names=["doc_id", "toxic", "features", "swaps"])

    return run


def _learn(chosen: np.ndarray, share: float, swaps: dict[tuple[str, str], int], swap: float):
    def run(rows: pa.Table) -> pa.Table:
        toxic = rows.column("toxic").to_numpy().astype(np.float64)
        lists = rows.column("own").combine_chunks()
        row = np.repeat(np.arange(len(toxic)), np.diff(lists.offsets.to_numpy()))
        own = lists.flatten()
        col, val = np.searchsorted(chosen, own.field("f").to_numpy()), own.field("n").to_numpy().astype(np.float64)
        return pa.table({"model": pa.array([fit(chosen, row, col, val, toxic, share, swaps, swap).to_text()])})

    return run


def train(labels: DataFrame, docs: DataFrame, groups: Sequence[Sequence[str]] = IDENTITY_TERMS, sample: int = SAMPLE, swap: float = SWAP) -> Model:
    """The model of ``labels (doc_id, toxic)`` on ``docs (doc_id, text)``; the fit is one task over the screened features of the bounded sample."""
    rows = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).distinct()
    size = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    total = sum(size.values())
    share = size.get(1, 0) / total if total else 0.0
    bound = F.when(F.col("toxic") == 1, F.lit(min(1.0, sample / max(size.get(1, 0), 1)))).otherwise(F.lit(min(1.0, sample / max(size.get(0, 0), 1))))
    # The chosen labels, about ``sample`` of each, go to the texts, not the texts to them.
    wanted = rows.where((F.pmod(F.xxhash64("doc_id"), F.lit(2**53)) / 2.0**53) < bound)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chosen = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    prepared = chosen.mapInArrow(_prepare(groups), "doc_id long, toxic int, features array<struct<f:int,n:int>>, swaps string")
    prepared = written(prepared, "features")
    held = {r[0]: r[1] for r in prepared.groupBy("toxic").count().collect()}
    if not held.get(0) or not held.get(1):
        return fit(np.zeros(0, dtype=np.int64), *(np.zeros(0, dtype=np.int64) for _ in range(3)), np.zeros(0), share, {})
    pair = F.explode(F.from_json("swaps", "array<array<string>>"))
    swaps = {(r[0], r[1]): r[2] for r in prepared.select(pair.alias("s")).groupBy(F.col("s")[0], F.col("s")[1]).count().collect()}  # at most two terms of a group
    exploded = prepared.select("doc_id", "toxic", F.explode("features").alias("x")).select("doc_id", "toxic", "x.f", "x.n")
    swapped = sorted({x for pair in swaps for t in pair if t for x in features_of(t)})
    counted = exploded.groupBy("f").agg(F.sum("toxic").alias("on"), F.count("*").alias("all")).where(F.col("all") >= LEAST_DOCS)
    telling = z_value(F.col("on"), F.col("all") - F.col("on"), held[1], held[0]) >= LEAST_Z
    used = np.sort(counted.where(telling | F.col("f").isin(swapped)).select("f").toArrow().column(0).to_numpy().astype(np.int64))  # of the bounded sample
    kept = docs.sparkSession.createDataFrame([(int(x),) for x in used], "f int")
    own = exploded.join(F.broadcast(kept), "f").groupBy("doc_id", "toxic").agg(F.collect_list(F.struct("f", "n")).alias("own"))
    every = prepared.select("doc_id", "toxic").join(own, ["doc_id", "toxic"], "left").select("toxic", F.coalesce("own", F.array().cast("array<struct<f:int,n:int>>")).alias("own"))
    made = every.groupBy(F.lit(1).alias("all")).applyInArrow(_learn(used, share, swaps, swap), "model string").collect()
    unwritten(prepared)
    return Model.from_text(made[0][0])


_LOADED: dict[int, Model] = {}


def _loaded(shipped, key: int) -> Model:
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Model.from_text(shipped.value)
    return _LOADED[key]


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with the score of every whole text."""
    if score_col in df.columns:
        raise ValueError(f"the table has a column {score_col} already")
    n, text = df.columns.index(text_col), model.to_text()
    shipped, key = df.sparkSession.sparkContext.broadcast(text), hash(text)  # features of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _loaded(shipped, key)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                made = pa.array([own.score(t) for t in rows.column(n).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*rows.columns, made], names=[*rows.schema.names, score_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(score_col, T.DoubleType())]))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 5) == 0
    model = train(labels.where(~held_out).select("doc_id", "toxic"), docs)
    found = score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
