"""Quality scores from overlapping heuristic labellers.

Labellers vote good, bad or nothing on each text. Their accuracies are estimated by
expectation-maximisation on the counts of vote patterns over all documents: the share of good documents,
and for each labeller how often it votes bad on either kind. Posteriors of that model label a
bounded sample, on which a hashed linear scorer of words and form is trained; it scores every text.

The vote patterns that come to the driver are at most 3 to the number of labellers. The scorer learns from
about ``SAMPLE`` documents, chosen by a hash of doc_id, for each half of the posteriors.

Cases: null and empty texts get votes as texts without words and a score like any other; if all posteriors
lie on one side the scorer is constant; ties at 0.5 count as good; repeated rows get equal results; an empty
table gives an empty result; a null doc_id is hashed as null; other columns stay, and a column that has the
name of a result column is an error that names it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiquarry.llm.shared import table, written

SAMPLE = 4_000
DIMS = 2**16
ROUNDS = 100
#: Passes of the scorer over its sample.
PASSES, RATE, RIDGE = 8, 0.3, 1e-4

_SPACE = r"\s+"
_RUN = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+")


def measures(text: Column) -> dict[str, Column]:
    """What the labellers look at."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    # Looks at a run of symbols from its first one only: long runs are read once.
    tails = F.regexp_count(text, F.lit(r"(?<![^\p{L}\p{N}\s.])[^\p{L}\p{N}\s.]{2,}+(\s|$)"))
    return {
        "words": F.size(words),
        "distinct": F.when(F.size(words) > 0, F.size(F.array_distinct(words)) / F.sqrt(F.size(words).cast("double"))).otherwise(0.0),
        "symbols": F.regexp_count(text, F.lit(r"[#$%&*{}<>|\\^~=_]")) / size,
        "upper": F.regexp_count(text, F.lit(r"[A-Z]")) / size,
        "shouts": F.regexp_count(text, F.lit(r"!!")) / size,
        "stops": F.regexp_count(text, F.lit(r"[.!?](\s|$)")) / F.greatest(F.size(words), F.lit(1)),
        "repeats": F.when(F.size(lines) > 0, 1 - F.size(F.array_distinct(lines)) / F.size(lines)).otherwise(0.0),
        "tails": tails / F.greatest(F.size(words), F.lit(1)),
        "bars": F.regexp_count(text, F.lit(r" \| ")) / F.greatest(F.size(words), F.lit(1)),
    }


def votes() -> dict[str, str]:
    """Each labeller as SQL over the measures: 1 good, 0 bad, -1 no vote."""

    def bad_if(bad: str, there: str = "true") -> str:
        return f"case when not ({there}) then -1 when {bad} then 0 else 1 end"

    return {
        "v_distinct": bad_if("distinct < 2.5", "words >= 20"),
        "v_symbols": bad_if("symbols > 0.05"),
        "v_tails": bad_if("tails > 0.2"),
        "v_upper": bad_if("upper > 0.3"),
        "v_shouts": bad_if("shouts > 0.01"),
        "v_stops": bad_if("stops < 0.02", "words >= 30"),
        "v_repeats": bad_if("repeats > 0.3"),
        "v_bars": bad_if("bars > 0.1"),
    }


#: Where estimation starts, and what it is drawn to with the weight of ``PRIOR`` of all documents: how
#: often a labeller votes bad on bad and on good documents.
START, PRIOR = (0.4, 0.01), 0.05


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """The share of good documents and ``p[class, labeller]``, how often a labeller votes bad when it votes.

    Expectation-maximisation; class 1 is good.
    """
    p = np.repeat(np.array(START)[:, None], patterns.shape[1], axis=1)
    share, total = 0.85, counts.sum()
    for _ in range(rounds):
        post = posterior(patterns, share, p)
        share = float(((post * counts).sum() + 1) / (total + 2))
        weight = np.stack([(1 - post) * counts, post * counts])
        bad, any_ = weight @ (patterns == 0), weight @ (patterns >= 0)
        p = (bad + PRIOR * total * np.array(START)[:, None] + 1e-3) / (any_ + PRIOR * total + 2e-3)
    return share, p


def evidence(p: np.ndarray) -> np.ndarray:
    """The log-odds for good of each labeller's vote: bad, good."""
    return np.stack([np.log(p[1] / p[0]), np.log((1 - p[1]) / (1 - p[0]))])


def posterior(patterns: np.ndarray, share: float, p: np.ndarray) -> np.ndarray:
    odds = evidence(p)
    total = ((patterns == 0) * odds[0] + (patterns == 1) * odds[1]).sum(axis=1) + np.log(share / (1 - share))
    return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


class _Hashes(dict):
    """The two features of a run of characters: itself in lower case, and its form and length."""

    def __missing__(self, run: str) -> tuple[int, int]:
        if len(self) >= 300_000:
            self.clear()
        form = "A" if run.isupper() and len(run) > 1 else "a" if run[0].isalpha() else "0" if run[0].isdigit() else "." + run[:3]
        value = self[run] = tuple(crc32(x.encode("utf-8", "replace")) % DIMS for x in (run.lower(), form + str(min(len(run), 12))))
        return value


_HASHES = _Hashes()


def features_of(text: str | None) -> np.ndarray:
    """Hashed words and their forms, each once."""
    own = {f for run in set(_RUN.findall(text or "")) for f in _HASHES[run]}
    return np.array(sorted(own), dtype=np.int64)


def _vector(text: str | None) -> tuple[np.ndarray, float]:
    """A text's features and their common value: vectors have length 1."""
    own = features_of(text)
    return own, 1 / np.sqrt(len(own) + 1)


class Scorer:
    """A hashed linear scorer: logistic of a bias and the weights of a text's features."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        own, value = _vector(text)
        return float(1 / (1 + np.exp(-np.clip(self.bias + value * self.weights[own].sum(), -40, 40))))

    @classmethod
    def fit(cls, vectors: list[tuple[np.ndarray, float]], target: np.ndarray) -> Scorer:
        """Passes of stochastic gradient steps in a fixed order; soft targets; both halves weigh alike."""
        weights, bias = np.zeros(DIMS), 0.0
        good = target >= 0.5
        if good.all() or not good.any():
            return cls(weights, 0.0 if not len(target) else (4.0 if good.all() else -4.0))
        weigh = np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
        order = np.random.default_rng(5)
        for k in range(PASSES):
            rate = RATE * 10 / (1 + k)
            for i in order.permutation(len(vectors)).tolist():
                own, value = vectors[i]
                s = 1 / (1 + np.exp(-np.clip(bias + value * weights[own].sum(), -40, 40)))
                step = rate * weigh[i] * (target[i] - s)
                weights[own] += step * value - rate * RIDGE * weights[own]
                bias += step * 0.1
        return cls(weights, float(bias))

    def to_text(self) -> str:
        at = np.flatnonzero(self.weights)
        return json.dumps([self.bias, at.tolist(), self.weights[at].tolist()])

    @classmethod
    def from_text(cls, text: str) -> Scorer:
        bias, at, value = json.loads(text)
        weights = np.zeros(DIMS)
        weights[at] = value
        return cls(weights, bias)


_LOADED: dict[int, Scorer] = {}


def _loaded(shipped, key: int) -> Scorer:
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Scorer.from_text(shipped.value)
    return _LOADED[key]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            rows = batch.slice(at, 200)
            own = [features_of(t) for t in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(own, pa.list_(pa.int64()))], names=["posterior", "features"])


def _train(rows: pa.Table) -> pa.Table:
    vectors = [(own := np.array(f, dtype=np.int64), 1 / np.sqrt(len(own) + 1)) for f in rows.column("features").to_pylist()]
    return pa.table({"model": pa.array([Scorer.fit(vectors, rows.column("posterior").to_numpy()).to_text()])})


def voted(docs: DataFrame) -> DataFrame:
    """``row``, all columns of ``docs`` but the text, ``text``, and a column for the vote of each labeller."""
    own = measures(F.col("text"))
    measured = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), F.col("text").cast("string"), *[c.alias(k) for k, c in own.items()])
    return measured.select("row", "text", *[F.expr(sql).alias(k) for k, sql in votes().items()])


def labellers(rows: DataFrame) -> tuple[float, np.ndarray]:
    """:func:`fit_labellers` on the vote patterns of all of ``rows``."""
    names = list(votes())
    counted = rows.groupBy(*names).count().collect()
    patterns = np.array([[r[k] for k in names] for r in counted], dtype=np.int64).reshape(-1, len(names))
    return fit_labellers(patterns, np.array([r["count"] for r in counted], dtype=np.float64))


def posterior_of(share: float, p: np.ndarray) -> Column:
    """The probability of a good document given its votes."""
    odds, own = F.lit(float(np.log(share / (1 - share)))), evidence(p)
    for k, name in enumerate(votes()):
        for vote in (0, 1):
            odds = odds + F.when(F.col(name) == vote, F.lit(float(own[vote, k]))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


RESULT = ("posterior", "score", "good")


def quality(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs (doc_id, text, …)`` less the text, with ``posterior``, ``score`` (0 to 1) and ``good``."""
    for name in RESULT:
        if name in docs.columns:
            raise ValueError(f"the table has a column {name} already")
    # Votes are taken once; the text is written beside them, so that scoring needs no second look.
    kept = written(voted(docs), "votes", compression="zstd")
    post = posterior_of(*labellers(kept))
    labelled = kept.withColumn("posterior", post)
    good = F.col("posterior") >= 0.5
    size = labelled.agg(F.count_if(good), F.count_if(~good)).first()
    chance = F.when(good, F.lit(min(1.0, sample / max(size[0], 1)))).otherwise(F.lit(min(1.0, sample / max(size[1], 1))))
    chosen = labelled.where(F.pmod(F.xxhash64("row.doc_id"), F.lit(2**53)) / 2.0**53 < chance).select("row.doc_id", "posterior")
    # The chosen rows, about ``sample`` of each half, go to the texts, not the texts to them.
    chosen = chosen.groupBy("doc_id").agg(F.min("posterior").alias("posterior"))
    learned = kept.select("row.doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "posterior").agg(F.min("text").alias("text")).select("posterior", "text")
    learned = learned.mapInArrow(_vectors, "posterior double, features array<long>")
    made = learned.groupBy(F.lit(1).alias("all")).applyInArrow(_train, "model string").collect()
    text = made[0][0] if made else Scorer(np.zeros(DIMS), 0.0).to_text()
    shipped, key = docs.sparkSession.sparkContext.broadcast(text), hash(text)  # at most DIMS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _loaded(shipped, key)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made = pa.array([own.score(t) for t in part.column(2).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), made], names=["row", "posterior", "score"])

    scored = kept.select("row", post.alias("posterior"), "text")
    schema = T.StructType([scored.schema["row"], T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return scored.mapInArrow(run, schema).select("row.*", "posterior", "score", (F.col("score") >= 0.5).alias("good"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
