"""Quality rules: a decision list learned by sequential covering, over counts that a reader can check.

Each text is counted once (words, symbols, repeated lines and windows, and what else :data:`FEATURES` are made of).
Documents that pass the base rules and have a label teach the list. A rule is a conjunction of thresholds on
features; it grows on two thirds of them by the threshold with the largest information gain until it covers no
good document, and is then pruned back to the prefix that does best on the other third, (bad - good) /
(bad + good) covered. It joins the list if it covers at least ``LEAST`` bad documents of that third with a
precision of ``PRECISION``; what it covers is put aside and the next rule grows, until none is good enough. The list
becomes one conditional expression of Spark, the rules in their order.

All statistics are aggregates over all labelled documents: the thresholds that are tried lie half-way between quantiles, and each step counts labels by feature and interval, which is a few thousand numbers whatever the
table's size. There is no sample.

Cases: a null text has no words and fails the base rules; windows of fewer than five words are none; texts are
taken whole; ids with labels that contradict each other, labels other than 0 and 1 and null ids teach
nothing; without labels of both kinds the list is empty and keeps what the base rules keep; documents that
share an id are each counted and judged by their own text; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from math import log2
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm.shared import give_back, table, written

#: Fixed values of the base rules.
LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
#: Thresholds in a rule, and rules in a list, at most; what a rule must reach on the documents kept back.
CONDITIONS, RULES, LEAST, PRECISION = 4, 20, 3, 0.9
#: Quantiles of each label's documents that are tried as thresholds.
LEVELS = (0.0, 0.001, 0.005, 0.01, 0.025, *(k / 20 for k in range(1, 20)), 0.975, 0.99, 0.995, 0.999, 1.0)
#: Characters that are counted together.
CHUNK = 500_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_doubled", "n_upper", "n_digits", "n_stops", "n_marks")
#: What a rule may ask, each from the counts.
FEATURES = {
    "words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "variety": "n_distinct / sqrt(greatest(n_words, 1))",
    "doubled": "n_doubled / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "stops": "n_stops / greatest(n_words, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
}

_BLANKS, _UPPER, _DIGITS = b" \t\n\x0b\x0c\r", bytes(range(65, 91)), bytes(range(48, 58))
#: Blanks as spaces, ends of sentences as full stops.
_ENDS = bytes(32 if b in _BLANKS else 46 if b in b".!?" else b for b in range(256))


def _held(raw: bytes, kinds: bytes) -> int:
    return len(raw) - len(raw.translate(None, kinds))


def repetitions(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For each text, how many of its words are in windows of ``WINDOW`` words that it has twice or more, and how many repeat the word before.

    Windows are numbered exactly: words, then pairs, fours and fives, each by rank among those of all the texts.
    """
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    known: dict[bytes, int] = {}
    own = np.array([known.setdefault(w, len(known)) for ws in words for w in ws], dtype=np.int64)
    text = np.repeat(np.arange(len(words)), sizes)
    doubled = np.bincount(text[1:][(own[1:] == own[:-1]) & (text[1:] == text[:-1])], minlength=len(words))
    if len(own) < WINDOW:
        return np.zeros(len(words), dtype=np.int64), doubled

    def ranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]

    pairs = ranked(own[:-1], own[1:])
    fours = ranked(pairs[:-2], pairs[2:])
    fives = ranked(fours[:-1], own[4:])
    inside = text[:-4] == text[4:]
    found, counts = np.unique(fives[inside] * len(words) + text[:-4][inside], return_counts=True)
    again = np.zeros(len(fives), dtype=bool)
    again[inside] = np.isin(fives[inside] * len(words) + text[:-4][inside], found[counts > 1])
    marked = np.zeros(len(own) + 1, dtype=np.int64)
    np.add.at(marked, np.flatnonzero(again), 1)
    np.add.at(marked, np.flatnonzero(again) + WINDOW, -1)
    return np.bincount(text[np.cumsum(marked)[:-1] > 0], minlength=len(words)), doubled


def counts_of(texts: list[str | None]) -> list[tuple[int, ...]]:
    """:data:`COUNTS` of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    words = [r.split() for r in raw]  # bytes are split at the blanks of ASCII only
    out = []
    for t, r, own, repeated, doubled in zip(texts, raw, words, *(x.tolist() for x in repetitions(words)), strict=True):
        lines = [x for x in r.split(b"\n") if x.strip()]
        ends = r.translate(_ENDS)
        stops = ends.count(b". ") + ends.endswith(b".")
        dup = len(lines) - len(set(lines))
        out.append((len(own), len(t or "") - _held(r, _BLANKS), _held(r, SYMBOLS), dup, repeated, len(lines), len(set(own)), doubled, _held(r, _UPPER), _held(r, _DIGITS), stops, r.count(b"!")))
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        sizes = np.array([len(t) if t else 0 for t in texts.to_pylist()]) if batch.num_rows else np.zeros(0)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            own = counts_of(texts.slice(a, b - a).to_pylist())
            columns = zip(*own, strict=True) if own else [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *COUNTS])
    give_back()


def counted(docs: DataFrame) -> DataFrame:
    """``doc_id``, :data:`COUNTS` and ``base_failed`` of each of ``docs (doc_id, text)``."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_counted, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))
    return own.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


class Condition(NamedTuple):
    """A feature above, or else at most, a threshold."""

    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def _all(rule: Rule) -> str:
    return " AND ".join(c.sql() for c in rule) or "true"


class DecisionList(NamedTuple):
    """Rules in their order; a document that one covers goes."""

    rules: tuple[Rule, ...]

    def kept(self) -> Column:
        """The list as one conditional expression over the counts."""
        verdict = F.lit(True)
        for rule in reversed(self.rules):
            verdict = F.when(F.expr(_all(rule)), False).otherwise(verdict)
        return verdict

    def __str__(self) -> str:
        return "\n".join([*(f"drop if {' and '.join(f'{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}' for c in rule)}" for rule in self.rules), "keep"])


def labelled(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """The counted documents that pass the base rules and have one label, with ``bad`` and ``grows``, whether rules grow on them."""
    told = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    told = told.agg(F.min("quality").alias("least"), F.max("quality").alias("most")).where("least = most").select("doc_id", (F.col("least") == 0).alias("bad"))
    met = counts.where(~F.col("base_failed")).join(told, "doc_id")
    return met.select("bad", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 < 2).alias("grows"), *COUNTS)


def thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """Half-way between neighbours among the quantiles that each feature has for bad and for good documents."""
    levels = F.array(*map(F.lit, LEVELS))
    found = rows.groupBy("bad").agg(*[F.percentile_approx(F.expr(sql), levels, F.lit(10_000)).alias(name) for name, sql in FEATURES.items()]).collect()
    values = {name: sorted({x for r in found for x in r[name] or ()}) for name in FEATURES}
    return {name: [(a + b) / 2 for a, b in pairwise(own)] for name, own in values.items()}


def gain(bad: int, good: int, of_bad: int, of_good: int) -> float:
    """The information gained for the bad documents that stay covered."""
    return bad * (log2(bad / (bad + good)) - log2(of_bad / (of_bad + of_good))) if bad else 0.0


def best_condition(cells: dict[str, np.ndarray], cuts: dict[str, list[float]]) -> tuple[float, Condition | None]:
    """The threshold of the largest gain; ``cells[feature][interval, label]`` counts documents, label 1 is bad."""
    best: tuple[float, Condition | None] = (1e-9, None)
    for name, own in cells.items():
        good, bad = own.sum(axis=0).tolist()
        up_to = own.cumsum(axis=0)
        for k, cut in enumerate(cuts[name]):  # interval k ends with the cut
            low_good, low_bad = up_to[k].tolist()
            for above, p, n in ((True, bad - low_bad, good - low_good), (False, low_bad, low_good)):
                value = gain(p, n, bad, good)
                if value > best[0] + 1e-9:
                    best = (value, Condition(name, above, cut))
    return best


def _grown(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    rule: Rule = ()
    names = list(FEATURES)
    while len(rule) < CONDITIONS:
        counted_ = rows.where(F.expr(_all(rule))).select("bad", F.posexplode("intervals").alias("at", "k")).groupBy("at", "k", "bad").count().collect()
        cells = {name: np.zeros((len(cuts[name]) + 1, 2), dtype=np.int64) for name in names}
        for r in counted_:
            cells[names[r["at"]]][r["k"], int(r["bad"])] += r["count"]
        good, bad = cells[names[0]].sum(axis=0).tolist()
        found = best_condition(cells, cuts)[1] if bad and good else None
        if found is None:
            break
        rule = (*rule, found)
    return rule


def _pruned(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The prefix that does best on ``rows``, the shorter of equals, and the bad and good documents that it covers."""
    prefixes = [rule[:k] for k in range(1, len(rule) + 1)]
    each = [c for k, p in enumerate(prefixes) for c in (F.count_if(F.expr(_all(p)) & F.col("bad")).alias(f"b{k}"), F.count_if(F.expr(_all(p)) & ~F.col("bad")).alias(f"g{k}"))]
    own = rows.agg(*each).first()
    covered = [(own[f"b{k}"], own[f"g{k}"]) for k in range(len(prefixes))]
    best = max(range(len(prefixes)), key=lambda k: ((covered[k][0] - covered[k][1]) / max(1, sum(covered[k])), -k))
    return prefixes[best], *covered[best]


def interval(value: Column, cuts: list[float]) -> Column:
    """How many of the sorted ``cuts`` are below the value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value)) if cuts else F.lit(0)


def learn(rows: DataFrame) -> DecisionList:
    """The decision list of :func:`labelled` documents."""
    cuts = thresholds(rows)
    at = F.array(*[interval(F.expr(sql), cuts[name]) for name, sql in FEATURES.items()])
    left = written(rows.withColumn("intervals", at), "labelled")
    rules: list[Rule] = []
    while len(rules) < RULES:
        rule = _grown(left.where("grows"), cuts)
        if not rule:
            break
        rule, bad, good = _pruned(left.where(~F.col("grows")), rule)
        if bad < LEAST or bad < PRECISION * (bad + good):
            break
        rules.append(rule)
        left = left.where(~F.expr(_all(rule)))
    return DecisionList(tuple(rules))


RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def judged(counts: DataFrame, rules: DecisionList) -> DataFrame:
    """The counts of the base rules, ``base_failed`` and ``kept``."""
    return counts.select(*RESULT, (~F.col("base_failed") & rules.kept()).alias("kept"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = written(counted(table(spark, sf_dir, "documents").select("doc_id", "text")), "counts")
    return judged(counts, learn(labelled(counts, table(spark, sf_dir, "labels").select("doc_id", "quality"))))
