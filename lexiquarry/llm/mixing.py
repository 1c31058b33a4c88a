"""Mixing sources, languages and topics to target weights.

Tokens are counted by cell (source, language, topic). Iterative proportional fitting rakes the cells'
token weights until the totals by source, by language and by topic have the target shares of the wanted number of
tokens. A document's probability is its cell's weight over the cell's tokens, and a document is taken when
a hash of its id, seen as a number in [0, 1), is below just that probability, so that weights of 1 / probability
are unbiased. The taken shares come near the expected ones as documents grow in number.

No probability exceeds 1: a step of the fitting gives a level the factor at which its cells, none with more than
its tokens, add up to the level's target, so that cells that are taken whole stay fixed and the others are raked
on. The wanted number of tokens is what is taken: a target beyond a level's tokens is cut to these, and what it
lacks is spread over the other levels in proportion. :func:`report` shows targets, what of them can be reached, what
probabilities expect and what was taken.

The cells are known from the targets alone: levels that a target does not name are one level ``other``.
So at most the product of the numbers of levels comes to the driver, whatever the corpus holds.

A target whose named levels have the whole weight says nothing of other levels: these keep the share of the
tokens that they have, and the named ones are scaled to the rest, so that no level is lost.

Cases: null levels count as ``other``; null and empty texts have no tokens and take their cell's
probability (0 in a cell without tokens); targets of levels without tokens are spread over the others in
proportion; targets that no weights can meet together are missed by the least that raking reaches, which :func:`report`
shows; a null doc_id is hashed as 0; rows that share a doc_id are taken or left together if they are of one cell;
an empty table gives an empty result; an input column with the name of a result column is an error that names it.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm.shared import table, written

OTHER = "other"
#: Rounds of fitting at most, and the miss of a share that ends them.
ROUNDS, CLOSE = 1000, 1e-9
MARGINS = ("source", "lang", "topic")

#: Target shares of the query and the pipeline; levels that are not named share what is left, or keep their
#: own share if nothing is.
TARGETS: dict[str, dict[str, float]] = {
    "source": {"src0": 0.15, **{f"src{k}": 0.04 for k in range(1, 20)}},
    "lang": {"en": 0.55, "de": 0.17, "fr": 0.16, "es": 0.12},
    "topic": {"table": 0.1, "contact": 0.1, "short": 0.05, "prose": 0.75},
}
#: Share of all tokens that the mixture has.
BUDGET = 0.6
SEED = 11


def topic_of(text: Column) -> Column:
    """A topic by form: rows of a table, contact data, few words, or prose."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when((F.contains(text, F.lit("@")) & text.rlike(r"[A-Za-z0-9._-]@[A-Za-z0-9-]++\.[A-Za-z]")) | (F.contains(text, F.lit("+")) & text.rlike(r"\+\d++ \(?\d")), "contact")
        .when(F.length(text) < 400, "short")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"\S+")), F.lit(0)).cast("long")


def levelled(level: Column, named: Mapping[str, float]) -> Column:
    level = level.cast("string")
    return F.when(level.isin(*named), level).otherwise(OTHER)


def shares_of(tokens: np.ndarray, axis: int, named: Mapping[str, float]) -> np.ndarray:
    """Target shares of the named levels and, last, of ``other``."""
    left = 1 - sum(named.values())
    if left > CLOSE:
        return np.array([*named.values(), left])
    own = float(tokens.take(-1, axis=axis).sum() / max(tokens.sum(), 1))
    return np.array([*(x / sum(named.values()) * (1 - own) for x in named.values()), own])


def wanted(tokens: np.ndarray, targets: list[np.ndarray]) -> list[np.ndarray]:
    """``targets`` without the levels that have no tokens, each adding up to 1."""
    out = []
    for axis, target in enumerate(targets):
        there = tokens.sum(axis=tuple(k for k in range(tokens.ndim) if k != axis)) > 0
        target = np.where(there, target, 0.0)
        out.append(target / target.sum() if target.sum() > 0 else np.where(there, 1.0, 0.0) / max(there.sum(), 1))
    return out


def factors(tokens: np.ndarray, rate: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """For each row of cells the factor ``f`` at which ``sum(tokens * min(1, f * rate))`` is the row's goal.

    Cells reach 1 in the order of their rates; a row that cannot have its goal gets the factor at which all do.
    """
    order = np.argsort(-rate, axis=1, kind="stable")
    n, r = np.take_along_axis(tokens, order, 1), np.take_along_axis(rate, order, 1)
    weight = n * r
    full = np.cumsum(n, axis=1) - n  # tokens of the cells before, taken whole
    free = np.cumsum(weight[:, ::-1], axis=1)[:, ::-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        f = np.where(free > 0, (goal[:, None] - full) / free, np.inf)
        fits = f * r <= 1
    first = fits.argmax(axis=1)
    at = np.arange(len(goal))
    least = np.where(n > 0, r, np.inf).min(axis=1)
    most = np.where(np.isfinite(least) & (least > 0), 1 / np.where(least > 0, least, 1), 0.0)
    return np.where(fits.any(axis=1), np.maximum(f[at, first], 0.0), most)


def rake(tokens: np.ndarray, targets: list[np.ndarray], goal: float) -> tuple[np.ndarray, float]:
    """Probabilities of the cells, none above 1, that take ``goal`` tokens with the shares ``targets`` along each axis,
    as far as the cells allow, and by how much the worst share is off."""
    rate, best, since = np.where(tokens > 0, goal / max(tokens.sum(), 1), 0.0), (np.zeros_like(tokens), np.inf), 0
    for _ in range(ROUNDS):
        for axis, target in enumerate(targets):
            flat = lambda x: np.moveaxis(x, axis, 0).reshape(tokens.shape[axis], -1)  # noqa: B023, E731
            f = factors(flat(tokens), flat(rate), target * goal)
            rate = np.minimum(rate * f.reshape([-1 if k == axis else 1 for k in range(tokens.ndim)]), 1e9)
        taken = tokens * np.minimum(rate, 1.0)
        total = max(taken.sum(), 1e-300)
        off = max(float(np.abs(taken.sum(axis=tuple(k for k in range(tokens.ndim) if k != a)) / total - t).max(initial=0)) for a, t in enumerate(targets))
        off = max(off, 1 - total / goal if goal > 0 else 0.0)
        since = 0 if off < 0.999 * best[1] else since + 1
        if off < best[1]:
            best = np.minimum(rate, 1.0), off
        if off < CLOSE or since > 30:
            break
    return best


def reachable(tokens: np.ndarray, targets: list[np.ndarray], goal: float) -> list[np.ndarray]:
    """``targets`` with none beyond its level's tokens, if ``goal`` are taken; the others get what is left in proportion."""
    out = []
    for axis, target in enumerate(targets):
        most = tokens.sum(axis=tuple(k for k in range(tokens.ndim) if k != axis)) / goal
        capped = np.zeros(len(target), dtype=bool)
        share = target.copy()
        while (over := ~capped & (share > most)).any():
            capped |= over
            rest = target[~capped].sum()
            share = np.where(capped, most, target * (1 - most[capped].sum()) / rest if rest > 0 else 0.0)
        out.append(share)
    return out


def calibrated(tokens: np.ndarray, targets: list[np.ndarray], budget: float) -> tuple[np.ndarray, float]:
    """Probabilities that take ``budget`` of all tokens with the target shares, as far as these can be reached, and the worst miss."""
    goal = budget * tokens.sum()
    if not goal:
        return np.zeros_like(tokens), 0.0
    return rake(tokens, reachable(tokens, wanted(tokens, targets), goal), goal)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``topic`` and ``tokens``."""
    for name in ("topic", "tokens", "probability", "kept"):
        if name in docs.columns:
            raise ValueError(f"the table has a column {name} already")
    return docs.withColumns({"topic": topic_of(F.col("text")), "tokens": tokens_of(F.col("text"))})


def _cells(rows: DataFrame, targets: Mapping[str, Mapping[str, float]], *sums: Column) -> list:
    return rows.groupBy(*[levelled(F.col(m), targets[m]).alias(f"_{m}") for m in MARGINS]).agg(F.sum("tokens").alias("n"), *sums).collect()


def _table(counted: list, value: str, targets: Mapping[str, Mapping[str, float]]) -> np.ndarray:
    """The values by cell."""
    levels = [[*targets[m], OTHER] for m in MARGINS]
    out = np.zeros([*map(len, levels)])
    for r in counted:
        out[tuple(x.index(r[f"_{m}"]) for x, m in zip(levels, MARGINS, strict=True))] = r[value]
    return out


def taken(doc_id: Column, probability: Column, seed: int) -> Column:
    """Whether the draw of a document, of 53 bits, is below its probability."""
    draw = F.pmod(F.xxhash64(F.coalesce(doc_id.cast("long"), F.lit(0).cast("long")), F.lit(seed)), F.lit(2**53)) / F.lit(2.0**53)
    return draw < probability


def weighed(rows: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS, budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """``rows``, as from :func:`measured`, with ``probability`` and ``kept``."""
    tokens = _table(_cells(rows, targets), "n", targets)
    p, _ = calibrated(tokens, [shares_of(tokens, k, targets[m]) for k, m in enumerate(MARGINS)], budget)
    levels = [[*targets[m], OTHER] for m in MARGINS]
    table_ = rows.sparkSession.createDataFrame(
        [(*(x[i] for x, i in zip(levels, at, strict=True)), float(p[at])) for at in np.ndindex(p.shape)], ", ".join(f"_{m} string" for m in MARGINS) + ", probability double"
    )
    # The table of cells is bounded by the targets.
    packed = rows.select(F.struct(*rows.columns).alias("row"), *[levelled(F.col(m), targets[m]).alias(f"_{m}") for m in MARGINS])
    found = packed.join(F.broadcast(table_), [f"_{m}" for m in MARGINS])
    return found.select("row.*", "probability", taken(F.col("row.doc_id"), F.col("probability"), seed).alias("kept"))


def mixed(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS, budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """``docs`` with ``topic, tokens, probability, kept``."""
    return weighed(measured(docs), targets, budget, seed)


def report(found: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """``margin, level, target, reachable, expected, kept``: the wanted share of tokens, what of it the level's tokens allow,
    the share by probabilities, and the one taken."""
    counted = _cells(found, targets, F.sum(F.col("tokens") * F.col("probability")).alias("expected"), F.sum(F.when(F.col("kept"), F.col("tokens")).otherwise(0)).alias("kept"))
    tables = {name: _table(counted, name, targets) for name in ("n", "expected", "kept")}
    want = wanted(tables["n"], [shares_of(tables["n"], k, targets[m]) for k, m in enumerate(MARGINS)])
    can = reachable(tables["n"], want, max(budget * tables["n"].sum(), 1e-300))
    out = []
    for k, m in enumerate(MARGINS):
        along = {name: x.sum(axis=tuple(a for a in range(3) if a != k)) / max(x.sum(), 1e-300) for name, x in tables.items()}
        out += [(m, level, float(want[k][i]), float(can[k][i]), float(along["expected"][i]), float(along["kept"][i])) for i, level in enumerate([*targets[m], OTHER])]
    return found.sparkSession.createDataFrame(out, "margin string, level string, target double, reachable double, expected double, kept double")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are read once; their topics and counts of tokens are written for the two passes that need them."""
    rows = measured(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text")
    return weighed(written(rows, "measured")).select("doc_id", "topic", "tokens", "probability", "kept")
