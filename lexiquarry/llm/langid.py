"""Language mixtures of documents by expectation-maximisation.

Character trigrams of all learning texts are counted by language. A document is a mixture: each of its
words comes from one language with that language's n-gram likelihood, and the shares of the languages are
estimated by expectation-maximisation until no share moves by ``STILL`` (``ROUNDS`` rounds at most, which only
documents of nearly equal languages need). Sets of languages (the largest share alone, the two largest, and so on to
all) are fitted again and compared by likelihood less ``PENALTY * log(words) / 2`` a language; the best set
gives the shares, and its largest share the predicted language. A set is not tried if the language that it adds
has less than half a word of the document, which no penalty would pay for.

Learning takes at most ``LANGUAGES`` languages, as each is a table of ``GRAMS`` numbers on the driver and in each
task; more are an error that tells so.

Cases: null texts and texts without letters are ``und`` with score 0; without any learning text all are
``und``; ties go to the language first in order; texts are taken whole; repeated rows get equal results; an
empty table gives an empty result; a null doc_id is never learned from; an input column with the name of a
result column is an error that names it.
"""

from __future__ import annotations

import base64
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiquarry.llm.shared import give_back, table

UNKNOWN = "und"
PENALTY = 4.0
#: A trigram is three classes of 6 bits: a gap, 26 letters, and 37 classes of bytes beyond ASCII.
CLASS_BITS = 6
GRAMS = 2 ** (3 * CLASS_BITS)
#: Characters that are worked on together.
CHUNK = 400_000
ROUNDS, STILL = 60, 1e-3
#: Languages that are learned, at most.
LANGUAGES = 256

_CLASS = np.zeros(256, dtype=np.int32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:256] = 27 + np.arange(128) % 37


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigram of every position of the texts laid end to end, and where each text starts."""
    raw = [b" " + t.lower().encode("utf-8", "replace") + b"  " for t in texts]
    c = _CLASS[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    gram = np.zeros(len(c), dtype=np.int32)
    if len(c) > 2:
        gram[:-2] = (c[:-2] << (2 * CLASS_BITS)) | (c[1:-1] << CLASS_BITS) | c[2:]
    return gram, np.concatenate(([0], np.cumsum([len(r) for r in raw])))


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of each language over what the task reads."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        texts = batch.column(1)
        for lang in sorted(set(langs.tolist())):
            own = texts.take(pa.array(np.flatnonzero(langs == lang))).to_pylist()
            if lang not in total:
                total[lang] = np.zeros(GRAMS, dtype=np.int64)
            for i, j in _chunks(own):
                total[lang] += np.bincount(_codes(own[i:j])[0], minlength=GRAMS)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "gram", "n"])
    total.clear()
    give_back()


def _fit(pi: np.ndarray, p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The shares of the languages in documents of ``size`` words with likelihoods ``p``, from ``pi`` on."""
    pi, moving = pi.copy(), np.arange(len(pi))
    for _ in range(ROUNDS):
        first = np.cumsum(size) - size
        r = p * np.repeat(pi[moving].astype(np.float32), size, axis=0)
        r /= r.sum(axis=1, keepdims=True)
        new = np.add.reduceat(r, first, axis=0) / size[:, None]
        still = np.abs(new - pi[moving]).max(axis=1) < STILL
        pi[moving] = new
        if still.all():
            break
        if still.mean() > 0.3:  # go on with the others
            p, moving, size = p[np.repeat(~still, size)], moving[~still], size[~still]
    return pi


class Model:
    """Log-likelihoods of trigrams given the two characters before, by language."""

    def __init__(self, langs: list[str], logp: np.ndarray):
        self.langs, self.logp = langs, logp

    @classmethod
    def from_counts(cls, langs: list[str], counts: np.ndarray) -> Model:
        """``counts``: languages x trigrams."""
        grams = counts.reshape(len(langs), 4**CLASS_BITS, 2**CLASS_BITS).astype(np.float64)
        letters = counts.reshape(len(langs), 4**CLASS_BITS, 2**CLASS_BITS).sum(axis=1) + 1.0
        prior = letters / letters.sum(axis=1, keepdims=True)
        logp = np.log((grams + 2.0 * prior[:, None, :]) / (grams.sum(axis=2, keepdims=True) + 2.0))
        return cls(langs, np.ascontiguousarray(logp.reshape(len(langs), GRAMS).T, dtype=np.float32))

    def to_text(self) -> str:
        out = io.BytesIO()
        np.savez_compressed(out, langs=np.array(self.langs), logp=self.logp)
        return base64.b64encode(out.getvalue()).decode()

    @classmethod
    def from_text(cls, text: str) -> Model:
        with np.load(io.BytesIO(base64.b64decode(text))) as z:
            return cls([str(x) for x in z["langs"]], z["logp"])

    def shares(self, texts: list[str]) -> np.ndarray:
        """For each text the share of each language, zero outside the selected set; zeros without words."""
        n, width = len(texts), len(self.langs)
        out = np.zeros((n, width))
        gram, start = _codes(texts)
        letter = (gram >> CLASS_BITS) & (2**CLASS_BITS - 1) > 0  # the middle character
        begins = np.flatnonzero(letter & ((gram >> (2 * CLASS_BITS)) == 0))
        if not len(begins):
            return out
        like = self.logp[gram]
        like[~letter] = 0
        ll = np.add.reduceat(like, begins, axis=0)
        doc = np.searchsorted(start, begins, side="right") - 1
        there, first = np.unique(doc, return_index=True)
        size = np.diff(np.append(first, len(doc))).astype(np.float64)
        p = np.exp(ll - ll.max(axis=1, keepdims=True)).astype(np.float32) + np.float32(1e-20)
        of = np.repeat(np.arange(len(there)), size.astype(np.int64))

        def likelihood(pi: np.ndarray) -> np.ndarray:
            return np.add.reduceat(np.log((p * pi[of].astype(np.float32)).sum(axis=1)), first)

        full = _fit(np.full((len(there), width), 1 / width), p, size.astype(np.int64))
        order = np.argsort(-full, axis=1, kind="stable")
        chosen = np.zeros_like(full)
        np.put_along_axis(chosen, order[:, :1], 1.0, 1)
        top = likelihood(chosen)
        for k in range(2, width + 1):
            held = np.take_along_axis(full, order[:, :k], 1)
            some = np.flatnonzero(held[:, -1] * size >= 0.5)
            if not len(some):
                break
            inside = np.zeros((len(some), width))
            np.put_along_axis(inside, order[some, :k], held[some], 1)
            words = np.isin(of, some)
            pi = np.zeros_like(full)
            pi[some] = _fit(inside / inside.sum(axis=1, keepdims=True), p[words], size[some].astype(np.int64))
            value = np.full(len(there), -np.inf)
            value[some] = likelihood(np.where(pi > 0, pi, 1e-30))[some] - PENALTY * (k - 1) * np.log(size[some] + 1) / 2
            better = value > top
            chosen[better], top[better] = pi[better], value[better]
        out[there] = chosen
        return out


def train(rows: DataFrame) -> Model:
    """The model of ``rows (lang, text)``: trigram counts over all of them.

    What comes to the driver has at most ``GRAMS`` rows a language.
    """
    rows = rows.where("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    many = rows.select("lang").distinct().limit(LANGUAGES + 1).count()
    if many > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn; name fewer in the column lang")
    counted = rows.mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang = np.array(counted.column("lang").to_pylist(), dtype=object)
    langs = sorted(set(lang.tolist()))
    counts = np.zeros((len(langs), GRAMS), dtype=np.int64)
    gram, n = counted.column("gram").to_numpy(), counted.column("n").to_numpy()
    for i, name in enumerate(langs):
        counts[i, gram[lang == name]] = n[lang == name]
    return Model.from_counts(langs, counts)


_LOADED: dict[int, Model] = {}


def _loaded(shipped, key: int) -> Model:
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Model.from_text(shipped.value)
    return _LOADED[key]


FOUND = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("lang_shares", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


def detect(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, its share ``score`` and the shares of all selected languages."""
    for name in FOUND.fieldNames():
        if name in df.columns:
            raise ValueError(f"the table has a column {name} already")
    n = df.columns.index(text_col)
    text = model.to_text()
    shipped, key = df.sparkSession.sparkContext.broadcast(text), hash(text)  # languages x GRAMS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _loaded(shipped, key)
        for batch in batches:
            size = pa.compute.fill_null(pa.compute.binary_length(batch.column(n)), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(size) // CHUNK
            for k in np.unique(part):
                at = np.flatnonzero(part == k)
                rows = batch.slice(int(at[0]), len(at))
                texts = [t or "" for t in rows.column(n).to_pylist()]
                pred, score, shares = [], [], []
                for t, s in zip(texts, own.shares(texts) if own.langs else np.zeros((len(texts), 0)), strict=True):
                    best = int(np.argmax(s)) if len(s) else -1
                    known = best >= 0 and s[best] > 0 and any(map(str.isalpha, t))
                    pred.append(own.langs[best] if known else UNKNOWN)
                    score.append(min(1.0, float(s[best])) if known else 0.0)
                    shares.append([(own.langs[i], float(s[i])) for i in np.flatnonzero(s)] if known else [])
                made = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*rows.columns, *made], names=[*rows.schema.names, *FOUND.fieldNames()])
        give_back()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *FOUND.fields]))


def remainder(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = train(docs.where(~held_out).select("lang", "text"))
    found = detect(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), "lang_pred", "score")
