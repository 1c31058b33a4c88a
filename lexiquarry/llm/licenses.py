"""Licence scans: sparse TF-IDF cosine to templates, then inheritance along directories.

A text is cut into lines and sentences, and into paragraphs (lines without one that is blank or has no words between
them), so that a wrapped licence text is seen whole. Each is a sparse TF-IDF vector of its words and compared with the
passages of licence templates. Document frequencies are counted over all texts: of each word of a template, and of
all other words in ``BUCKETS`` hashed buckets. Weights follow from the share of documents, ``1 + log((1 + RARE) / (share
+ RARE))``, so they do not depend on how many documents there are.

A passage is like a template from a cosine of ``CLOSE`` on, if both have the same of the words that tell licences apart
(names, versions). A document's own licence is the one with the highest cosine. A licence file, known by its name or
by licence passages making up ``FILE_SHARE`` of its characters, speaks for its directory; a file without a licence of
its own takes that of the nearest ancestor directory that has one, found by joining the directories above each path.

Cases: null and empty texts have no licence of their own; a null path has no directories; of several licence
files in a directory the closest counts, then the first name; ties between templates go to the first
name, but to the licence that has the other's text in it; rows that share a path are single files; an empty table
gives an empty result; other columns stay, and a column that has the name of a result column is an error that names it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiquarry.llm.license_texts import HOLDS, PASSAGES, SPDX, TELLING
from lexiquarry.llm.line_dedup import lines_of
from lexiquarry.llm.shared import dealt_join, table, written

CLOSE, FILE_SHARE = 0.6, 0.25
#: Share of documents at which a word counts as rare, and the buckets of words that no template has.
RARE, BUCKETS = 1e-3, 2**16
#: Chunks whose words a worker keeps.
KEPT = 200_000
_WORD = regex.compile(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*")
_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"
_TELLING = frozenset(TELLING)

#: Each licence's passages, with the declaration by identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    name: (*passages, *(f"SPDX-License-Identifier: {x}" for x in ((name, *SPDX.get(name, ())) if name != "proprietary" else ()))) for name, passages in PASSAGES.items()
}


class _Words(dict):
    """The words of what stands between white space."""

    def __missing__(self, chunk: str) -> tuple[str, ...]:
        if len(self) >= KEPT:
            self.clear()
        value = self[chunk] = tuple(_WORD.findall(chunk))
        return value


_WORDS = _Words()


def words_of(text: str) -> list[str]:
    return [w for chunk in text.lower().split() for w in _WORDS[chunk]]


def vocabulary_of(templates: Mapping[str, Sequence[str]]) -> dict[str, int]:
    """The words of the templates, numbered; the buckets of other words follow."""
    return {w: k for k, w in enumerate(sorted({w for passages in templates.values() for t in passages for w in words_of(t)}))}


def place_of(word: str, vocabulary: Mapping[str, int]) -> int:
    return vocabulary[word] if word in vocabulary else len(vocabulary) + crc32(word.encode("utf-8", "replace")) % BUCKETS


def _documents_with(vocabulary: Mapping[str, int]):
    class Places(dict):
        """Where the words of a chunk are counted."""

        def __missing__(self, chunk: str) -> tuple[int, ...]:
            if len(self) >= KEPT:
                self.clear()
            value = self[chunk] = tuple(place_of(w, vocabulary) for w in _WORD.findall(chunk))
            return value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many documents hold a word of each place, and (last) how many there are."""
        total, places = np.zeros(len(vocabulary) + BUCKETS + 1, dtype=np.int64), Places()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for text in batch.column(0).slice(at, 500).to_pylist():
                    total[-1] += 1
                    own = set().union(*map(places.__getitem__, set((text or "").lower().split())))
                    total[np.fromiter(own, dtype=np.int64, count=len(own))] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["place", "n"])

    return run


def document_shares(docs: DataFrame, vocabulary: Mapping[str, int]) -> np.ndarray:
    """The share of documents that hold a word of each place; the places are bounded by templates and buckets."""
    rows = docs.select(F.col("text").cast("string")).mapInArrow(_documents_with(vocabulary), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(vocabulary) + BUCKETS + 1)
    total[rows.column("place").to_numpy()] = rows.column("n").to_numpy()
    return total[:-1] / max(total[-1], 1)


class _Known(dict):
    """The template words of a chunk, by number."""

    def __init__(self, number: Mapping[str, int]):
        self.number = number

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if len(self) >= KEPT:
            self.clear()
        value = self[chunk] = tuple(self.number[w] for w in _WORD.findall(chunk) if w in self.number)
        return value


def paragraphs_of(lines: Sequence[str]) -> list[list[str]]:
    """Runs of lines and sentences that hold a word."""
    out: list[list[str]] = [[]]
    for line in lines:
        if any(map(str.isalnum, line)):
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return out if out[-1] else out[:-1]


class Matcher:
    """Cosines of passages to the templates."""

    def __init__(self, templates: Mapping[str, Sequence[str]], vocabulary: Mapping[str, int], shares: np.ndarray):
        self.vocabulary = vocabulary
        self.idf = (1 + np.log((1 + RARE) / (np.minimum(shares, 1) + RARE))).astype(np.float32)
        self.names, self.telling = [], []
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for name in sorted(templates):
            for passage in templates[name]:
                weights = self.weights(words_of(passage))
                size = math.sqrt(sum(x * x for x in weights.values()))
                for w, x in weights.items():
                    self.postings.setdefault(w, []).append((len(self.names), x / size))
                self.names.append(name)
                self.telling.append(_TELLING & weights.keys())
        # A cosine is at most the root of what the shared words make of the template's own length.
        number = {w: k for k, w in enumerate(self.postings)}
        self.squares = np.zeros((len(number), len(self.names)), dtype=np.float32)
        for w, found in self.postings.items():
            for k, u in found:
                self.squares[number[w], k] = u * u
        self.most = [float(x) for x in self.squares.max(axis=1, initial=0.0)]
        self.known = _Known(number)

    def weights(self, words: Sequence[str]) -> dict[str, float]:
        count: dict[str, int] = {}
        for w in words:
            count[w] = count.get(w, 0) + 1
        return {w: n * float(self.idf[place_of(w, self.vocabulary)]) for w, n in count.items()}

    def best(self, words: Sequence[str]) -> tuple[str | None, float]:
        """The closest licence that has the same telling words, and its cosine; none below ``CLOSE``."""
        weights = self.weights(words)
        size = math.sqrt(sum(x * x for x in weights.values()))
        cosine: dict[int, float] = {}
        for w, x in weights.items():
            for k, u in self.postings.get(w, ()):
                cosine[k] = cosine.get(k, 0.0) + x * u / size
        found, top, telling = None, 0.0, _TELLING & weights.keys()
        for k, c in sorted(cosine.items()):
            if c >= CLOSE - 1e-9 and c > top + 1e-12 and self.telling[k] == telling:
                found, top = self.names[k], c
        return found, top

    def may_match(self, chunks: set[str]) -> bool:
        """Whether a passage of these chunks could reach ``CLOSE`` with any template."""
        words, least = set().union(*map(self.known.__getitem__, chunks)), CLOSE * CLOSE - 1e-6
        if sum(map(self.most.__getitem__, words)) < least:
            return False
        return bool(self.squares[list(words)].sum(axis=0).max(initial=0.0) >= least)

    def scan(self, text: str | None) -> tuple[str | None, float, float]:
        """The licence of a text, its cosine, and the share of its characters in licence passages."""
        inside, text = 0, (text or "").lower()
        top: dict[str, float] = {}
        if not self.may_match(set(text.split())):  # then no part of it does
            return None, 0.0, 0.0

        def match(passage: str) -> int:
            if not self.may_match(set(passage.split())):
                return 0
            name, cosine = self.best(words_of(passage))
            if name is None:
                return 0
            top[name] = max(top.get(name, 0.0), cosine)
            return len(passage)

        for lines in paragraphs_of(lines_of(text)):
            passage = "".join(lines)
            if self.may_match(set(passage.split())):
                apart = sum(map(match, lines))
                inside += match(passage) or apart
        for name, held in HOLDS.items():
            if name in top:
                top[name] = max(top[name], top.pop(held, 0.0))
        if not top:
            return None, 0.0, 0.0
        high = max(top.values())
        found = min(name for name, cosine in top.items() if cosine >= high - 1e-12)
        return found, top[found], inside / len(text)


OWN = T.StructType([T.StructField("own_license", T.StringType()), T.StructField("similarity", T.DoubleType()), T.StructField("license_share", T.DoubleType())])
RESULT = ("own_license", "similarity", "license_share", "license", "license_from")


def scan(docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES) -> DataFrame:
    """``docs`` with the licence that each text itself declares."""
    vocabulary = vocabulary_of(templates)
    matcher = Matcher(templates, vocabulary, document_shares(docs, vocabulary))
    n = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                found = [matcher.scan(t) for t in rows.column(n).to_pylist()]
                made = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*rows.columns, *made], names=[*rows.schema.names, *OWN.fieldNames()])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *OWN.fields]))


def _above(path: str):
    """The directories above a path, nearest last; the root is the empty string."""
    parts = f"split({path}, '/')"
    return F.expr(f"transform(sequence(0, size({parts}) - 1), k -> array_join(slice({parts}, 1, k), '/'))")


def licenses(docs: DataFrame, path_col: str = "path", templates: Mapping[str, Sequence[str]] = TEMPLATES) -> DataFrame:
    """``docs (…, text, path)`` less the text, with own and inherited licences.

    ``license`` is the own licence or the inherited one; ``license_from`` is ``own``, the directory that
    gave it, or null.
    """
    for name in RESULT:
        if name in docs.columns:
            raise ValueError(f"the table has a column {name} already")
    columns = [c for c in docs.columns if c != "text"]
    found = scan(docs, templates).select(F.struct(*columns).alias("row"), F.col(path_col).alias("path"), *OWN.fieldNames())
    found = written(found, "licenses")
    folder = F.element_at(_above("path"), -1)
    named = F.col("path").rlike(_NAME)
    speaks = found.where(F.col("own_license").isNotNull() & F.col("path").isNotNull() & (named | (F.col("license_share") >= FILE_SHARE)))
    given = (
        speaks.select(folder.alias("dir"), "own_license", "similarity")
        .groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("far"), "own_license")).alias("best"))
        .select("dir", F.col("best.own_license").alias("given"))
    )
    # A path needs its distinct directory only; each directory looks at the directories above it once.
    placed = found.withColumn("folder", F.when(F.col("path").isNotNull(), folder))
    dirs = placed.where("folder is not null").groupBy("folder").agg(F.count("*").alias("files"))
    above = dirs.withColumn("dir", F.explode(F.array_distinct(F.array_append(_above("folder"), F.col("folder")))))
    # Every directory looks at the root; what many look at is not dealt to one task.
    under = above.groupBy("dir").agg(F.count("*").alias("under"))
    given = written(given.join(under, "dir"), "given")
    looks = given.agg(F.sum("under")).first()[0] or 0
    nearest = dealt_join(above, given, "dir", "under", looks).groupBy("folder", "files").agg(F.max(F.struct(F.length("dir").alias("depth"), "dir", "given")).alias("near")).select("folder", "files", F.col("near.dir").alias("near_dir"), F.col("near.given").alias("given"))
    nearest = written(nearest, "nearest")
    joined = dealt_join(placed, nearest, "folder", "files", found.count(), "left")
    origin = F.when(F.col("own_license").isNotNull(), "own").otherwise(F.col("near_dir"))
    return joined.select("row.*", *OWN.fieldNames(), F.coalesce("own_license", "given").alias("license"), origin.alias("license_from"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: ``source/lang/hundred of ids/id``."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", (F.floor(F.col("doc_id") / 100)).cast("string"), F.col("doc_id").cast("string"))
    found = licenses(docs.select("doc_id", "text", path.alias("path")))
    return found.select("doc_id", "path", "own_license", F.round("similarity", 9).alias("similarity"), "license", "license_from")
