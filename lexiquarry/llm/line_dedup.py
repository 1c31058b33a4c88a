"""Removal of multi-line passages that repeat across documents.

A text is cut into chunks between words, by content alone. A paragraph (a line of the text) of two sentences
or ``LONG`` words or more is cut on its own; shorter lines are cut together, so that hard-wrapped text is as
good as flowing text. Inside, the text is cut where the hash of the words on both sides is the least of all
within ``REACH`` words, so that chunks have ``LEAST_WORDS`` words or more, about 11 in the mean, and a passage has
the same chunks wherever it stands, but for those at its two ends. Chunks of two sentences or ``LEAST_WORDS``
words or more that occur more than once are found, but for the first occurrence in the document with the
smallest doc_id; runs of adjacent ones are removed if they have ``RUN_WORDS`` words or more, or two lines with words, so
that a phrase that many texts share stays in its sentence.

Byte comparison: chunks are found by hash; the texts of those that occur more than once are then compared,
combined before they are shuffled, and a hash that has two texts is left alone.

Cases: null and empty texts stay as they are; white space inside a chunk counts; a chunk that repeats
inside one document only is removed there too after its first place; rows that share a doc_id are one
document; rows without doc_id lose the chunks that a document with one keeps, and keep those that only such rows have; words are what stands between white
space, so text without any is one chunk; an empty table gives an empty result; other columns stay, and a
column that has the name of a result column is an error that names it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiquarry.llm.shared import give_back, table, unwritten, written

#: Words on each side among which a cut has the least hash.
REACH = 5
#: A chunk of so many words, or of so many lines or sentences, can be removed; no cut leaves fewer words.
LEAST_WORDS, LEAST_LINES = 6, 2
#: A line of so many words is cut on its own.
LONG = 20
#: Words that adjacent repeated chunks on fewer than ``LEAST_LINES`` lines must have together to be removed.
RUN_WORDS = 13
#: Bytes that are worked on together.
TOGETHER = 400_000
#: Share of the rows from which a hash is told by a broadcast.
FREQUENT = 0.002

_SPACE, _STOP = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP[[*b".!?"]] = True
#: Factors of the hash of a word, and of those of two neighbours.
_ODD, _LEFT, _RIGHT = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BACK = np.uint64(pow(int(_ODD), -1, 2**64))

_LINE = re.compile(r"[^\n.!?]*(?:[.!?]+(?!\s)[^\n.!?]*)*[.!?]*[ \t]*\n?")


def lines_of(text: str) -> list[str]:
    """Lines and sentences with the white space after them; joined they are ``text``."""
    return [x for x in _LINE.findall(text) if x]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _cuts(hard: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """The words that begin a chunk: those that begin a part (``hard``) and the least of ``mixed`` around."""
    n = len(mixed)
    begin = np.flatnonzero(hard)
    size = np.diff(np.append(begin, n))
    since = np.arange(n) - np.repeat(begin, size)
    free = (since >= LEAST_WORDS) & (np.repeat(size, size) - since >= LEAST_WORDS)
    mixed = np.where(free, mixed, np.uint64(2**64 - 1))
    for d in range(1, REACH + 1):
        free[:-d] &= mixed[:-d] <= mixed[d:]
        free[d:] &= mixed[d:] <= mixed[:-d]
    at = np.flatnonzero(free | hard)
    close = np.diff(at) < LEAST_WORDS
    if (close & free[at[1:]] & free[at[:-1]]).any():  # equal hashes, as in words that repeat
        kept, last = [], -1
        for k in at.tolist():
            if hard[k] or k - last >= LEAST_WORDS:
                kept.append(k)
                last = k
        at = np.array(kept)
    return at


def chunks_of_all(texts: list[bytes]) -> Iterator[list[tuple[bytes, int]]]:
    """For each text its chunks and their sizes in lines; joined they are the text."""
    raw = b"\n".join(texts) + b"\n"
    c = np.frombuffer(raw, dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[c]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    start, stop = edge[::2], edge[1::2]
    n = len(start)
    first = np.searchsorted(start, np.concatenate(([0], ends)))  # the first word of each text
    if n:
        prefix = np.concatenate(([np.uint64(0)], np.cumsum((c.astype(np.uint64) + np.uint64(1)) * _powers(_ODD, len(c)), dtype=np.uint64)))
        word = (prefix[stop] - prefix[start]) * _powers(_BACK, len(c))[start]
        word ^= word >> np.uint64(32)
        mixed = word * _RIGHT
        mixed[1:] += word[:-1] * _LEFT
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD
        mixed ^= mixed >> np.uint64(32)
        line = np.searchsorted(start, np.flatnonzero(c == 10))  # the words that follow a line break
        opens = np.zeros(n + 1, dtype=bool)
        opens[line] = opens[0] = True
        opens = opens[:-1]
        closes = np.append(opens[1:], True)
        sentence = (_STOP[c[stop - 1]] | closes).astype(np.int64)
        begin = np.flatnonzero(opens)
        own = (np.add.reduceat(sentence, begin) >= LEAST_LINES) | (np.diff(np.append(begin, n)) >= LONG)
        hard = np.zeros(n, dtype=bool)
        hard[begin] = own | np.concatenate(([True], own[:-1]))
        hard[first[first < n]] = True
        at = _cuts(hard, mixed)
        inside = np.add.reduceat(sentence, at)
        last = np.append(at[1:], n) - 1
        inside += sentence[last] == 0
        lines = np.maximum(inside, np.diff(np.append(at, n)) * LEAST_LINES // LEAST_WORDS)
        where, lines = start[at].tolist(), lines.tolist()
        chunk = np.searchsorted(at, first).tolist()
    for k, text in enumerate(texts):
        lo, hi = (chunk[k], chunk[k + 1]) if n else (0, 0)
        if lo == hi:
            yield [(text, 1)] if text else []
            continue
        base = int(ends[k]) - len(text) - 1
        cut = [0, *(x - base for x in where[lo + 1 : hi]), len(text)]
        yield [(text[i:j], m) for i, j, m in zip(cut, cut[1:], lines[lo:hi], strict=False)]


def chunks_of(text: str) -> list[tuple[str, int]]:
    """The chunks of ``text`` and their numbers of lines; joined they are ``text``.

    A line is a line, a sentence or half of ``LEAST_WORDS`` words, whichever gives more.
    """
    (found,) = chunks_of_all([text.encode("utf-8", "surrogatepass")])
    return [(c.decode("utf-8", "surrogatepass"), n) for c, n in found]


def _key(chunk: bytes) -> int:
    return int.from_bytes(blake2b(chunk.strip(), digest_size=8).digest(), "little", signed=True)


def _keyed(chunks: list[tuple[bytes, int]]) -> list[tuple[bytes, int | None]]:
    """Chunks with the keys of those that can be removed."""
    return [(c, _key(c) if n >= LEAST_LINES and c.strip() else None) for c, n in chunks]


def _slices(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None], Iterator[list[tuple[bytes, int | None]]]]]:
    """Rows whose texts have about ``TOGETHER`` bytes, their texts, and the keyed chunks of each."""
    for batch in batches:
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size.astype(np.int64) + 1) // TOGETHER
        for k in np.unique(part):
            at = np.flatnonzero(part == k)
            rows = batch.slice(int(at[0]), len(at))
            texts = rows.column(text_at).cast(pa.binary()).to_pylist()
            yield rows, texts, map(_keyed, chunks_of_all([t or b"" for t in texts]))
    give_back()


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunk hashes of each document, those that it has more than once twice, without texts."""
    for rows, _, chunks in _slices(batches, 2):
        ids, of, keys = [], [], []
        for i, named, own in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), chunks, strict=True):
            count = Counter(key for _, key in own if key is not None)
            twice = [key for key, n in count.items() if n > 1]
            ids += [i] * (len(count) + len(twice))
            of += [named] * (len(count) + len(twice))
            keys += count.keys()
            keys += twice
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(of, pa.bool_()), pa.array(keys, pa.int64())], names=["id", "named", "h"])


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes that are a ``FREQUENT`` share of the rows read together, and how often they are."""
    for batch in batches:
        h, n = np.unique(batch.column(0).to_numpy(), return_counts=True)
        at = n >= max(2, FREQUENT * batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(h[at], pa.int64()), pa.array(n[at], pa.int64())], names=["h", "n"])


def repeated_chunks(found: DataFrame) -> DataFrame:
    """``id, named, h, keeps`` of the occurrences ``found (id, named, h)`` of hashes that occur more than once.

    A hash with twice a ``FREQUENT`` share of all rows has that share in some rows that are read together and
    is found by these alone; there are fewer than ``1 / FREQUENT`` such hashes. Their rows are counted before they
    are shuffled, and told by a broadcast; all others are dealt by hash, once.
    """
    total = found.count()
    often = found.select("h").mapInArrow(_often, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT * total).select("h")
    often = written(often, "often")
    first = F.min(F.when(F.col("named"), F.col("id")))
    few = found.join(F.broadcast(often), "h").groupBy("h").agg(F.count("*").alias("n"), first.alias("keeper")).where("n > 1")
    hot = found.join(F.broadcast(few), "h").select("id", "named", "h", "keeper")
    by = W.partitionBy("h")
    rest = found.join(F.broadcast(often), "h", "left_anti").select("id", "named", "h", F.count("*").over(by).alias("n"), first.over(by).alias("keeper")).where("n > 1").drop("n")
    return hot.unionByName(rest).select("id", "named", "h", (F.col("keeper").isNull() | (F.col("named") & (F.col("id") == F.col("keeper")))).alias("keeps"))


REMOVED = T.StructType([T.StructField("removed_chunks", T.LongType()), T.StructField("removed_chars", T.LongType())])
_SEEN = T.StructField("seen", T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("chunk", T.BinaryType())])))
_PIECE = pa.list_(pa.struct([("h", pa.int64()), ("chunk", pa.binary())]))


def passages(chunks: list[bytes], repeated: list[bool]) -> list[bool]:
    """Which of the repeated chunks are in a run that is long enough to go."""
    out, k = list(repeated), 0
    for repeats, run in groupby(zip(repeated, chunks, strict=True), key=lambda x: x[0]):
        own = [c for _, c in run]
        if repeats:
            text = b"".join(own)
            if len(text.split()) < RUN_WORDS and sum(bool(x.strip()) for x in text.split(b"\n")) < LEAST_LINES:
                out[k : k + len(own)] = [False] * len(own)
        k += len(own)
    return out


def _drop(columns: list[str], text_at: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows without the marked chunks, and the texts of all marked ones, each once in what is read together."""
        for rows, whole, chunks in _slices(batches, text_at):
            texts, cut, size, seen = [], [], [], []
            told: set[tuple[int, bytes]] = set()
            for text, goes, pieces in zip(whole, rows.column(width).to_pylist(), chunks, strict=True):
                own = {g["h"]: g["keeps"] for g in goes or ()}
                here: set[int | None] = set()
                new, repeated = [], []
                all_ = list(pieces) if own else []
                for chunk, key in all_:
                    if key in own:
                        piece = (key, chunk.strip())
                        if piece not in told:
                            told.add(piece)
                            new.append({"h": key, "chunk": piece[1]})
                    repeated.append(key in own and (not own[key] or key in here))
                    here.add(key)
                goes_ = passages([c for c, _ in all_], repeated)
                n = sum(goes_)
                kept = [c for (c, _), out in zip(all_, goes_, strict=True) if not out]
                left = b"".join(kept) if n else text
                texts.append(left)
                cut.append(n)
                size.append(len(text.decode()) - len(left.decode()) if n else 0)
                seen.append(new)
            own = [*rows.columns[:width]]
            own[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*own, pa.array(cut, pa.int64()), pa.array(size, pa.int64()), pa.array(seen, _PIECE)], names=columns)

    return run


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks cut from ``text``, and how many chunks and characters went."""
    for name in REMOVED.fieldNames():
        if name in docs.columns:
            raise ValueError(f"the table has a column {name} already")
    text_at, width = docs.columns.index("text"), len(docs.columns)
    names = [f"c{k}" for k in range(width)]
    # Rows without doc_id go by their texts.
    named, own_id = F.col("doc_id").isNotNull(), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))
    found = docs.select(own_id.alias("id"), named.alias("named"), F.col("text").cast("string")).mapInArrow(_occurrences, "id long, named boolean, h long")
    found = written(found, "chunks")
    whole = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], own_id.alias("_id"), named.alias("_named"))
    schema = T.StructType([*[T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)], *REMOVED.fields, _SEEN])
    repeated, unlike = repeated_chunks(found), []
    while True:
        # At most as many marks as the document has chunks.
        marks = repeated.groupBy(F.col("id").alias("of"), F.col("named").alias("of_named")).agg(F.collect_set(F.struct("h", "keeps")).alias("goes"))
        joined = whole.join(marks.hint("merge"), (F.col("_id") == F.col("of")) & (F.col("_named") == F.col("of_named")), "left").select(*names, "goes")
        cleaned = written(joined.mapInArrow(_drop(schema.fieldNames(), text_at, width), schema), "cleaned", compression="zstd")
        # The byte comparison: a hash whose texts differ is left alone, and the work done again.
        pieces = cleaned.select(F.explode("seen").alias("s")).groupBy("s.h").agg(F.min("s.chunk").alias("least"), F.max("s.chunk").alias("most"))
        differ = written(pieces.where("least <> most").select("h"), "differ")
        if differ.isEmpty():
            break
        unlike.append(differ)
        unwritten(cleaned)
        repeated = repeated.join(differ, "h", "left_anti")
    for done in (found, differ, *unlike):
        unwritten(done)
    return cleaned.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)], *REMOVED.fieldNames())


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "removed_chunks", "removed_chars", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
