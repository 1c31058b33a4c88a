"""Exact duplicates of an incoming batch against an immutable snapshot, and within either.

The digests of a snapshot are dealt in shards by hash, and each shard gets a static 3-wise binary-fuse
filter (9 to 10 bits a digest) that is written with the snapshot's digests and never changed, as the snapshot is
not; later batches use it again. Incoming digests probe the filter of their shard. Those that fail it are new for certain; those that pass join the snapshot's exact
digest buckets. Duplicates inside the batch, and inside the snapshot, are grouped by digest apart from that.

Rows of digests that occur more than once are compared byte for byte: they are grouped by digest and text.
Only their texts take part; the rest of the work moves digests. A group's rows are combined before they
are shuffled, so the size of a group does not matter.

Cases: a null text counts as empty; texts are equal when identical after lower-casing A-Z only; the row
with the largest doc_id stays, and rows that repeat that doc_id with that text stay too, being one row; a
row without doc_id counts in its group and goes if any row of it has a doc_id, else it stays (keep_id
null); an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm.shared import blocks, dealt_join, fold_ascii, fresh, split_hot, table, written

#: Digests in a shard.
SHARD = 65_536


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class FuseFilter:
    """A static set of 64-bit keys with one-byte fingerprints; no false negatives, 1 in 256 false positives."""

    def __init__(self, seed: int, segment: int, starts: int, cells: np.ndarray):
        self.seed, self.segment, self.starts, self.cells = seed, segment, starts, cells

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Three cells in successive segments for each key, and its fingerprint."""
        h = _mixed(keys, self.seed)
        mask = np.uint64(self.segment - 1)
        first = ((h >> np.uint64(32)) * np.uint64(self.starts)) >> np.uint64(32)
        base, inside = first // np.uint64(self.segment), first & mask
        places = np.stack([base * np.uint64(self.segment) + inside, (base + np.uint64(1)) * np.uint64(self.segment) + ((inside ^ (h >> np.uint64(18))) & mask), (base + np.uint64(2)) * np.uint64(self.segment) + ((inside ^ h) & mask)])
        return places.astype(np.int64), (h ^ (h >> np.uint64(40))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = max(len(keys), 2)
        segment = min(2**18, 2 ** max(2, math.floor(math.log(n) / math.log(3.33) + 2.25)))
        room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        segments = max(1, math.ceil(room / segment) - 2) + 2
        for seed in range(1, 200):
            out = cls(seed, segment, (segments - 2) * segment, np.zeros(segments * segment, dtype=np.uint8))
            if out._fill(keys):
                return out
            if seed % 10 == 0:
                segments += 1 + segments // 8
        raise RuntimeError("no seed fits these keys")

    def _fill(self, keys: np.ndarray) -> bool:
        """Peel keys that own a cell alone, layer by layer, then set the cells in reverse."""
        places, prints = self._places(keys)
        cells, n = len(self.cells), len(keys)
        number = np.bincount(places.ravel(), minlength=cells)
        owner = np.zeros(cells, dtype=np.int64)
        index = np.arange(n)
        for row in places:
            np.bitwise_xor.at(owner, row, index)
        layers, left = [], n
        single = np.flatnonzero(number == 1)
        while len(single):
            own, at = np.unique(owner[single], return_index=True)
            cell = single[at]
            layers.append((own, cell))
            left -= len(own)
            gone = places[:, own]
            np.subtract.at(number, gone.ravel(), 1)
            np.bitwise_xor.at(owner, gone.ravel(), np.tile(own, 3))
            touched = np.unique(gone.ravel())
            single = touched[number[touched] == 1]
        if left:
            return False
        for own, cell in reversed(layers):
            three = self.cells[places[:, own]]
            self.cells[cell] = prints[own] ^ three[0] ^ three[1] ^ three[2] ^ self.cells[cell]
        return True

    def contains(self, keys: np.ndarray) -> np.ndarray:
        places, prints = self._places(keys.astype(np.uint64))
        three = self.cells[places]
        return (three[0] ^ three[1] ^ three[2]) == prints

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.starts], dtype=np.int64).tobytes() + self.cells.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> FuseFilter:
        seed, segment, starts = np.frombuffer(raw[:24], dtype=np.int64).tolist()
        return cls(seed, segment, starts, np.frombuffer(raw[24:], dtype=np.uint8))


def _build(rows: pa.Table) -> pa.Table:
    keys = rows.column("key").to_numpy().view(np.uint64)
    return pa.table({"shard": rows.column("shard")[:1], "filter": pa.array([FuseFilter.build(keys).to_bytes()], pa.binary())})


def _probe(filters: pa.Table, rows: pa.Table) -> pa.Table:
    keys = rows.column("key").to_numpy().view(np.uint64)
    hit = np.zeros(len(keys), dtype=bool)
    for raw in filters.column("filter").to_pylist():
        hit |= FuseFilter.from_bytes(raw).contains(keys)
    return rows.select(["digest"]).filter(pa.array(hit))


def _keyed(digests: DataFrame, shards: int) -> DataFrame:
    return digests.select("digest", F.xxhash64("digest").alias("key")).withColumn("shard", F.expr(f"cast(pmod(hash(digest), {shards}) as int)"))


@dataclass(frozen=True)
class Snapshot:
    """The digests of a snapshot, ``(digest, n)``, and its filters, ``(shard, filter)``, as they were written once."""

    digests: DataFrame
    filters: DataFrame
    shards: int

    @classmethod
    def write(cls, digests: DataFrame, path: str) -> Snapshot:
        """The snapshot of ``digests (digest)``, with repeats, under a new folder; it is never changed again."""
        spark = digests.sparkSession
        digests.groupBy("digest").agg(F.count("*").alias("n")).write.parquet(f"{path}/digests")
        shards = blocks(spark.read.parquet(f"{path}/digests").count(), SHARD)
        keyed = _keyed(spark.read.parquet(f"{path}/digests"), shards)
        built = keyed.groupBy("shard").applyInArrow(_build, "shard int, filter binary")
        built.withColumn("shards", F.lit(shards)).write.parquet(f"{path}/filters")
        return cls.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Snapshot:
        filters = spark.read.parquet(f"{path}/filters")
        one = filters.select("shards").first()
        return cls(spark.read.parquet(f"{path}/digests"), filters.drop("shards"), one[0] if one else 1)

    def screened(self, incoming: DataFrame) -> DataFrame:
        """The distinct ``digest`` values of ``incoming`` that pass the filters; no text and no digest of the snapshot is read."""
        return self.filters.groupBy("shard").cogroup(_keyed(incoming, self.shards).groupBy("shard")).applyInArrow(_probe, "digest string")

    def known(self, incoming: DataFrame) -> DataFrame:
        """``digest, n``: the incoming digests that are in the snapshot's exact buckets, and how often."""
        return self.screened(incoming).join(self.digests, "digest")


def digests_of(docs: DataFrame) -> DataFrame:
    """``doc_id, digest`` of every row of ``docs (doc_id, text)``."""
    norm = fold_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select(F.col("doc_id").cast("long"), F.sha2(norm.cast("binary"), 256).alias("digest"))


def exact_duplicates(docs: DataFrame, incoming, snapshot: Snapshot | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs (doc_id, text)``.

    ``incoming`` is the condition of the rows of the new batch; all others are the snapshot, of which ``snapshot`` was
    written; without it one is written for this call.
    """
    spark = docs.sparkSession
    norm = fold_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long"), F.sha2(norm.cast("binary"), 256).alias("digest"), F.coalesce(incoming, F.lit(True)).alias("new"))
    rows = written(rows, "digests")
    snapshot = snapshot or Snapshot.write(rows.where("not new").select("digest"), fresh(spark, "snapshot"))
    new = written(rows.where("new").groupBy("digest").agg(F.count("*").alias("n")), "batch")
    across = snapshot.known(new).join(new.withColumnRenamed("n", "more"), "digest").select("digest", (F.col("n") + F.col("more")).alias("n"))
    inside = snapshot.digests.where("n > 1").unionByName(new.where("n > 1"))
    suspect = written(across.unionByName(inside).groupBy("digest").agg(F.max("n").alias("n")), "suspect")
    total = rows.count()
    # The byte check: of each digest that is not alone, the texts themselves are the groups. Those of hot digests
    # are combined where they are read.
    own = docs.select(F.col("doc_id").cast("long"), norm.alias("norm")).withColumn("digest", F.sha2(F.col("norm").cast("binary"), 256))

    def grouped(met: DataFrame) -> DataFrame:
        groups = met.groupBy("digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        return groups.select("digest", "keep_id", "group_size", F.xxhash64("norm").alias("variant"))

    hot, rest = split_hot(suspect, "n", total)
    if hot.isEmpty():
        groups = grouped(own.join(rest.select("digest").hint("merge"), "digest"))
    else:
        few = F.broadcast(hot.select("digest"))
        groups = grouped(own.join(few, "digest", "left_anti").join(rest.select("digest").hint("merge"), "digest")).unionByName(grouped(own.join(few, "digest")))
    groups = written(groups, "groups")
    clash = groups.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    if clash.isEmpty():
        sides = groups.drop("variant").withColumn("n", F.col("group_size"))
        found = dealt_join(rows, sides, "digest", "n", total, "left")
    else:  # different texts under one digest: their rows are told apart by a second hash
        found = docs.select(F.col("doc_id").cast("long"), F.sha2(norm.cast("binary"), 256).alias("digest"), F.xxhash64(norm).alias("variant")).join(groups, ["digest", "variant"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("digest").alias("text_sha256"))


def op5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower half of the ids is the snapshot, the upper half the incoming batch."""
    docs = table(spark, sf_dir, "documents")
    middle = docs.agg(F.expr("(min(doc_id) + max(doc_id)) div 2")).first()[0]
    return exact_duplicates(docs, F.col("doc_id") > F.lit(middle if middle is not None else 0))


OP5_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256 FROM t
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
