"""Near-duplicate documents by b-bit MinHash.

A document is the set of its 5-word shingles. Per document, 128 minima are taken; 24 bands of 5 minima
give candidate buckets, and the low 4 bits of all minima are packed in a signature of 8 longs. Estimates
come from bit counts of two signatures, corrected for the 1 in 16 of unequal minima whose low bits agree.
Pairs with an estimate of at least the screen are confirmed on their full shingle sets.

Bands and screen follow from the least similarity, here for 0.85: at 0.80 there are 27 bands of 4. A pair at
the least similarity is missed by all bands with a probability below ``MISSED`` and by the estimate
(``DEVIATIONS`` standard deviations below) with about 1e-7.

Documents with equal word sequences are one node before any pair is made. In each bucket the node that
shares most buckets is tested against the others, which takes a number of pairs that is linear in the
bucket. Nodes that are linked by then need no further test among themselves; what is left, pairs of a
leader's members in different components, is compared in blocks of signatures and then of texts inside
tasks, and only links come out. There is no cap on a bucket, and no pair that shares a bucket and lies in
different components goes untested.

Cases: null texts and texts without words have the empty set and are linked with nothing; texts of fewer
than five words have one shingle, their whole word sequence; a row without doc_id is a class of its own
(component null, kept); repeated rows are copies of each other; ties go to the smaller doc_id; an empty
table gives an empty result; other columns of the input play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiquarry.llm.components import components
from lexiquarry.llm.shared import blocks, dealt_join, give_back, table, unwritten, written

WIDTH = 5
HASHES, BITS = 128, 4
#: Chance that a pair at the least similarity shares no band, at most, and how far below it estimates are tested.
MISSED, DEVIATIONS = 8e-7, 5.2
#: Members that meet one leader in one task, and the side of a block of signatures.
BLOCK, SIDE = 64, 512
#: Words whose hashes a worker keeps.
KEPT_WORDS = 200_000

_rng = np.random.default_rng(20)
_ODD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_STEP = _rng.integers(0, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands_for(share: int) -> tuple[int, int]:
    """Bands and rows a band: the longest bands that miss a pair at ``share`` with less than ``MISSED``.

    Where 128 minima do not suffice, as many bands of one row as there are minima.
    """
    for rows in range(HASHES, 0, -1):
        same = (share / 100) ** rows
        bands = HASHES // rows if same <= 0 else 1 if same >= 1 else math.ceil(math.log(MISSED) / math.log1p(-same))
        if bands * rows <= HASHES and (same >= 1 or bands * math.log1p(-same) <= math.log(MISSED)):
            return bands, rows
    return HASHES, 1


def screen_for(share: int) -> float:
    """The estimate below which a pair is taken to be under ``share``."""
    chance = 1 / 2**BITS
    agree = share / 100 * (1 - chance) + chance
    return share / 100 - DEVIATIONS * math.sqrt(agree * (1 - agree) / HASHES) / (1 - chance)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return value


_HASHES = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes | None) -> list[bytes]:
    """Words as runs of bytes other than space and \\t to \\r, with A-Z lower-cased."""
    return (text or b"").lower().split()


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles of ``words``."""
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=n)
    if n < WIDTH:
        return _mix(np.array([(w * _STEP[:n]).sum() + np.uint64(n)], dtype=np.uint64))
    m = n - WIDTH + 1
    s = w[:m] * _STEP[0]
    for k in range(1, WIDTH):
        s += w[k : k + m] * _STEP[k]
    return np.unique(_mix(s))


def shingle_set(words: list[bytes]) -> set:
    """The shingles of ``words`` themselves."""
    if len(words) < WIDTH:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(WIDTH)), strict=False))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """For each set (none empty) its 128 minima, as 64-bit numbers."""
    x = np.concatenate(sets)
    start = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out, t = np.empty((HASHES, len(sets)), dtype=np.uint64), np.empty_like(x)
    for k in range(HASHES):
        np.bitwise_xor(x, _XOR[k], out=t)
        np.multiply(t, _ODD[k], out=t)
        out[k] = np.minimum.reduceat(t, start)
    return out.T >> np.uint64(20)  # the low bits of a product are those of its factors


def packed(mins: np.ndarray) -> np.ndarray:
    """The low bits of each row's minima in 8 longs."""
    low = (mins & np.uint64(2**BITS - 1)).reshape(len(mins), HASHES * BITS // 64, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64).view(np.int64)


def band_keys(mins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    m = _mix(mins[:, : bands * rows].reshape(len(mins), bands, rows) + np.uint64(1))
    return _mix((m * _BAND[: bands * rows].reshape(1, bands, rows)).sum(axis=2, dtype=np.uint64)).view(np.int64)


SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("node", T.BinaryType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("sig", T.ArrayType(T.LongType(), False)),
        T.StructField("bands", T.ArrayType(T.LongType(), False)),
    ]
)


def _lists(rows: np.ndarray, there: np.ndarray) -> pa.Array:
    """A list per document, null where ``there`` is false."""
    width = rows.shape[1]
    offsets = np.concatenate(([0], np.cumsum(there) * width)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()), mask=pa.array(~there))


def _sign(bands: int, rows_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                nodes, sets = [], []
                for text in rows.column(1).cast(pa.binary()).to_pylist():
                    words = words_of(text)
                    nodes.append(blake2b(b" ".join(words), digest_size=16).digest() if words else None)
                    sets.append(shingle_hashes(words))
                size = np.array([len(s) for s in sets])
                there = size > 0
                mins = minima([s for s in sets if len(s)]) if there.any() else np.empty((0, HASHES), dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(nodes, pa.binary()), pa.array(size, pa.int64()), _lists(packed(mins), there), _lists(band_keys(mins, bands, rows_), there)],
                    names=SIGNED.fieldNames(),
                )
        _HASHES.clear()
        give_back()

    return run


def signatures(docs: DataFrame, share: int) -> DataFrame:
    """Node, set size, packed signature and band keys for ``share`` of every row of ``docs (doc_id, text)``."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sign(*bands_for(share)), SIGNED)


def estimate(a: str, b: str) -> Column:
    """The similarity of two packed signatures from the count of lanes that agree, less chance agreement."""
    lanes = "0x" + "1" * 16
    mask = str(int(lanes, 16))
    differ = []
    for k in range(HASHES * BITS // 64):
        x = f"({a}[{k}] ^ {b}[{k}])"
        x = f"({x} | shiftrightunsigned({x}, 1))"
        differ.append(f"bit_count(({x} | shiftrightunsigned({x}, 2)) & {mask}L)")
    agree = f"(1 - ({' + '.join(differ)}) / {HASHES}D)"
    chance = 1 / 2**BITS
    return F.expr(f"({agree} - {chance}D) / {1 - chance}D")


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for all of ``a`` against all of ``b``."""
    differ = np.zeros((len(a), len(b)), dtype=np.int32)
    mask = np.uint64(int("1" * 16, 16))
    for k in range(a.shape[1]):
        x = a[:, k, None] ^ b[None, :, k]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        differ += np.bitwise_count(x & mask)
    chance = 1 / 2**BITS
    return (1 - differ / HASHES - chance) / (1 - chance)


def _confirm(share: int):
    def run(rows: pa.Table) -> pa.Table:
        leader, links = None, []
        lead, node, text = (rows.column(c).to_pylist() for c in ("leader", "node", "text"))
        members = []
        for a, n, t in zip(lead, node, text, strict=True):
            words = words_of(t)
            if blake2b(b" ".join(words), digest_size=16).digest() != n:
                continue  # another text under the same doc_id
            if n == a:
                leader = shingle_set(words)
            else:
                members.append((n, words))
        for n, words in members if leader else []:
            own = shingle_set(words)
            both = len(leader & own)
            if 100 * both >= share * (len(leader) + len(own) - both):
                links.append((lead[0], n))
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([x for _, x in links], pa.binary())})

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, share: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets have ``100 * intersection >= share * union``.

    The members of a leader ``a`` are dealt in blocks, so that a leader of many members is spread; a
    block holds the leader's text once.
    """
    dealt = written(pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"), "n"), "dealt")
    members = (
        dealt_join(pairs, dealt, "a", "n", dealt.agg(F.sum("n")).first()[0] or 0)
        .select(F.col("b").alias("node"), F.col("a").alias("leader"), F.expr("pmod(xxhash64(b), parts)").cast("int").alias("part"))
    )
    leaders = dealt.select(F.col("a").alias("node"), F.col("a").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = members.unionByName(leaders).join(texts, "node")
    return rows.groupBy("leader", "part").applyInArrow(_confirm(share), "a binary, b binary")


def _passing(rows: pa.Table, screen: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each group of blocks in ``rows``, the rows of minor and of any role whose pairs pass the estimate.

    The two rows of a pair are in different components. Also returned: which rows are in such a pair.
    """
    group = rows.column("bin").to_numpy()
    lead, comp, node = (np.array(rows.column(c).to_pylist(), dtype=object) for c in ("leader", "comp", "node"))
    minor = rows.column("minor").to_numpy(zero_copy_only=False)
    sig = rows.column("sig").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(group), -1)
    of: dict[bytes, list[int]] = {}
    for k, a in enumerate(lead):
        of.setdefault(a, []).append(k)
    left, right = [], []
    for at in map(np.array, of.values()):
        own, rest = at[minor[at]], at[~minor[at]]
        if len(own) and len(rest):
            x, y = np.nonzero(_estimates(sig[own], sig[rest]) >= screen)
            p, q = own[x], rest[y]
            apart = (comp[p] != comp[q]) & (node[p] != node[q])
            left.append(p[apart])
            right.append(q[apart])
    p, q = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (left, right))
    there = np.zeros(len(group), dtype=bool)
    there[p] = there[q] = True
    return p, q, there


MET = ["bin", "i", "j", "leader", "node", "comp", "minor", "sig"]


def _screen(screen: float):
    def run(rows: pa.Table) -> pa.Table:
        """The rows of a group of blocks that are in a pair that passes the estimate."""
        return rows.filter(pa.array(_passing(rows, screen)[2])).select(MET)

    return run


def _settle(share: int):
    def run(rows: pa.Table) -> pa.Table:
        """Links of the passing pairs; rows that are connected by then are not tested again."""
        p, q, _ = _passing(rows, screen_for(share))
        comp, node, text = (rows.column(c).to_pylist() for c in ("comp", "node", "text"))
        kept: dict[int, tuple[list[bytes], set]] = {}
        root: dict[bytes, bytes] = {}

        def words(k: int) -> tuple[list[bytes], set]:
            if k not in kept:
                w = words_of(text[k])
                fits = blake2b(b" ".join(w), digest_size=16).digest() == node[k]
                kept[k] = (w, set(shingle_hashes(w).tolist())) if fits else ([], set())
            return kept[k]

        def find(c: bytes) -> bytes:
            while root.get(c, c) != c:
                c = root[c]
            return c

        def enough(x: set, y: set) -> bool:
            both = len(x & y)
            return bool(both) and 100 * both >= share * (len(x) + len(y) - both)

        links = []
        for a, b in zip(p.tolist(), q.tolist(), strict=True):
            x, y = find(comp[a]), find(comp[b])
            if x == y:
                continue
            (one, own), (two, other) = words(a), words(b)
            if 100 * min(len(own), len(other)) >= share * max(len(own), len(other)) and enough(own, other) and enough(shingle_set(one), shingle_set(two)):
                root[x] = y
                links.append((node[a], node[b]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([x for _, x in links], pa.binary())})

    return run


def remaining(led: DataFrame, comps: DataFrame, texts: DataFrame, share: int) -> DataFrame:
    """Links between the members ``led (leader, node, sig)`` of a leader that are in different components.

    Members outside a leader's largest component (minor) meet all members, block against block. Blocks
    are compared by signatures first; only the texts of members in a passing pair are sent, to the same
    blocks, where the pairs are confirmed. Pairs with the leader itself have been tested.
    """
    rows = led.where("node <> leader").join(comps, "node", "left").select("leader", "node", "sig", F.coalesce("comp", "node").alias("comp"))
    ends = (
        rows.groupBy("leader", "comp").agg(F.count("*").alias("n"))
        .groupBy("leader").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("most"), F.count("*").alias("comps"))
        .where("comps > 1")
        .select("leader", "n", F.col("most.comp").alias("major"), F.ceil((F.col("n") - F.col("most.n")) / SIDE).cast("int").alias("minors"), F.ceil(F.col("n") / SIDE).cast("int").alias("sides"))
    )
    # Leaders of one block are put together; of others each pair of blocks is a group.
    bins = blocks(led.count(), 4 * SIDE)
    h = F.xxhash64("node")
    bin_ = F.when(F.expr("minors = 1 and sides = 1"), F.expr(f"pmod(xxhash64(leader), {bins})")).otherwise(F.xxhash64("leader"))
    ends = written(ends.withColumn("weight", F.col("n")), "ends")
    rows = dealt_join(rows, ends.drop("n"), "leader", "weight", led.count()).withColumn("bin", bin_).withColumn("h", h)
    minor = rows.where("comp <> major").withColumn("i", F.expr("cast(pmod(h, minors) as int)")).withColumn("j", F.explode(F.expr("sequence(0, sides - 1)"))).withColumn("minor", F.lit(True))
    every = rows.withColumn("j", F.expr("cast(pmod(h, sides) as int)")).withColumn("i", F.explode(F.expr("sequence(0, minors - 1)"))).withColumn("minor", F.lit(False))
    met = minor.select(MET).unionByName(every.select(MET))
    schema = "bin long, i int, j int, leader binary, node binary, comp binary, minor boolean, sig array<long>"
    close = written(met.groupBy("bin", "i", "j").applyInArrow(_screen(screen_for(share)), schema), "close")
    return close.join(texts, "node").groupBy("bin", "i", "j").applyInArrow(_settle(share), "a binary, b binary")


def near_duplicates(docs: DataFrame, share: int = 85) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked when ``100 * intersection >= share * union`` of their shingle sets;
    ``component_id`` is the smallest doc_id that links reach, ``kept`` marks the row that has it.
    """
    signed = written(signatures(docs, share), "signed")
    nodes = signed.where("node is not null and doc_id is not null").groupBy("node", "sig", "bands").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"))
    nodes = written(nodes, "nodes")
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    common = written(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "common")
    held = common.agg(F.sum("n")).first()[0] or 0
    shared = written(dealt_join(buckets, common.withColumn("weight", F.col("n")), "key", "weight", held), "shared")
    degree = shared.groupBy("node").agg(F.sum("n").alias("degree")).join(nodes.select("node", "doc", "sig"), "node")
    degree = written(degree, "degree")
    leaders = shared.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("lead"), F.max("n").alias("weight")).select("key", F.col("lead.node").alias("leader"), "weight")
    members = dealt_join(shared.drop("n"), written(leaders, "leaders"), "key", "weight", held).select("leader", "node").distinct()
    members = written(members, "members")
    signs = degree.select("node", "sig")
    led_by = written(members.groupBy("leader").agg(F.count("*").alias("weight")).join(signs.select(F.col("node").alias("leader"), F.col("sig").alias("leader_sig")), "leader"), "led_by")
    led = dealt_join(members.join(signs, "node"), led_by, "leader", "weight", members.count())
    led = written(led.withColumn("estimate", estimate("leader_sig", "sig")).drop("leader_sig"), "led")
    stars = led.where(f"node <> leader and estimate >= {screen_for(share)}").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").cast("binary").alias("text"))
    texts = written(texts.join(degree.select("node", "doc").hint("merge"), "doc").select("node", "text"), "texts")
    links = written(confirmed(stars, texts, share), "links")
    more = written(remaining(led, components(links), texts, share), "links")
    for done in (texts, shared, members, led_by, led, degree):
        unwritten(done)
    comps = written(components(links.unionByName(more)), "comps")
    least = nodes.select("node", "doc").join(comps, "node").groupBy("comp").agg(F.min("doc").alias("least"))
    labels = nodes.select("node", "doc", "copies").join(comps.join(least, "comp").select("node", "least"), "node", "left").select("node", "copies", F.coalesce("least", "doc").alias("label"))
    labels = written(labels, "labels")
    total = nodes.agg(F.sum("copies")).first()[0] or 0
    # Documents without words or id have no node and so none of the hot ones.
    found = dealt_join(signed.select("node", "doc_id", "n_shingles"), labels, "node", "copies", total, "left")
    label = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("label", "doc_id"))
    return found.select("doc_id", "n_shingles", label.alias("component_id"), F.col("doc_id").eqNullSafe(label).alias("kept"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
