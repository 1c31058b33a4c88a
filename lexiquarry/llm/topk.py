"""Exact top-k inner products by the threshold algorithm.

Vectors are dealt in blocks; per block and dimension the rows are sorted once. A query walks the lists of
the dimensions in which it is not zero, from the large end where its own component is positive and from
the small end where it is negative. After each step the sum over the lists of component times the value
at the walked depth bounds the score of every row not yet met; the walk of a block stops when the k-th
best score so far is above that bound. A row that could still tie the k-th score is always met, so ties
are settled by the smaller id.

Work is one task for each pair of a block of vectors and a block of queries, each of them one row in the
shuffle; results of a pair are at most k rows a query, and the best k of all blocks are taken
by a window per query.

Components of less than 31 bits are kept and added as machine integers; a block with a larger one, of any
finite size, is worked on with Python's integers. Scores are exact; one beyond 64 bits counts as the nearest
number of 64 bits.

Cases: a vector that is null, or holds a null or a non-finite number, takes no part; of rows that share an id
each is a candidate, and the best k of all their queries are returned; a shorter vector counts as ending in
zeros; fewer than k candidates give fewer rows; an empty table gives no rows; a null id takes no part; other
columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiquarry.llm.shared import blocks, table, written

#: Rows in a block of vectors and queries in a block of queries.
ROWS, QUERIES = 4096, 8192
#: Shuffle partitions that pairs of blocks are dealt to, at most; a partition can hold several pairs.
PARTITIONS = 10_000
#: Entries of each list that the first step walks; each later step doubles the depth.
FIRST_STEP = 32
#: Components below this in size are stored in 32 bits; their products can be added over 2**20 dimensions in 64.
SMALL = 2.0**21
LEAST, MOST = -(2**63), 2**63 - 1


def finite_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v)`` of the rows that take part, in double precision."""
    valid = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & valid).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))


def integers(raw: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as 32-bit integers, or as Python's if one is large."""
    if not raw.size or np.abs(raw).max() * scale < SMALL:
        return np.floor(raw * scale).astype(np.int32)
    large = [int(x) * scale if abs(x) >= 2.0**52 else math.floor(x * scale) for x in raw.ravel().tolist()]
    return np.array(large, dtype=object).reshape(raw.shape)


def _pack(rows: pa.Table, scale: int, every: int) -> pa.Table:
    """A block as byte strings: ids, the matrix, each dimension's order of the rows, and its queries."""
    ids, vectors = rows.column("id").to_numpy(), rows.column("v").to_pylist()
    width = max(map(len, vectors))
    raw = np.array([v + [0.0] * (width - len(v)) for v in vectors], dtype=np.float64).reshape(len(ids), width)
    order = np.argsort(ids, kind="stable")
    ids, raw = ids[order], raw[order]
    own = integers(raw, scale)
    lists = np.argsort(own, axis=0, kind="stable").T.astype(np.int32)
    small = own.dtype != object
    asks = ids % every == 0
    return pa.table(
        {
            "block": rows.column("block")[:1], "width": pa.array([width], pa.int32()), "small": pa.array([small]), "ids": pa.array([ids.tobytes()], pa.binary()),
            "matrix": pa.array([(own if small else raw).tobytes()], pa.binary()), "lists": pa.array([lists.tobytes()], pa.binary()),
            "q_ids": pa.array([ids[asks].tobytes()], pa.binary()), "queries": pa.array([(own[asks] if small else raw[asks]).tobytes()], pa.binary()),
        }
    )


PACKED = "block int, width int, small boolean, ids binary, matrix binary, lists binary, q_ids binary, queries binary"


def _matrix(raw: bytes, small: bool, rows: int, width: int, scale: int) -> np.ndarray:
    if small:
        return np.frombuffer(raw, dtype=np.int32).reshape(rows, width)
    return integers(np.frombuffer(raw, dtype=np.float64).reshape(rows, width), scale)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` highest scores, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda j: (-scores[j], ids[j]))[:k], dtype=np.int64)
    return np.lexsort((ids, -scores))[:k]


def walk(query: np.ndarray, own: int, ids: np.ndarray, matrix: np.ndarray, lists: np.ndarray, k: int) -> tuple[list[tuple[int, int]], int, int]:
    """The best ``(score, id)`` of a block for one query, how deep its lists were walked, and the rows met."""
    n, exact = len(ids), matrix.dtype == object or query.dtype == object
    held = (lambda x: min(max(int(x), LEAST), MOST)) if exact else int
    dims = np.flatnonzero(query)
    if not len(dims):  # every score is zero
        return [(0, int(i)) for i in ids[ids != own][:k]], 0, 0
    sign = np.array([bool(x > 0) for x in query[dims]])
    wide = object if exact else np.int64
    met = np.zeros(n, dtype=bool)
    best_s, best_i = np.empty(0, dtype=wide), np.empty(0, dtype=np.int64)
    depth, step = 0, FIRST_STEP
    while depth < n:
        to = min(n, depth + step)
        head = lists[dims[~sign], depth:to].ravel()
        tail = lists[dims[sign], n - to : n - depth].ravel()
        new = np.zeros(n, dtype=bool)
        new[head] = new[tail] = True
        new &= ~met
        met |= new
        rows = np.flatnonzero(new)
        rows = rows[ids[rows] != own]
        if len(rows):
            found = matrix[rows].astype(wide) @ query.astype(wide)
            if exact:
                found = np.array([held(x) for x in found], dtype=object)
            best_s, best_i = np.concatenate((best_s, found)), np.concatenate((best_i, ids[rows]))
            keep = _best(best_s, best_i, k)
            best_s, best_i = best_s[keep], best_i[keep]
        at = np.where(sign, n - to, to - 1)
        bound = held((query[dims].astype(wide) * matrix[lists[dims, at], dims].astype(wide)).sum())
        depth, step = to, step * 2
        if len(best_s) == k and best_s[-1] > bound:
            break
    return list(zip(best_s.tolist(), best_i.tolist(), strict=True)), depth, int(met.sum())


def _meet(rows: pa.Table, k: int, scale: int) -> pa.Table:
    """Each block of vectors in the group against the group's queries."""
    out: list[tuple[int, int, int]] = []
    packed = rows.to_pylist()
    for block in (r for r in packed if r["matrix"] is not None):
        ids, width = np.frombuffer(block["ids"], dtype=np.int64), block["width"]
        matrix = _matrix(block["matrix"], block["small"], len(ids), width, scale)
        lists = np.frombuffer(block["lists"], dtype=np.int32).reshape(width, len(ids))
        for asked in (q for r in packed for q in r["asked"] or ()):
            q_ids = np.frombuffer(asked["q_ids"], dtype=np.int64)
            queries = _matrix(asked["queries"], asked["small"], len(q_ids), asked["width"], scale)
            shared = min(width, asked["width"])
            for own, given in zip(q_ids.tolist(), queries, strict=True):
                query = np.zeros(width, dtype=object if given.dtype == object else np.int64)
                query[:shared] = given[:shared]
                out += [(own, s, i) for s, i in walk(query, own, ids, matrix, lists, k)[0]]
    columns = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query_id", "score", "vec_id"), columns, strict=True)})


def top_k(df: DataFrame, k: int, every: int, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows for each row whose id ``every`` divides."""
    vectors = finite_vectors(df, id_col, vec_col)
    total, asked = vectors.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    parts, groups = blocks(total, ROWS), blocks(asked, QUERIES)
    packed = (
        vectors.withColumn("block", F.expr(f"cast(pmod(xxhash64(monotonically_increasing_id()), {parts}) as int)"))
        .groupBy("block").applyInArrow(lambda t: _pack(t, scale, every), PACKED)
    )
    packed = written(packed, "vectors")
    # Each block goes to every group of queries, and each group, some blocks' queries, to every block.
    dealt = packed.select("block", "width", "small", "ids", "matrix", "lists", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    queries = packed.where(F.length("q_ids") > 0).select(F.expr(f"cast(pmod(block, {groups}) as int)").alias("part"), F.struct("width", "small", "q_ids", "queries").alias("q"))
    queries = queries.groupBy("part").agg(F.collect_list("q").alias("asked")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = (
        dealt.unionByName(queries, allowMissingColumns=True)
        .repartition(min(parts * groups, PARTITIONS), "block", "part")
        .groupBy("block", "part").applyInArrow(lambda t: _meet(t, k, scale), "query_id long, score long, vec_id long")
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


OP1_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
