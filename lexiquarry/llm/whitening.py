"""Whitening of vectors by the exact characteristic polynomial of their scatter.

Components become integers, ``floor(scale * c) + shift``. Their scatter ``n * sum(x x') - S S'``, which is n
squared times the covariance, is summed exactly: each task adds its own rows, and cells are summed in limbs of
30 bits. The matrix's characteristic polynomial comes from its Hessenberg forms modulo primes of 31 bits, a
task for some of the primes, and Chinese remaindering. All its roots are real, so the sign variations of the
polynomial moved to a point count the roots above that point (Budan and Fourier), with multiplicity; halving
on those counts isolates each root, and signs alone narrow it down to 2**-150 of the trace. An eigenvector is
a null vector of the scatter less its root, by inverse iteration in decimals of ``DIGITS`` digits; roots that
are equal, or closer than that, are iterated together and made orthogonal. Roots and vectors are one task a
component.

What comes to the driver is the scatter, the polynomial and the components: sizes of the vectors, not of the
table. Rows are read twice, for the scatter and for the result, which is written once before its
covariance is taken.

Cases: a vector that is null, or holds a null or a non-finite number, takes no part; a shorter vector counts as
ending in zeros; a null id stays null, and of rows that share an id each counts; entries beyond 64 bits count
as the nearest number of 64 bits, and so do deviations; a component without variance has ``whitened`` null and
``explained`` 0, and has no part in the identity error, which is null if no component has variance; vectors
have at most as many components as entries; an empty table, or one of empty vectors, gives no rows; other
columns play no part.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm.shared import table, written

SCALE, SHIFT, TOP = 1024, 100_000, 8
LIMB = 30
#: Digits of the decimals in which null vectors are found, and bits below the trace to which roots are known.
DIGITS, BITS = 120, 150
LEAST, MOST = -(2**63), 2**63 - 1


class Basis(NamedTuple):
    """What whitening needs: the rows' number, their sums, and the components by falling eigenvalue."""

    n: int
    sums: list[int]
    eigenvalues: list[float]
    explained: list[float]
    vectors: np.ndarray


def complete(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, v)`` of the rows whose vector is whole and finite, in double precision."""
    valid = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.col(vec_col).isNotNull() & valid).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))


def integers(batch: pa.RecordBatch, scale: int, shift: int) -> np.ndarray:
    """``floor(scale * c)`` of a batch's vectors, a row each, such that ``shift`` more is a number of 64 bits.

    The shift itself is left out: it changes neither the scatter nor deviations.
    """
    lists = batch.column("v")
    sizes = np.diff(lists.offsets.to_numpy())
    flat, width = lists.flatten().to_numpy(zero_copy_only=False), int(sizes.max(initial=0))
    raw = np.zeros((len(sizes), width))
    raw[np.arange(width) < sizes[:, None]] = flat
    with np.errstate(over="ignore"):
        found = np.floor(raw * scale)
    if np.abs(found).max(initial=0) < 2.0**62:
        return found.astype(np.int64)
    return np.array([min(max(int(x) + shift, LEAST), MOST) - shift for x in np.clip(found, -(2.0**64), 2.0**64).ravel()], dtype=object).reshape(raw.shape)


def _gram(own: np.ndarray) -> np.ndarray:
    """The exact sum of the rows' outer products."""
    if own.dtype != object:
        most = max(int(own.max(initial=0)), -int(own.min(initial=0)))
        if most * most * len(own) < 2**53:  # every partial sum is an integer that a double holds
            real = own.astype(np.float64)
            return (real.T @ real).astype(np.int64).astype(object)
        if most * most * len(own) < 2**63:
            return (own.T @ own).astype(object)
    wide = own.astype(object)
    return wide.T @ wide


def _cells(batches: Iterator[pa.RecordBatch], scale: int, shift: int) -> Iterator[pa.RecordBatch]:
    """A task's count (cell -1, -1), sums (-1, j) and outer products (i, j), each in limbs."""
    n, sums, gram = 0, np.zeros(0, dtype=object), np.zeros((0, 0), dtype=object)
    for batch in batches:
        own = integers(batch, scale, shift)
        w, held = own.shape[1], len(sums)
        if w > held:
            sums, gram, before = np.append(sums, [0] * (w - held)), np.zeros((w, w), dtype=object), gram
            gram[:held, :held] = before
        n += len(own)
        sums[:w] += own.astype(object).sum(axis=0) if own.dtype == object else own.sum(axis=0).astype(object)
        gram[:w, :w] += _gram(own)
    if not n:
        return
    cells = [(-1, -1, n), *((-1, j, int(s)) for j, s in enumerate(sums)), *((i, j, int(gram[i, j])) for i in range(len(sums)) for j in range(i, len(sums)))]
    rows = []
    for i, j, value in cells:
        size, sign, k = abs(value), 1 if value >= 0 else -1, 0
        while size or not k:
            rows.append((i, j, k, sign * (size & (2**LIMB - 1))))
            size, k = size >> LIMB, k + 1
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["i", "j", "limb", "part"])


def scatter(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> tuple[int, list[int], list[list[int]]]:
    """The rows' number, sums of ``x - shift``, and ``n * sum(x x') - S S'``, all exact."""
    cells = vectors.mapInArrow(lambda b: _cells(b, scale, shift), "i int, j int, limb int, part long")
    summed = cells.groupBy("i", "j", "limb").agg(F.sum("part").alias("part")).collect()
    value: dict[tuple[int, int], int] = {}
    for r in summed:
        value[r.i, r.j] = value.get((r.i, r.j), 0) + (r.part << (LIMB * r.limb))
    n, width = value.get((-1, -1), 0), max((j for _, j in value), default=-1) + 1
    sums = [value[-1, j] for j in range(width)]
    return n, sums, [[n * value[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(width)] for i in range(width)]


def is_prime(x: int) -> bool:
    """Miller and Rabin's test, certain below 3.2 * 10**9."""
    if x < 8:
        return x in (2, 3, 5, 7)
    odd, twos = x - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        power = pow(base, odd, x)
        if power in (1, x - 1) or x == base:
            continue
        if not any((power := power * power % x) == x - 1 for _ in range(twos - 1)):
            return False
    return x % 2 == 1


def primes_beyond(bound: int) -> list[int]:
    """The largest primes below 2**31 whose product is above ``bound``."""
    found, product, at = [], 1, 2**31 - 1
    while product <= bound:
        if is_prime(at):
            found.append(at)
            product *= at
        at -= 2
    return found


def hessenberg(matrix: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The Hessenberg form of ``matrix[q]`` modulo ``p[q]``, by similar steps, for all q at once."""
    h, d, many = matrix.copy(), matrix.shape[1], np.arange(len(p))
    one, two = p[:, None], p[:, None, None]
    for m in range(1, d - 1):
        pivot = m + (h[:, m:, m - 1] != 0).argmax(axis=1)
        rows = h[many, pivot].copy()
        h[many, pivot], h[:, m] = h[:, m].copy(), rows
        columns = h[many, :, pivot].copy()
        h[many, :, pivot], h[:, :, m] = h[:, :, m].copy(), columns
        inverse = np.array([pow(int(x), -1, int(q)) if x else 0 for x, q in zip(h[:, m, m - 1], p, strict=True)], dtype=np.int64)
        u = h[:, m + 1 :, m - 1] * inverse[:, None] % one
        h[:, m + 1 :] = (h[:, m + 1 :] - u[:, :, None] * h[:, m, None, :] % two) % two
        h[:, :, m] = (h[:, :, m] + (h[:, :, m + 1 :] * u[:, None, :] % two).sum(axis=2)) % one
    return h


def polynomial_mod(matrix: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients of ``det(x - matrix)`` modulo each prime, from the constant one on."""
    p, d = np.array(primes, dtype=np.int64), len(matrix)
    exact = np.array(matrix, dtype=object).reshape(d, d)
    h = hessenberg(np.array([(exact % q).astype(np.int64) for q in primes]), p)
    one = p[:, None]
    polys = np.zeros((d + 1, len(p), d + 1), dtype=np.int64)  # of the leading blocks
    polys[0, :, 0] = 1
    for k in range(1, d + 1):
        own = np.roll(polys[k - 1], 1, axis=1) - polys[k - 1] * h[:, k - 1, k - 1, None] % one
        below = np.ones(len(p), dtype=np.int64)
        for i in range(1, k):
            below = below * h[:, k - i, k - i - 1] % p
            own -= polys[k - i - 1] * (below * h[:, k - i - 1, k - 1] % p)[:, None] % one
        polys[k] = own % one
    return polys[d]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """``det(x - matrix)`` of a positive semi-definite matrix of integers, from the constant coefficient on.

    The roots are not negative, so the coefficient k below the first is, but for its sign, at most ``C(d, k)`` times
    the k-th power of their mean (Maclaurin); primes go beyond that.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = max(math.comb(d, k) * -(-(trace**k) // d**k) for k in range(d + 1))
    primes = primes_beyond(bound)
    shipped = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = polynomial_mod(shipped.value, batch.column("p").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array(list(own), pa.list_(pa.int64()))], names=["p", "coefficients"])

    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(q,) for q in primes], "p long").repartition(tasks).mapInArrow(run, "p long, coefficients array<long>").collect()
    product = math.prod(primes)
    parts = [(rest := product // r.p) * pow(rest, -1, r.p) for r in rows]
    found = [sum(part * r.coefficients[k] for part, r in zip(parts, rows, strict=True)) % product for k in range(d + 1)]
    return [x - product if (d - k) % 2 and x else x for k, x in enumerate(found)]  # signs alternate from the first one on


def roots_above(poly: list[int], at: int, bits: int) -> int:
    """How many roots of ``poly``, all of them real, are above ``at / 2**bits``, which is not negative."""
    d = len(poly) - 1
    if at:
        moved, power = [], 1
        for k, c in enumerate(poly):
            moved.append((c * power) << (bits * (d - k)))
            power *= at
        for i in range(d):
            for j in range(d - 1, i - 1, -1):
                moved[j] += moved[j + 1]
    else:
        moved = poly
    signs = [c > 0 for c in moved if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _sign(poly: list[int], at: int, bits: int) -> int:
    value, d = 0, len(poly) - 1
    for k in range(d, -1, -1):
        value = value * at + (poly[k] << (bits * (d - k)))
    return (value > 0) - (value < 0)


def isolate(poly: list[int], k: int, bits: int, top: int) -> tuple[int, int, int]:
    """The k-th largest root: ``(hi, above, inside)``.

    The root is in ``(hi - 1, hi] / 2**bits``; ``above`` roots are larger than that and ``inside`` in it. ``hi`` is 0 if the
    root is 0. ``top / 2**bits`` is at least the largest root.
    """
    lo, hi, at_lo, at_hi = 0, top, roots_above(poly, 0, bits), 0
    if k > at_lo:
        return 0, at_lo, len(poly) - 1 - at_lo
    beyond = None
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if at_lo - at_hi > 1:
            above = roots_above(poly, mid, bits)
            lo, hi, at_lo, at_hi = (mid, hi, above, at_hi) if above >= k else (lo, mid, at_lo, above)
            continue
        # One root is left inside: signs tell on which side.
        beyond = _sign(poly, hi, bits) if beyond is None else beyond
        sign = _sign(poly, mid, bits) if beyond else -1
        if beyond == 0:
            lo = hi - 1
        elif sign == 0:
            lo, hi = mid - 1, mid
        elif sign == beyond:
            hi = mid
        else:
            lo = mid
    return hi, at_hi, at_lo - at_hi


def null_vectors(matrix: list[list[int]], root: Decimal, many: int) -> list[np.ndarray]:
    """``many`` orthonormal vectors that ``matrix - root`` all but sends to zero, by inverse iteration."""
    d = len(matrix)
    with decimal.localcontext(prec=DIGITS):
        a = np.array([[Decimal(x) - (root if i == j else 0) for j, x in enumerate(row)] for i, row in enumerate(matrix)], dtype=object)
        tiny, order = max(abs(root), Decimal(1)).scaleb(-DIGITS), np.arange(d)
        for i in range(d):
            pivot = i + int(np.argmax(np.abs(a[i:, i])))
            a[[i, pivot]], order[[i, pivot]] = a[[pivot, i]], order[[pivot, i]]
            if abs(a[i, i]) < tiny:
                a[i, i] = tiny
            a[i + 1 :, i] = a[i + 1 :, i] / a[i, i]
            a[i + 1 :, i + 1 :] -= np.outer(a[i + 1 :, i], a[i, i + 1 :])
        draws = np.random.default_rng(7).integers(1, 1000, size=(many, d))
        found = [np.array([Decimal(int(x)) for x in row], dtype=object) for row in draws]
        for _ in range(4):
            for k in range(many):
                b = found[k][order]
                for i in range(1, d):
                    b[i] -= a[i, :i] @ b[:i]
                for i in range(d - 1, -1, -1):
                    b[i] = (b[i] - a[i, i + 1 :] @ b[i + 1 :] if i + 1 < d else b[i]) / a[i, i]
                for other in found[:k]:
                    b = b - other * (other @ b)
                found[k] = b / (b @ b).sqrt()
        return [v.astype(np.float64) * (1 if v[np.argmax(np.abs(v))] > 0 else -1) for v in found]


def components(spark: SparkSession, n: int, matrix: list[list[int]], top: int) -> list[tuple[float, float, list[float]]]:
    """``(eigenvalue, explained, vector)`` of the covariance ``matrix / n**2``, the largest ``top`` of them."""
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    if not trace:
        return [(0.0, 0.0, [0.0] * len(matrix))] * min(top, len(matrix))
    poly = characteristic_polynomial(spark, matrix)
    bits = max(0, BITS - trace.bit_length())
    shipped = spark.sparkContext.broadcast((matrix, poly))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                own, coefficients = shipped.value
                hi, above, inside = isolate(coefficients, k, bits, trace << bits)
                with decimal.localcontext(prec=DIGITS):
                    root = (Decimal(2 * hi - 1) / 2 / 2**bits) if hi else Decimal(0)
                    value, share = float(root / n / n), float(root / trace)
                vector = null_vectors(own, root, inside)[k - above - 1] if hi else np.zeros(len(own))
                columns = [pa.array([k], pa.int64()), pa.array([value]), pa.array([share]), pa.array([vector.tolist()], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "eigenvalue", "explained", "vector"])

    many = min(top, len(matrix))
    found = spark.range(1, many + 1, 1, many).mapInArrow(run, "id long, eigenvalue double, explained double, vector array<double>").collect()
    return [(r.eigenvalue, r.explained, r.vector) for r in sorted(found, key=lambda r: r.id)]


def fit(df: DataFrame, top: int = TOP, scale: int = SCALE, shift: int = SHIFT, vec_col: str = "embedding") -> Basis:
    """The ``top`` components of all complete vectors of ``df``."""
    n, sums, matrix = scatter(complete(df.select(F.lit(None).alias("_id"), vec_col), "_id", vec_col), scale, shift)
    found = components(df.sparkSession, n, matrix, top) if sums else []
    return Basis(n, sums, [e for e, _, _ in found], [x for _, x, _ in found], np.array([v for _, _, v in found]).reshape(len(found), len(sums)))


def _whitened(batch: pa.RecordBatch, basis: Basis, scale: int, shift: int) -> pa.RecordBatch:
    own, n, width = integers(batch, scale, shift), basis.n, len(basis.sums)
    own = np.hstack((own, np.zeros((len(own), width - own.shape[1]), dtype=own.dtype)))
    reach = n * max(1, int(np.abs(own).max(initial=0))) + max(map(abs, basis.sums), default=0)
    if reach * reach * max(width, 1) < 2**63:
        moved = own.astype(np.int64) * n - np.array(basis.sums, dtype=np.int64)
        deviation = (moved * moved).sum(axis=1)
        centred = moved / n
    else:
        moved = own.astype(object) * n - np.array(basis.sums, dtype=object)
        deviation = np.array([min(x, MOST) for x in (moved * moved).sum(axis=1)], dtype=np.int64)
        centred = (moved / n).astype(np.float64)
    spread = np.sqrt(np.array(basis.eigenvalues))
    with np.errstate(divide="ignore", invalid="ignore"):
        white = (centred @ basis.vectors.T) / spread
    flat = pa.array(white.ravel(), mask=np.tile(spread == 0, len(white)))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1) * len(spread), pa.int32()), flat)
    return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviation, pa.int64()), lists], names=["vec_id", "deviation", "whitened"])


def whiten(df: DataFrame, basis: Basis, scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, deviation, whitened (an array, an entry a component)`` of the complete vectors of ``df``, which is what ``basis`` was fitted on."""
    shipped = df.sparkSession.sparkContext.broadcast(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _whitened(batch, shipped.value, scale, shift)

    return complete(df, id_col, vec_col).mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def _moments(batches: Iterator[pa.RecordBatch], at: list[int]) -> Iterator[pa.RecordBatch]:
    """For each pair of components a task's rows, means, and products about these means."""
    n, mean, co = 0, np.zeros(len(at)), np.zeros((len(at), len(at)))
    for batch in batches:
        if batch.num_rows:
            own = batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[:, at].astype(np.float64)
            m = own.mean(axis=0)
            off, total = m - mean, n + len(own)
            co += (own - m).T @ (own - m) + np.outer(off, off) * n * len(own) / total
            mean, n = mean + off * len(own) / total, total
    if n:
        rows = [(i, j, n, mean[i], mean[j], co[i, j]) for i in range(len(at)) for j in range(i, len(at))]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["i", "j", "n", "a", "b", "co"])


def identity_error(whitened: DataFrame, basis: Basis) -> float | None:
    """The largest absolute entry of the covariance of ``whitened`` less the identity, over components with variance."""
    at = [k for k, e in enumerate(basis.eigenvalues) if e > 0]
    if not at:
        return None
    parts = whitened.select("whitened").mapInArrow(lambda b: _moments(b, at), "i int, j int, n long, a double, b double, co double")
    n = F.sum("n")
    centre = F.sum(F.col("n") * F.col("a")) * F.sum(F.col("n") * F.col("b")) / n
    found = parts.groupBy("i", "j").agg(((F.sum(F.col("co") + F.col("n") * F.col("a") * F.col("b")) - centre) / n).alias("c")).collect()  # a row a pair
    return max(abs(r.c - (r.i == r.j)) for r in found)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    basis = fit(vectors)
    whitened = written(whiten(vectors, basis), "whitened")
    error = identity_error(whitened, basis)
    explained = F.array(*map(F.lit, basis.explained)) if basis.explained else F.array().cast("array<double>")
    rows = whitened.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(basis.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )
