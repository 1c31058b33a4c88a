from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import whitening
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows):
    """Counts, deviations, eigenvalues and eigenvectors by numpy, of rows (id, whole vector)."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows])
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, ((n * x - sums) ** 2).sum(axis=1), centred, values[::-1], vectors[:, ::-1]


def test_query_against_numpy(spark):
    got = whitening.op11_whitening(spark, SF).toPandas()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    n, deviation, centred, values, vectors = plain(rows)
    white = got.pivot(index="vec_id", columns="component", values="whitened").sort_index()
    want = centred @ vectors[:, :8] / np.sqrt(values[:8])
    signs = np.sign((white.to_numpy() * want).sum(axis=0))
    assert np.abs(white.to_numpy() - want * signs).max() < 1e-8
    assert list(white.columns) == list(range(1, 9)) and len(got) == 8 * len(rows)
    first = got[got.component == 1].sort_values("vec_id")
    assert first.deviation.tolist() == deviation.tolist() and set(got.n) == {n}
    assert got.groupby("component").explained.first().tolist() == pytest.approx((values[:8] / values.sum()).tolist(), rel=1e-9)
    assert set(got.identity_error) == {got.identity_error[0]} and got.identity_error[0] < 1e-9


def faddeev(matrix):
    """The characteristic polynomial by traces of powers, in fractions."""
    d = len(matrix)
    a, m = np.array(matrix, dtype=object), np.zeros((d, d), dtype=object)
    out = [0] * d + [1]
    for k in range(1, d + 1):
        m = a @ m + np.eye(d, dtype=object) * out[d - k + 1]
        out[d - k] = Fraction(-sum((a @ m).diagonal()), k)
    return [int(c) for c in out]


@pytest.mark.parametrize("d", [1, 2, 3, 7, 20])
def test_characteristic_polynomial(spark, d):
    rng = np.random.default_rng(d)
    raw = rng.integers(-(10**6), 10**6, size=(d, d)).astype(object)
    for matrix in (raw.T @ raw, np.diag([5] * d).astype(object), np.ones((d, d), dtype=object), np.eye(d, dtype=object)[:, ::-1] + np.eye(d, dtype=object)):
        matrix = [[int(x) for x in row] for row in matrix]
        assert whitening.characteristic_polynomial(spark, matrix) == faddeev(matrix)


def test_hessenberg_with_zeros_where_pivots_stand():
    """Swaps, and steps without a pivot; modulo small primes zeros are many."""
    rng = np.random.default_rng(3)
    for p in (2, 3, 5, 101):
        for _ in range(20):
            matrix = rng.integers(0, 3, size=(6, 6))
            matrix = (matrix @ matrix.T).tolist()
            assert whitening.polynomial_mod(matrix, [p])[0].tolist() == [c % p for c in faddeev(matrix)]


def test_roots_and_their_multiplicity():
    poly = [1]
    for root in (0, 0, 3, 3, 3, 7, 10**20, 10**20 + 1):
        poly = [a - root * b for a, b in zip([0, *poly], [*poly, 0], strict=True)]
    assert [whitening.roots_above(poly, x << 4, 4) for x in (0, 2, 3, 6, 7, 10**20 - 1, 10**20, 10**20 + 1)] == [6, 6, 3, 3, 2, 2, 1, 0]
    top = 10**21 << 4
    found = [whitening.isolate(poly, k, 4, top) for k in range(1, 9)]
    assert [hi / 16 for hi, _, _ in found] == pytest.approx([10**20 + 1, 10**20, 7, 3, 3, 3, 0, 0])
    assert [f[1:] for f in found] == [(0, 1), (1, 1), (2, 1), (3, 3), (3, 3), (3, 3), (6, 2), (6, 2)]


def test_equal_and_close_eigenvalues(spark):
    """A covariance with a threefold eigenvalue and two that differ by 1e-9 of their size."""
    base = [[a if i == k else 0 for i in range(5)] for k, a in enumerate((8, 8, 8, 3000, 3000))]
    rows = [[s * x for x in v] for v in base for s in (1, -1)] + [[0, 0, 0, 1, 0], [0, 0, 0, -1, 0]]
    data = [(i, [x / 1024 for x in v]) for i, v in enumerate(rows)]
    df = spark.createDataFrame(data, SCHEMA)
    basis = whitening.fit(df)
    assert basis.eigenvalues == pytest.approx([(2 * 3000**2 + 2) / 12, 2 * 3000**2 / 12, *[2 * 64 / 12] * 3], rel=1e-15)
    assert np.abs(basis.vectors @ basis.vectors.T - np.eye(5)).max() < 1e-15
    assert whitening.identity_error(whitening.whiten(df, basis), basis) < 1e-12


def test_vectors_on_one_line(spark):
    """Only one component has variance."""
    data = [(i, [float(i), 2.0 * i, 0.5]) for i in range(7)]
    df = spark.createDataFrame(data, SCHEMA)
    basis = whitening.fit(df)
    assert basis.eigenvalues == pytest.approx([5 * 1024**2 * 4.0, 0, 0]) and basis.explained == [1.0, 0, 0]
    white = {r.vec_id: r.whitened for r in whitening.whiten(df, basis).collect()}
    assert [abs(white[i][0]) for i in range(7)] == pytest.approx([abs(i - 3) / 2 for i in range(7)]) and white[0][1:] == [None, None]
    assert whitening.identity_error(whitening.whiten(df, basis), basis) < 1e-12


@pytest.fixture
def ran(spark, tmp_path):
    """The query's rows over a given table."""

    def run(rows, schema=SCHEMA, extra=()):
        df = spark.createDataFrame(rows, schema)
        df.withColumns({c: F.lit("x") for c in extra}).coalesce(2).write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
        return whitening.op11_whitening(spark, str(tmp_path)).collect()

    return run


def test_odd_rows(ran):
    nan, inf = float("nan"), float("inf")
    whole = [(1, [0.5, -0.25]), (1, [0.5, -0.25]), (None, [1.0]), (7, [0.125, 3.0]), (8, [])]
    odd = [(2, None), (3, [1.0, None]), (4, [nan, 0.0]), (5, [inf, 0.0]), (6, [-inf, 0.0]), (None, None)]
    got = ran(whole + odd, extra=("n", "at", "v", "whitened", "component"))
    padded = [(i, v + [0.0] * (2 - len(v))) for i, v in whole]
    n, deviation, centred, values, vectors = plain(padded)
    want = centred @ vectors / np.sqrt(values)
    assert len(got) == 2 * n
    told = sorted(((r.vec_id or -1, r.component, r.deviation, round(abs(r.whitened), 6), r.n) for r in got))
    assert told == sorted((i or -1, k + 1, int(deviation[j]), round(abs(want[j, k]), 6), n) for j, (i, _) in enumerate(padded) for k in range(2))


def test_empty_and_alone(ran):
    assert ran([]) == [] and ran([(1, []), (2, None)]) == []
    alone = ran([(1, [3.0, 4.0])])
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 0, None, 0.0, None), (2, 0, None, 0.0, None)]


def test_large_entries(ran):
    """Entries whose products pass 64 bits, and entries beyond 64 bits themselves."""
    rows = [(i, [2.0**40 * (i - 2), 1e300 if i == 4 else float(i)]) for i in range(5)]
    got = ran(rows)
    x = [[1024 * 2**40 * (i - 2) + 100_000, 2**63 - 1 if i == 4 else 1024 * i + 100_000] for i in range(5)]
    sums = [sum(r[k] for r in x) for k in (0, 1)]
    want = [min(2**63 - 1, sum((5 * a - s) ** 2 for a, s in zip(r, sums, strict=True))) for r in x]
    assert [r.deviation for r in sorted(got, key=lambda r: (r.component, r.vec_id))] == want * 2
    assert got[0].identity_error < 1e-9


def test_partial_sums_do_not_depend_on_the_split(spark):
    rng = np.random.default_rng(9)
    data = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    many, one = (whitening.scatter(whitening.complete(spark.createDataFrame(data, SCHEMA).repartition(k), "vec_id", "embedding")) for k in (7, 1))
    assert many == one
