"""Whitening against exact fractions and a plain double solution."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows):
    """(vec_id, x) kept, sums and the exact covariance."""
    kept = [(i, [int(np.floor(1024 * float(c))) + 100_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    n, x = len(kept), np.array([k[1] for k in kept], dtype=object)
    sums = x.sum(axis=0)
    off = n * x - sums
    return kept, sums, off, off.T @ off


def check(found, rows):
    kept, sums, off, square = plain(rows)
    n, d = off.shape
    cov = np.array([[float(Fraction(int(v), n**3)) for v in row] for row in square])
    values = np.linalg.eigvalsh(cov)[::-1]
    assert len(found) == len(kept) * min(8, d)
    want = sorted((i, int((o * o).sum())) for (i, _), o in zip(kept, off))
    by = {}
    for r in found:
        by.setdefault(r.component, []).append(r)
    whitened = {}
    for c, own in by.items():
        assert sorted((r.vec_id, int(r.deviation_exact)) for r in own) == want
        assert all(r.n == n and np.isclose(r.explained, values[c - 1] / np.trace(cov), rtol=1e-9) and r.identity_error < 1e-9 for r in own)
        assert all(r.deviation == int(r.deviation_exact) for r in own if int(r.deviation_exact) < 1 << 63)
        whitened[c] = {r.vec_id: r.whitened for r in own}
    y = np.array([[whitened[c][i] for c in sorted(whitened)] for i, _ in kept])
    assert np.abs(y.T @ y / n - np.eye(y.shape[1])).max() < 1e-9
    # Each component is an eigenvector: the covariance of x with it is the eigenvalue's root times the vector.
    x = off.astype(float) / n
    for k in range(y.shape[1]):
        v = x.T @ y[:, k] / n / np.sqrt(values[k])
        assert np.isclose(v @ v, 1) and np.allclose(cov @ v, values[k] * v, rtol=0, atol=1e-9 * values[0])


def test_products_and_sums_are_exact():
    draw = np.random.default_rng(2)
    a, b = draw.normal(size=500) * 10.0 ** draw.integers(-8, 8, 500), draw.normal(size=500)
    for f, exact in ((whitening.two_sum, lambda x, y: Fraction(x) + Fraction(y)), (whitening.two_product, lambda x, y: Fraction(x) * Fraction(y))):
        for s, e, x, y in zip(*f(a, b), a, b):
            assert Fraction(float(s)) + Fraction(float(e)) == exact(float(x), float(y))
    high, low = whitening.outer_sum(a[:, None] * 1e8, np.zeros((500, 1)))
    want = sum(Fraction(float(x)) ** 2 for x in a * 1e8)
    assert abs(Fraction(float(high[0])) + Fraction(float(low[0])) - want) / want < Fraction(1, 2**95)


def test_a_large_mean_loses_nothing(spark):
    """Entries of 10^9 with a spread of some thousandths: plain sums of squares in doubles would give noise."""
    draw = np.random.default_rng(5)
    rows = [(k, [float(1e9 + v) for v in draw.integers(-3, 4, 3) / 1024]) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    check(whitening.whiten(df).collect(), rows)


def test_rows_that_take_no_part_and_clashing_names(spark):
    draw = np.random.default_rng(7)
    rows = [(k, [float(np.float32(v)) for v in draw.normal(size=5)]) for k in range(60)]
    odd = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, [float("nan")] * 5), (904, [float("inf")] * 5), (None, rows[0][1]), (3, rows[3][1]), (2**60 + 1, rows[4][1])]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumns({c: F.lit(1) for c in ("x", "Component", "n", "Y", "deviation")})
    found = whitening.whiten(df).collect()
    kept = rows + odd[5:]
    assert sorted({r.vec_id for r in found}, key=str) == sorted({i for i, _ in kept}, key=str)
    check([r for r in whitening.whiten(df.where("vec_id < 900")).collect()], rows + odd[6:7])
    short = df.unionByName(spark.createDataFrame([(950, [1.0, 2.0])], SCHEMA), allowMissingColumns=True)
    assert {r.vec_id for r in whitening.whiten(short).collect()} == {i for i, _ in kept}


def test_no_rows_one_row_equal_rows_and_dependent_dimensions(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    for rows in ([(1, [1.0, 2.0])], [(k, [0.5, 0.25]) for k in range(9)]):
        found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
        assert len(found) == 2 * len(rows) and all((r.whitened, r.explained, r.identity_error, r.deviation) == (None, 0.0, 0.0, 0) for r in found)
    found = whitening.whiten(spark.createDataFrame([(k, [float(k), float(2 * k), 1.0]) for k in range(50)], SCHEMA)).collect()
    assert {r.component: r.whitened is None for r in found} == {1: False, 2: True, 3: True}
    assert all(r.identity_error < 1e-12 for r in found)


def test_sums_past_64_bits(spark):
    rows = [(k, [2.0**30 * (k % 7), 2.0**29 * k]) for k in range(40)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    check(found, rows)
    assert any(r.deviation is None for r in found)


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_whole_query(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(queries.op13_embedding_whitening(spark, folder).collect(), rows)
