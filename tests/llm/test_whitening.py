"""Whitening against numpy on all rows at once, and on odd rows."""

import numpy as np
import pytest

from corvane.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, component int, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], SCHEMA).repartition(5)


def check(got, good):
    """got: rows of whiten; good: (id, float32 vector) pairs that remain, in any order."""
    x = np.floor(np.array([v for _, v in good], np.float32).astype(float) * 1024) + 100_000
    n, k = len(x), min(8, x.shape[1])
    assert len(got) == n * k
    c = x - x.mean(0)
    values = np.linalg.eigvalsh(c.T @ c / n)[::-1]
    s = x.astype(np.int64).sum(0)
    deviation = ((n * x.astype(np.int64) - s) ** 2).sum(1)
    want = sorted(zip([i for i, _ in good], deviation.tolist()), key=str)
    assert sorted({(r.vec_id, r.deviation) for r in got}, key=str) == sorted(set(want), key=str)
    assert all(r.n == n and r.deviation_exact == r.deviation for r in got)
    for j in range(k):
        mine = [r for r in got if r.component == j + 1]
        assert len({r.explained for r in mine}) == 1 and mine[0].explained == pytest.approx(values[j] / values.sum(), rel=1e-9)
        w = np.array([r.whitened for r in mine])
        assert abs(w.mean()) < 1e-9 and abs((w * w).mean() - 1) < 1e-9
    assert {r.identity_error < 1e-9 for r in got} == {True} and len({r.identity_error for r in got}) == 1


def test_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = whitening.whiten(table(spark, rows)).collect()
    check(got, rows)
    # one projection for all rows: whitened distances are Mahalanobis ones, which have no sign
    w = np.zeros((700, 8))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
    f = np.floor(x.astype(float) * 1024)
    c = f - f.mean(0)
    values, axes = np.linalg.eigh(c.T @ c / 700)
    want = c @ axes[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    assert np.allclose(w @ w.T, want @ want.T, atol=1e-6)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=9).astype(np.float32).tolist()) for i in range(40)]
    good += [good[3], good[3], (None, good[4][1])]
    bad = [(90, None), (91, [float("nan")] * 9), (92, [1.0] * 8 + [None]), (93, [float("inf")] + [1.0] * 8), (94, [])]
    got = whitening.whiten(table(spark, good + bad)).collect()
    check(got, good)
    assert not {r.vec_id for r in got} & {i for i, _ in bad}


def test_lengths_are_fitted_apart(spark):
    rng = np.random.default_rng(2)
    a = [(i, rng.normal(size=9).astype(np.float32).tolist()) for i in range(30)]
    b = [(100 + i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(20)]
    got = whitening.whiten(table(spark, a + b)).collect()
    check([r for r in got if r.vec_id < 100], a)
    check([r for r in got if r.vec_id >= 100], b)


def test_without_variance(spark):
    got = whitening.whiten(table(spark, [(1, [0.5, 1.0])])).collect()
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in got] == [(None, 0.0, 0, 0.0)] * 2
    flat = whitening.whiten(table(spark, [(i, [0.5, float(i)]) for i in range(4)])).collect()
    assert {r.component: r.whitened is None for r in flat} == {1: False, 2: True}
    assert {r.explained for r in flat} == {1.0, 0.0}


def test_numbers_beyond_a_long(spark):
    got = whitening.whiten(table(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 0.0])])).collect()
    x = np.array([[1 << 62, 101024], [-(1 << 62), 102048], [100000, 100000]], object)
    want = [int(s) for s in ((x * 3 - x.sum(0)) ** 2).sum(1)]
    assert {(r.vec_id, r.deviation) for r in got} == {(i, d if d < 1 << 63 else None) for i, d in enumerate(want, 1)}
    assert {(r.vec_id, int(r.deviation_exact) if r.deviation_exact is not None else None) for r in got} == {(i, d if d < 10**38 else None) for i, d in enumerate(want, 1)}


def test_deviation_by_limbs():
    rng = np.random.default_rng(3)
    x = rng.integers(99_000, 101_000, size=(50, 64))
    f = whitening.Fit(10**9, [int(v) * 10**7 for v in x.sum(0)], None, None, None)
    want = [sum((10**9 * int(v) - s) ** 2 for v, s in zip(row, f.sums)) for row in x]
    assert f.deviations(x) == want and max(want) > 1 << 63


def test_empty(spark):
    got = whitening.whiten(table(spark, []))
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0
