import math

import numpy as np
import pytest

from graphloom.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, x int, n int"


def brute(rows):
    """Kept rows and the covariance's leading eigenpairs, by numpy on all of it."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(v) for _, v in kept)
    kept = [(i, v + [0] * (d - len(v))) for i, v in kept]
    x = np.array(sorted({tuple(v) for _, v in kept}), float)
    mean = x.mean(0)
    e, parts = np.linalg.eigh((x - mean).T @ (x - mean) / len(x))
    return kept, x, mean, e[::-1], parts[:, ::-1]


def check(spark, rows, components=4):
    found = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    kept, x, mean, e, parts = brute(rows)
    n, sums = len(x), [int(s) for s in x.sum(0)]
    assert sorted(r.vec_id is None for r in found) == sorted(i is None for i, _ in kept for _ in range(components)) and len(found) == components * len(kept)
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in kept}
    for r in found:
        assert r.n == n and 0 <= r.identity_error <= 1e-9 and r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
    for c in range(1, components + 1):
        mine = {r.vec_id: r for r in found if r.component == c and r.vec_id is not None}
        want = {i: (np.array(v) - mean) @ parts[:, c - 1] / np.sqrt(e[c - 1]) for i, v in kept if i is not None}
        sign = np.sign(sum(mine[i].whitened * want[i] for i in want))
        for i in want:
            assert mine[i].deviation == deviation[i] and mine[i].whitened == pytest.approx(sign * want[i], abs=1e-8)


def test_equals_numpy(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(400, 24)) * np.linspace(3, 0.2, 24)
    rows = [(i, [float(c) for c in v], 1, None, None) for i, v in enumerate(a)]
    rows += [(1000 + i, rows[7][1], 1, None, None) for i in range(300)]  # copies count once in the fit
    rows += [(2000, None, 1, None, None), (2001, [1.0, None], 1, None, None), (2002, [float("nan")] * 24, 1, None, None), (2003, [float("inf")] + [0.0] * 23, 1, None, None),
             (2004, [1e300] * 24, 1, None, None), (2005, [0.5] * 9, 1, None, None), (2006, [], 1, None, None), (None, rows[3][1], 1, None, None)]
    check(spark, [r for r in rows if r[0] != 2004])
    assert not [r for r in whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect() if r.vec_id in (2000, 2001, 2002, 2003, 2004)]


def test_narrow_basis_is_enough_where_variance_falls(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(500, 40)) * np.array([40, 20, 10, 5] + [0.05] * 36)
    rows = [(i, [float(c) for c in v], 0, 0, 0) for i, v in enumerate(a)]
    model = whitening.fit(whitening.scaled(spark.createDataFrame(rows, SCHEMA)))
    assert model.width == 12
    check(spark, rows)


def test_flat_spectrum_widens_to_the_whole_space(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in v], 0, 0, 0) for i, v in enumerate(rng.normal(size=(300, 30)))]
    assert whitening.fit(whitening.scaled(spark.createDataFrame(rows, SCHEMA))).width == 30


def test_without_variance(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert whitening.whitened(frame([])).count() == 0
    assert whitening.whitened(frame([(1, [1.0, 2.0], 0, 0, 0)] * 5)).count() == 0
    assert whitening.whitened(frame([(1, [], 0, 0, 0)])).count() == 0
    line = [(i, [float(i), 2.0 * i, 1.0], 0, 0, 0) for i in range(9)]
    assert {r.component for r in whitening.whitened(frame(line)).collect()} == {1}


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [1e12 * (i + 1), float(i)], 0, 0, 0) for i in range(4)]
    found = {r.vec_id: r.deviation for r in whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == dict.fromkeys(range(4))
