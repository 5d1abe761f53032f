import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.functions import bases, curves, lags


def test_mklag_and_seqlag():
    assert lags.mklag(5) == (0, 5) and lags.mklag(-3) == (-3, 0) and lags.mklag([2, 8]) == (2, 8)
    for bad in ([8, 2], [], [1, 2, 3]):
        with pytest.raises(ValueError):
            lags.mklag(bad)
    assert lags.seqlag([0, 5]) == [0, 1, 2, 3, 4, 5] and lags.seqlag([0, 2], 0.5) == [0, 0.5, 1, 1.5, 2]
    assert lags.seqlag([0, 1], 0.3)[-1] <= 1


def test_logknots():
    assert np.allclose(lags.logknots([0, 21], nk=3), [1.01119279, 2.77947266, 7.63995588])
    assert len(lags.logknots([0, 21])) == 1
    for bad in (dict(x=[0, 0], nk=2), dict(x=[0, 5], nk=0)):
        with pytest.raises(ValueError):
            lags.logknots(**bad)


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate([1, 2, 3, 4, 5])], "t int, x double")


def test_exphist(five):
    got = {(r.t, r.lag): r.x for r in lags.exphist(five, "x", "t", lag=(0, 2)).collect()}
    assert [got[0, k] for k in (0, 1, 2)] == [1, 0, 0] and [got[2, k] for k in (0, 1, 2)] == [3, 2, 1]


def test_exphist_takes_the_nearest_within_half(spark):
    e = spark.createDataFrame([(0.0, 1.0), (0.4, 2.0), (3.0, 5.0)], "t double, x double")
    t = spark.createDataFrame([(0.2,), (1.4,), (3.0,)], "t double")
    got = {(r.t, r.lag): r.x for r in lags.exphist(e, "x", "t", t, (0, 1), -1.0).collect()}
    assert got == {(0.2, 0): 1, (0.2, 1): -1, (1.4, 0): -1, (1.4, 1): 2, (3.0, 0): 5, (3.0, 1): -1}


def test_lag_matrix_and_spine(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 4, 4.0), ("b", 7, None)], "g string, t int, x double")
    full = lags.spine(df, "t", ["g"])
    assert full.count() == 5
    got = {(r.g, r.t): (r.lag0, r.lag3, r.lag_m1) for r in lags.lag_matrix(full, "x", "t", (-1, 3), ["g"]).collect()}
    assert got["a", 4] == (4.0, 1.0, None) and got["a", 3] == (None, None, 4.0)


SPECS = [
    dict(fun="lin"), dict(fun="lin", intercept=True), dict(fun="poly", degree=3), dict(fun="strata", df_=3), dict(fun="strata", breaks=[2, 4], ref=0),
    dict(fun="thr", thr=3), dict(fun="thr", side="l", thr=[2, 3]), dict(fun="thr", side="d", thr=[2, 4]),
    dict(fun="bs", degree=2, df_=5), dict(fun="bs", df_=6, intercept=True), dict(fun="ns", df_=4), dict(fun="ns_trunc", df_=4), dict(fun="ns", knots=[2.5], cen=3.0),
]


@pytest.mark.parametrize("kw", SPECS, ids=str)
def test_columns_equal_numpy(spark, kw):
    x = [1.0, 1.7, 2.0, 3.1, 4.0, 4.9, 5.0]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    spec = bases.fit_basis(df, "x", **kw)
    at = [-1.0, *x, 8.0]
    out = bases.basis_columns(spark.createDataFrame([(v,) for v in at] + [(None,)], "x double"), "x", spec)
    got = np.array([[r[n] if r[n] is not None else np.nan for n in spec.names()] for r in out.collect()], float)
    assert np.allclose(got[:-1], spec.numpy(at)) and (np.isnan(got[-1]).all() or kw["fun"] == "lin" and kw.get("intercept"))


def test_known_values(spark, five):
    assert np.allclose(bases.fit_basis(five, "x", "poly", degree=2).numpy([1, 5]), [[0.2, 0.04], [1, 1]])
    assert bases.fit_basis(five, "x", "lin").bounds == (1, 5)
    with pytest.raises(ValueError):
        bases.fit_basis(five, "x", "thr", side="q")


def test_b_splines_are_a_partition_and_go_on_linearly():
    spec = bases.BasisSpec("bs", 3, (2.0, 3.0), (0.0, 5.0), intercept=True)
    x = np.linspace(0, 5, 41)
    assert np.allclose(spec.numpy(x).sum(1), 1)
    b = spec.numpy([5.0, 6.0, 7.0, -1.0, -2.0, 0.0])
    assert np.allclose(b[2] - b[1], b[1] - b[0]) and np.allclose(b[4] - b[3], b[3] - b[5])
    h = 1e-6
    assert np.allclose(b[1] - b[0], (spec.numpy([5.0]) - spec.numpy([5.0 - h]))[0] / h, atol=1e-4)


def test_natural_splines_are_linear_outside():
    spec = bases.BasisSpec("ns", 1, (1.0, 2.0, 3.0), (0.0, 4.0), intercept=True)
    b = spec.numpy([4.0, 5.0, 6.0, -2.0, -1.0, 0.0])
    assert np.allclose(b[2] - b[1], b[1] - b[0]) and np.allclose(b[5] - b[4], b[4] - b[3])
    assert np.linalg.matrix_rank(spec.numpy(np.linspace(0, 4, 50))) == 5


def test_own_basis_and_report(five):
    spec = bases.fit_basis(five, "x", "own", own=lambda x: [F.log(x), x * x], own_numpy=lambda x: np.column_stack([np.log(x), x * x]))
    got = bases.basis_columns(five, "x", spec).collect()
    assert math.isclose(got[4].b1, math.log(5)) and got[4].b2 == 25
    report = bases.basis_report(five, "x", bases.fit_basis(five, "x", "ns", df_=3))
    assert report["rank"] == 3 and report["extrapolates"]


def test_interpolation_and_agreement(spark):
    c = spark.createDataFrame([(0, 0.0), (10, 5.0)], "t int, x double")
    p = spark.createDataFrame([(0,), (4,), (10,), (12,)], "t int")
    assert {r.t: r.x for r in curves.at_points(c, p, "t", "x").collect()} == {0: 0.0, 4: 2.0, 10: 5.0, 12: None}
    d = spark.createDataFrame([(1.0, 1.0), (2.0, 2.5), (3.0, None)], "a double, b double")
    r = curves.agreement(d, "a", "b").first()
    assert (r.n, r.max_diff, r.mean_diff, r.n_close) == (2, 0.5, 0.25, 1)


def test_quantiles_beyond_one_buffer(spark, monkeypatch):
    """Brackets give the exact quantiles too: ties, a value that a third of all rows have, NULL, NaN and few rows."""
    r = np.random.default_rng(7)
    probs = [0.0, 0.025, 0.1, 1 / 3, 0.5, 0.75, 0.9, 1.0]
    for values in (r.normal(0, 1, 5000), np.r_[np.full(1500, 2.5), r.integers(0, 900, 3000) / 10.0], np.array([3.0, 1.0, 2.0]), np.array([4.0])):
        rows = [(float(v),) for v in values] + [(None,), (float("nan"),)]
        df = spark.createDataFrame(rows, "x double").repartition(3)
        whole = lags.quantiles(df, "x", probs)
        with monkeypatch.context() as m:
            m.setattr(lags, "HELD", 0 if len(values) < 10 else 60)
            assert np.allclose(lags.quantiles(df, "x", probs), np.quantile(values, probs), rtol=1e-12, atol=1e-12)
        assert np.allclose(whole, np.quantile(values, probs), rtol=1e-12, atol=1e-12)
    assert lags.quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == []


def recursion(x, t, p):
    """B-splines at one x inside the bounds, by the definition."""
    last = max(i for i in range(len(t) - 1) if t[i] < t[i + 1])
    b = [float(t[i] <= x < t[i + 1] or (i == last and x == t[i + 1])) for i in range(len(t) - 1)]
    for k in range(1, p + 1):
        share = lambda i: (x - t[i]) / (t[i + k] - t[i]) if t[i + k] > t[i] else 0.0  # noqa: E731, B023
        b = [share(i) * b[i] + (1 - share(i + 1)) * b[i + 1] * (t[i + k + 1] > t[i + 1]) for i in range(len(b) - 1)]
    return b


@pytest.mark.parametrize("degree", [0, 2, 3])
@pytest.mark.parametrize("knots", [(3.0,), (2.0, 5.0, 5.0, 7.0), (0.0, 4.0), tuple(np.linspace(0.4, 9.6, 30))])
def test_splines_by_pieces(spark, degree, knots):
    spec = bases.BasisSpec("bs", degree, knots, (0.0, 10.0), intercept=True)
    x = np.concatenate([np.linspace(0, 10, 41), knots])
    want = np.array([recursion(a, [0.0] * (degree + 1) + list(knots) + [10.0] * (degree + 1), degree) for a in x])
    assert np.allclose(spec.numpy(x), want, atol=1e-10)
    h = 1e-5  # beyond the bounds: the tangent
    for end, away in ((0.0, -3.0), (10.0, 4.0)):
        inner = spec.numpy([end, end + h, end + 2 * h] if end == 0 else [end, end - h, end - 2 * h])
        slope = (-3 * inner[0] + 4 * inner[1] - inner[2]) / (2 * h) * (1 if end == 0 else -1)
        assert np.allclose(spec.numpy([end + away])[0], inner[0] + away * slope, atol=1e-4 * max(1, np.abs(slope).max()))
    rows = spark.createDataFrame([(float(a),) for a in x] + [(None,), (-3.0,), (14.0,)], "x double")
    got = [r.b for r in rows.select("x", F.array(*spec.columns(F.col("x"))).alias("b")).orderBy("x").collect()]
    assert all(v is None for v in got[0])
    assert np.allclose(np.array(got[1:]), spec.numpy(np.sort(np.append(x, [-3.0, 14.0]))), atol=1e-12)


def test_wide_histories(spark):
    """120 lags and 12 splines: code within the limits of generation, NULL for short histories and NULL inside."""
    from lagweave.operators.crossbasis import CrossBasis

    r = np.random.default_rng(3)
    h = r.uniform(0, 10, (6, 120))
    rows = [(i, [float(a) for a in row], i) for i, row in enumerate(h)] + [(6, [1.0] * 119, 6), (7, [1.0] * 119 + [None], 7), (8, None, 8)]
    df = spark.createDataFrame(rows, "id int, h array<double>, extra int")
    cb = CrossBasis(bases.BasisSpec("bs", 3, tuple(np.linspace(1, 9, 9)), (0.0, 10.0)), bases.lag_basis((0, 119), "ns", knots=[5.0, 30.0]), (0, 119))
    out = cb.matrix(df, "h")
    assert out.columns == [*df.columns, *cb.names]
    got = {q.id: [q[n] for n in cb.names] for q in out.collect()}
    c = cb.lag_matrix()
    for i, row in enumerate(h):
        assert np.allclose(got[i], (cb.var.numpy(row).T @ c).ravel(), atol=1e-9)
    assert all(v is None for i in (6, 7, 8) for v in got[i])
