import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.functions import bases
from lagweave.operators import attribution, glm, meta, penalized, predict, seasonality
from lagweave.operators.crossbasis import CrossBasis


@pytest.fixture(scope="module")
def daily(spark):
    r = np.random.default_rng(4)
    x = 15 + 8 * np.sin(np.arange(400) / 60) + r.normal(0, 2, 400)
    y = r.poisson(np.exp(3 + 0.02 * np.abs(x - 18)))
    return spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "t int, x double, y int")


def arrays(df):
    rows = df.orderBy("t").collect()
    return np.array([r.x if r.x is not None else np.nan for r in rows]), np.array([r.y for r in rows])


def brute_cross(cb, x):
    r, c, (lo, hi) = cb.var.numpy(x), cb.lag_matrix(), cb.lag
    out = np.full((len(x), r.shape[1] * c.shape[1]), np.nan)
    for t in range(len(x)):
        at = [t - k for k in range(lo, hi + 1)]
        if min(at) >= 0 and max(at) < len(x) and not np.isnan(r[at]).any():
            out[t] = np.einsum("kv,kl->vl", r[at], c).ravel()
    return out


@pytest.mark.parametrize("lag", [(0, 4), (2, 5), (-2, 1), (0, 0)])
def test_cross_basis_against_loops(daily, lag):
    holes = daily.withColumn("x", F.when(F.col("t") % 50 != 7, F.col("x"))).where("t < 120")
    cb = CrossBasis.fit(holes, "x", lag, {"fun": "bs", "degree": 2, "df_": 4}, {"fun": "poly", "degree": 1})
    got = cb.series(holes, "x", "t").orderBy("t").collect()
    want = brute_cross(cb, arrays(holes)[0])
    mine = np.array([[v if v is not None else np.nan for v in r[1:]] for r in got], float)
    assert np.allclose(mine, want, equal_nan=True) and np.isnan(want).any() == (lag != (9, 9))


@pytest.mark.parametrize("lag", [(0, 4), (2, 5), (-2, 1), (0, 0), (3, 3)])
@pytest.mark.parametrize("na", ["null", "zero"])
def test_cross_basis_by_range_frames_equals_the_spread_one(spark, monkeypatch, lag, na):
    """Blocks of few lags, gaps in time, unknown exposures, times below 0, and a group of one row."""
    from lagweave.operators import crossbasis

    monkeypatch.setattr(crossbasis, "BLOCK_LAGS", 2)
    rows = [("a", t, float(t % 17) if t % 23 else None) for t in range(-40, 90) if t % 31] + [("b", 3, 1.0), (None, 1, 2.0), (None, 2, 5.0)]
    df = spark.createDataFrame(rows, "g string, t int, x double")
    cb = CrossBasis.fit(df, "x", lag, {"fun": "bs", "degree": 2, "df_": 4}, {"fun": "poly", "degree": 1})
    a, b = (sorted(map(tuple, cb.series(df, "x", "t", ["g"], na=na, frame=f).collect()), key=lambda r: (r[0] or "", r[1])) for f in (False, True))
    assert [r[:2] for r in a] == [r[:2] for r in b] and len(a) == len(rows)
    mine, want = (np.array([[np.nan if v is None else v for v in r[2:]] for r in z], float) for z in (a, b))
    assert np.allclose(mine, want, equal_nan=True, atol=1e-12) and not np.isnan(want).all()


def test_cross_basis_shapes_and_groups(spark):
    df = spark.createDataFrame([("a", t, float(t + 1)) for t in range(5)] + [("b", 0, 9.0)], "g string, t int, x double")
    cb = CrossBasis.fit(df, "x", 2, {"fun": "poly", "degree": 2}, {"fun": "poly", "degree": 1})
    assert cb.shape == (2, 2) and CrossBasis.fit(df, "x", 2, {"fun": "poly", "degree": 2}, {"fun": "poly", "degree": 1, "intercept": False}).shape == (2, 1)
    got = {(r.g, r.t): r.v1_l1 for r in cb.series(df, "x", "t", ["g"]).collect()}
    assert got["a", 1] is None and math.isclose(got["a", 2], 6 / 9) and got["b", 0] is None and len(got) == 6
    zero = {(r.g, r.t): r.v1_l1 for r in cb.series(df.withColumn("x", F.when(F.col("t") != 3, F.col("x"))), "x", "t", ["g"], na="zero").collect()}
    assert math.isclose(zero["a", 4], 8 / 9)


def test_cross_basis_of_histories_equals_that_of_the_series(daily):
    cb = CrossBasis.fit(daily, "x", 3, {"fun": "ns", "df_": 3}, {"fun": "ns", "knots": [1.0]})
    from lagweave.functions.lags import lag_matrix

    h = lag_matrix(daily, "x", "t", 3).select("t", F.array(*(f"lag{k}" for k in range(4))).alias("h")).where("t >= 3")
    a = {r.t: r.v3_l2 for r in cb.matrix(h, "h").collect()}
    assert all(math.isclose(a[r.t], r.v3_l2, abs_tol=1e-9) for r in cb.series(daily, "x", "t").where("t >= 3").collect())


@pytest.mark.parametrize("family", ["gaussian", "poisson", "quasipoisson", "gamma", "binomial"])
def test_glm_against_spark_ml(spark, daily, family):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    df = daily.withColumn("u", F.col("x") / 10).withColumn("z", F.sin("t"))
    df = df.withColumn("y", (F.col("y") > 22).cast("int")) if family == "binomial" else df.withColumn("y", F.col("y") + 1)
    got = glm.fit_glm(df, "y", ["u", "z"], family)
    want = GeneralizedLinearRegression(family=family.removeprefix("quasi"), link=got.link, labelCol="y", tol=1e-10, maxIter=60).fit(VectorAssembler(inputCols=["u", "z"], outputCol="features").transform(df))
    assert np.allclose(got.coef, [want.intercept, *want.coefficients], atol=1e-6)
    se = np.roll(want.summary.coefficientStandardErrors, 1) * (math.sqrt(got.dispersion) if family == "quasipoisson" else 1)
    assert np.allclose(np.sqrt(np.diag(got.vcov)), se, rtol=1e-4) and got.converged
    assert got.predict(df.limit(3)).count() == 3 and glm.getlink(got) == got.link
    assert np.allclose(glm.getcoef(got, ["z"]), got.coef[2:]) and glm.getvcov(got, ["z"]).shape == (1, 1)


def test_glm_offset_nulls_and_locations(spark, daily):
    df = daily.withColumn("o", F.log(F.col("t") + 10.0)).withColumn("x", F.when(F.col("t") != 5, F.col("x")))
    x, y = arrays(df)
    ok = ~np.isnan(x)
    beta, v, _, _ = glm.irls(np.column_stack([np.ones(ok.sum()), x[ok]]), y[ok].astype(float), "poisson", np.log(np.arange(400) + 10.0)[ok])
    got = glm.fit_glm(df, "y", ["x"], "poisson", "o")
    assert np.allclose(got.coef, beta, atol=1e-7) and np.allclose(got.vcov, v, rtol=1e-5) and got.n == 399
    by = glm.fit_by(df.withColumn("g", F.col("t") % 2), "g", "y", ["x"]).collect()
    one = glm.fit_glm(df.where("t % 2 = 0"), "y", ["x"], "quasipoisson")
    assert np.allclose(next(r for r in by if r.g == 0).coef, one.coef, atol=1e-7)


@pytest.fixture(scope="module")
def model(daily):
    cb = CrossBasis.fit(daily, "x", 5, {"fun": "bs", "degree": 2, "df_": 4}, {"fun": "ns", "knots": [1.0, 3.0]})
    r = np.random.default_rng(1)
    p = cb.shape[0] * cb.shape[1]
    a = r.normal(size=(p, p)) * 0.05
    return cb, r.normal(size=p) * 0.1, a @ a.T


def test_predictions(spark, daily, model):
    cb, coef, vcov = model
    at = predict.grid(spark, 5.0, 25.0, 2.5)
    x = np.arange(5, 25.1, 2.5)
    d, c = cb.var.numpy(x) - cb.var.numpy([15.0]), cb.lag_matrix()
    each = {(round(r.predvar, 2), r.lag): r for r in predict.crosspred(at, "predvar", cb, coef, vcov, "lag", cen=15.0).collect()}
    overall = {round(r.predvar, 2): r for r in predict.crosspred(at, "predvar", cb, coef, vcov, cen=15.0, ci_level=0.9).collect()}
    cumul = {(round(r.predvar, 2), r.lag): r.fit for r in predict.crosspred(at, "predvar", cb, coef, vcov, "cumul", cen=15.0).collect()}
    for i, v in enumerate(x):
        for k in range(6):
            row = np.kron(d[i], c[k])
            assert math.isclose(each[v, k].fit, row @ coef, abs_tol=1e-10) and math.isclose(each[v, k].se, math.sqrt(row @ vcov @ row), abs_tol=1e-8)
        row = np.kron(d[i], c.sum(0))
        assert math.isclose(overall[v].fit, row @ coef, abs_tol=1e-10) and math.isclose(overall[v].se, math.sqrt(row @ vcov @ row), abs_tol=1e-8)
        assert math.isclose(sum(each[v, k].fit for k in range(6)), cumul[v, 5.0], abs_tol=1e-9)
    assert overall[15.0].rr == 1 and math.isclose(math.log(overall[5.0].rr_high) - overall[5.0].fit, 1.6448536 * overall[5.0].se, rel_tol=1e-6)
    reduced = predict.crosspred(at, "predvar", cb, *predict.crossreduce(cb, coef, vcov), cen=15.0)
    assert all(math.isclose(r.fit, overall[round(r.predvar, 2)].fit, abs_tol=1e-9) for r in reduced.collect())
    with pytest.raises(ValueError):
        predict.crosspred(at, "predvar", cb, coef, vcov, ci_level=2)
    with pytest.raises(ValueError):
        predict.crosspred(at, "predvar", cb, coef[:3], vcov[:3, :3])


def test_optimum_and_centres(spark, daily, model):
    cb, coef, vcov = model
    at = predict.percentile_grid(daily, "x")
    best = predict.find_mmt(at, "predvar", cb, coef, vcov).first()
    curve = predict.crosspred(at, "predvar", cb, coef, vcov).collect()
    assert math.isclose(best.fit, min(r.fit for r in curve))
    x, _ = arrays(daily)
    assert math.isclose(predict.center_value(daily, "x", "percentile_90"), np.percentile(x, 90)) and predict.center_value(daily, "x", 3) == 3
    assert math.isclose(predict.center_value(daily, "x", "mmt", cb, coef, vcov), best.mmt)


def test_attribution(spark, daily, model):
    cb, coef, vcov = model
    x, y = arrays(daily)
    fit = (cb.var.numpy(x) - cb.var.numpy([15.0])) @ predict.crossreduce(cb, coef, vcov)[0]
    an = (1 - np.exp(-fit)) * y
    a = (daily, "x", "y", cb, coef, vcov, 15.0)
    assert math.isclose(attribution.attrdl(*a).first().an, an.sum()) and math.isclose(attribution.attrdl(*a, direction="forw").first().af, an.sum() / y.sum())
    part = attribution.attrdl(*a, range_=(10, 20), sub=F.col("t") < 200).first()
    m = (x >= 10) & (x <= 20) & (np.arange(400) < 200)
    assert math.isclose(part.an, an[m].sum()) and part.cases == y[m].sum()
    hc = attribution.attr_heat_cold(*a).first()
    lo, hi = np.percentile(x, [2.5, 97.5])
    assert math.isclose(hc.an_cold, an[x <= lo].sum(), abs_tol=1e-9) and math.isclose(hc.an_heat + hc.an_cold, hc.an_total, abs_tol=1e-9)
    bands = attribution.attr_by_percentiles(*a).collect()
    edges = {p: np.quantile(x, p / 100) for b in attribution.BANDS for p in b}
    for r in bands:
        lo, hi = (edges[float(p)] for p in r.band.split("-"))
        assert math.isclose(r.an, an[(x >= lo) & (x <= hi)].sum(), rel_tol=1e-6)
    covering = ((0, 2.5), (2.5, 25), (25, 50), (50, 75), (75, 97.5), (97.5, 100))
    bands = attribution.attr_by_percentiles(*a, bands=covering).collect()
    assert len(bands) == 6 and math.isclose(sum(r.an for r in bands), an.sum(), rel_tol=0.05, abs_tol=5)
    ci = attribution.simulated_interval(*a, nsim=400, seed=2).first()
    assert ci.an_low < an.sum() < ci.an_high and ci == attribution.simulated_interval(*a, nsim=400, seed=2).first()
    w = cb.centered(15.0).series(daily, "x", "t").join(daily, "t")
    got = attribution.attrdl_lagged(w, "x", "y", cb, coef).first()
    h = brute_cross(cb.centered(15.0), x)
    ok = ~np.isnan(h).any(1)
    assert math.isclose(got.an, ((1 - np.exp(-(h[ok] @ coef))) * y[ok]).sum(), rel_tol=1e-9)
    none = attribution.attrdl(daily, "x", "y", cb, coef, vcov, 15.0, range_=(99, 100)).first()
    assert none.an is None and none.af is None


def test_meta_analysis():
    r = np.random.default_rng(3)
    k, q = 40, 2
    s = np.stack([np.diag(r.uniform(0.01, 0.05, q)) for _ in range(k)])
    psi = np.array([[0.2, 0.05], [0.05, 0.1]])
    y = np.array([r.multivariate_normal([1, -1], psi + s[i]) for i in range(k)])
    fixed = meta.mvmeta(y, s, method="fixed")
    w = 1 / s[:, 0, 0]
    assert math.isclose(fixed.beta[0, 0], (w * y[:, 0]).sum() / w.sum()) and math.isclose(fixed.vcov[0, 0], 1 / w.sum())
    for method in ("ml", "reml"):
        fit = meta.mvmeta(y, s, method=method)
        assert fit.converged and np.allclose(fit.psi, psi, atol=0.12) and np.allclose(fit.beta, [[1, -1]], atol=0.25)
        est, cov = meta.blup(fit, y, s)
        assert np.linalg.eigvalsh(cov[0]).min() > 0
        inv = np.linalg.inv(np.linalg.inv(s[0]) + np.linalg.inv(fit.psi))
        assert np.allclose(est[0], inv @ (np.linalg.solve(s[0], y[0]) + np.linalg.solve(fit.psi, fit.beta[0]))) and np.allclose(cov[0], inv)
        assert all(0 <= row["p"] <= 1 for row in fit.summary()) and fit.predict()[0].shape == (k, q)
    # One outcome: the closed form of the restricted likelihood is at its optimum in psi.
    one = meta.mvmeta(y[:, 0], s[:, 0, 0])
    like = lambda t: sum(math.log(v + t) for v in s[:, 0, 0]) + math.log(sum(1 / (v + t) for v in s[:, 0, 0])) + sum((a - sum(b / (v + t) for b, v in zip(y[:, 0], s[:, 0, 0])) / sum(1 / (v + t) for v in s[:, 0, 0])) ** 2 / (c + t) for a, c in zip(y[:, 0], s[:, 0, 0]))
    t = one.psi[0, 0]
    assert like(t) <= min(like(t * 1.02), like(t * 0.98)) + 1e-9


def test_multi_location(spark):
    r = np.random.default_rng(6)
    rows = []
    for g in range(6):
        x = r.normal(15 + g, 5, 300)
        rows += [(f"g{g}", t, float(x[t]), int(r.poisson(math.exp(3 + 0.002 * (x[t] - 16) ** 2)))) for t in range(300)]
    df = spark.createDataFrame(rows, "g string, t int, x double, y int")
    cb = CrossBasis.fit(df, "x", 2, {"fun": "poly", "degree": 2}, {"fun": "poly", "degree": 1})
    w = cb.series(df, "x", "t", ["g"]).join(df, ["g", "t"])
    got = meta.multi_location(w, "g", "x", "y", cb, []).collect()
    assert len(got) == 6 and all(12 < row.mmt < 20 for row in got)
    pooled = meta.pooled_mmt(spark.createDataFrame([(row.mmt,) for row in got], "mmt double")).first()
    assert math.isclose(pooled.mean_mmt, np.mean([row.mmt for row in got]))
    with pytest.raises(ValueError):
        meta.multi_location(w.where("g = 'g0'"), "g", "x", "y", cb, [])


def test_locations_that_do_not_converge_are_told(spark):
    r = np.random.default_rng(2)
    rows = [(f"g{g}", t, float(r.normal(15 + g + 0.3 * (g % 2) * t / 50, 4 + g % 3)), int(r.poisson(30))) for g in range(4) for t in range(200)]
    rows += [("short", t, 10.0 + t, 5) for t in range(4)]
    df = spark.createDataFrame(rows, "g string, t int, x double, y int")
    cb = CrossBasis.fit(df, "x", 1, {"fun": "poly", "degree": 2}, {"fun": "poly", "degree": 1})
    w = cb.series(df, "x", "t", ["g"]).join(df, ["g", "t"])
    got = {x.g: x for x in meta.multi_location(w, "g", "x", "y", cb, []).collect()}
    assert len(got) == 5 and not got["short"].converged and got["short"].blup is None and all(got[f"g{i}"].mmt for i in range(4))
    assert meta.location_summary(spark.createDataFrame(list(got.values()), "g string, converged boolean, coef array<double>, blup array<double>, shrinkage double, mmt double, pct int")).first().n_converged == 4
    few = w.where("g in ('g0', 'g1', 'short')")
    with pytest.raises(ValueError, match="predictors"):
        meta.multi_location(few, "g", "x", "y", cb, [])
    assert meta.multi_location(few, "g", "x", "y", cb, [], predictors=()).count() == 3


def test_flagship_by_numpy(spark):
    """The whole model against dense iterations in numpy: 8 df a year, day of the week, lags up to 21."""
    from lagweave.functions import bases
    from lagweave.operators import dlnm
    from lagweave.plans import catalogue

    s, m = catalogue.flagship_fit(spark, "/root/testdata/sf0.01")
    rows = s.orderBy("t").collect()
    t, x, y = (np.array([np.nan if r[c] is None else r[c] for r in rows], float) for c in ("t", "x", "y"))
    r, c = m.cb.var.numpy(x), m.cb.lags.numpy(np.arange(22))
    w = np.full((len(x), r.shape[1] * c.shape[1]), np.nan)
    for i in range(21, len(x)):
        w[i] = (r[i - np.arange(22)].T @ c).ravel()
    years = len({x.d.year for x in rows})
    k = np.quantile(t, np.arange(1, 8 * years) / (8 * years))
    spec = bases.BasisSpec("ns", knots=tuple(k), bounds=(t.min(), t.max()))
    days = np.array([[float(q.d.weekday() == d) for d in range(1, 7)] for q in rows])
    full = np.column_stack([np.ones(len(x)), w, days, spec.numpy(t)])
    ok = ~np.isnan(full).any(1)
    full, yy = full[ok], y[ok]
    assert full.shape[1] == len(m.fit.names) == 1 + w.shape[1] + 6 + 8 * years
    scale = np.abs(full).max(0)
    eta = np.log(yy + 0.1)
    for _ in range(40):
        mu = np.exp(eta)
        sw = np.sqrt(mu)
        beta = np.linalg.lstsq(full / scale * sw[:, None], sw * (eta + (yy - mu) / mu), rcond=None)[0]
        eta = full / scale @ beta
    mu = np.exp(eta)
    p = np.column_stack([np.ones(99), np.quantile(x[~np.isnan(x)], np.arange(1, 100) / 100)])[:, 1]
    cen = np.median(x[~np.isnan(x)])
    want = (m.cb.var.numpy(p) - m.cb.var.numpy([cen])) @ (np.kron(np.eye(r.shape[1]), c.sum(0)[None, :]) @ (beta / scale)[1 : 1 + w.shape[1]])
    got = (m.cb.var.numpy(p) - m.cb.var.numpy([cen])) @ m.coef
    assert np.allclose(got, want, atol=1e-6) and m.fit.converged
    assert math.isclose(m.fit.dispersion, ((yy - mu) ** 2 / mu).sum() / (len(yy) - np.linalg.matrix_rank(full / scale)), rel_tol=1e-6)
    by = dlnm.fit_dlnm(s.withColumn("g", F.lit("one")), m.cb, "x", "y", "t", date="d", dfseas=8, dow=True, by="g").first()
    assert np.allclose(by.coef, m.coef, atol=1e-6) and by.converged
    s.unpersist()


def test_unpenalised_fits_equal_glms(spark, daily):
    cb = CrossBasis.fit(daily, "x", 2, {"fun": "poly", "degree": 2}, {"fun": "poly", "degree": 1})
    w = cb.series(daily, "x", "t").join(daily.select("t", "y"), "t").withColumn("b", (F.col("y") > 23).cast("int")).withColumn("p", F.col("y") + 0.5)
    for family, y in (("gaussian", "y"), ("poisson", "y"), ("quasipoisson", "y"), ("gamma", "p"), ("binomial", "b")):
        got, want = penalized.fit_penalised(w, y, cb, lam=(0.0, 0.0), family=family).fit, glm.fit_glm(w, y, cb.names, family, tol=1e-13)
        assert got.link == want.link and got.converged and np.allclose(got.coef, want.coef, rtol=1e-4, atol=1e-6)
        assert np.allclose(got.vcov, want.vcov, rtol=1e-3, atol=1e-9) and math.isclose(got.dispersion, want.dispersion, rel_tol=1e-4)


def test_b_splines_of_a_constant(spark):
    from lagweave.functions import bases

    df = spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double")
    spec = bases.fit_basis(df, "x", "bs", df_=5, intercept=True)
    rows = [[*r][1:] for r in bases.basis_columns(df, "x", spec).where("x is not null").collect()]
    assert np.allclose(np.sum(rows, 1), 1) and np.allclose(rows, spec.numpy([2.0, 2.0]))


def test_seasonality(spark, daily):
    got = seasonality.decompose(daily, "x", "t", 1, 377.0).orderBy("t").collect()
    x, _ = arrays(daily)
    t = np.arange(400)
    m = np.column_stack([np.ones(400), t, np.sin(2 * np.pi * t / 377), np.cos(2 * np.pi * t / 377)])
    res = x - m @ np.linalg.lstsq(m, x, rcond=None)[0]
    assert np.allclose([r.residual for r in got], res, atol=1e-6)
    table = {r.config: r for r in seasonality.compare(daily, "x", "t", period=377.0).collect()}
    c2 = m[:, [0, 2, 3]]
    rss = ((x - c2 @ np.linalg.lstsq(c2, x, rcond=None)[0]) ** 2).sum()
    assert math.isclose(table["harmonic1"].aic, 400 * math.log(rss / 400) + 8, rel_tol=1e-9) and seasonality.best(daily, "x", "t") in table


def test_seasonal_methods(spark, daily):
    parts = [{"type": "harmonic", "n_harmonics": 1}, {"type": "spline", "n_df": 5, "fun": "ns"}]
    for method, kw in (("spline", {"n_df": 5}), ("flexible", {"components": parts})):
        cols = seasonality.seasonal_basis(F.col("t"), method, period=120.0, **kw)
        rows = daily.orderBy("t").select(*(c.alias(k) for k, c in cols.items())).collect()
        m = np.column_stack([np.ones(400), np.arange(400), np.array([[*r] for r in rows])])
        x, _ = arrays(daily)
        beta = np.linalg.lstsq(m, x, rcond=None)[0]
        got = seasonality.decompose(daily, "x", "t", period=120.0, method=method, effects=True, **kw).orderBy("t").collect()
        assert np.allclose([r.residual for r in got], x - m @ beta, atol=1e-6)
        assert np.allclose([r.seasonal for r in got], m[:, 2:] @ beta[2:], atol=1e-6)
        assert np.allclose([sum(r[f"effect_{k}"] for k in cols) for r in got], [r.seasonal for r in got], atol=1e-9)
    with pytest.raises(ValueError):
        seasonality.seasonal_basis(F.col("t"), "wavelet")
    table = seasonality.compare(daily, "x", "t").collect()
    assert len(table) == 12 and seasonality.best(daily, "x", "t", "r2") == max(table, key=lambda r: (r.r2, r.config)).config


def test_ridge_has_zero_gradient(spark, daily):
    for family in ("poisson", "gaussian"):
        fit = glm.fit_glm(daily, "y", ["x"], family, ridge=0.3, tol=1e-14)
        x, y = arrays(daily)
        eta = fit.coef[0] + fit.coef[1] * x
        mu = np.exp(eta) if family == "poisson" else eta
        assert abs((y - mu).sum()) < 1e-5 * y.sum()
        assert math.isclose((x * (y - mu)).mean(), 0.3 * fit.coef[1], rel_tol=1e-4, abs_tol=1e-6)
        assert abs(fit.coef[1]) < abs(glm.fit_glm(daily, "y", ["x"], family).coef[1])


def test_penalised(spark, daily):
    cb = CrossBasis.fit(daily, "x", 4, {"fun": "bs", "df_": 6}, {"fun": "bs", "degree": 2, "df_": 4, "knots": [2.0]})
    w = cb.series(daily, "x", "t").join(daily.select("t", "y"), "t")
    got = penalized.fit_penalised(w, "y", cb, lam=(2.0, 3.0))
    rows = w.na.drop().orderBy("t").collect()
    x = np.array([[1.0, *(r[n] for n in cb.names)] for r in rows])
    y = np.array([r.y for r in rows], float)
    pen = np.zeros((x.shape[1],) * 2)
    pen[1:, 1:] = penalized.combined(cb, 2.0, 3.0)
    a = x.T @ x + pen
    beta = np.linalg.solve(a, x.T @ y)
    edf = np.trace(np.linalg.solve(a, x.T @ x))
    rss = ((y - x @ beta) ** 2).sum()
    assert np.allclose(got.fit.coef, beta, atol=1e-5) and math.isclose(got.edf, edf, rel_tol=1e-6) and math.isclose(got.criterion, rss / len(y) / (1 - edf / len(y)) ** 2, rel_tol=1e-6)
    for method in ("gcv", "aic", "reml"):
        auto = penalized.fit_penalised(w, "y", cb, method=method)
        assert method == "reml" or auto.criterion <= penalized.fit_penalised(w, "y", cb, method=method, lam=(1.0, 1.0)).criterion + 1e-9
    assert penalized.fit_penalised(w, "y", cb, lam=(5.0, 5.0), family="poisson").edf < x.shape[1]
    assert np.allclose(penalized.penalty(4, "difference", 1), [[1, -1, 0, 0], [-1, 2, -1, 0], [0, -1, 2, -1], [0, 0, -1, 1]])
    assert np.allclose(penalized.penalty(2), np.eye(2)) and np.allclose(penalized.penalty(3, "ridge"), np.eye(3))


def test_smooth_spline_and_penalty_kinds(spark, daily):
    basis = penalized.smooth_spline_basis(daily, "x", lam=7.0, df_=5)
    fit = penalized.fit_smooth(daily, "x", "y", basis)
    x, y = arrays(daily)
    m = np.column_stack([np.ones(len(x)), basis.spec.numpy(x)])
    pen = np.zeros((m.shape[1],) * 2)
    d = np.diff(np.eye(basis.spec.size), 2, axis=0)
    pen[1:, 1:] = 7.0 * d.T @ d
    assert np.allclose(fit.coef, np.linalg.solve(m.T @ m + pen, m.T @ y), atol=1e-5)
    cb = CrossBasis.fit(daily, "x", 4, {"fun": "bs", "df_": 6}, {"fun": "poly", "degree": 3})
    v, n = cb.shape
    d = np.diff(np.eye(n), 1, axis=0)
    want = 2.0 * np.eye(v * n) + 3.0 * np.kron(np.eye(v), d.T @ d)
    assert np.allclose(penalized.combined(cb, 2.0, 3.0, ("ridge", "difference"), (2, 1)), want)
    got = penalized.fit_penalised(cb.series(daily, "x", "t").join(daily.select("t", "y"), "t"), "y", cb, lam=(2.0, 6.0))
    about = got.smoothing()
    assert math.isclose(about["edf_var"] + about["edf_lag"], got.edf) and math.isclose(about["edf_var"], got.edf * 0.75) and 0 < about["r2"] < 1
    at = got.predict(daily.select("x"), "x", cb, cen=15.0).first()
    assert math.isclose(at.high - at.low, 2 * 1.959963984540054 * at.se, rel_tol=1e-9)


def test_reports(spark, daily, model):
    cb, coef, vcov = model
    two = daily.withColumn("city", F.when(F.col("t") < 200, "a").otherwise("b")).unionByName(daily.limit(3).select("t", F.lit(None).cast("double").alias("x"), "y", F.lit("none").alias("city")))
    spec = bases.BasisSpec("poly", 2, scale=10.0)
    coefs = two.select("city").distinct().withColumn("coef", F.array(F.lit(-3.0), F.lit(1.0)))
    rows = {r.city: r for r in meta.location_report(two, "city", "x", "y", spec, coefs).collect()}
    assert rows["none"].mmt is None and rows["none"].n_days == 3 and rows["none"].rr_hot is None
    for c, part in (("a", slice(0, 200)), ("b", slice(200, 400))):
        q = np.percentile(arrays(daily)[0][part], np.arange(1, 100))
        f = -3 * q / 10 + (q / 10) ** 2
        k = f.argmin()
        got = rows[c]
        assert got.pct == k + 1 and np.allclose([got.mmt, got.rr_cold, got.rr_hot], [q[k], np.exp(f[: k + 1].max() - f[k]), np.exp(f[k:].max() - f[k])])
    report = {r.part: r for r in attribution.attribution_report(daily, "x", "y", cb, coef, vcov).collect()}
    whole = attribution.attrdl(daily, "x", "y", cb, coef, vcov, report["total"].cen).first()
    assert math.isclose(report["total"].an, whole.an) and report["total"].n_rows == 400 and {"cold", "heat", "0-1", "99-100"} <= set(report)
    named = {r.term: r for r in glm.fit_glm(daily, "y", ["x"], "gaussian").summary(spark).collect()}
    assert math.isclose(named["x"].z, named["x"].coef / named["x"].se) and 0 <= named["x"].p <= 1
