"""Models of many locations: own seasonality, offsets and knots, blocks of rows, quantiles by cells, meta-analysis."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.functions import groups
from lagweave.functions.bases import BasisSpec, lag_basis
from lagweave.functions.lags import quantiles
from lagweave.functions.season import Season, season_columns
from lagweave.operators import dlnm, glm, grouped, meta
from lagweave.operators.crossbasis import CrossBasis


@pytest.fixture(scope="module")
def two(spark):
    """Two locations: one year of 2001, and two and a half years from 2011 on; counts follow exposure, season, people."""
    r, rows = np.random.default_rng(3), []
    for g, first, days, people in (("a", 11323, 365, 1.0), ("b", 14975, 912, 4.0)):
        for i in range(days):
            x = 15 + 8 * math.sin(2 * math.pi * i / 365) + r.normal(0, 3)
            o = math.log(people * (1 + 0.3 * math.sin(i / 50)))
            rows.append((g, first + i, float(x) if i % 97 else None, int(r.poisson(math.exp(2 + 0.03 * x + o))), float(o)))
    df = spark.createDataFrame(rows, "g string, t int, x double, y int, o double")
    return df.withColumn("d", F.date_add(F.lit("1970-01-01").cast("date"), F.col("t"))).cache()


@pytest.fixture(scope="module")
def cb():
    return CrossBasis(BasisSpec("bs", 2, (12.0, 20.0), (0.0, 32.0)), lag_basis(3, "poly", degree=1), (0, 3))


OPTIONS = {"date": "d", "dfseas": 4, "dow": True, "offset": "o"}


def test_locations_have_their_own_season_and_offset(two, cb):
    by = {r.g: r for r in dlnm.fit_dlnm(two, cb, "x", "y", "t", by="g", **OPTIONS).collect()}
    plain = {r.g: r for r in dlnm.fit_dlnm(two, cb, "x", "y", "t", by="g", **(OPTIONS | {"offset": None})).collect()}
    for g in ("a", "b"):
        one = dlnm.fit_dlnm(two.where(F.col("g") == g), cb, "x", "y", "t", **OPTIONS)
        assert by[g].converged and by[g].n == one.fit.n
        assert np.allclose(by[g].coef, one.coef, rtol=1e-6, atol=1e-8) and np.allclose(np.reshape(by[g].vcov, one.vcov.shape), one.vcov, rtol=1e-5, atol=1e-9)
        assert not np.allclose(by[g].coef, plain[g].coef, rtol=1e-3)
    assert sum(n.startswith("season") for n in one.fit.names) == 12  # 2011, 2012 and 2013


def test_single_fit_predicts_with_its_offset(two):
    fit = glm.fit_glm(two.na.drop(), "y", ["x"], "poisson", "o")
    r = fit.predict(two.na.drop()).agg(F.sum("fitted").alias("f"), F.sum("y").alias("y")).first()
    assert r.f == pytest.approx(r.y, rel=1e-7)


def full(two, cb):
    w, more = dlnm.design(two, cb, "x", "t", date="d", dow=True, by=["g"])
    return w, [*cb.names, *more]


@pytest.mark.parametrize("rows", [100, 4096])
def test_blocks_equal_one_task(monkeypatch, two, cb, rows):
    monkeypatch.setattr(grouped, "ROWS", rows)
    w, names = full(two, cb)
    w = w.unionByName(w.where("g = 'a' and t < 11340").withColumn("g", F.lit("few"))).unionByName(w.where("g = 'a'").limit(5).withColumn("g", F.lit(None).cast("string")))
    form = dlnm.reduction(cb, len(names) - len(cb.names))
    more = {"form": form, "offset": "o", "season": Season("t", "d", 4)}
    want = {r.g: r for r in glm.fit_by(w, "g", "y", names, **more).collect()}
    got = {r.g: r for r in grouped.fit_blocks(w, "g", "y", names, **more).collect()}
    assert set(got) == set(want) == {"a", "b", "few", None}
    for g, r in want.items():
        assert (got[g].n, got[g].converged) == (r.n, r.converged)
        assert (got[g].coef, got[g].vcov, got[g].dispersion) == (r.coef, r.vcov, r.dispersion) if None in r.coef else np.allclose(got[g].coef, r.coef, rtol=1e-7, atol=1e-9) and np.allclose(got[g].vcov, r.vcov, rtol=1e-6, atol=1e-10)
    assert not want["few"].converged and want["b"].converged


def test_blocks_hold_a_bounded_number_of_rows(monkeypatch, two):
    monkeypatch.setattr(grouped, "ROWS", 64)
    got = [len(r.m) // 16 for r in grouped.blocks(two, "g", [F.col("x"), F.col("y")], "t").collect()]
    assert sum(got) == two.where("x is not null").count() and max(got) <= 64 and len(got) > 15
    none = two.where("g = 'none'")
    assert grouped.fit_blocks(none, "g", "y", ["x"]).count() == 0


def test_dispatch_goes_by_rows(monkeypatch, two):
    asked = []
    monkeypatch.setattr(grouped, "fit_by", lambda *a, **k: asked.append("by"))
    monkeypatch.setattr(grouped, "fit_blocks", lambda *a, **k: asked.append("blocks"))
    grouped.fit_locations(two, "g", "y", ["x"], held=912)
    grouped.fit_locations(two, "g", "y", ["x"], held=911)
    assert asked == ["by", "blocks"]


@pytest.mark.parametrize("held", [groups.HELD, 100, 7])
def test_quantiles_by(spark, held):
    r = np.random.default_rng(8)
    data = {"a": np.exp(r.normal(0, 4, 700)), "b": np.round(r.normal(0, 2, 500)), "one": np.full(300, 2.5), "c": r.normal(0, 1, 3), None: r.normal(5, 1e-9, 150)}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None), ("a", math.nan), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    probs = [0.0, 0.013, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {x.g: x for x in groups.quantiles_by(df, ["g"], "x", probs, [F.count("*").alias("rows")], held=held).collect()}
    assert set(got) == {*data, "none"} and got["none"].q is None and got["none"].n == 0 and got["a"].rows == 702
    for g, vs in data.items():
        assert got[g].n == len(vs) and np.allclose(got[g].q, np.quantile(vs, probs), rtol=1e-14, atol=0)


def test_season_table_equals_one_series(two):
    s = Season("t", "d", 4)
    for held in (groups.HELD, 50):
        got = {r.g: r.ends for r in s.table(two, ["g"], held=held).collect()}
        assert len(got["a"]) == 5 and len(got["b"]) == 13
        for g, years in (("a", 1), ("b", 3)):
            t = np.array([r.t for r in two.where(F.col("g") == g).collect()], float)
            assert np.allclose(got[g], s.knots(t, years), rtol=1e-14)
            assert season_columns(got[g], t).shape == (len(t), len(got[g]) - 1)


def test_own_knots(two, cb):
    """A model with knots at a location's own quantiles is the one fitted to it alone with these knots."""
    by = {r.g: r for r in dlnm.fit_dlnm(two, cb, "x", "y", "t", by="g", knots_at=[0.25, 0.75], **OPTIONS).collect()}
    for g in ("a", "b"):
        own = two.where(F.col("g") == g)
        lo, k1, k2, hi = quantiles(own, "x", [0.0, 0.25, 0.75, 1.0])
        alone = CrossBasis(BasisSpec("bs", 2, (k1, k2), (lo, hi)), cb.lags, cb.lag)
        one = dlnm.fit_dlnm(own, alone, "x", "y", "t", **OPTIONS)
        assert np.allclose(by[g].coef, one.coef, rtol=1e-6, atol=1e-8)


def bfgs(f, x, rounds=400):
    """Minimum of f by differences, to compare with."""
    def gradient(x):
        h = 1e-5 * np.maximum(1, np.abs(x))
        return np.array([(f(x + e) - f(x - e)) / (2 * e.max()) for e in np.diag(h)])

    x, hess = np.asarray(x, float), np.eye(len(x))
    g, now = gradient(x), f(x)
    for _ in range(rounds):
        step, size = -hess @ g, 1.0
        while size > 1e-12 and f(x + size * step) > now + 1e-4 * size * (step @ g):
            size /= 2
        new = x + size * step
        after, gn = f(new), gradient(new)
        if np.abs(gn).max() < 1e-8 or abs(now - after) < 1e-14:
            return new
        d, u = new - x, gn - g
        if d @ u > 1e-12:
            rho = 1 / (d @ u)
            a = np.eye(len(x)) - rho * np.outer(d, u)
            hess = a @ hess @ a.T + rho * np.outer(d, d)
        x, g, now = new, gn, after
    return x


def studies(seed, k, q):
    r = np.random.default_rng(seed)
    x = np.column_stack([np.ones(k), r.normal(0, 1, k)])
    s = np.stack([(a := r.normal(0, 0.3, (q, q))) @ a.T + 0.05 * np.eye(q) for _ in range(k)])
    root = np.tril(r.normal(0, 0.4, (q, q))) + 0.3 * np.eye(q)
    y = x @ r.normal(0, 1, (2, q)) + np.stack([r.multivariate_normal(np.zeros(q), v + root @ root.T) for v in s])
    return y, s, x


@pytest.mark.parametrize("method", ["ml", "reml"])
def test_analytic_score_equals_differences(method):
    y, s, x = studies(1, 40, 2)
    z = [np.kron(r[None], np.eye(2)) for r in x]

    def objective(u):
        root = np.array([[u[0], 0], [u[1], u[2]]])
        vs = [v + root @ root.T for v in s]
        info = sum(a.T @ np.linalg.solve(v, a) for a, v in zip(z, vs))
        beta = np.linalg.solve(info, sum(a.T @ np.linalg.solve(v, b) for a, v, b in zip(z, vs, y)))
        value = sum(np.linalg.slogdet(v)[1] + (e := b - a @ beta) @ np.linalg.solve(v, e) for a, v, b in zip(z, vs, y))
        return 0.5 * (value + (np.linalg.slogdet(info)[1] if method == "reml" else 0))

    u = bfgs(objective, [0.3, 0, 0.3])
    root = np.array([[u[0], 0], [u[1], u[2]]])
    fit = meta.mvmeta(y, s, x, method)
    assert fit.converged and np.allclose(fit.psi, root @ root.T, atol=1e-6)
    const = (80 - (4 if method == "reml" else 0)) * math.log(2 * math.pi) / 2
    assert fit.loglik == pytest.approx(-objective(u) - const, abs=1e-8)


def test_no_spread_ends_at_the_boundary():
    s = np.stack([np.eye(2)] * 30)
    y = np.tile([[0.1, -0.1], [-0.1, 0.1]], (15, 1))
    fit = meta.mvmeta(y, s)
    assert fit.converged and np.abs(fit.psi).max() < 1e-3


def test_rows_equal_memory(spark):
    y, s, x = studies(2, 60, 3)
    df = spark.createDataFrame([(i, a.tolist(), b.ravel().tolist(), c.tolist()) for i, (a, b, c) in enumerate(zip(y, s, x))], "g long, coef array<double>, vcov array<double>, x array<double>")
    df = df.repartition(3).cache()
    for method, small in (("fixed", 0), ("reml", 0), ("ml", meta.SMALL)):
        here, there = meta.mvmeta(y, s, x, method), meta.mvmeta_rows(df, method, small)
        assert np.allclose(here.psi, there.psi, atol=1e-7) and np.allclose(here.beta, there.beta, atol=1e-7) and here.loglik == pytest.approx(there.loglik, abs=1e-7)
    best, _ = meta.blup(here, y, s)  # of the last method
    got = {r.g: r for r in meta.blup_rows(df, "g", here).collect()}
    assert np.allclose([got[i].blup for i in range(60)], best) and got[3].shrinkage == pytest.approx(np.linalg.norm(best[3] - y[3]))


def test_many_locations(spark):
    """20,000 locations, pooled by passes over rows alone."""
    draw = lambda seed: F.randn(seed)
    df = spark.range(20_000).select("id", F.array(0.5 + 0.4 * draw(1) + 0.3 * draw(2), -1 + 0.2 * draw(3) + 0.3 * draw(4)).alias("coef"), F.array(F.lit(0.09), F.lit(0.0), F.lit(0.0), F.lit(0.09)).alias("vcov"), F.array(F.lit(1.0)).alias("x")).cache()
    fit = meta.mvmeta_rows(df, small=0)
    assert fit.converged and np.allclose(np.diag(fit.psi), [0.16, 0.04], rtol=0.05) and np.allclose(fit.beta, [[0.5, -1]], atol=0.02)
    assert meta.blup_rows(df, "id", fit).count() == 20_000


def test_multi_location_from_the_raw_series(spark, two, cb):
    r = np.random.default_rng(4)
    parts = [two.withColumn("g", F.concat("g", F.lit(str(i)))).withColumn("y", (F.col("y") * float(1 + r.random())).cast("int")).withColumn("x", F.col("x") + float(r.normal())) for i in range(3)]
    df = parts[0].unionByName(parts[1]).unionByName(parts[2])
    got = {x.g: x for x in meta.multi_location(df, "g", "x", "y", cb, predictors=["avg"], t="t", **OPTIONS).collect()}
    fits = {x.g: x for x in dlnm.fit_dlnm(df, cb, "x", "y", "t", by="g", **OPTIONS).collect()}
    assert set(got) == set(fits) and len(got) == 6
    for g, x in got.items():
        assert x.converged and np.allclose(x.coef, fits[g].coef, rtol=1e-9) and 1 <= x.pct <= 99
    names = sorted(fits)
    avg = {x.g: x.m for x in df.groupBy("g").agg(F.avg("x").alias("m")).collect()}
    m = np.array([avg[g] for g in names])
    ys, ss = np.array([fits[g].coef for g in names]), np.array([fits[g].vcov for g in names]).reshape(6, 4, 4)
    pooled = meta.mvmeta(ys, ss, np.column_stack([np.ones(6), (m - m.mean()) / m.std()]))
    assert np.allclose([got[g].blup for g in names], meta.blup(pooled, ys, ss)[0], atol=1e-5)
    own = meta.multi_location(df, "g", "x", "y", cb, predictors=[], t="t", knots_at=[0.3, 0.7], **OPTIONS).collect()
    assert all(x.converged and x.mmt is not None for x in own)


def test_simulation_over_the_history(spark, two, cb):
    from lagweave.operators import attribution

    c = cb.centered(18.0)
    w = c.series(two, "x", "t", ["g"]).join(two, ["g", "t"]).repartition(3).cache()
    r = np.random.default_rng(1)
    coef, root = r.normal(0, 0.01, 8), r.normal(0, 0.003, (8, 8))
    vcov = root @ root.T
    values, vectors = np.linalg.eigh(vcov)
    draws = coef + np.random.default_rng(5).standard_normal((50, 8)) * np.sqrt(np.maximum(values, 0)) @ vectors.T
    rows = [x for x in w.collect() if all(x[n] is not None for n in c.names) and x.x is not None and 10 <= x.x <= 22]
    for by in ([], ["g"]):
        got = {(x.g if by else None, x.sim): x.an for x in attribution.simulated_lagged(w, "x", "y", c, coef, vcov, 50, 5, (10, 22), by).collect()}
        want = {}
        for x in rows:
            for s, d in enumerate(draws):
                k = x.g if by else None, s
                want[k] = want.get(k, 0.0) + (1 - math.exp(-sum(x[n] * v for n, v in zip(c.names, d)))) * x.y
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)
    ends = attribution.lagged_interval(w, "x", "y", c, coef, vcov, nsim=50, seed=5, range_=(10, 22), by=["g"]).collect()
    assert len(ends) == 2 and all(e.an_low < e.an_high for e in ends)
    assert attribution.simulated_lagged(w.where("g = 'none'"), "x", "y", c, coef, vcov, 10).count() == 0


def test_penalised_fit_with_an_offset(two, cb):
    from lagweave.operators import penalized

    w = cb.series(two, "x", "t", ["g"]).join(two, ["g", "t"]).cache()
    got = penalized.fit_penalised(w, "y", cb, lam=(0.0, 0.0), family="poisson", offset="o").fit
    want = glm.fit_glm(w, "y", cb.names, "poisson", "o", tol=1e-13)
    assert np.allclose(got.coef, want.coef, rtol=1e-4, atol=1e-6) and got.offset == "o"
