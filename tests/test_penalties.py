"""Penalties of non-Gaussian models by the deviance, and degrees of freedom by penalty, against dense searches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.operators import glm, penalized
from lagweave.operators.crossbasis import CrossBasis


@pytest.fixture(scope="module")
def design(spark):
    r = np.random.default_rng(5)
    x = np.clip(15 + 8 * np.sin(np.arange(300) / 30) + r.normal(0, 3, 300), 0, 35)
    y = r.poisson(np.exp(1.5 + 0.004 * (x - 18) ** 2))
    df = spark.createDataFrame([(t, float(a), int(b), float(t) / 1000) for t, (a, b) in enumerate(zip(x, y))], "t int, x double, y long, o double")
    df = df.withColumn("b", (F.col("y") > 5).cast("int"))
    cb = CrossBasis.fit(df, "x", 3, {"fun": "bs", "df_": 5}, {"fun": "poly", "degree": 2})
    w = cb.series(df, "x", "t").join(df.select("t", "y", "b", "o"), "t").na.drop().cache()
    rows = w.orderBy("t").collect()
    return cb, w, np.array([[1.0, *(q[n] for n in cb.names)] for q in rows]), {c: np.array([q[c] for q in rows], float) for c in ("y", "b", "o")}


def fit(x, y, family, pen, offset):
    beta = None
    for _ in range(200):
        z, w, _, d = glm.working(family, y, None if beta is None else x @ beta + offset)
        g = (x * w[:, None]).T @ x
        new = np.linalg.solve(g + pen, (x * w[:, None]).T @ (z - offset))
        if beta is not None and np.abs(new - beta).max() < 1e-11:
            break
        beta = new
    return beta, d.sum(), np.trace(np.linalg.solve(g + pen, g)), g


@pytest.mark.parametrize(("family", "y", "method", "offset"), [("poisson", "y", "aic", "o"), ("binomial", "b", "gcv", None), ("poisson", "y", "reml", None)])
def test_deviance_criterion(design, family, y, method, offset):
    cb, w, x, values = design
    n, o = len(x), values["o"] if offset else np.zeros(len(x))

    def value(u):
        pen = np.zeros((x.shape[1],) * 2)
        pen[1:, 1:] = penalized.combined(cb, *np.exp(u))
        beta, dev, edf, g = fit(x, values[y], family, pen, o)
        if method == "reml":
            e = np.linalg.eigvalsh(pen)
            rank = np.linalg.matrix_rank(pen)
            return dev + beta @ pen @ beta + np.linalg.slogdet(g + pen)[1] - np.log(e[-rank:]).sum()
        return dev + 2 * edf if method == "aic" else n * dev / (n - edf) ** 2

    got = penalized.fit_penalised(w, y, cb, method=method, family=family, offset=offset)
    assert got.fit.converged and math.isclose(got.criterion, value(np.log(got.lam)), rel_tol=1e-6)
    grid = [value((a, b)) for a in np.linspace(-12, 16, 15) for b in np.linspace(-12, 16, 15)]
    near = [value(np.clip(np.log(got.lam) + d, -12, 16)) for d in ((0.1, 0), (-0.1, 0), (0, 0.1), (0, -0.1))]
    assert got.criterion <= min(*grid, *near) + 1e-4 * (1 + abs(got.criterion))
    fixed = penalized.fit_penalised(w, y, cb, method=method, family=family, offset=offset, lam=got.lam)
    assert np.allclose(fixed.fit.coef, got.fit.coef, atol=1e-5) and math.isclose(fixed.criterion, got.criterion, rel_tol=1e-6)


def test_degrees_by_penalty(design):
    cb, w, x, values = design
    v, n = cb.shape
    pens = []
    for part in ((3.0, 0.0), (0.0, 0.5)):
        pen = np.zeros((x.shape[1],) * 2)
        pen[1:, 1:] = penalized.combined(cb, *part)
        pens.append(pen)
    a = np.linalg.inv(x.T @ x + sum(pens))
    s = penalized.fit_penalised(w, "y", cb, lam=(3.0, 0.5)).smoothing()
    assert np.allclose([s["lost_var"], s["lost_lag"]], [np.trace(a @ p) for p in pens], rtol=1e-6)
    assert math.isclose(s["edf_cross"] + s["edf_other"], s["edf"]) and math.isclose(s["edf_other"], x.shape[1] - v * n, rel_tol=1e-6)
    assert math.isclose(s["edf_cross"], np.trace((a @ x.T @ x)[1:, 1:]), rel_tol=1e-6)
    free = penalized.fit_penalised(w, "y", cb, lam=(1e-9, 1e-9)).smoothing()
    assert np.allclose([free["size_var"], free["size_lag"], free["edf_cross"]], [v, n, v * n], atol=1e-3)
    stiff = penalized.fit_penalised(w, "y", cb, lam=(1e9, 1e-9)).smoothing()
    assert abs(stiff["size_var"] - 2) < 1e-3 and abs(stiff["size_lag"] - n) < 1e-3  # second differences leave lines
