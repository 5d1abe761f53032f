"""Generalised linear models by iterated sums of outer products.

A round is one pass: each task adds up X'WX and X'Wz of its rows, the entries are summed by place in a shuffle of
p x p rows, and the driver solves a p x p system. Per-location fits run grouped, one location's series per task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.season import Season, season_columns

FAMILIES = ("gaussian", "poisson", "quasipoisson", "gamma", "binomial")
LINKS = {"gaussian": "identity", "binomial": "logit"}


@dataclass
class FitResult:
    names: list[str]
    coef: np.ndarray
    vcov: np.ndarray
    family: str
    link: str
    dispersion: float = 1.0
    deviance: float = 0.0
    n: int = 0
    df_resid: int = 0
    converged: bool = True
    extra: dict = field(default_factory=dict)
    offset: str | None = None

    def part(self, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients and covariance by name."""
        at = [self.names.index(n) for n in names]
        return self.coef[at], self.vcov[np.ix_(at, at)]

    def to_df(self, spark) -> DataFrame:
        se = np.sqrt(np.maximum(np.diag(self.vcov), 0))
        return spark.createDataFrame([(n, float(c), float(s)) for n, c, s in zip(self.names, self.coef, se)], "term string, coef double, se double")

    def summary(self, spark) -> DataFrame:
        """to_df with z and the two-sided p of the normal distribution; z and p are NULL where se is 0."""
        se = np.sqrt(np.maximum(np.diag(self.vcov), 0))
        z = [float(c / s) if s > 0 else None for c, s in zip(self.coef, se)]
        rows = [(n, float(c), float(s), v, None if v is None else math.erfc(abs(v) / math.sqrt(2))) for n, c, s, v in zip(self.names, self.coef, se, z)]
        return spark.createDataFrame(rows, "term string, coef double, se double, z double, p double")

    def predict(self, df: DataFrame, name: str = "fitted") -> DataFrame:
        """df with the expected outcome, with the offset that the model was fitted with."""
        eta = sum((F.lit(float(c)) * (F.lit(1.0) if n == "(intercept)" else F.col(n)) for n, c in zip(self.names, self.coef)), F.col(self.offset) if self.offset else F.lit(0.0))
        return df.withColumn(name, {"identity": eta, "log": F.exp(eta), "logit": 1 / (1 + F.exp(-eta))}[self.link])


def getcoef(model, names=None):
    return model.part(names)[0] if isinstance(model, FitResult) and names else np.asarray(getattr(model, "coef", None) if hasattr(model, "coef") else model.coefficients, float)


def getvcov(model, names=None):
    """The covariance; of Spark's own fitted models only the standard errors are known, which give a diagonal."""
    if isinstance(model, FitResult):
        return model.part(names)[1] if names else model.vcov
    return np.diag(np.asarray(model.summary.coefficientStandardErrors, float)[: len(model.coefficients)] ** 2)


def getlink(model) -> str:
    return model.link if isinstance(model, FitResult) else model.getOrDefault("link") if hasattr(model, "getOrDefault") else "identity"


def check_model(coef, vcov, size: int) -> None:
    if len(coef) != size or np.shape(vcov) != (size, size):
        raise ValueError(f"the basis has {size} columns, the model {len(coef)} coefficients")


def gram(df: DataFrame, names: Sequence[str], y: str | None, weight: str | None = None) -> tuple[np.ndarray, np.ndarray, int, float]:
    """X'WX, X'Wy, the rows and y'Wy of complete rows."""
    out = _pass(df.select(*names, *([y] if y else []), *([weight] if weight else [])), len(names), lambda m: (m[:, : len(names)], m[:, len(names)] if y else np.zeros(len(m)), m[:, -1] if weight else np.ones(len(m)), 0.0))
    return out[:4]


def _pass(df: DataFrame, p: int, step) -> tuple[np.ndarray, np.ndarray, int, float, float]:
    """Sums over all rows of step(matrix) -> X, z, w, deviance."""

    def run(batches):
        g, c, n, q, d = np.zeros((p, p)), np.zeros(p), 0, 0.0, 0.0
        for b in batches:
            m = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(b.num_columns)])
            m = m[~np.isnan(m).any(1)]
            x, z, w, dev = step(m)
            xw = x * w[:, None]
            g, c, n, q, d = g + xw.T @ x, c + xw.T @ z, n + len(m), q + float((w * z * z).sum()), d + float(np.sum(dev))
        flat = np.concatenate([g.ravel(), c, [n, q, d]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "v"])

    rows = df.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # p x p + p + 3 rows
    flat = np.zeros(p * p + p + 3)
    for r in rows:
        flat[r.i] = r.v
    return flat[: p * p].reshape(p, p), flat[p * p : p * p + p], int(flat[-3]), flat[-2], flat[-1]


def working(family: str, y: np.ndarray, eta: np.ndarray | None):
    """z, w, mu and unit deviances; eta None: the starting values."""
    kind = "poisson" if family == "quasipoisson" else family
    if eta is None:
        mu = {"gaussian": y, "poisson": y + 0.1, "gamma": np.maximum(y, 1e-3), "binomial": (y + 0.5) / 2}[kind]
        eta = mu if kind == "gaussian" else np.log(mu / (1 - mu)) if kind == "binomial" else np.log(mu)
    if kind == "gaussian":
        return y, np.ones(len(y)), eta, (y - eta) ** 2
    if kind == "binomial":
        mu = 1 / (1 + np.exp(-eta))
        w = np.maximum(mu * (1 - mu), 1e-10)
        dev = -2 * (y * np.log(np.maximum(mu, 1e-15)) + (1 - y) * np.log(np.maximum(1 - mu, 1e-15)))
        return eta + (y - mu) / w, w, mu, dev
    mu = np.exp(np.clip(eta, -50, 50))
    ratio = np.where(y > 0, y * np.log(np.maximum(y, 1e-300) / mu), 0.0)
    if kind == "poisson":
        return eta + (y - mu) / mu, mu, mu, 2 * (ratio - (y - mu))
    return eta + (y - mu) / mu, np.ones(len(y)), mu, -2 * (np.log(np.maximum(y, 1e-300) / mu) - (y - mu) / mu)


def variance(family: str, mu: np.ndarray) -> np.ndarray:
    return {"gaussian": np.ones_like(mu), "gamma": mu**2, "binomial": mu * (1 - mu)}.get(family, mu)


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A solution even of a rank-deficient system, scaled for conditioning."""
    s = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
    return s * np.linalg.lstsq(a * s[:, None] * s, s * b, rcond=1e-13)[0]


def invert(a: np.ndarray) -> np.ndarray:
    s = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
    return np.linalg.pinv(a * s[:, None] * s, rcond=1e-13, hermitian=True) * s[:, None] * s


def fit_glm(df: DataFrame, y: str, names: Sequence[str], family: str = "poisson", offset: str | None = None, max_iter: int = 30, tol: float = 1e-9, ridge: float = 0.0) -> FitResult:
    """y ~ 1 + names on complete rows. df should be cached by the caller if it is dear to compute.

    ridge adds ridge / 2 times the squared coefficients, but for the intercept's, to the mean of half the deviance.
    """
    if family not in FAMILIES:
        raise ValueError(f"family: one of {FAMILIES}")
    x = df.select(F.lit(1.0).alias("(intercept)"), *(F.col(n).cast("double").alias(n) for n in names), F.col(y).cast("double").alias("_y"), (F.col(offset).cast("double") if offset else F.lit(0.0)).alias("_o"))
    p, beta, dev, converged = len(names) + 1, None, np.inf, False
    shrunk = ridge * np.diag([0.0] + [1.0] * len(names))
    for _ in range(max_iter):
        now = beta

        def step(m):
            xs, ys, o = m[:, :p], m[:, p], m[:, p + 1]
            z, w, _, d = working(family, ys, None if now is None else xs @ now + o)
            return xs, z - o, w, d

        a, b, n, _, d = _pass(x, p, step)
        beta = solve(a + n * shrunk, b)
        if now is not None and abs(dev - d) <= tol * (abs(d) + 0.1):
            converged = True
            break
        dev = d

    def last(m):
        xs, ys, o = m[:, :p], m[:, p], m[:, p + 1]
        _, w, mu, d = working(family, ys, xs @ beta + o)
        return xs, np.sqrt((ys - mu) ** 2 / variance(family, mu) / np.maximum(w, 1e-300)), w, d

    a, _, n, pearson, dev = _pass(x, p, last)
    free = n - int(np.linalg.matrix_rank(a * np.outer(s := 1 / np.sqrt(np.maximum(np.diag(a), 1e-300)), s)))
    phi = pearson / free if family in ("gaussian", "quasipoisson", "gamma") and free > 0 else 1.0
    inverse = invert(a + n * shrunk)
    return FitResult(["(intercept)", *names], beta, phi * (inverse @ a @ inverse if ridge else inverse), family, LINKS.get(family, "log"), phi, dev, n, free, converged, offset=offset)


def irls(x: np.ndarray, y: np.ndarray, family: str, offset: np.ndarray | None = None, max_iter: int = 30, tol: float = 1e-9):
    """The same for one location's rows: coefficients, covariance, dispersion, converged."""
    o = np.zeros(len(y)) if offset is None else offset
    beta, dev, ok = None, np.inf, False
    for _ in range(max_iter):
        z, w, mu, d = working(family, y, None if beta is None else x @ beta + o)
        ok = bool(beta is not None and abs(dev - d.sum()) <= tol * (abs(d.sum()) + 0.1))
        dev = d.sum()
        beta = solve((x * w[:, None]).T @ x, (x * w[:, None]).T @ (z - o))  # once more where the deviance has settled
        if ok:
            break
    a = (x * w[:, None]).T @ x
    s = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
    free = len(y) - int(np.linalg.matrix_rank(a * np.outer(s, s)))
    phi = float(((y - mu) ** 2 / variance(family, mu)).sum() / max(1, free)) if family in ("gaussian", "quasipoisson", "gamma") else 1.0
    return beta, phi * invert(a), phi, ok


def fit_by(df: DataFrame, by: str, y: str, names: Sequence[str], family: str = "quasipoisson", form: np.ndarray | None = None, *, offset: str | None = None, season: Season | None = None) -> DataFrame:
    """(by, coef, vcov, dispersion, n, converged): a model per location, on its complete rows; arrays in the order
    (intercept), names, season.

    form: a matrix by which coefficients of (intercept) and names are multiplied, so that only what is asked for leaves
    the task. season: columns from the location's own dates. A location's rows are in one task; `grouped.fit_blocks`
    takes any number of them.
    """
    kind = df.schema[by].dataType.simpleString()
    numbers = [y, *names, *([offset] if offset else []), *([season.t] if season else [])]

    def run(pdf):
        import pandas as pd

        m = np.column_stack([pdf[f"_{i}"].to_numpy(float) for i in range(len(numbers))])
        fine = ~np.isnan(m).any(1)
        years = pdf["_year"].nunique()
        p = 1 + len(names) + (season.size(years) if season else 0)
        if fine.sum() > p:
            x = np.column_stack([np.ones(fine.sum()), m[fine, 1 : 1 + len(names)]])
            if season:
                x = np.column_stack([x, season_columns(season.knots(m[:, -1], years), m[fine, -1])])
            beta, v, phi, ok = irls(x, m[fine, 0], family, m[fine, 1 + len(names)] if offset else None)
        else:
            beta, v, phi, ok = np.full(p, np.nan), np.full((p, p), np.nan), np.nan, False
        if form is not None:
            full = np.column_stack([form, np.zeros((len(form), p - form.shape[1]))])
            beta, v = full @ beta, full @ v @ full.T
        return pd.DataFrame({by: [pdf[by].iloc[0]], "coef": [beta.tolist()], "vcov": [v.ravel().tolist()], "dispersion": [phi], "n": [int(fine.sum())], "converged": [ok]})

    year = F.year(season.date) if season else F.lit(0)
    rows = df.select(by, *(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(numbers)), year.alias("_year"))
    return rows.groupBy(by).applyInPandas(run, f"{by} {kind}, coef array<double>, vcov array<double>, dispersion double, n long, converged boolean")


def dow_dummies(df: DataFrame, date: str, prefix: str = "dow_") -> tuple[DataFrame, list[str]]:
    """Indicators of the day of the week; Monday is the reference."""
    days = ["Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
    name = F.date_format(date, "EEEE")
    cols = [f"{prefix}{d[:3].lower()}" for d in days]
    return df.select("*", *(F.when(name.isNotNull(), (name == d).cast("double")).alias(c) for d, c in zip(days, cols))), cols
