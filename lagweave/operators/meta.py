"""Multivariate meta-analysis of per-location estimates, and the multi-location chain.

A location gives q coefficients and a q x q covariance, so k locations are k small blocks; no k q x k q matrix is made.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import BasisSpec
from ..functions.groups import joined, own_basis, own_knots, quantiles_by
from ..functions.shared import settled
from ..sources.tables import summary_columns
from .crossbasis import CrossBasis
from .dlnm import fit_regions, reduction
from .grouped import fit_locations
from .predict import linear_form, percentile_grid


@dataclass
class MetaFit:
    beta: np.ndarray  # predictors x outcomes
    vcov: np.ndarray  # of beta, outcome by outcome within a predictor
    psi: np.ndarray
    loglik: float
    method: str
    converged: bool
    x: np.ndarray

    def predict(self, x_new=None) -> tuple[np.ndarray, np.ndarray]:
        """Means and covariances (of the mean and the spread between locations)."""
        x = np.atleast_2d(np.asarray(self.x if x_new is None else x_new, float))
        q = self.psi.shape[0]
        z = np.stack([np.kron(r[None, :], np.eye(q)) for r in x])
        return x @ self.beta, z @ self.vcov @ z.transpose(0, 2, 1) + self.psi

    def summary(self) -> list[dict]:
        se = np.sqrt(np.diag(self.vcov)).reshape(self.beta.shape)
        z = self.beta / se
        p = 2 * (1 - np.vectorize(NormalDist().cdf)(np.abs(z)))
        return [{"predictor": i, "outcome": j, "coef": self.beta[i, j], "se": se[i, j], "z": z[i, j], "p": p[i, j]} for i in range(z.shape[0]) for j in range(z.shape[1])]

    def heterogeneity(self) -> dict:
        return {"psi": self.psi, "tau2": np.diag(self.psi), "loglik": self.loglik}


def as_matrices(s, q: int) -> np.ndarray:
    s = np.asarray(s, float)
    return np.stack([np.diag(v) for v in s]) if s.ndim == 2 and s.shape[1] == q and q > 1 else s.reshape(-1, q, q)


class Held:
    """Locations in memory: y (k x q), s (k x q x q), x (k x p)."""

    def __init__(self, y, s, x):
        self.y, self.s, self.x = y, s, x

    def total(self, f) -> np.ndarray:
        return f(self.y, self.s, self.x)


class Spread:
    """Locations as rows (coef, vcov, x: arrays), summed up by tasks."""

    def __init__(self, df: DataFrame):
        self.df = df.select("coef", "vcov", "x")

    def total(self, f) -> np.ndarray:
        def run(batches):
            for b in batches:
                if b.num_rows:
                    y, s, x = arrays(b)
                    v = f(y, s, x)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(v)], names=["i", "v"])

        rows = self.df.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # of q and p alone
        return np.array([r.v for r in rows])


def arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, s, x = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in ("coef", "vcov", "x"))
    return y, s.reshape(len(y), y.shape[1], y.shape[1]), x


def level_sums(psi: np.ndarray):
    """Sums for the mean given psi: information, right side, log determinants, y'Wy."""

    def f(y, s, x):
        v = s + psi
        w = np.linalg.inv(v)
        a = np.einsum("ka,kij,kb->aibj", x, w, x)
        wy = np.einsum("kij,kj->ki", w, y)
        return np.concatenate([a.ravel(), (x.T @ wy).ravel(), [np.linalg.slogdet(v)[1].sum(), (y * wy).sum()]])

    return f


def spread_sums(psi: np.ndarray, beta: np.ndarray, cov: np.ndarray | None):
    """Sums of twice the gradient of the objective by psi, and of its expected second derivatives. cov: of beta, for REML."""

    def f(y, s, x):
        w = np.linalg.inv(s + psi)
        e = np.einsum("kij,kj->ki", w, y - x @ beta)
        g = w.sum(0) - e.T @ e
        if cov is not None:
            p, q = beta.shape
            m = np.einsum("ka,aibj,kb->kij", x, cov.reshape(p, q, p, q), x)
            g = g - np.einsum("kij,kjl,klm->im", w, m, w)
        return np.concatenate([g.ravel(), np.einsum("kij,klm->iljm", w, w).ravel() / 2])

    return f


@dataclass
class Level:
    """The mean given psi, and minus the log likelihood without its constant."""

    beta: np.ndarray
    info: np.ndarray
    value: float


def level(data, psi: np.ndarray, p: int, reml: bool) -> Level | None:
    q = len(psi)
    try:
        flat = data.total(level_sums(psi))
        info, right = flat[: (p * q) ** 2].reshape(p * q, p * q), flat[(p * q) ** 2 : -2]
        beta = np.linalg.solve(info, right)
    except np.linalg.LinAlgError:
        return None
    value = 0.5 * (flat[-2] + flat[-1] - beta @ right + (np.linalg.slogdet(info)[1] if reml else 0.0))
    return Level(beta.reshape(p, q), info, value) if np.isfinite(value) else None


def fit_spread(data, spread: np.ndarray, p: int, reml: bool, rounds: int = 200, tol: float = 1e-8) -> tuple[np.ndarray, Level, bool]:
    """psi = L L' of least objective by the analytic score of L: the first step is Fisher's, and what the score's changes
    tell about the curvature improves the next ones (BFGS). A round is two passes over the locations, or a few more.
    """
    q = len(spread)
    low = np.tril_indices(q)

    def slope(root: np.ndarray, at: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = data.total(spread_sums(root @ root.T, at.beta, np.linalg.inv(at.info) if reml else None))
        g = flat[: q * q].reshape(q, q)
        return (g @ root)[low], (g + g.T) / 2, flat[q * q :].reshape(q * q, q * q)

    def scoring(root: np.ndarray, g: np.ndarray, expected: np.ndarray) -> np.ndarray:
        """The inverse of the expected curvature by L, and of what is left of it where psi ends singular."""
        turns = np.zeros((q * q, len(low[0])))
        for k, (i, j) in enumerate(zip(*low)):
            e = np.zeros((q, q))
            e[i, j] = 1
            turns[:, k] = (e @ root.T + root @ e.T).ravel()
        roots, axes = np.linalg.eigh(g)
        bend = (axes * np.maximum(roots, 0)) @ axes.T
        curve = turns.T @ expected @ turns + bend[np.ix_(low[0], low[0])] * (low[1][:, None] == low[1])
        return np.linalg.inv(curve + 1e-3 * np.diag(np.maximum(np.diag(curve), 1e-8 * max(1.0, np.diag(curve).max()))))

    root = np.diag(spread)
    now = level(data, root @ root.T, p, reml)
    grad, g, expected = slope(root, now)
    inverse, fresh = scoring(root, g, expected), True
    for _ in range(rounds):
        small = np.abs(grad).max() / (1 + abs(now.value))
        if small < tol:
            return root @ root.T, now, True
        step, size = -inverse @ grad, 1.0
        while True:
            new = root.copy()
            new[low] += size * step
            after = level(data, new @ new.T, p, reml)
            if after is not None and after.value <= now.value + 1e-4 * size * (step @ grad):
                break
            size /= 4
            if size < 1e-9:
                after = None
                break
        if after is None:
            if fresh:
                return root @ root.T, now, bool(small < 1e-4)
            inverse, fresh = scoring(root, g, expected), True
            continue
        after_grad, g, expected = slope(new, after)
        d, u = size * step, after_grad - grad
        if d @ u > 1e-14:
            rho = 1 / (d @ u)
            a = np.eye(len(d)) - rho * np.outer(d, u)
            inverse, fresh = a @ inverse @ a.T + rho * np.outer(d, d), False
        root, now, grad = new, after, after_grad
    return root @ root.T, now, False


METHODS = ("fixed", "ml", "reml")


def fitted(data, k: int, p: int, spread: np.ndarray, method: str, x) -> MetaFit:
    if method not in METHODS:
        raise ValueError("method: fixed, ml or reml")
    q, reml, converged, psi = len(spread), method == "reml", True, np.zeros((len(spread),) * 2)
    if method == "fixed":
        at = level(data, psi, p, reml)
    else:
        psi, at, converged = fit_spread(data, spread, p, reml)
    const = (k * q - (p * q if reml else 0)) * np.log(2 * np.pi) / 2
    return MetaFit(at.beta, np.linalg.inv(at.info), psi, -at.value - const, method, converged, x)


def first_spread(variance) -> np.ndarray:
    return np.sqrt(np.maximum(np.asarray(variance, float), 1e-8)) / 2


def mvmeta(y, s, x=None, method: str = "reml") -> MetaFit:
    """y: k x q estimates; s: variances (k x q) or covariances; x: k x p predictors, by default a constant."""
    y = np.asarray(y, float)
    y = y[:, None] if y.ndim == 1 else y
    k, q = y.shape
    s = as_matrices(np.asarray(s, float).reshape(k, -1) if np.ndim(s) < 3 else s, q)
    x = np.ones((k, 1)) if x is None else np.asarray(x, float).reshape(k, -1)
    return fitted(Held(y, s, x), k, x.shape[1], first_spread(y.var(0)), method, x)


#: Numbers of all locations together up to which they are pooled in memory.
SMALL = 500_000


def mvmeta_rows(df: DataFrame, method: str = "reml", small: int = SMALL) -> MetaFit:
    """The same of rows (coef, vcov, x), a location each: passes over them in Spark, however many there are.

    x: an array of predictors, the constant among them. The result has no x; predictions take theirs. Up to `small`
    numbers in all are fetched once instead.
    """
    sizes = df.agg(F.count("*").alias("k"), F.max(F.size("coef")).alias("q"), F.max(F.size("x")).alias("p")).first()
    spread = df.select(F.posexplode("coef").alias("i", "c")).groupBy("i").agg(F.var_pop("c").alias("v")).orderBy("i").collect()  # q rows
    data = Spread(df)
    if sizes.k * (sizes.q**2 + sizes.q + sizes.p) <= small:
        rows = df.select("coef", "vcov", "x").collect()  # `small` numbers at most
        data = Held(np.array([r.coef for r in rows]), np.array([r.vcov for r in rows]).reshape(sizes.k, sizes.q, sizes.q), np.array([r.x for r in rows]))
    return fitted(data, sizes.k, sizes.p, first_spread([r.v for r in spread]), method, None)


def blup_rows(df: DataFrame, by: str, fit: MetaFit) -> DataFrame:
    """(by, coef, blup, shrinkage) of rows (by, coef, vcov, x)."""
    beta, psi = fit.beta, fit.psi

    def run(batches):
        for b in batches:
            if b.num_rows:
                y, s, x = arrays(b)
                mean = x @ beta
                best = mean + np.einsum("ij,kjl,kl->ki", psi, np.linalg.inv(s + psi), y - mean)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(np.ascontiguousarray(v).ravel())) for v in (y, best)]
                yield pa.RecordBatch.from_arrays([b.column(by), *lists, pa.array(np.linalg.norm(best - y, axis=1))], names=[by, "coef", "blup", "shrinkage"])

    return df.select(by, "coef", "vcov", "x").mapInArrow(run, f"{by} {df.schema[by].dataType.simpleString()}, coef array<double>, blup array<double>, shrinkage double")


def blup(fit: MetaFit, y, s) -> tuple[np.ndarray, np.ndarray]:
    """Shrunken estimates X b + psi (S + psi)^-1 (y - X b), and their covariances; psi need not be invertible."""
    y = np.asarray(y, float)
    y = y[:, None] if y.ndim == 1 else y
    k, q = y.shape
    s = as_matrices(np.asarray(s, float).reshape(k, -1) if np.ndim(s) < 3 else s, q)
    mean, out, cov = fit.x @ fit.beta, [], []
    for i in range(k):
        w = fit.psi @ np.linalg.inv(s[i] + fit.psi)
        out.append(mean[i] + w @ (y[i] - mean[i]))
        cov.append(fit.psi - w @ fit.psi)
    return np.array(out), np.array(cov)


def multi_location(w: DataFrame, by: str, x: str, y: str, cb: CrossBasis, covariates: Sequence[str] = (), method: str = "reml", family: str = "quasipoisson", predictors: Sequence[str] = ("avg", "range"), *, t: str | None = None, date: str | None = None, dfseas: int | None = None, dow: bool = False, offset: str | None = None, knots_at: Sequence[float] | None = None) -> DataFrame:
    """(by, converged, coef, blup, shrinkage, mmt, pct): fits per location, reduces, pools, shrinks.

    With t, w is the raw series: cross-basis, day of the week and seasonality (dfseas per year of a location's own
    dates) are made here, and knots_at puts the exposure's knots at shares of a location's own exposures. Without t, w
    has cb's columns and covariates. predictors: of the pooled model besides a constant, of the mean (avg) and range of
    x in a location; more locations than these need to have converged. Locations that have not are returned too, with
    converged false and nothing else. Nothing that grows with the locations goes through the driver.
    """
    unknown = {*predictors} - {"avg", "range"}
    if unknown:
        raise ValueError(f"predictors: avg, range; not {sorted(unknown)}")
    knots = settled(own_knots(w, by, x, knots_at), "knots") if knots_at else None
    if t is None:
        fits = fit_locations(w, by, y, [*cb.names, *covariates], family, reduction(cb, len(covariates)), offset=offset)
    else:
        fits = fit_regions(w, cb, x, y, t, by, family=family, date=date, dfseas=dfseas, dow=dow, covariates=covariates, offset=offset, knots=knots)
    fits = settled(fits, "fits")
    about = w.groupBy(by).agg(F.avg(x).alias("avg"), (F.max(x) - F.min(x)).alias("range"))
    good = joined(fits.where("converged").select(by, "coef", "vcov"), about, [by])
    stats = good.agg(F.count("*").alias("n"), *(f(p).alias(f"{k}_{p}") for p in predictors for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if stats.n < 2:
        raise ValueError("at least two locations are pooled")
    terms = [F.lit(1.0), *((F.col(p) - stats[f"m_{p}"]) / max(stats[f"s_{p}"], 1e-9) for p in predictors)]
    good = settled(good.select(by, "coef", "vcov", F.array(*terms).alias("x")), "good")
    size = len(terms)
    products = good.agg(*(F.sum(F.get("x", F.lit(i)) * F.get("x", F.lit(j))) for i in range(size) for j in range(size))).first()
    if stats.n <= size or np.linalg.matrix_rank(np.array(products).reshape(size, size)) < size:
        raise ValueError(f"{stats.n} locations do not tell the effects of {len(predictors)} predictors apart")
    made = settled(blup_rows(good, by, mvmeta_rows(good, method)), "blups")
    found = joined(made, location_mmt(w, by, x, cb.var, made.select(by, "blup"), knots), [by])
    return joined(fits.select(by, "converged"), found, [by], "left")


def location_summary(found: DataFrame) -> DataFrame:
    """One row about multi_location's result: locations, those that converged, shrinkage, and the pooled optimum."""
    return found.agg(F.count("*").alias("n"), F.count_if("converged").alias("n_converged"), F.avg("shrinkage").alias("mean_shrinkage"), F.median("mmt").alias("median_mmt"), F.avg("mmt").alias("mean_mmt"), F.stddev_pop("mmt").alias("sd_mmt"))


def location_mmt(df: DataFrame, by: str, x: str, spec: BasisSpec, coefs: DataFrame, knots: DataFrame | None = None) -> DataFrame:
    """(by, mmt, pct) from each location's own percentiles and coefficients (column blup), and knots if it has its own."""
    at = joined(percentile_grid(df, x, by=[by]), coefs, [by])
    if knots is None:
        r = F.array(*spec.columns(F.col("predvar")))
    else:
        names = [f"_r{i}" for i in range(spec.size)]
        at, r = own_basis(at, by, "predvar", spec, knots, names), F.array(*names)
    best_ = F.struct("fit", "pct")
    return at.withColumn("fit", linear_form(r, F.col("blup"))).groupBy(by).agg(F.min_by("predvar", best_).alias("mmt"), F.min_by("pct", best_).alias("pct"))


def location_report(df: DataFrame, by: str, x: str, y: str, spec: BasisSpec, coefs: DataFrame) -> DataFrame:
    """city_summary with mmt, its percentile, and the greatest risk against it on its cold and on its hot side.

    coefs: (by, coef), coef of spec. Risks are taken at the whole percentiles of a location's x; a location without
    any x has NULLs, one without coefs is left out.
    """
    about = quantiles_by(df, [by], x, [i / 100 for i in range(1, 100)], summary_columns(x, y)).drop("n").withColumnRenamed("q", "_q")
    fit = F.transform("_q", lambda v: linear_form(F.array(*spec.columns(v)), F.col("coef")))
    got = about.join(coefs.select(by, "coef"), by).withColumn("_f", fit).withColumn("pct", F.array_position("_f", F.array_min("_f")).cast("int"))
    over = lambda part: F.exp(F.array_max(part) - F.array_min("_f"))
    cold, hot = F.slice("_f", F.lit(1), F.col("pct")), F.slice("_f", F.col("pct"), F.lit(99))
    return got.withColumns({"mmt": F.get("_q", F.col("pct") - 1), "rr_cold": over(cold), "rr_hot": over(hot)}).drop("_q", "_f", "coef")


def pooled_mmt(mmts: DataFrame) -> DataFrame:
    return mmts.agg(F.count("*").alias("n"), F.median("mmt").alias("median_mmt"), F.avg("mmt").alias("mean_mmt"), F.stddev_pop("mmt").alias("sd_mmt"))
