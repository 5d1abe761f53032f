"""Penalised cross-basis fits: one Gram matrix from Spark, the rest p x p on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import BasisSpec, basis_columns, fit_basis
from .crossbasis import CrossBasis
from .glm import LINKS, FitResult, _pass, gram, invert, solve, working
from .predict import crosspred


def penalty(n: int, kind: str = "difference", order: int = 2) -> np.ndarray:
    """difference (of an order), ridge, or roughness (second differences)."""
    if kind == "ridge":
        return np.eye(n)
    if kind not in ("difference", "roughness"):
        raise ValueError("kind: difference, ridge or roughness")
    order = 2 if kind == "roughness" else order
    if n <= order:
        return np.eye(n)
    d = np.diff(np.eye(n), order, axis=0)
    return d.T @ d


def combined(cb: CrossBasis, lam_var: float, lam_lag: float, kind: str | tuple[str, str] = "difference", order: int | tuple[int, int] = 2) -> np.ndarray:
    """kind, order: one for both dimensions, or of the exposure's and of the lags'."""
    v, n = cb.shape
    kinds, orders = ((kind, kind) if isinstance(kind, str) else kind), ((order, order) if isinstance(order, int) else order)
    return lam_var * np.kron(penalty(v, kinds[0], orders[0]), np.eye(n)) + lam_lag * np.kron(np.eye(v), penalty(n, kinds[1], orders[1]))


def nelder_mead(f: Callable, start: np.ndarray, rounds: int = 200, tol: float = 1e-7) -> np.ndarray:
    """The place of a minimum of f."""
    pts = [np.asarray(start, float), *(np.asarray(start, float) + e for e in np.eye(len(start)))]
    pts = sorted(((f(p), tuple(p)) for p in pts))
    for _ in range(rounds):
        if pts[-1][0] - pts[0][0] < tol:
            break
        centre, worst = np.mean([p for _, p in pts[:-1]], 0), np.array(pts[-1][1])
        at = lambda k: (f(q := centre + k * (worst - centre)), tuple(q))
        new = at(-1.0)
        if new[0] < pts[0][0]:
            new = min(new, at(-2.0))
        elif new[0] >= pts[-2][0]:
            new = at(0.5) if new[0] >= pts[-1][0] else min(new, at(-0.5))
        if new[0] < pts[-1][0]:
            pts[-1] = new
        else:
            low = np.array(pts[0][1])
            pts = [pts[0], *((f(q := (low + np.array(p)) / 2), tuple(q)) for _, p in pts[1:])]
        pts.sort()
    return np.array(pts[0][1])


@dataclass
class Penalised:
    fit: FitResult
    lam: tuple[float, float]
    edf: float
    criterion: float
    rss: float
    tss: float
    shape: tuple[int, int] = (0, 0)
    lost: tuple[float, float] = (0.0, 0.0)

    def smoothing(self) -> dict:
        """Penalties, effective degrees of freedom and R2.

        edf_var and edf_lag split all degrees by the other dimension's share of the penalties, roughly. Exact are
        lost_var and lost_lag, the degrees that each penalty takes away (lam tr(A^-1 S)): edf_cross, the degrees of the
        v x n cross-basis, is v n - lost_var - lost_lag, and edf_other, those of all other columns, is the rest.
        size_var and size_lag are v - lost_var / n and n - lost_lag / v: the effective size of each basis.
        """
        lv, ll = self.lam
        share = ll / (lv + ll) if lv + ll else 0.5
        (v, n), (a, b) = self.shape, self.lost
        return {
            "lam_var": lv, "lam_lag": ll, "edf": self.edf, "edf_var": self.edf * share, "edf_lag": self.edf * (1 - share), "r2": 1 - self.rss / self.tss if self.tss > 0 else math.nan,
            "edf_cross": v * n - a - b, "edf_other": self.edf - (v * n - a - b), "lost_var": a, "lost_lag": b, "size_var": v - a / max(n, 1), "size_lag": n - b / max(v, 1),
        }

    def predict(self, at: DataFrame, x: str, cb: CrossBasis, kind: str = "overall", **kw) -> DataFrame:
        """at with effects, standard errors and intervals, as crosspred gives them."""
        return crosspred(at, x, cb, *self.fit.part(cb.names), kind, link=self.fit.link, **kw)


def criterion(g, c, yy, n, pen, kind: str) -> tuple[float, np.ndarray, float, float]:
    """The criterion, coefficients, effective degrees of freedom tr(A^-1 X'X), and rss."""
    a = g + pen
    inv = invert(a)
    beta = inv @ c
    edf, rss = float(np.trace(inv @ g)), max(float(yy - 2 * beta @ c + beta @ g @ beta), 1e-300)
    if kind == "gcv":
        value = (rss / n) / (1 - edf / n) ** 2
    elif kind == "aic":
        value = n * math.log(rss / n) + 2 * edf
    elif kind == "reml":
        rank = int(np.linalg.matrix_rank(pen))
        plus = lambda m: float(np.log(np.maximum(np.linalg.eigvalsh(m)[-max(rank, 1):], 1e-300)).sum()) if rank else 0.0
        null = len(c) - rank
        value = (n - null) * math.log((rss + float(beta @ pen @ beta)) / (n - null)) + float(np.linalg.slogdet(a + 1e-10 * np.eye(len(a)))[1]) - plus(pen)
    else:
        raise ValueError("kind: gcv, aic or reml")
    return value, beta, edf, rss


def deviance_criterion(dev: float, beta, g, n: int, pen, kind: str, known: bool) -> tuple[float, float]:
    """The criterion of a converged fit, and tr(A^-1 G), from its deviance and G = X'WX; known: the dispersion is 1.

    aic: deviance + 2 edf. reml: by Laplace's approximation.
    """
    a = g + pen
    edf = float(np.trace(invert(a) @ g))
    if kind == "gcv":
        return dev / n / (1 - edf / n) ** 2, edf
    if kind == "aic":
        return (dev if known else n * math.log(max(dev, 1e-300) / n)) + 2 * edf, edf
    if kind != "reml":
        raise ValueError("kind: gcv, aic or reml")
    rank = int(np.linalg.matrix_rank(pen))
    logs = float(np.linalg.slogdet(a + 1e-10 * np.eye(len(a)))[1]) - (float(np.log(np.maximum(np.linalg.eigvalsh(pen)[-rank:], 1e-300)).sum()) if rank else 0.0)
    left, free = dev + float(beta @ pen @ beta), n - (len(a) - rank)
    return (left if known else free * math.log(left / free)) + logs, edf


def trial_sums(x: DataFrame, k: int, family: str, betas: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
    """X'WX, X'Wz, z'Wz and the deviance at each of the coefficients, in one pass over x (k columns, y, offset)."""
    width = k * k + k + 2

    def run(batches):
        flat = np.zeros((len(betas), width))
        for b in batches:
            m = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(b.num_columns)])
            for i, beta in enumerate(betas):
                z, w, _, d = working(family, m[:, k], m[:, :k] @ beta + m[:, k + 1])
                xw, z = m[:, :k] * w[:, None], z - m[:, k + 1]
                flat[i] += np.concatenate([(xw.T @ m[:, :k]).ravel(), xw.T @ z, [(w * z * z).sum(), d.sum()]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(flat.size)), pa.array(flat.ravel())], names=["i", "v"])

    flat = np.zeros(len(betas) * width)
    for r in x.mapInArrow(run, "i long, v double").groupBy("i").agg({"v": "sum"}).collect():  # trials x (p x p + p + 2) rows
        flat[r[0]] = r[1]
    return [(f[: k * k].reshape(k, k), f[k * k : -2], float(f[-2]), float(f[-1])) for f in flat.reshape(len(betas), width)]


def converged_trials(x: DataFrame, k: int, family: str, pens: Sequence[np.ndarray], start: np.ndarray, rounds: int, tol: float = 1e-8) -> list[tuple]:
    """(coefficients, G, c, z'Wz, deviance, converged) of the penalised fit with each penalty; a round is one pass for
    all trials that have not converged."""
    betas, out, open_ = [start] * len(pens), [None] * len(pens), list(range(len(pens)))
    for _ in range(rounds):
        for i, (g, c, yy, dev) in zip(list(open_), trial_sums(x, k, family, [betas[i] for i in open_])):
            new = solve(g + pens[i], c)
            fine = bool(np.abs(new - betas[i]).max() <= tol * (1 + np.abs(new).max()))
            out[i], betas[i] = (betas[i], g, c, yy, dev, fine), new
            if fine:
                open_.remove(i)
        if not open_:
            break
    return out


def select_penalties(x: DataFrame, k: int, n: int, family: str, whole: Callable, method: str, u: tuple[float, float], beta: np.ndarray, rounds: int, finest: float = 1 / 64):
    """Log penalties of the least deviance criterion, and the fit there: steps to the best of eight neighbours, each
    fitted to convergence, at spacings halved from 1 to `finest` where no neighbour is better."""
    known = family in ("poisson", "binomial")
    clip = lambda q: tuple(float(np.clip(a, -12, 16)) for a in q)
    seen: dict = {}

    def look(places, start):
        new = [q for q in dict.fromkeys(places) if q not in seen]
        for q, fit in zip(new, converged_trials(x, k, family, [whole(*np.exp(q)) for q in new], start, rounds)):
            value = deviance_criterion(fit[4], fit[0], fit[1], n, whole(*np.exp(q)), method, known)[0]
            seen[q] = (value if fit[5] and math.isfinite(value) else math.inf, fit)

    u, h = clip(u), 1.0
    look([u], beta)
    while h >= finest:
        around = [clip((u[0] + i * h, u[1] + j * h)) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        look(around, seen[u][1][0])
        best = min(around, key=lambda q: seen[q][0])
        if seen[best][0] < seen[u][0] - 1e-9 * (1 + abs(seen[best][0])):
            u = best
        else:
            h /= 2
    return u, *seen[u]


def fit_penalised(df: DataFrame, y: str, cb: CrossBasis, extra: Sequence[str] = (), *, method: str = "gcv", lam: tuple[float, float] | None = None, kind: str | tuple[str, str] = "difference", order: int | tuple[int, int] = 2, family: str = "gaussian", rounds: int = 50, offset: str | None = None) -> Penalised:
    """Penalised fit of y on 1, cb's columns and extra, on complete rows; lam None: chosen by method.

    Other families than the Gaussian take penalised reweighted rounds. Their penalties are chosen by the deviance of
    fits that have converged (`deviance_criterion`), from the choice of working values on; trials that are compared
    share their passes. The vcov is phi A^-1 G A^-1, where phi is 1 for Poisson and binomial models.
    """
    names = ["(intercept)", *cb.names, *extra]
    x = df.select(F.lit(1.0).alias("(intercept)"), *(F.col(k).cast("double").alias(k) for k in names[1:]), F.col(y).cast("double").alias("_y"), (F.col(offset).cast("double") if offset else F.lit(0.0)).alias("_o")).na.drop().cache()
    k, p, beta, converged = len(names), cb.shape[0] * cb.shape[1], None, False

    def whole(l1, l2):
        out = np.zeros((k, k))
        out[1 : 1 + p, 1 : 1 + p] = combined(cb, l1, l2, kind, order)
        return out

    for _ in range(rounds):
        now = beta

        def step(m):
            z, w, _, d = working(family, m[:, k], None if now is None else m[:, :k] @ now + m[:, k + 1])
            return m[:, :k], z - m[:, k + 1], w, d

        g, c, n, yy, dev = _pass(x, k, step)
        got = lam
        if got is None:
            got = tuple(np.exp(nelder_mead(lambda u: criterion(g, c, yy, n, whole(*np.exp(np.clip(u, -12, 16))), method)[0], np.zeros(2))))
        value, beta, edf, rss = criterion(g, c, yy, n, whole(*got), method)
        if family == "gaussian" or (now is not None and np.abs(beta - now).max() < 1e-9 * (1 + np.abs(beta).max())):
            converged = True
            break
    known = family in ("poisson", "binomial")
    if family != "gaussian":
        if lam is None:
            u, _, (beta, g, c, yy, dev, converged) = select_penalties(x, k, n, family, whole, method, tuple(np.log(got)), beta, rounds)
            got = tuple(float(v) for v in np.exp(u))
        rss = max(float(yy - 2 * beta @ c + beta @ g @ beta), 1e-300)
        value, edf = deviance_criterion(dev, beta, g, n, whole(*got), method, known)
    x.unpersist()
    inv = invert(g + whole(*got))
    phi = 1.0 if known else rss / max(n - edf, 1e-9)
    fit = FitResult(names, beta, phi * inv @ g @ inv, family, LINKS.get(family, "log"), phi, rss if family == "gaussian" else dev, n, int(n - edf), converged, offset=offset)
    lost = tuple(float(np.trace(inv @ whole(*part))) for part in ((got[0], 0.0), (0.0, got[1])))
    return Penalised(fit, got, edf, value, rss, float(yy - c[0] ** 2 / g[0, 0]), cb.shape, lost)


def penalised_dlnm(df: DataFrame, x: str, y: str, t: str, lag, argvar: dict | None = None, arglag: dict | None = None, **kw) -> tuple[CrossBasis, Penalised]:
    """The cross-basis of x and its penalised fit in one call."""
    cb = CrossBasis.fit(df, x, lag, argvar, arglag)
    return cb, fit_penalised(cb.series(df, x, t).join(df.select(t, y), t), y, cb, **kw)


@dataclass(frozen=True)
class SmoothBasis:
    """A natural-spline basis, and lam times the squared second differences of its coefficients as its penalty."""

    spec: BasisSpec
    lam: float

    @property
    def penalty(self) -> np.ndarray:
        return self.lam * penalty(self.spec.size)


def smooth_spline_basis(df: DataFrame, x: str, lam: float = 1.0, df_: int | None = None, knots=None) -> SmoothBasis:
    return SmoothBasis(fit_basis(df, x, "ns", df_=df_, knots=knots), lam)


def fit_smooth(df: DataFrame, x: str, y: str, basis: SmoothBasis) -> FitResult:
    """Penalised least squares of y on 1 (not penalised) and the basis of x, on complete rows."""
    names = ["(intercept)", *basis.spec.names("s")]
    rows = basis_columns(df.select(F.lit(1.0).alias(names[0]), x, F.col(y).cast("double").alias(y)), x, basis.spec, "s").na.drop()
    g, c, n, yy = gram(rows, names, y)
    pen = np.zeros_like(g)
    pen[1:, 1:] = basis.penalty
    _, beta, edf, rss = criterion(g, c, yy, n, pen, "gcv")
    inv, phi = invert(g + pen), rss / max(n - edf, 1e-9)
    return FitResult(names, beta, phi * inv @ g @ inv, "gaussian", "identity", phi, rss, n, int(n - edf), extra={"edf": edf})
