"""Seasonal bases, decomposition by least squares, and the choice among seasonal models."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bases import BasisSpec
from .glm import gram, solve

YEAR = 365.25


def harmonic(t: Column, n_harmonics: int = 2, period: float = YEAR, trend: bool = False) -> dict[str, Column]:
    """sin and cos of the first harmonics of t in days."""
    out = {"trend": t.cast("double")} if trend else {}
    for h in range(1, n_harmonics + 1):
        angle = t * F.lit(2 * math.pi * h / period)
        out |= {f"sin{h}": F.sin(angle), f"cos{h}": F.cos(angle)}
    return out


def seasonal_spline(t: Column, n_df: int = 4, period: float = YEAR, fun: str = "bs", degree: int = 3) -> dict[str, Column]:
    """A spline of the place in the period, with evenly spaced knots."""
    n = max(0, n_df - (degree if fun == "bs" else 1))
    spec = BasisSpec(fun, degree, tuple(period * i / (n + 1) for i in range(1, n + 1)), (0.0, period), period)
    place = F.pmod(t.cast("double"), F.lit(float(period)))
    return {f"{fun}{i}": c for i, c in enumerate(spec.columns(place), 1)}


def cyclic(df: DataFrame, t: str, names: Sequence[str], period: float = YEAR, share: float = 0.05) -> DataFrame:
    """names drawn, within share of either end of the period, towards the mean of both ends' means."""
    place = F.pmod(F.col(t).cast("double"), F.lit(float(period)))
    width = share * period
    first, last = place < width, place > period - width
    ends = df.agg(*(((F.avg(F.when(first, F.col(n))) + F.avg(F.when(last, F.col(n)))) / 2).alias(n) for n in names)).first()
    far = F.when(first, place / width).when(last, (period - place) / width)
    return df.withColumns({n: F.when(far.isNull() | F.lit(ends[n] is None), F.col(n)).otherwise(far * F.col(n) + (1 - far) * F.lit(ends[n] or 0.0)) for n in names})


def least_squares(g: np.ndarray, c: np.ndarray, yy: float, n: int, keep: Sequence[int] | None = None) -> dict:
    """Coefficients, residual sum of squares, AIC and BIC of the columns in keep, from one Gram matrix."""
    at = list(range(len(c))) if keep is None else list(keep)
    beta = solve(g[np.ix_(at, at)], c[at])
    rss = max(yy - 2 * beta @ c[at] + beta @ g[np.ix_(at, at)] @ beta, 0.0)
    k, mse = len(at) + 1, max(rss / max(n, 1), 1e-300)
    return {"coef": beta, "rss": rss, "aic": n * math.log(mse) + 2 * k, "bic": n * math.log(mse) + math.log(max(n, 1)) * k}


def flexible(t: Column, components: Sequence[dict], period: float = YEAR) -> dict[str, Column]:
    """The columns of several bases side by side; each component names its type and that basis's own arguments."""
    out = {}
    for i, c in enumerate(components, 1):
        out |= {f"c{i}_{k}": v for k, v in seasonal_basis(t, c["type"], period=period, **{k: v for k, v in c.items() if k != "type"}).items()}
    return out


BASES = {"harmonic": harmonic, "spline": seasonal_spline, "flexible": flexible}


def seasonal_basis(t: Column, method: str = "harmonic", **kw) -> dict[str, Column]:
    """The columns of a seasonal basis by the name of its method."""
    if method not in BASES:
        raise ValueError(f"method: one of {tuple(BASES)}")
    return BASES[method](t, **kw)


def decompose(df: DataFrame, y: str, t: str, n_harmonics: int = 2, period: float = YEAR, method: str = "harmonic", effects: bool = False, **kw) -> DataFrame:
    """df with trend, seasonal and residual of y = a + b t + a seasonal basis; effects: each of its columns' share too."""
    if method == "harmonic":
        kw = {"n_harmonics": n_harmonics} | kw
    cols = {"one": F.lit(1.0), "slope": F.col(t).cast("double"), **seasonal_basis(F.col(t), method, period=period, **kw)}
    x = df.withColumns({f"_{k}": c for k, c in cols.items()})
    names = [f"_{k}" for k in cols]
    g, c, n, yy = gram(x, names, y)
    beta = dict(zip(names, map(float, least_squares(g, c, yy, n)["coef"])))
    part = lambda ns: sum((F.col(k) * beta[k] for k in ns), F.lit(0.0))
    out = x.withColumns({"trend": part(names[:2]), "seasonal": part(names[2:])} | ({f"effect{k}": part([k]) for k in names[2:]} if effects else {}))
    return out.withColumn("residual", F.col(y) - F.col("trend") - F.col("seasonal")).drop(*names)


#: Name -> method, its size (harmonics or columns), and whether a trend goes along.
CONFIGURATIONS = {f"{m}{k}{'_trend' * tr}": (m, k, tr) for m, sizes in (("harmonic", (1, 2, 3)), ("spline", (4, 6, 8))) for k in sizes for tr in (False, True)}


def compare(df: DataFrame, y: str, t: str, configurations: dict = CONFIGURATIONS, period: float = YEAR) -> DataFrame:
    """(config, n_terms, r2, aic, bic) of every configuration, all from one pass over the union of their columns."""
    cols, has = {"one": F.lit(1.0), "trend": F.col(t).cast("double")}, {}
    for name, (method, size, trend) in configurations.items():
        own = seasonal_basis(F.col(t), method, period=period, **{"n_harmonics" if method == "harmonic" else "n_df": size})
        own = {k if method == "harmonic" else f"{method}{size}_{k}": c for k, c in own.items()}
        has[name] = ["one", *["trend"] * trend, *own]
        cols |= own
    g, c, n, yy = gram(df.select(y, *(v.alias(f"_{k}") for k, v in cols.items())), [f"_{k}" for k in cols], y)
    at, total, rows = {k: i for i, k in enumerate(cols)}, max(yy - c[0] ** 2 / max(n, 1), 1e-300), []
    for name, keep in has.items():
        fit = least_squares(g, c, yy, n, [at[k] for k in keep])
        rows.append((name, len(keep), float(1 - fit["rss"] / total), float(fit["aic"]), float(fit["bic"])))
    return df.sparkSession.createDataFrame(rows, "config string, n_terms int, r2 double, aic double, bic double")


def best(df: DataFrame, y: str, t: str, by: str = "aic") -> str:
    """The configuration of least AIC or BIC, or of most r2."""
    return min(compare(df, y, t).collect(), key=lambda r: (-r[by] if by == "r2" else r[by], r.config)).config
