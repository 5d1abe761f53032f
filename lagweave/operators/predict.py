"""Effects of exposures: lag-specific, overall and cumulative predictions, reduction, centring and optima.

The algebra on coefficients (p x p) is the driver's; it turns a model into a coefficient vector and a covariance of
the exposure's basis per lag, which then apply to any number of exposures as array arithmetic in Spark.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bases import BasisSpec
from ..functions.groups import quantiles_by
from ..functions.lags import mklag, quantiles, seqlag
from .crossbasis import CrossBasis
from .glm import check_model


def crossreduce(cb: CrossBasis, coef, vcov, kind: str = "overall", value: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and covariance of one dimension: overall (sum over lags), lag (at a lag), var (at an exposure)."""
    coef, vcov = np.asarray(coef, float), np.asarray(vcov, float)
    v, n = cb.shape
    check_model(coef, vcov, v * n)
    if kind == "overall":
        m = cb.reduce_to(cb.lag_matrix().sum(0))
    elif kind == "lag":
        m = cb.reduce_to(cb.lag_matrix([value])[0])
    elif kind == "var":
        m = np.kron(cb.var.numpy([value])[0][None, :], np.eye(n))
    else:
        raise ValueError("kind: overall, lag or var")
    return m @ coef, m @ vcov @ m.T


def lag_effects(cb: CrossBasis, coef, vcov, lags: Sequence[float], cumulative: bool = False) -> list[tuple]:
    """(lag, coefficients, covariance) of the exposure's basis, at each lag or summed up to it."""
    rows = cb.lag_matrix(lags)
    out = []
    for k, c in zip(lags, np.cumsum(rows, 0) if cumulative else rows):
        m = cb.reduce_to(c)
        out.append((float(k), (m @ coef).tolist(), (m @ vcov @ m.T).ravel().tolist()))
    return out


def grid(spark: SparkSession, lo: float, hi: float, by: float | None = None, name: str = "predvar") -> DataFrame:
    """lo, lo + by, ... up to hi; by defaults to a twentieth of the range."""
    by = by or (hi - lo) / 20 or 1.0
    return spark.range(int((hi - lo) / by + 1e-9) + 1).select((F.lit(float(lo)) + F.col("id") * F.lit(float(by))).alias(name))


def linear_form(r: Column, theta: Column) -> Column:
    return F.aggregate(F.zip_with(r, theta, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def quadratic_form(r: Column, v: Column) -> Column:
    """r'Vr of an array and a flattened matrix."""
    size = F.size(r)
    weighted = F.transform(v, lambda x, i: x * F.get(r, (i / size).cast("int")) * F.get(r, (i % size).cast("int")))
    return F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x)


def with_intervals(df: DataFrame, link: str, ci_level: float = 0.95) -> DataFrame:
    """low and high around fit; for log and logit links also rr, rr_low and rr_high."""
    if not 0 < ci_level < 1:
        raise ValueError("ci_level lies between 0 and 1")
    z = NormalDist().inv_cdf(1 - (1 - ci_level) / 2)
    low, high = F.col("fit") - z * F.col("se"), F.col("fit") + z * F.col("se")
    df = df.withColumns({"low": low, "high": high})
    if link in ("log", "logit"):
        df = df.withColumns({"rr": F.exp("fit"), "rr_low": F.exp("low"), "rr_high": F.exp("high")})
    return df


def apply_effects(at: DataFrame, x: str, spec: BasisSpec, effects: list[tuple], link: str = "log", ci_level: float = 0.95) -> DataFrame:
    """at with a row per lag of effects, and fit, se and intervals."""
    r = F.array(*spec.columns(F.col(x)))
    lit = lambda v: F.array(*map(F.lit, v))
    lags = F.array(*(F.struct(F.lit(k).alias("lag"), lit(c).alias("c"), lit(v).alias("v")) for k, c, v in effects))
    long = at.withColumn("_r", r).withColumn("_e", F.explode(lags))
    fit = linear_form(F.col("_r"), F.col("_e.c"))
    se = F.sqrt(F.greatest(F.lit(0.0), quadratic_form(F.col("_r"), F.col("_e.v"))))
    got = long.select(*at.columns, F.col("_e.lag").alias("lag"), fit.alias("fit"), F.when(fit.isNotNull(), se).alias("se"))
    return with_intervals(got, link, ci_level)


def crosspred(at: DataFrame, x: str, cb: CrossBasis | BasisSpec, coef, vcov, kind: str = "overall", *, link: str = "log", cen: float | None = None, lag=None, bylag: float = 1, ci_level: float = 0.95) -> DataFrame:
    """at with predictions. kind: overall, lag (a row per lag) or cumul (effects summed up to each lag).

    A basis, or a cross-basis with coefficients reduced to its exposure's basis, has the overall kind only.
    """
    coef, vcov = np.asarray(coef, float), np.asarray(vcov, float)
    spec = cb if isinstance(cb, BasisSpec) else cb.var
    spec = spec.centered(cen if cen is not None else spec.cen)
    if isinstance(cb, BasisSpec) or len(coef) == spec.size != cb.shape[0] * cb.shape[1]:
        check_model(coef, vcov, spec.size)
        return apply_effects(at, x, spec, [(0.0, coef.tolist(), vcov.ravel().tolist())], link, ci_level).drop("lag")
    if kind == "overall":
        c, v = crossreduce(cb, coef, vcov)
        return apply_effects(at, x, spec, [(0.0, c.tolist(), v.ravel().tolist())], link, ci_level).drop("lag")
    if kind == "cumul" and bylag != 1:
        raise ValueError("cumulative effects are sums over whole lags")
    check_model(coef, vcov, cb.shape[0] * cb.shape[1])
    lags = seqlag(mklag(lag) if lag is not None else cb.lag, bylag)
    return apply_effects(at, x, spec, lag_effects(cb, coef, vcov, lags, kind == "cumul"), link, ci_level)


def find_mmt(at: DataFrame, x: str, cb, coef, vcov, by: Sequence[str] = (), **kw) -> DataFrame:
    """The exposure of least overall effect (the smallest of equals), per group."""
    p = crosspred(at, x, cb, coef, vcov, **kw)
    best = F.struct("fit", x)
    return p.groupBy(*by).agg(F.min_by(x, best).alias("mmt"), F.min("fit").alias("fit"), F.min_by("low", best).alias("low"), F.min_by("high", best).alias("high"))


def percentile_grid(df: DataFrame, x: str, lo: int = 1, hi: int = 99, by: Sequence[str] = ()) -> DataFrame:
    """(by, pct, predvar): whole percentiles of x, of all rows or per group of any size."""
    pct = [i / 100 for i in range(lo, hi + 1)]
    if not by:
        return df.sparkSession.createDataFrame(list(zip(range(lo, hi + 1), quantiles(df, x, pct))), "pct int, predvar double")
    got = quantiles_by(df, by, x, pct)
    return got.select(*by, F.posexplode("q").alias("p", "predvar")).select(*by, (F.col("p") + lo).alias("pct"), "predvar")


def find_mmt_blup(df: DataFrame, x: str, spec: BasisSpec, coef, lo: int = 1, hi: int = 99) -> DataFrame:
    """mmt and its percentile among the percentiles of x, of reduced (shrunken) coefficients."""
    v = len(coef)
    p = crosspred(percentile_grid(df, x, lo, hi), "predvar", spec, coef, np.zeros((v, v)))
    return p.agg(F.min_by("predvar", F.struct("fit", "pct")).alias("mmt"), F.min_by("pct", F.struct("fit", "pct")).alias("pct"))


def center_value(df: DataFrame, x: str, strategy: str | float, cb=None, coef=None, vcov=None) -> float:
    """mean, median, percentile_X, mmt or a number."""
    if isinstance(strategy, (int, float)):
        return float(strategy)
    if strategy == "mmt":
        return find_mmt(percentile_grid(df, x), "predvar", cb, coef, vcov).first().mmt
    if strategy == "mean":
        return df.agg(F.avg(x)).first()[0]
    share = 0.5 if strategy == "median" else float(strategy.removeprefix("percentile_")) / 100
    return (quantiles(df, x, [share]) or [None])[0]


def compare_centering(at: DataFrame, x: str, cb, coef, vcov, values: dict[str, float], **kw) -> DataFrame:
    """Predictions at every centre, told apart by the column center."""
    parts = [crosspred(at, x, cb, coef, vcov, cen=v, **kw).withColumn("center", F.lit(k)) for k, v in values.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
