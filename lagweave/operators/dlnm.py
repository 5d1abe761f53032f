"""Whole models in one call: cross-basis, covariates, day of the week and seasonality, fitted and reduced."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.groups import own_basis, own_knots
from ..functions.lags import quantiles
from ..functions.season import Season, natural_in_b_splines, season_columns
from .crossbasis import CrossBasis
from .glm import FitResult, dow_dummies, fit_glm
from .grouped import fit_locations
from .predict import crossreduce


def seasonality(df: DataFrame, date: str, t: str, dfseas: int = 8, prefix: str = "season") -> tuple[DataFrame, list[str]]:
    """df with a natural spline of the day, dfseas degrees of freedom for every year that df has."""
    years = df.select(F.count_distinct(F.year(date))).first()[0]
    n = dfseas * max(1, years)
    ends = quantiles(df, t, [i / n for i in range(n + 1)]) or [i / n for i in range(n + 1)]
    names = [f"{prefix}{i}" for i in range(1, n + 1)]

    def run(batches):
        for b in batches:
            m = season_columns(ends, b.column(t).to_numpy(zero_copy_only=False).astype(float))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.ascontiguousarray(c), from_pandas=True) for c in m.T)], names=[*b.schema.names, *names])

    kinds = [*df.schema.fields, *(T.StructField(k, T.DoubleType()) for k in names)]
    return df.mapInArrow(run, T.StructType(kinds)), names


def design(df: DataFrame, cb: CrossBasis, x: str, t: str, *, date: str | None = None, dfseas: int | None = None, dow: bool = False, by: Sequence[str] = (), knots: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """df with the cross-basis columns, and the names of the covariates that were added.

    dfseas is for one series (by: empty); a model per location takes a Season. knots: (by, knots, lo, hi), where the
    knots and the range of the exposure's basis are a location's own.
    """
    out, names = df, []
    if dow:
        out, names = dow_dummies(out, date)
    if dfseas:
        out, more = seasonality(out, date, t, dfseas)
        names = [*names, *more]
    if knots is None:
        return out.join(cb.series(df, x, t, by), [*by, t]), names
    values = [f"_r{i}" for i in range(cb.var.size)]
    return out.join(cb.series(own_basis(df.select(*by, t, x), by[0], x, cb.var, knots, values), x, t, by, values=values), [*by, t]), names


@dataclass
class Dlnm:
    """A fitted model: coef and vcov are those of the exposure's basis, summed over the lags."""

    cb: CrossBasis
    fit: FitResult
    coef: np.ndarray
    vcov: np.ndarray


def fit_dlnm(df: DataFrame, cb: CrossBasis, x: str, y: str, t: str, *, family: str = "quasipoisson", date: str | None = None, dfseas: int | None = None, dow: bool = False, covariates: Sequence[str] = (), offset: str | None = None, by: str | None = None, knots_at: Sequence[float] | None = None) -> Dlnm | DataFrame:
    """y ~ cross-basis of x + covariates + day of the week + spline of the date, on complete rows.

    t: integer days, once per location. by: a model per location, as (by, coef, vcov, dispersion, n, converged) with
    coef and vcov reduced to the exposure's basis; else one model. A model that does not converge raises.

    Each location has the degrees of freedom of its own years, with knots at its own days; knots_at: shares of a
    location's exposures at which the knots of its exposure's basis lie, in place of those of cb.
    """
    if (dow or dfseas) and date is None:
        raise ValueError("the day of the week and seasonality take the column of the date")
    if by:
        return fit_regions(df, cb, x, y, t, by, family=family, date=date, dfseas=dfseas, dow=dow, covariates=covariates, offset=offset, knots=own_knots(df, by, x, knots_at) if knots_at else None)
    full, more = design(df, cb, x, t, date=date, dfseas=dfseas, dow=dow)
    names = [*cb.names, *covariates, *more]
    full = full.select(y, *names, *([offset] if offset else [])).cache()
    fit = fit_glm(full, y, names, family, offset)
    full.unpersist()
    if not fit.converged:
        raise ValueError("the model did not converge")
    return Dlnm(cb, fit, *crossreduce(cb, *fit.part(cb.names)))


def fit_regions(df: DataFrame, cb: CrossBasis, x: str, y: str, t: str, by: str, *, family: str, date: str | None, dfseas: int | None, dow: bool, covariates: Sequence[str], offset: str | None, knots: DataFrame | None = None) -> DataFrame:
    """A model per location, reduced to the exposure's basis."""
    full, more = design(df, cb, x, t, date=date, dow=dow, by=[by], knots=knots)
    names = [*cb.names, *covariates, *more]
    season = Season(t, date, dfseas) if dfseas else None
    return fit_locations(full, by, y, names, family, reduction(cb, len(names) - len(cb.names)), offset=offset, season=season, t=t, counted=df)


def reduction(cb: CrossBasis, others: int) -> np.ndarray:
    """The form that takes a whole model's coefficients to the overall ones of the exposure's basis."""
    m = cb.reduce_to(cb.lag_matrix().sum(0))
    return np.column_stack([np.zeros((len(m), 1)), m, np.zeros((len(m), others))])
