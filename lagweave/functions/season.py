"""Natural splines of the date with degrees of freedom per year, from knots that are a series' own."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bases import BasisSpec
from .groups import quantiles_by


def natural_in_b_splines(knots: Sequence[float], bounds: tuple[float, float]) -> tuple[BasisSpec, np.ndarray]:
    """A B-spline basis and the matrix that takes it to natural splines without a constant (len(knots) + 1 columns).

    Same curves as the truncated powers of `ns`, but each B-spline is short, so that dozens of knots do not spoil the
    normal equations.
    """
    spec = BasisSpec("bs", 3, tuple(knots), bounds)
    ends = [bounds[0], *knots, bounds[1]]
    at = [ends[0] + np.arange(4) * (ends[1] - ends[0]) / 3, ends[-1] - np.arange(4) * (ends[-1] - ends[-2]) / 3]
    bent = np.stack([np.array([2, -5, 4, -1]) @ spec.numpy(x) for x in at])  # second derivatives of cubics, to scale
    q, _ = np.linalg.qr((bent / np.abs(bent).max(1, keepdims=True)).T, mode="complete")
    return spec, q[:, 2:]


@dataclass(frozen=True)
class Season:
    """A natural spline of the day t, dfseas degrees of freedom for every year of `date` that a series has."""

    t: str
    date: str
    dfseas: int = 8

    def size(self, years: int) -> int:
        return self.dfseas * max(1, years)

    def knots(self, t: np.ndarray, years: int) -> list[float]:
        """Both ends and the knots between them, at equal shares of the days."""
        n = self.size(years)
        t = t[~np.isnan(t)]
        return np.quantile(t, np.arange(n + 1) / n).tolist() if len(t) else [i / n for i in range(n + 1)]

    def table(self, df: DataFrame, by: Sequence[str], **kw) -> DataFrame:
        """(by, ends): the same for every group, whatever its size; a row for a single series without groups."""
        years: Column = F.greatest(F.col("years"), F.lit(1)) * self.dfseas
        probs = F.transform(F.sequence(F.lit(0).cast("long"), years.cast("long")), lambda i: i / years)
        got = quantiles_by(df, by, self.t, probs, [F.count_distinct(F.year(self.date)).alias("years")], **kw)
        return got.select(*by, F.coalesce("q", F.transform(F.sequence(F.lit(0).cast("long"), years.cast("long")), lambda i: i / years)).alias("ends"))


def season_columns(ends: Sequence[float], t: np.ndarray) -> np.ndarray:
    """A row per day of t, a column per degree of freedom."""
    lo, *knots, hi = ends
    spec, q = natural_in_b_splines(knots, (float(lo), float(hi)))
    return spec.numpy(t) @ q
