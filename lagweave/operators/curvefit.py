"""Curves rebuilt from points of theirs: least squares on a B-spline with a series' own knots, for any number of series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import BasisSpec
from ..functions.groups import joined, own_basis
from .grouped import fit_locations
from .predict import linear_form


def rebuild(points: DataFrame, at: DataFrame, by: str, x: str, y: str, knots: DataFrame, n_knots: int, degree: int = 2, name: str = "fit") -> DataFrame:
    """at (by, x, ...) with `name`: the least-squares spline of its series' points (by, x, y), at x.

    knots: (by, knots, lo, hi), n_knots interior knots a series and the range of its curve. NULL where x is, where a
    series has no knots, or no more points than the spline has coefficients.
    """
    spec = BasisSpec("bs", degree=degree, knots=tuple(float(i) for i in range(1, n_knots + 1)), bounds=(0.0, n_knots + 1.0))
    names = [f"_r{i}" for i in range(spec.size)]
    fitted = fit_locations(own_basis(points.select(by, x, y), by, x, spec, knots, names), by, y, names, "gaussian", counted=points)
    rows = joined(own_basis(at, by, x, spec, knots, names), fitted.select(by, F.col("coef").alias("_coef")), [by], "left")
    known = F.when(F.col(names[0]).isNotNull(), linear_form(F.array(F.lit(1.0), *names), F.col("_coef")))
    return rows.withColumn(name, F.nanvl(known, F.lit(None).cast("double"))).drop("_coef", *names)
