"""Interpolation within series and agreement between two curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interpolate(df: DataFrame, t: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """df with NULLs of x filled by the line between its neighbours in t; NULL before the first and after the last."""
    at = F.when(F.col(x).isNotNull(), F.struct(F.col(t).alias("t"), F.col(x).alias("x")))
    w = Window.partitionBy(*by).orderBy(t)
    before = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    got = df.withColumn("_a", before).withColumn("_b", after)
    line = F.col("_a.x") + (F.col("_b.x") - F.col("_a.x")) * (F.col(t) - F.col("_a.t")) / F.when(F.col("_b.t") != F.col("_a.t"), F.col("_b.t") - F.col("_a.t"))
    return got.withColumn(x, F.when(F.col("_a.t") == F.col("_b.t"), F.col("_a.x")).otherwise(line)).drop("_a", "_b")


def at_points(curve: DataFrame, points: DataFrame, t: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """x of a curve, interpolated at the t of points."""
    both = curve.select(*by, t, x, F.lit(False).alias("_p")).unionByName(points.select(*by, t, F.lit(None).cast("double").alias(x), F.lit(True).alias("_p")))
    known = both.groupBy(*by, t).agg(F.avg(x).alias(x), F.max("_p").alias("_p"))
    return interpolate(known, t, x, by).where("_p").drop("_p")


def agreement(df: DataFrame, a: str, b: str, by: Sequence[str] = (), close: float | Sequence[float] = 0.05) -> DataFrame:
    """Largest and mean absolute difference, root mean square, correlation, and how many rows differ by less than close.

    Several limits give n_close1, n_close2, ... in their order.
    """
    d = F.abs(F.col(a) - F.col(b))
    one = isinstance(close, (int, float))
    near = [F.count_if(d < c).alias("n_close" if one else f"n_close{i}") for i, c in enumerate([close] if one else close, 1)]
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff"), F.sqrt(F.avg(d * d)).alias("rmse"), F.corr(a, b).alias("correlation"), *near
    )
