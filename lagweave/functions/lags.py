"""Lag ranges, knots and lagged columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mklag(lag) -> tuple[int, int]:
    """k >= 0 gives (0, k), k < 0 gives (k, 0), an ordered pair itself."""
    if isinstance(lag, (int, float)):
        return (0, int(lag)) if lag >= 0 else (int(lag), 0)
    pair = [int(x) for x in lag]
    if len(pair) == 1:
        return mklag(pair[0])
    if len(pair) != 2 or pair[0] > pair[1]:
        raise ValueError("lag: one integer, or two in order")
    return pair[0], pair[1]


def seqlag(lag, by: float = 1) -> list[float]:
    """lo, lo + by, ... up to hi and not beyond."""
    lo, hi = mklag(lag)
    if by <= 0:
        raise ValueError("by must be positive")
    out = [lo + i * by for i in range(int((hi - lo) / by + 1e-9) + 1)]
    return [int(x) if float(x).is_integer() else x for x in out]


def inner_knots(fun: str, df: int, degree: int = 3, intercept: bool = False) -> int:
    """How many interior knots give a basis of df columns."""
    n = df - int(intercept) - (degree if fun == "bs" else 0 if fun == "strata" else 1)
    return max(0, n)


def equalknots(df: DataFrame, x: str, fun: str = "ns", n_df: int = 5, degree: int = 3) -> list[float]:
    """Interior knots at equally spaced exact quantiles of x (NULL and NaN skipped): one aggregate row."""
    n = n_df - 1 if fun != "bs" else n_df - degree - 1
    return quantiles(df, x, [i / (n + 1) for i in range(1, n + 1)]) if n > 0 else []


#: Distinct values up to which one aggregation buffer may hold all of a column's values and their counts.
HELD = 2_000_000


def quantiles(df: DataFrame, x: str, probs: Sequence[float]) -> list[float]:
    """Exact quantiles with linear interpolation, of the values that are not NULL or NaN; [] if there are none.

    The exact percentile keeps every distinct value in one buffer, so their number is checked first; beyond HELD each
    quantile is bracketed by a sketch, and only what lies between is sorted out exactly.
    """
    if not probs:
        return []
    values = df.select(F.nanvl(F.col(x).cast("double"), F.lit(None)).alias("v")).where("v is not null")
    n, distinct = values.agg(F.count("*"), F.approx_count_distinct("v")).first()
    probs = [float(p) for p in probs]
    if not n:
        return []
    if distinct <= HELD:
        return list(values.agg(F.percentile("v", probs)).first()[0])
    return bracketed(values, n, probs)


def bracketed(values: DataFrame, n: int, probs: Sequence[float]) -> list[float]:
    """Exact quantiles of v from brackets that hold the two order statistics beside each of them."""
    share = min(0.01, max(1e-6, HELD / (8.0 * n * len(probs))))
    at = [p * (n - 1) for p in probs]
    while True:
        # A sketch errs by at most `share` of the rows; open ends where a bracket would pass the first or last row.
        ends = [(p - 2 * share, p + 2 * share) for p in probs]
        asked = [min(1.0, max(0.0, e)) for pair in ends for e in pair]
        got = values.agg(F.percentile_approx("v", asked, int(1 / share) + 1)).first()[0]
        low = [got[2 * i] if e[0] > 0 else float("-inf") for i, e in enumerate(ends)]
        high = [got[2 * i + 1] if e[1] < 1 else float("inf") for i, e in enumerate(ends)]
        inside = [F.col("v").between(F.lit(a), F.lit(b)) for a, b in zip(low, high)]
        counts = values.agg(*(F.count_if(F.col("v") < F.lit(a)) for a in low), *map(F.count_if, inside)).first()
        below, held = counts[: len(probs)], counts[len(probs) :]
        if all(b <= int(h) and min(int(h) + 2, n) <= b + m for h, b, m in zip(at, below, held)):
            break
        share *= 4
    places = [(h - b) / (m - 1) if m > 1 else 0.0 for h, b, m in zip(at, below, held)]
    exact = values.agg(*(F.percentile(F.when(i, F.col("v")), min(1.0, max(0.0, p))) for i, p in zip(inside, places))).first()
    return list(exact)


def logknots(x, nk: int | None = None, fun: str = "ns", n_df: int = 1, degree: int = 3, intercept: bool = True) -> list[float]:
    """nk knots equally spaced in the logarithm of the lag; from df if nk is not given."""
    values = list(x) if not isinstance(x, (int, float)) else list(mklag(x))
    lo, hi = min(values), max(values)
    if nk is None:
        nk = n_df - {"bs": degree, "strata": 0}.get(fun, 1) - int(intercept)
        nk = max(nk, 1) if n_df == 1 else nk
    if nk < 1 or hi <= lo:
        raise ValueError("knots need a positive number and a range above 0")
    step = (1 + math.log(hi - lo)) / (nk + 1)
    return [lo + math.exp(step * k - 1) for k in range(1, nk + 1)]


def spine(df: DataFrame, t: str, by: Sequence[str] = ()) -> DataFrame:
    """A row for every integer t between a location's first and last, so that row lags are calendar lags."""
    ends = df.groupBy(*by).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    full = ends.select(*by, F.explode(F.sequence("_lo", "_hi")).alias(t))
    return full.join(df, [*by, t], "left")


def lag_matrix(df: DataFrame, x: str, t: str, lag, by: Sequence[str] = (), prefix: str = "lag") -> DataFrame:
    """Columns <prefix>0, <prefix>1, ... of x at t - lag on a dense series; NULL beyond its ends (leads too)."""
    w = Window.partitionBy(*by).orderBy(t)
    name = lambda k: f"{prefix}{k}" if k >= 0 else f"{prefix}_m{-k}"
    return df.select("*", *((F.lag(x, k) if k >= 0 else F.lead(x, -k)).over(w).alias(name(k)) for k in seqlag(lag)))


def exphist(df: DataFrame, x: str, t: str, times: DataFrame | None = None, lag=(0, 1), fill: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """(by, t, lag, x): the exposure nearest to t - lag within half a unit, the earlier of equals, else fill.

    Exposures meet targets on the unit cell of their time and its two neighbours, an equi-join for any times.
    """
    at = (times or df).select(*by, F.col(t).alias(t)).distinct()
    want = at.select(*by, t, F.explode(F.array(*(F.lit(float(k)) for k in seqlag(lag)))).alias("lag"))
    want = want.withColumn("_target", F.col(t) - F.col("lag")).withColumn("_cell", F.round("_target").cast("long"))
    have = df.select(*by, F.col(t).cast("double").alias("_t"), F.col(x).cast("double").alias("_x"))
    have = have.withColumn("_cell", F.explode(F.array(*(F.round("_t").cast("long") + d for d in (-1, 0, 1)))))
    got = want.join(have, [*by, "_cell"], "left").withColumn("_d", F.abs(F.col("_t") - F.col("_target")))
    near = F.min_by("_x", F.when(F.col("_d") < 0.5, F.struct("_d", "_t")))
    return got.groupBy(*by, t, "lag").agg(F.coalesce(near, F.lit(float(fill))).alias("x"))
