"""Cross-bases: W[t, v, l] = sum over lags of R_v(x[t - lag]) C_l(lag).

Every observation is spread over the rows it reaches (one per lag, with the lag basis as literals) and summed by
location and time: one shuffle with partial sums, and calendar lags whether or not the series has gaps. Or each row
gathers its history by a range frame over integer times, in blocks of a location's times that overlap by the lags, so
that the shuffle has little more than a row per observation and no location is one task's.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import BasisSpec, fit_basis, lag_basis, literals
from ..functions.lags import mklag


#: Times in a block of the range frame, in lags: the share of rows that are shuffled twice is one in so many.
BLOCK_LAGS = 64


@dataclass(frozen=True)
class CrossBasis:
    """var: the exposure's basis; lags: the lags' basis; lag: the range."""

    var: BasisSpec
    lags: BasisSpec
    lag: tuple[int, int]

    @classmethod
    def fit(cls, df: DataFrame, x: str, lag, argvar: dict | None = None, arglag: dict | None = None) -> CrossBasis:
        """Both arguments: fun and the options of its basis; lag bases have an intercept unless told otherwise."""
        lag = mklag(lag)
        return cls(fit_basis(df, x, **({"fun": "ns"} | (argvar or {}))), lag_basis(lag, **({"fun": "ns"} | (arglag or {}))), lag)

    def lag_matrix(self, lags=None) -> np.ndarray:
        return self.lags.numpy(np.arange(self.lag[0], self.lag[1] + 1) if lags is None else lags)

    @property
    def shape(self) -> tuple[int, int]:
        return self.var.size, self.lags.size

    @property
    def names(self) -> list[str]:
        v, n = self.shape
        return [f"v{i}_l{j}" for i in range(1, v + 1) for j in range(1, n + 1)]

    def centered(self, cen: float | None) -> CrossBasis:
        return CrossBasis(self.var.centered(cen), self.lags, self.lag)

    def series(self, df: DataFrame, x: str = "x", t: str = "t", by: Sequence[str] = (), na: str = "null", values: Sequence[str] | None = None, frame: bool = False) -> DataFrame:
        """(by, t, names): a row per row of df; NULL without the whole history.

        by: location, and season or any other group that histories must not cross. t: integers, once per group.
        na='zero': missing exposures inside a history count as 0. values: columns that hold the exposure's basis already,
        as where knots are a location's own. frame: gather by a range frame instead of spreading rows over the lags.
        """
        if frame:
            return self._framed(df, x, t, by, na, values)
        c = self.lag_matrix()
        v, n = self.shape
        lags = list(range(self.lag[0], self.lag[1] + 1))
        spread = F.array(*(F.struct(F.lit(k).alias("lag"), *(F.lit(float(a)).alias(f"c{j}") for j, a in enumerate(row))) for k, row in zip(lags, c)), F.struct(F.lit(None).cast("int").alias("lag"), *(F.lit(0.0).alias(f"c{j}") for j in range(n))))
        r = [b.alias(f"r{i}") for i, b in enumerate(map(F.col, values) if values else self.var.columns(F.col(x)))]
        long = df.select(*by, F.col(t).alias("_t"), *r, F.explode(spread).alias("s"))
        sums = [F.sum(F.col(f"r{i}") * F.col(f"s.c{j}")).alias(f"w{i}_{j}") for i in range(v) for j in range(n)]
        full = F.count(F.when(F.col("s.lag").isNotNull(), F.col("r0") if na == "null" else F.lit(1)))
        got = long.groupBy(*by, (F.col("_t") + F.coalesce("s.lag", F.lit(0))).alias(t)).agg(*sums, full.alias("_n"), F.max(F.col("s.lag").isNull()).alias("_own"))
        value = lambda i, j: F.coalesce(F.col(f"w{i}_{j}"), F.lit(0.0)) if na == "zero" else F.col(f"w{i}_{j}")
        ok = F.col("_n") == len(lags)
        return got.where("_own").select(*by, t, *(F.when(ok, value(i, j)).alias(f"v{i + 1}_l{j + 1}") for i in range(v) for j in range(n)))

    def _framed(self, df: DataFrame, x: str, t: str, by: Sequence[str], na: str, values: Sequence[str] | None) -> DataFrame:
        c, (lo, hi) = self.lag_matrix(), self.lag
        v, n = self.shape
        width = BLOCK_LAGS * (hi - lo + 1)
        block = lambda d: F.floor((F.col("_t") + d) / width)
        r = [b.cast("double").alias(f"r{i}") for i, b in enumerate(map(F.col, values) if values else self.var.columns(F.col(x)))]
        rows = df.select(*by, F.col(t).alias("_t"), F.array(*r).alias("_r"))
        spread = rows.withColumn("_b", F.explode(F.sequence(block(min(lo, 0)), block(max(hi, 0)))))
        history = Window.partitionBy(*by, "_b").orderBy("_t").rangeBetween(-hi, -lo)
        known = F.when(F.get("_r", F.lit(0)).isNotNull(), F.struct("_t", "_r")) if na == "null" else F.struct("_t", "_r")
        got = spread.withColumn("_h", F.collect_list(known).over(history)).where(F.col("_b") == block(0))
        full = got.select(*by, F.col("_t").alias(t), F.when(F.size("_h") == hi - lo + 1, F.col("_h")).alias("_h"))
        # The history of a complete row is in the order of time: from lag hi down to lo.
        value = lambda h, i: F.coalesce(F.get(h["_r"], F.lit(i)), F.lit(0.0)) if na == "zero" else F.get(h["_r"], F.lit(i))
        total = lambda i, j: F.aggregate(F.zip_with("_h", literals(c[::-1, j]), lambda h, a: value(h, i) * a), F.lit(0.0), lambda s, w: s + w)
        return full.select(*by, t, *(total(i, j).alias(f"v{i + 1}_l{j + 1}") for i in range(v) for j in range(n)))

    def matrix(self, df: DataFrame, history: str) -> DataFrame:
        """df with names from an array column of exposures at lag lo, lo + 1, ...; NULL unless all are there."""
        c = self.lag_matrix()
        v, n = self.shape
        length = self.lag[1] - self.lag[0] + 1
        held = "_" + max(df.columns, key=len)  # the exposure's basis at each lag, evaluated once
        basis = F.transform(F.col(history), lambda h: F.array(*self.var.columns(h)))
        rows = df.select("*", F.when(F.size(history) == length, basis).alias(held))
        total = lambda i, j: F.aggregate(F.zip_with(held, literals(c[:, j]), lambda r, a: F.get(r, F.lit(i)) * a), F.lit(0.0), lambda s, w: s + w)
        return rows.select(*df.columns, *(total(i, j).alias(f"v{i + 1}_l{j + 1}") for i in range(v) for j in range(n)))

    def reduce_to(self, rows: np.ndarray) -> np.ndarray:
        """M that takes the coefficients to those of the exposure's basis at a weight per lag basis column (v x v l)."""
        return np.kron(np.eye(self.shape[0]), np.asarray(rows, float)[None, :])
