"""Attributable numbers and fractions.

The risk at an exposure is exp(fit) against the centre; forward and backward fractions, (RR - 1) / RR and 1 - 1 / RR,
are the same number, so both names are accepted. Rows with a NULL exposure or count are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lags import quantiles
from .crossbasis import CrossBasis
from .predict import center_value, crosspred, crossreduce


#: Groups whose simulated totals a task holds.
KEPT = 500


def fraction(rr: Column, direction: str = "back") -> Column:
    if direction not in ("back", "forw"):
        raise ValueError("direction: back or forw")
    return 1 - 1 / rr if direction == "back" else (rr - 1) / rr


def attributed(df: DataFrame, x: str, cases: str, cb, coef, vcov, cen: float, direction: str = "back") -> DataFrame:
    """df with rr, af and an per row."""
    got = crosspred(df.where(F.col(x).isNotNull() & F.col(cases).isNotNull()), x, cb, coef, vcov, cen=cen)
    return got.select(*df.columns, "rr").withColumn("af", fraction(F.col("rr"), direction)).withColumn("an", F.col("af") * F.col(cases))


def in_range(x: str, lo: float | None, hi: float | None) -> Column:
    at = F.lit(True)
    at = at & (F.col(x) >= lo) if lo is not None else at
    return at & (F.col(x) <= hi) if hi is not None else at


def attrdl(df: DataFrame, x: str, cases: str, cb, coef, vcov, cen: float, *, range_=(None, None), sub: Column | None = None, by: Sequence[str] = (), direction: str = "back") -> DataFrame:
    """(by, an, af, cases): totals within an inclusive range of exposures, and a subset of rows."""
    rows = attributed(df if sub is None else df.where(sub), x, cases, cb, coef, vcov, cen, direction).where(in_range(x, *range_))
    return rows.groupBy(*by).agg(F.sum("an").alias("an"), F.try_divide(F.sum("an"), F.sum(cases)).alias("af"), F.sum(cases).alias("cases"))


def attrdl_lagged(w: DataFrame, x: str, cases: str, cb: CrossBasis, coef, range_=(None, None), by: Sequence[str] = ()) -> DataFrame:
    """Totals from the whole exposure history: w has the columns of a (centred) cross-basis; incomplete rows are left out."""
    eta = sum((F.col(n) * float(c) for n, c in zip(cb.names, coef)), F.lit(0.0))
    rows = w.where(in_range(x, *range_)).withColumn("_an", (1 - F.exp(-eta)) * F.col(cases)).where("_an is not null")
    return rows.groupBy(*by).agg(F.sum("_an").alias("an"), F.try_divide(F.sum("_an"), F.sum(cases)).alias("af"))


def attr_heat_cold(df: DataFrame, x: str, cases: str, cb, coef, vcov, cen: float, percentiles=(2.5, 97.5), by: Sequence[str] = ()) -> DataFrame:
    """Cold (up to the lower percentile), heat (from the upper) and their total, in one pass after the percentiles."""
    lo, hi = quantiles(df, x, [p / 100 for p in percentiles]) or (None, None)
    rows = attributed(df, x, cases, cb, coef, vcov, cen)
    part = lambda c, n: F.coalesce(F.sum(F.when(c, F.col("an"))), F.lit(0.0)).alias(n)
    cold, heat = F.col(x) <= F.lit(lo), F.col(x) >= F.lit(hi)
    return rows.groupBy(*by).agg(part(cold, "an_cold"), part(heat, "an_heat"), part(cold | heat, "an_total"), F.sum(cases).alias("cases"))


#: The tails, by default; what lies between the 10th and the 90th percentile is in no band.
BANDS = ((0, 1), (1, 5), (5, 10), (90, 95), (95, 99), (99, 100))


def attr_by_percentiles(df: DataFrame, x: str, cases: str, cb, coef, vcov, cen: float, bands=BANDS, by: Sequence[str] = ()) -> DataFrame:
    """A row per percentile band, inclusive at both ends."""
    probs = sorted({p for b in bands for p in b})
    at = dict(zip(probs, quantiles(df, x, [p / 100 for p in probs]) or [None] * len(probs)))
    table = F.array(*(F.struct(F.lit(f"{a:g}-{b:g}").alias("band"), F.lit(at[a]).alias("lo"), F.lit(at[b]).alias("hi")) for a, b in bands))
    rows = attributed(df, x, cases, cb, coef, vcov, cen).withColumn("b", F.explode(F.filter(table, lambda t: (F.col(x) >= t.lo) & (F.col(x) <= t.hi))))
    return rows.groupBy(*by, F.col("b.band").alias("band")).agg(F.count("*").alias("n_rows"), F.sum("an").alias("an"), F.try_divide(F.sum("an"), F.sum(cases)).alias("af"))


def attribution_report(df: DataFrame, x: str, cases: str, cb, coef, vcov, cen: float | None = None, percentiles=(2.5, 97.5), bands=BANDS) -> DataFrame:
    """(part, cen, n_rows, an, af, cases): total, cold, heat and percentile bands in one table, against the optimum.

    cen None: the exposure of least effect among the percentiles of x. Parts overlap, so they do not add up.
    """
    cen = center_value(df, x, "mmt", cb, coef, vcov) if cen is None else cen
    probs = sorted({*percentiles, *(p for b in bands for p in b)})
    at = dict(zip(probs, quantiles(df, x, [p / 100 for p in probs]) or [None] * len(probs)))
    limits = [("total", None, None), ("cold", None, at[percentiles[0]]), ("heat", at[percentiles[1]], None), *((f"{a:g}-{b:g}", at[a], at[b]) for a, b in bands)]
    parts = F.array_compact(F.array(*(F.when(in_range(x, lo, hi), F.lit(name)) for name, lo, hi in limits)))
    rows = attributed(df, x, cases, cb, coef, vcov, cen).withColumn("part", F.explode(parts))
    return rows.groupBy("part").agg(F.lit(float(cen)).alias("cen"), F.count("*").alias("n_rows"), F.sum("an").alias("an"), F.try_divide(F.sum("an"), F.sum(cases)).alias("af"), F.sum(cases).alias("cases"))


def simulated(df: DataFrame, x: str, cases: str, cb, coef, vcov, cen: float, nsim: int = 1000, seed: int = 0, range_=(None, None)) -> DataFrame:
    """(sim, an): totals under draws of the coefficients. Exposures are summed up first; each task adds up its own."""
    if isinstance(cb, CrossBasis):
        if len(coef) != cb.var.size:
            coef, vcov = crossreduce(cb, coef, vcov)
        cb = cb.var
    spec = cb.centered(cen)
    coef, vcov = np.asarray(coef, float), np.asarray(vcov, float)
    values, vectors = np.linalg.eigh(vcov)
    draws = coef + np.random.default_rng(seed).standard_normal((nsim, len(coef))) * np.sqrt(np.maximum(values, 0)) @ vectors.T
    totals = df.where(in_range(x, *range_) & F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("x")).agg(F.sum(cases).cast("double").alias("n"))

    def run(batches):
        an = np.zeros(nsim)
        for b in batches:
            r, n = spec.numpy(b.column(0).to_numpy()), b.column(1).to_numpy()
            for i in range(0, len(r), 4096):
                an += ((1 - np.exp(-(r[i : i + 4096] @ draws.T))) * n[i : i + 4096, None]).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(nsim)), pa.array(an)], names=["sim", "an"])

    return totals.mapInArrow(run, "sim long, an double").groupBy("sim").agg(F.sum("an").alias("an"))


def simulated_lagged(w: DataFrame, x: str, cases: str, cb: CrossBasis, coef, vcov, nsim: int = 1000, seed: int = 0, range_=(None, None), by: Sequence[str] = ()) -> DataFrame:
    """(by, sim, an): totals from the whole exposure history under draws of all coefficients.

    w has the columns of a (centred) cross-basis; incomplete rows are left out, as in attrdl_lagged. Rows meet the
    draws in blocks of Arrow rows; a task adds up its own, and passes on the sums of KEPT groups at a time.
    """
    coef, vcov, keys = np.asarray(coef, float), np.asarray(vcov, float), list(by)
    values, vectors = np.linalg.eigh(vcov)
    draws = coef + np.random.default_rng(seed).standard_normal((nsim, len(coef))) * np.sqrt(np.maximum(values, 0)) @ vectors.T
    group = F.struct(*(F.col(k) for k in keys)) if keys else F.struct(F.lit(0).alias("_all"))
    rows = w.where(in_range(x, *range_)).select(group.alias("g"), *(F.col(n).cast("double").alias(f"w{i}") for i, n in enumerate(cb.names)), F.col(cases).cast("double").alias("n")).na.drop(subset=["n", *(f"w{i}" for i in range(len(coef)))])
    kind = rows.schema["g"].dataType.simpleString()

    def run(batches):
        sums: dict = {}
        kinds = None
        for b in batches:
            kinds = b.column("g").type
            m = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(1, b.num_columns)])
            names = [tuple(g.values()) for g in b.column("g").to_pylist()]
            codes = {g: i for i, g in enumerate(dict.fromkeys(names))}
            at = np.array([codes[g] for g in names], int)
            part = np.zeros((len(codes), nsim))
            for i in range(0, len(m), 1024):
                np.add.at(part, at[i : i + 1024], (1 - np.exp(-(m[i : i + 1024, :-1] @ draws.T))) * m[i : i + 1024, -1:])
            for g, i in codes.items():
                sums[g] = sums[g] + part[i] if g in sums else part[i]
            if len(sums) >= KEPT:
                yield from told(sums, kinds)
                sums = {}
        if sums:
            yield from told(sums, kinds)

    def told(sums, kinds):
        fields = [f.name for f in kinds]
        for g, an in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([dict(zip(fields, g))] * nsim, kinds), pa.array(np.arange(nsim)), pa.array(an)], names=["g", "sim", "an"])

    got = rows.mapInArrow(run, f"g {kind}, sim long, an double").groupBy("g", "sim").agg(F.sum("an").alias("an"))
    return got.select(*(F.col(f"g.{k}").alias(k) for k in keys), "sim", "an")


def lagged_interval(w: DataFrame, *args, level: float = 0.95, by: Sequence[str] = (), **kw) -> DataFrame:
    """(by, an_low, an_high) of simulated_lagged."""
    tail = (1 - level) / 2
    return simulated_lagged(w, *args, by=by, **kw).groupBy(*by).agg(F.percentile("an", tail).alias("an_low"), F.percentile("an", 1 - tail).alias("an_high"))


def simulated_interval(df: DataFrame, *args, level: float = 0.95, **kw) -> DataFrame:
    tail = (1 - level) / 2
    return simulated(df, *args, **kw).agg(F.percentile("an", tail).alias("an_low"), F.percentile("an", 1 - tail).alias("an_high"))
