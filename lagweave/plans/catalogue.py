"""The registered queries of the engine, each with SQL for the same rows where SQL can say it.

The SQL is written from the formulae, not from the library. Floating-point columns are rounded to six decimals on
both sides; fixed coefficients keep prediction apart from fitting.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bases, groups, lags
from ..operators import attribution, dlnm, glm, grouped, meta, penalized, predict, seasonality
from ..operators.crossbasis import CrossBasis
from ..operators.curvefit import rebuild
from . import series

QUERIES: dict = {}
SQL: dict[str, str] = {}
FLAGSHIP = "flagship_effects"
#: Added before rounding on both sides: means of cents often lie half-way, where the last bit would decide.
NUDGE = 1e-09


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c + F.lit(NUDGE), 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """df with its double columns rounded."""
    return df.select(*(r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def q6(e: str) -> str:
    return f"(round(CAST({e} AS DOUBLE) + {NUDGE!r}, 6) + 0.0)"


# -- series ------------------------------------------------------------------------------------------------
DAY = "CAST(date_diff('day', DATE '1995-01-01', {}) AS INTEGER)"
SHIP = (
    f"s0 AS (SELECT {DAY.format('CAST(l_shipdate AS DATE)')} AS t, count(*) AS y, avg(l_quantity) AS x FROM lineitem GROUP BY 1), "
    "s AS (SELECT CAST(g.t AS INTEGER) AS t, coalesce(y, 0) AS y, x FROM (SELECT unnest(generate_series((SELECT min(t) FROM s0), (SELECT max(t) FROM s0))) AS t) g LEFT JOIN s0 ON s0.t = g.t)"
)
REGION = (
    f"r0 AS (SELECT r_name, {DAY.format('CAST(o_orderdate AS DATE)')} AS t, count(*) AS y, avg(o_totalprice) / 1000 AS x FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2), "
    "r AS (SELECT g.r_name, CAST(g.t AS INTEGER) AS t, coalesce(y, 0) AS y, x FROM (SELECT r_name, unnest(generate_series(min(t), max(t))) AS t FROM r0 GROUP BY 1) g LEFT JOIN r0 ON r0.r_name = g.r_name AND r0.t = g.t)"
)
KNOTS = "k AS (SELECT quantile_cont(x, 0.1) AS k10, quantile_cont(x, 0.25) AS k25, quantile_cont(x, 0.5) AS k50, quantile_cont(x, 0.75) AS k75, quantile_cont(x, 0.9) AS k90, min(x) AS lo, max(x) AS hi, max(abs(x)) AS top, avg(x) AS mean FROM s)"


@query(f"WITH {SHIP} SELECT CAST(DATE '1995-01-01' + t AS VARCHAR) AS d, t, y, {q6('x')} AS x FROM s")
def series_daily(spark, sf_dir):
    return rounded(series.ship_daily(spark, sf_dir).withColumn("d", F.col("d").cast("string")))


@query(f"WITH {REGION} SELECT r_name, CAST(DATE '1995-01-01' + t AS VARCHAR) AS d, t, y, {q6('x')} AS x FROM r")
def series_region(spark, sf_dir):
    return rounded(series.region_daily(spark, sf_dir).withColumn("d", F.col("d").cast("string")))


@query(f"SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS t, count(*) AS y, {q6('avg(value)')} AS x FROM events GROUP BY 1, 2")
def series_hourly(spark, sf_dir):
    return rounded(series.event_hourly(spark, sf_dir))


# -- lags and knots ----------------------------------------------------------------------------------------
@query(f"WITH {SHIP} SELECT a.t, CAST(g.lag AS DOUBLE) AS lag, {q6('coalesce(b.x, 0)')} AS x FROM s a CROSS JOIN (SELECT unnest(range(0, 4)) AS lag) g LEFT JOIN s b ON b.t = a.t - g.lag")
def exphist_fill(spark, sf_dir):
    return rounded(lags.exphist(series.ship_daily(spark, sf_dir), "x", "t", lag=3))


@query(f"WITH {REGION} SELECT r_name, t, " + ", ".join(f"{q6(f'lag(x, {k}) OVER w')} AS lag{k}" for k in range(4)) + ", " + q6("lead(x, 1) OVER w") + " AS lag_m1 FROM r WINDOW w AS (PARTITION BY r_name ORDER BY t)")
def lag_matrix(spark, sf_dir):
    df = lags.lag_matrix(series.region_daily(spark, sf_dir), "x", "t", (-1, 3), ["r_name"])
    return rounded(df.select("r_name", "t", *(f"lag{k}" for k in range(4)), "lag_m1"))


@query(f"WITH {SHIP} SELECT unnest(['ns', 'ns', 'ns', 'bs']) AS fun, unnest([round(v + 1e-09, 6) + 0.0 for v in quantile_cont(x, [0.25, 0.5, 0.75, 0.5])]) AS knot FROM s")
def knots_quantile(spark, sf_dir):
    s = series.ship_daily(spark, sf_dir).cache()
    rows = [("ns", k) for k in lags.equalknots(s, "x", "ns", 4)] + [("bs", k) for k in lags.equalknots(s, "x", "bs", 5)]
    s.unpersist()
    return rounded(spark.createDataFrame(rows, "fun string, knot double"))


@query(f"WITH {SHIP}, a AS (SELECT max(t) - min(t) AS w FROM s), g AS (SELECT unnest(range(1, 4)) AS k) SELECT k, {q6('exp((1 + ln(w)) / 4 * k - 1)')} AS knot FROM a, g")
def knots_log(spark, sf_dir):
    """Log-spaced knots over a lag range as long as the series."""
    lo, hi = series.ship_daily(spark, sf_dir).agg(F.min("t"), F.max("t")).first()
    return rounded(spark.createDataFrame(list(enumerate(lags.logknots((0, hi - lo), nk=3), 1)), "k long, knot double"))


# -- bases -------------------------------------------------------------------------------------------------
def de_boor(x: str, t: list[str], p: int) -> list[str]:
    """SQL of the B-splines of degree p on knots t for x between the first and the last knot, which is included."""
    last = len(t) - p - 2
    b = {i: f"(CASE WHEN {x} >= {t[i]} AND {x} {'<=' if i == last else '<'} {t[i + 1]} THEN 1.0 ELSE 0.0 END)" for i in range(p, len(t) - p - 1)}
    for q in range(1, p + 1):
        new = {}
        for i in range(len(t) - q - 1):
            parts = []
            if i in b:
                parts.append(f"({x} - {t[i]}) / ({t[i + q]} - {t[i]}) * {b[i]}")
            if i + 1 in b:
                parts.append(f"({t[i + q + 1]} - {x}) / ({t[i + q + 1]} - {t[i + 1]}) * {b[i + 1]}")
            if parts:
                new[i] = "(" + " + ".join(parts) + ")"
        b = new
    return [b[i] for i in sorted(b)]


def natural(x: str, ks: list[str]) -> list[str]:
    """SQL of the natural cubic spline basis on [0, 1]-scaled x over scaled knots ks (0 and 1 included)."""
    d = [f"((greatest({x} - {k}, 0) ** 3 - greatest({x} - 1.0, 0) ** 3) / (1.0 - {k}))" for k in ks[:-1]]
    return [x, *(f"({dk} - {d[-1]})" for dk in d[:-1])]


def scaled(k: str) -> str:
    return f"(({k} - lo) / (hi - lo))"


def basis_sql(terms: list[str]) -> str:
    return f"WITH {SHIP}, {KNOTS} SELECT t, " + ", ".join(f"CASE WHEN x IS NOT NULL THEN {q6(e)} END AS b{i}" for i, e in enumerate(terms, 1)) + " FROM s, k"


def basis_query(name: str, terms: list[str], **kw):
    def f(spark, sf_dir):
        s = series.ship_daily(spark, sf_dir)
        spec = bases.fit_basis(s, "x", **kw)
        return rounded(bases.basis_columns(s.select("t", "x"), "x", spec).drop("x"))

    f.__name__ = name
    query(basis_sql(terms))(f)


basis_query("basis_lin", ["1.0", "x"], fun="lin", intercept=True)
basis_query("basis_poly", ["x / top", "(x / top) ** 2", "(x / top) ** 3"], fun="poly", degree=3)
basis_query("basis_strata", ["CASE WHEN x >= k25 AND x < k50 THEN 1.0 ELSE 0.0 END", "CASE WHEN x >= k50 AND x < k75 THEN 1.0 ELSE 0.0 END", "CASE WHEN x >= k75 THEN 1.0 ELSE 0.0 END"], fun="strata", df_=4)
basis_query("basis_thr_h", ["greatest(x - 25.5, 0)"], fun="thr", thr=25.5)
basis_query("basis_thr_l", ["greatest(k50 - x, 0)"], fun="thr", side="l")
basis_query("basis_thr_d", ["greatest(24.0 - x, 0)", "greatest(x - 27.0, 0)"], fun="thr", thr=[24.0, 27.0], side="d")
basis_query("basis_bs2", de_boor("x", ["lo"] * 3 + ["k50"] + ["hi"] * 3, 2)[1:], fun="bs", degree=2, df_=3)
basis_query("basis_bs3", de_boor("x", ["lo"] * 4 + ["k25", "k50", "k75"] + ["hi"] * 4, 3), fun="bs", degree=3, df_=7, intercept=True)
basis_query("basis_ns", natural(scaled("x"), ["0.0", scaled("k25"), scaled("k50"), scaled("k75"), "1.0"]), fun="ns", df_=4)
basis_query("basis_ns_trunc", ["x", *(f"(greatest(x - {k}, 0) ** 3 - greatest(x - hi, 0) ** 3 * (hi - {k}) / (hi - lo)) / (hi - lo) ** 2".replace(f"(hi - {k})", f"({k} - lo)") for k in ("k25", "k50", "k75"))], fun="ns_trunc", df_=4)


# -- cross-bases -------------------------------------------------------------------------------------------
def cross_sql(source: str, frame: str, r: list[str], c: list[list[float]], by: str = "", where: str = "k") -> str:
    """SQL of a cross-basis of exposure terms r and lag basis rows c, complete histories only."""
    values = ", ".join("(" + ", ".join([str(k), *map(repr, row)]) + ")" for k, row in enumerate(c))
    names = ", ".join(["lag", *(f"c{j}" for j in range(len(c[0])))])
    keys = f"{by}, " if by else ""
    sums = ", ".join(f"sum(r{i} * c{j}) AS w{i}_{j}" for i in range(len(r)) for j in range(len(c[0])))
    out = ", ".join(f"CASE WHEN n = {len(c)} THEN {q6(f'w{i}_{j}')} END AS v{i + 1}_l{j + 1}" for i in range(len(r)) for j in range(len(c[0])))
    rs = ", ".join(f"CASE WHEN x IS NOT NULL THEN {e} END AS r{i}" for i, e in enumerate(r))
    using = f"({by}, t)" if by else "(t)"
    return (
        f"WITH {source}, b AS (SELECT {keys}t, {rs} FROM {frame}{', k' if where else ''}), l AS (SELECT * FROM (VALUES {values}) AS v({names})), "
        f"a AS (SELECT {keys}b.t + l.lag AS t, count(r0) AS n, {sums} FROM b, l GROUP BY {keys}b.t + l.lag) SELECT {keys}t, {out} FROM {frame} LEFT JOIN a USING {using}"
    )


def crossed(spark, sf_dir, cb_of) -> DataFrame:
    s = series.ship_daily(spark, sf_dir)
    return rounded(cb_of(s).series(s, "x", "t"))


LIN = {"fun": "lin", "intercept": False}
L7 = [[k / 7] for k in range(8)]


@query(cross_sql(SHIP, "s", ["x"], [[float(k)] for k in range(8)], where=""))
def crossbasis_lin_lin(spark, sf_dir):
    return crossed(spark, sf_dir, lambda s: CrossBasis.fit(s, "x", 7, {"fun": "lin"}, LIN))


POLY_C = [[1.0, k / 7] for k in range(8)]
POLY = ({"fun": "poly", "degree": 2}, {"fun": "poly", "degree": 1})


@query(cross_sql(f"{SHIP}, {KNOTS}", "s", ["x / top", "(x / top) ** 2"], POLY_C))
def crossbasis_poly_poly(spark, sf_dir):
    return crossed(spark, sf_dir, lambda s: CrossBasis.fit(s, "x", 7, *POLY))


@query(cross_sql(f"{SHIP}, {KNOTS}", "s", ["greatest(x - k50, 0)"], [[1.0, 0.0, 0.0] if k < 2 else [1.0, 1.0, 0.0] if k < 5 else [1.0, 0.0, 1.0] for k in range(8)]))
def crossbasis_thr_strata(spark, sf_dir):
    return crossed(spark, sf_dir, lambda s: CrossBasis.fit(s, "x", 7, {"fun": "thr"}, {"fun": "strata", "breaks": [2, 5]}))


def lag_ns(lag: int, nk: int) -> list[list[float]]:
    """Intercept and natural splines of the lag at log-spaced knots, from the formula."""
    ks = [0.0, *(math.exp((1 + math.log(lag)) / (nk + 1) * i - 1) / lag for i in range(1, nk + 1)), 1.0]
    p3 = lambda v: max(v, 0.0) ** 3
    d = lambda u, k: (p3(u - k) - p3(u - 1)) / (1 - k)
    return [[1.0, k / lag, *(d(k / lag, a) - d(k / lag, ks[-2]) for a in ks[:-2])] for k in range(lag + 1)]


BS_NS = ({"fun": "bs", "degree": 2, "df_": 5}, {"fun": "ns"})


@query(cross_sql(f"{SHIP}, k AS (SELECT quantile_cont(x, 0.25) AS k25, quantile_cont(x, 0.5) AS k50, quantile_cont(x, 0.75) AS k75, min(x) AS lo, max(x) AS hi FROM s)", "s", de_boor("x", ["lo"] * 3 + ["k25", "k50", "k75"] + ["hi"] * 3, 2)[1:], lag_ns(21, 3)))
def crossbasis_bs_ns(spark, sf_dir):
    return crossed(spark, sf_dir, lambda s: CrossBasis.fit(s, "x", 21, *BS_NS))


@query(cross_sql(REGION, "r", ["x"], [[1.0, k / 3] for k in range(4)], by="r_name", where=""))
def crossbasis_group(spark, sf_dir):
    s = series.region_daily(spark, sf_dir)
    return rounded(CrossBasis.fit(s, "x", 3, {"fun": "lin"}, {"fun": "poly", "degree": 1}).series(s, "x", "t", ["r_name"]))


@query(cross_sql(REGION, "r", ["x"], [[1.0, k / 21] for k in range(22)], by="r_name", where=""))
def crossbasis_frame(spark, sf_dir):
    """Lags 0 to 21 per region, gathered by range frames."""
    s = series.region_daily(spark, sf_dir)
    return rounded(CrossBasis.fit(s, "x", 21, {"fun": "lin"}, {"fun": "poly", "degree": 1}).series(s, "x", "t", ["r_name"], frame=True))


@query(f"WITH {REGION} SELECT r_name, t, {q6("x")} AS x, {q6("pow(x / 100, 2)")} AS fit FROM r WHERE x IS NOT NULL")
def curve_rebuild(spark, sf_dir):
    """A parabola of each region's exposures, which is a spline on any knots, rebuilt on the region's own quantiles."""
    s = series.region_daily(spark, sf_dir).where("x is not null").select("r_name", "t", "x")
    knots = groups.own_knots(s, "r_name", "x", [0.1, 0.75, 0.9])
    return rounded(rebuild(s.withColumn("y", F.pow(F.col("x") / 100, 2)), s, "r_name", "x", "y", knots, 3))


@query(
    "SELECT vec_id, " + q6(" + ".join(f"CAST(embedding[{k + 1}] AS DOUBLE)" for k in range(64))) + " AS v1_l1, " + q6(" + ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) * {k / 63!r}" for k in range(64))) + " AS v1_l2 FROM embeddings"
)
def crossbasis_matrix(spark, sf_dir):
    """Every embedding as a history of 64 lags."""
    m = series.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    cb = CrossBasis(bases.BasisSpec("lin"), bases.lag_basis(63, "poly", degree=1), (0, 63))
    return rounded(cb.matrix(m, "x").drop("x"))


# -- covariates --------------------------------------------------------------------------------------------
@query(f"WITH {SHIP} SELECT t, " + ", ".join(f"CASE WHEN dayname(DATE '1995-01-01' + t) = '{d}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS dow_{d[:3].lower()}" for d in ("Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")) + " FROM s")
def dow_dummies(spark, sf_dir):
    df, cols = glm.dow_dummies(series.ship_daily(spark, sf_dir), "d")
    return df.select("t", *cols)


@query(f"WITH {SHIP} SELECT t, " + ", ".join(f"{q6(f'{f}(CAST(t AS DOUBLE) * {2 * math.pi * h / 365.25!r})')} AS {f}{h}" for h in (1, 2) for f in ("sin", "cos")) + " FROM s")
def harmonic(spark, sf_dir):
    cols = seasonality.harmonic(F.col("t"))
    return rounded(series.ship_daily(spark, sf_dir).select("t", *(c.alias(k) for k, c in cols.items())))


PLACE = "(t - floor(t / 365.25) * 365.25)"
SEASON = ", ".join(f"{e} AS bs{i}" for i, e in enumerate(de_boor(PLACE, ["0.0"] * 4 + ["182.625"] + ["365.25"] * 4, 3)[1:], 1))


@query(f"WITH {SHIP} SELECT t, " + ", ".join(f"{q6(f'bs{i}')} AS bs{i}" for i in range(1, 5)) + f" FROM (SELECT t, {SEASON} FROM s)")
def season_spline(spark, sf_dir):
    cols = seasonality.seasonal_spline(F.col("t"))
    return rounded(series.ship_daily(spark, sf_dir).select("t", *(c.alias(k) for k, c in cols.items())))


WIDTH = 0.05 * 365.25


@query(
    f"WITH {SHIP}, a AS (SELECT t, {PLACE} AS p, {SEASON} FROM s), e AS (SELECT "
    + ", ".join(f"(avg(bs{i}) FILTER (p < {WIDTH!r}) + avg(bs{i}) FILTER (p > {365.25 - WIDTH!r})) / 2 AS m{i}" for i in range(1, 5))
    + f" FROM a), f AS (SELECT *, CASE WHEN p < {WIDTH!r} THEN p / {WIDTH!r} WHEN p > {365.25 - WIDTH!r} THEN (365.25 - p) / {WIDTH!r} END AS w FROM a, e) SELECT t, "
    + ", ".join(f"{q6(f'CASE WHEN w IS NULL THEN bs{i} ELSE w * bs{i} + (1 - w) * m{i} END')} AS bs{i}" for i in range(1, 5)) + " FROM f"
)
def cyclic_spline(spark, sf_dir):
    cols = seasonality.seasonal_spline(F.col("t"))
    df = series.ship_daily(spark, sf_dir).select("t", *(c.alias(k) for k, c in cols.items()))
    return rounded(seasonality.cyclic(df, "t", list(cols)))


# -- models ------------------------------------------------------------------------------------------------
@query(f"WITH {SHIP}, z AS (SELECT t / 1000.0 AS u, x, CAST(y AS DOUBLE) AS y FROM s WHERE x IS NOT NULL) SELECT i, j, {q6('v')} AS v FROM (SELECT 1 AS i, 1 AS j, CAST(count(*) AS DOUBLE) AS v FROM z UNION ALL SELECT 1, 2, sum(x) FROM z UNION ALL SELECT 1, 3, sum(u) FROM z UNION ALL SELECT 2, 2, sum(x * x) FROM z UNION ALL SELECT 2, 3, sum(x * u) FROM z UNION ALL SELECT 3, 3, sum(u * u) FROM z)")
def gram_matrix(spark, sf_dir):
    s = series.ship_daily(spark, sf_dir).select(F.lit(1.0).alias("one"), "x", (F.col("t") / 1000.0).alias("u"))
    g, _, _, _ = glm.gram(s, ["one", "x", "u"], None)
    return rounded(spark.createDataFrame([(i + 1, j + 1, float(g[i, j])) for i in range(3) for j in range(i, 3)], "i int, j int, v double"))


@query(f"WITH {SHIP} SELECT term, {q6('coef')} AS coef FROM (SELECT '(intercept)' AS term, regr_intercept(y, x) AS coef FROM s UNION ALL SELECT 'x', regr_slope(y, x) FROM s)")
def ols_2param(spark, sf_dir):
    fit = glm.fit_glm(series.ship_daily(spark, sf_dir), "y", ["x"], "gaussian")
    return rounded(fit.to_df(spark).select("term", "coef"))


@query(f"WITH {SHIP} SELECT term, {q6('coef')} AS coef FROM (SELECT '(intercept)' AS term, avg(y) - avg(x) * regr_sxy(y, x) / (regr_sxx(y, x) + 0.5 * count(x)) AS coef FROM s WHERE x IS NOT NULL UNION ALL SELECT 'x', regr_sxy(y, x) / (regr_sxx(y, x) + 0.5 * count(x)) FROM s)")
def ridge_2param(spark, sf_dir):
    fit = glm.fit_glm(series.ship_daily(spark, sf_dir), "y", ["x"], "gaussian", ridge=0.5)
    return rounded(fit.to_df(spark).select("term", "coef"))


# Poisson regression of y on u: Newton's steps, from the logarithm of the mean.
NEWTON = """
a AS (SELECT array_agg(y ORDER BY y, u) AS ys, array_agg(u ORDER BY y, u) AS us FROM d),
it AS (SELECT 0 AS n, ln((SELECT avg(y) FROM d)) AS a0, 0.0::DOUBLE AS a1 UNION ALL
  SELECT n + 1, a0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), a1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM
  (SELECT n, a0, a1, list_sum(list_transform(range(1, len(ys) + 1), lambda i: ys[i] - exp(a0 + a1 * us[i]))) AS g0, list_sum(list_transform(range(1, len(ys) + 1), lambda i: us[i] * (ys[i] - exp(a0 + a1 * us[i])))) AS g1,
   list_sum(list_transform(us, lambda u: exp(a0 + a1 * u))) AS h00, list_sum(list_transform(us, lambda u: u * exp(a0 + a1 * u))) AS h01, list_sum(list_transform(us, lambda u: u * u * exp(a0 + a1 * u))) AS h11 FROM it, a WHERE n < 8))
"""


@query(f"WITH RECURSIVE {SHIP}, d AS (SELECT CAST(y AS DOUBLE) AS y, x - 25 AS u FROM s WHERE x IS NOT NULL), {NEWTON} SELECT term, {q6('coef')} AS coef FROM (SELECT '(intercept)' AS term, a0 AS coef FROM it WHERE n = 8 UNION ALL SELECT 'u', a1 FROM it WHERE n = 8)")
def poisson_2param(spark, sf_dir):
    s = series.ship_daily(spark, sf_dir).withColumn("u", F.col("x") - 25)
    return rounded(glm.fit_glm(s, "y", ["u"], "poisson").to_df(spark).select("term", "coef"))


@query(f"WITH RECURSIVE {SHIP}, d AS (SELECT CAST(a.y AS DOUBLE) AS y, sum(b.x) - 100 AS u FROM s a JOIN s b ON b.t BETWEEN a.t - 3 AND a.t GROUP BY a.t, a.y HAVING count(b.x) = 4), {NEWTON} SELECT {q6('4 * a1')} AS coef, {q6('exp(20 * a1)')} AS rr, (SELECT count(*) FROM d) AS n FROM it WHERE n = 8")
def dlnm_poisson(spark, sf_dir):
    """A whole model in one call, small enough for SQL: the same effect at four lags; overall, and the risk of 5 more."""
    s = series.ship_daily(spark, sf_dir)
    m = dlnm.fit_dlnm(s, CrossBasis.fit(s, "x", 3, {"fun": "lin"}, {"fun": "strata"}), "x", "y", "t", family="poisson")
    return rounded(spark.createDataFrame([(float(m.coef[0]), math.exp(5 * m.coef[0]), m.fit.n)], "coef double, rr double, n long"))


@query(
    f"WITH {SHIP}, m AS (SELECT count(x) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, avg(x) AS mx FROM s WHERE x IS NOT NULL), v AS (SELECT *, (syy - b * b * sxx) / (n - 2) AS phi FROM m), "
    f"r AS (SELECT '(intercept)' AS term, a AS coef, sqrt(phi * (1.0 / n + mx * mx / sxx)) AS se FROM v UNION ALL SELECT 'x', b, sqrt(phi / sxx) FROM v) SELECT term, {q6('coef')} AS coef, {q6('se')} AS se, {q6('coef / se')} AS z FROM r"
)
def glm_summary(spark, sf_dir):
    return rounded(glm.fit_glm(series.ship_daily(spark, sf_dir), "y", ["x"], "gaussian").summary(spark).drop("p"))


@query(f"WITH {REGION} SELECT r_name, CAST(count(x) AS BIGINT) AS n, {q6('regr_intercept(y, x)')} AS intercept, {q6('regr_slope(y, x)')} AS slope FROM r GROUP BY 1")
def fit_by_ols(spark, sf_dir):
    got = glm.fit_by(series.region_daily(spark, sf_dir), "r_name", "y", ["x"], "gaussian")
    return rounded(got.select("r_name", F.col("n").cast("long").alias("n"), F.get("coef", F.lit(0)).alias("intercept"), F.get("coef", F.lit(1)).alias("slope")))


# Least squares of y on 1 (not penalised), w1 and w2 of h, with a 2 x 2 penalty.
def penalised_sql(source: str, names: tuple[str, str], p11: float, p12: float, p22: float) -> str:
    sums = ", ".join(f"count(*) * covar_pop({a}, {b}) + {p!r} AS {n}" for n, a, b, p in (("a", "w1", "w1", p11), ("b", "w1", "w2", p12), ("d", "w2", "w2", p22), ("e", "w1", "y", 0.0), ("f", "w2", "y", 0.0)))
    return (
        f"WITH {source}, m AS (SELECT {sums}, avg(w1) AS m1, avg(w2) AS m2, avg(y) AS my FROM h), q AS (SELECT *, (d * e - b * f) / (a * d - b * b) AS b1, (a * f - b * e) / (a * d - b * b) AS b2 FROM m) "
        f"SELECT term, {q6('coef')} AS coef FROM (SELECT '(intercept)' AS term, my - b1 * m1 - b2 * m2 AS coef FROM q UNION ALL SELECT '{names[0]}', b1 FROM q UNION ALL SELECT '{names[1]}', b2 FROM q)"
    )


@query(penalised_sql(f"{SHIP}, h AS (SELECT CAST(a.y AS DOUBLE) AS y, sum(b.x) AS w1, sum(b.x * (a.t - b.t)) / 7 AS w2 FROM s a JOIN s b ON b.t BETWEEN a.t - 7 AND a.t GROUP BY a.t, a.y HAVING count(b.x) = 8)", ("v1_l1", "v1_l2"), 2.0 + 300.0, -300.0, 2.0 + 300.0))
def penalised_fixed(spark, sf_dir):
    """A penalised cross-basis with given penalties, of one kind per dimension."""
    s = series.ship_daily(spark, sf_dir)
    cb = CrossBasis.fit(s, "x", 7, {"fun": "lin"}, {"fun": "poly", "degree": 1})
    got = penalized.fit_penalised(cb.series(s, "x", "t").join(s.select("t", "y"), "t"), "y", cb, lam=(2.0, 300.0), kind=("ridge", "difference"), order=(1, 1))
    return rounded(got.fit.to_df(spark).select("term", "coef"))


@query(penalised_sql(f"{SHIP}, {KNOTS}, h AS (SELECT CAST(y AS DOUBLE) AS y, {natural(scaled('x'), ['0.0', scaled('k50'), '1.0'])[0]} AS w1, {natural(scaled('x'), ['0.0', scaled('k50'), '1.0'])[1]} AS w2 FROM s, k WHERE x IS NOT NULL)", ("s1", "s2"), 0.5, 0.0, 0.5))
def smooth_spline(spark, sf_dir):
    s = series.ship_daily(spark, sf_dir)
    basis = penalized.smooth_spline_basis(s, "x", lam=0.5, knots=lags.quantiles(s, "x", [0.5]))
    return rounded(penalized.fit_smooth(s, "x", "y", basis).to_df(spark).select("term", "coef"))


# -- predictions from fixed coefficients ---------------------------------------------------------------------
THETA = np.array([0.08, -0.05, -0.06, 0.04])
VCOV = np.diag([0.0001, 0.0002, 0.0003, 0.0004])
CEN, Z = 25.0, 1.959963984540054


def poly_cb(s) -> CrossBasis:
    return CrossBasis.fit(s, "x", 7, *POLY)


def effect_sql(c1: str, c2: str, v1: str, v2: str, extra: str = "", frame: str = "g, k") -> str:
    d1, d2 = "(p / top - 25.0 / top)", "((p / top) ** 2 - (25.0 / top) ** 2)"
    return f"SELECT *, {d1} * ({c1}) + {d2} * ({c2}) AS fit, sqrt({d1} ** 2 * ({v1}) + {d2} ** 2 * ({v2})) AS se FROM {frame}{extra}"


OVERALL = effect_sql("0.08 * 8 - 0.05 * 4", "-0.06 * 8 + 0.04 * 4", "0.0001 * 64 + 0.0002 * 16", "0.0003 * 64 + 0.0004 * 16")
GRID = "g AS (SELECT DISTINCT x AS p FROM s WHERE x IS NOT NULL)"


def distinct_x(s) -> DataFrame:
    return s.where("x is not null").select(F.col("x").alias("predvar")).distinct()


def interval_sql(keys: str) -> str:
    return f"{keys}, {q6('fit')} AS fit, {q6('se')} AS se, {q6(f'fit - {Z} * se')} AS low, {q6(f'fit + {Z} * se')} AS high, {q6('exp(fit)')} AS rr, {q6(f'exp(fit - {Z} * se)')} AS rr_low, {q6(f'exp(fit + {Z} * se)')} AS rr_high"


@query(f"WITH {SHIP}, {KNOTS}, {GRID}, f AS ({OVERALL}) SELECT {interval_sql(q6('p') + ' AS predvar')} FROM f")
def crosspred_overall(spark, sf_dir):
    s = series.ship_daily(spark, sf_dir)
    return rounded(predict.crosspred(distinct_x(s), "predvar", poly_cb(s), THETA, VCOV, cen=CEN))


LAGS = ", (SELECT unnest(range(0, 8)) AS l) h"


@query(f"WITH {SHIP}, {KNOTS}, {GRID}, f AS ({effect_sql('0.08 - 0.05 * l / 7', '-0.06 + 0.04 * l / 7', '0.0001 + 0.0002 * (l / 7) ** 2', '0.0003 + 0.0004 * (l / 7) ** 2', LAGS)}) SELECT {interval_sql(q6('p') + ' AS predvar, CAST(l AS DOUBLE) AS lag')} FROM f")
def crosspred_lag(spark, sf_dir):
    s = series.ship_daily(spark, sf_dir)
    return rounded(predict.crosspred(distinct_x(s), "predvar", poly_cb(s), THETA, VCOV, "lag", cen=CEN))


@query(f"WITH {SHIP}, {KNOTS}, {GRID}, f AS ({effect_sql('0.08 * (l + 1) - 0.05 * l * (l + 1) / 14', '-0.06 * (l + 1) + 0.04 * l * (l + 1) / 14', '0.0001 * (l + 1) ** 2 + 0.0002 * (l * (l + 1) / 14) ** 2', '0.0003 * (l + 1) ** 2 + 0.0004 * (l * (l + 1) / 14) ** 2', LAGS)}) SELECT {interval_sql(q6('p') + ' AS predvar, CAST(l AS DOUBLE) AS lag')} FROM f")
def crosspred_cumul(spark, sf_dir):
    s = series.ship_daily(spark, sf_dir)
    return rounded(predict.crosspred(distinct_x(s), "predvar", poly_cb(s), THETA, VCOV, "cumul", cen=CEN))


@query(f"WITH {SHIP}, {KNOTS}, {GRID}, f AS ({OVERALL}) SELECT {q6('p')} AS predvar, {q6('fit')} AS fit, {q6('se')} AS se FROM f")
def crossreduce_curve(spark, sf_dir):
    s = series.ship_daily(spark, sf_dir)
    cb = poly_cb(s)
    return rounded(predict.crosspred(distinct_x(s), "predvar", cb.var, *predict.crossreduce(cb, THETA, VCOV), cen=CEN).select("predvar", "fit", "se"))


PCT = f"g AS (SELECT CAST(unnest(range(1, 100)) AS INTEGER) AS pct, unnest(quantile_cont(x, {[i / 100 for i in range(1, 100)]})) AS p FROM s)"


@query(f"WITH {SHIP}, {KNOTS}, {PCT}, f AS ({OVERALL}) SELECT {q6('arg_min(p, fit)')} AS mmt, {q6('min(fit)')} AS fit, {q6(f'arg_min(fit - {Z} * se, fit)')} AS low, {q6(f'arg_min(fit + {Z} * se, fit)')} AS high FROM f")
def mmt(spark, sf_dir):
    s = series.ship_daily(spark, sf_dir)
    return rounded(predict.find_mmt(predict.percentile_grid(s, "x"), "predvar", poly_cb(s), THETA, VCOV, cen=CEN))


@query(f"WITH {SHIP}, {KNOTS}, {PCT}, f AS ({OVERALL}) SELECT {q6('arg_min(p, fit)')} AS mmt, arg_min(pct, fit) AS pct FROM f")
def mmt_percentile(spark, sf_dir):
    s = series.ship_daily(spark, sf_dir)
    cb = poly_cb(s)
    return rounded(predict.find_mmt_blup(s, "x", cb.var, predict.crossreduce(cb, THETA, VCOV)[0]))


def center_sql(name: str, at: str) -> str:
    d1, d2 = f"(p / top - {at} / top)", f"((p / top) ** 2 - ({at} / top) ** 2)"
    return f"SELECT '{name}' AS center, {q6('p')} AS predvar, {q6(f'exp({d1} * 0.44 + {d2} * -0.32)')} AS rr FROM g, k"


@query(f"WITH {SHIP}, {KNOTS}, {GRID} {center_sql('mean', 'mean')} UNION ALL {center_sql('median', 'k50')} UNION ALL {center_sql('p90', 'k90')}")
def centering_compare(spark, sf_dir):
    s = series.ship_daily(spark, sf_dir)
    at = {"mean": "mean", "median": "median", "p90": "percentile_90"}
    return rounded(predict.compare_centering(distinct_x(s), "predvar", poly_cb(s), THETA, VCOV, {k: predict.center_value(s, "x", v) for k, v in at.items()}).select("center", "predvar", "rr"))


# -- attribution -------------------------------------------------------------------------------------------
D1, D2 = "(x / top - 25.0 / top)", "((x / top) ** 2 - (25.0 / top) ** 2)"
ROWS = f"f AS (SELECT x, y, (1 - exp(-({D1} * 0.44 + {D2} * -0.32))) * y AS an FROM s, k WHERE x IS NOT NULL)"


def attributing(spark, sf_dir, f, *a, **kw):
    s = series.ship_daily(spark, sf_dir)
    return rounded(f(s, "x", "y", poly_cb(s), THETA, VCOV, CEN, *a, **kw))


@query(f"WITH {SHIP}, {KNOTS}, {ROWS} SELECT {q6('sum(an)')} AS an, {q6('sum(an) / sum(y)')} AS af, CAST(sum(y) AS BIGINT) AS cases FROM f")
def attr_an(spark, sf_dir):
    return attributing(spark, sf_dir, attribution.attrdl)


@query(f"WITH {SHIP}, {KNOTS}, {ROWS} SELECT {q6('sum(an)')} AS an, {q6('sum(an) / sum(y)')} AS af, CAST(sum(y) AS BIGINT) AS cases FROM f WHERE x BETWEEN 22 AND 28")
def attr_range(spark, sf_dir):
    return attributing(spark, sf_dir, attribution.attrdl, range_=(22, 28), direction="forw")


@query(f"WITH {SHIP}, {KNOTS}, {ROWS}, c AS (SELECT quantile_cont(x, 0.025) AS a, quantile_cont(x, 0.975) AS b FROM s) SELECT {q6('sum(an) FILTER (x <= a)')} AS an_cold, {q6('sum(an) FILTER (x >= b)')} AS an_heat, {q6('sum(an) FILTER (x <= a OR x >= b)')} AS an_total, CAST(sum(y) AS BIGINT) AS cases FROM f, c")
def attr_heat_cold(spark, sf_dir):
    return attributing(spark, sf_dir, attribution.attr_heat_cold)


@query(f"WITH {SHIP}, {KNOTS}, {ROWS}, c AS (SELECT unnest({[f'{a:g}-{b:g}' for a, b in attribution.BANDS]}) AS band, unnest(quantile_cont(x, {[a / 100 for a, _ in attribution.BANDS]})) AS lo, unnest(quantile_cont(x, {[b / 100 for _, b in attribution.BANDS]})) AS hi FROM s) SELECT band, count(*) AS n_rows, {q6('sum(an)')} AS an, {q6('sum(an) / sum(y)')} AS af FROM f, c WHERE x BETWEEN c.lo AND c.hi GROUP BY band")
def attr_bands(spark, sf_dir):
    return attributing(spark, sf_dir, attribution.attr_by_percentiles)


REPORT = [("total", 0.0, 1.0), ("cold", 0.0, 0.025), ("heat", 0.975, 1.0), *((f"{a:g}-{b:g}", a / 100, b / 100) for a, b in attribution.BANDS)]


@query(
    f"WITH {SHIP}, {KNOTS}, {PCT}, o AS (SELECT arg_min(p, fit) AS cen FROM ({OVERALL})), f AS (SELECT x, y, cen, (1 - exp(-((x - cen) / top * 0.44 + ((x / top) ** 2 - (cen / top) ** 2) * -0.32))) * y AS an FROM s, k, o WHERE x IS NOT NULL), "
    f"c AS (SELECT unnest({[n for n, _, _ in REPORT]}) AS part, unnest(quantile_cont(x, {[a for _, a, _ in REPORT]})) AS lo, unnest(quantile_cont(x, {[b for _, _, b in REPORT]})) AS hi FROM s) "
    f"SELECT part, {q6('any_value(cen)')} AS cen, count(*) AS n_rows, {q6('sum(an)')} AS an, {q6('sum(an) / sum(y)')} AS af, CAST(sum(y) AS BIGINT) AS cases FROM f, c WHERE x BETWEEN c.lo AND c.hi GROUP BY part"
)
def attr_report(spark, sf_dir):
    """Total, cold, heat and bands against the optimum, from fixed coefficients."""
    s = series.ship_daily(spark, sf_dir).cache()
    got = attribution.attribution_report(s, "x", "y", poly_cb(s), THETA, VCOV)
    s.unpersist()
    return rounded(got)


@query(
    f"WITH {REGION}, k AS (SELECT max(abs(x)) AS top, avg(x) AS mean FROM r), f AS (SELECT r_name, floor(t / 365.25) AS yr, y, (1 - exp(-((x / top - mean / top) * 0.44 + ((x / top) ** 2 - (mean / top) ** 2) * -0.32))) * y AS an FROM r, k WHERE x IS NOT NULL) "
    f"SELECT r_name, CAST(yr AS BIGINT) AS yr, {q6('sum(an)')} AS an, CAST(sum(y) AS BIGINT) AS cases FROM f GROUP BY ROLLUP (r_name, yr)"
)
def attr_rollup(spark, sf_dir):
    s = series.region_daily(spark, sf_dir).withColumn("yr", F.floor(F.col("t") / 365.25))
    cb, cen = poly_cb(s), predict.center_value(s, "x", "mean")
    rows = attribution.attributed(s, "x", "y", cb, THETA, VCOV, cen)
    return rounded(rows.rollup("r_name", "yr").agg(F.sum("an").alias("an"), F.sum("y").alias("cases")))


def lagged_attribution_sql() -> str:
    terms = ["x / top - 25.0 / top", "(x / top) ** 2 - (25.0 / top) ** 2"]
    inner = cross_sql(f"{SHIP}, {KNOTS}", "s", terms, POLY_C).replace("(round(CAST(", "((CAST(").replace(f"AS DOUBLE) + {NUDGE!r}, 6) + 0.0)", "AS DOUBLE)))")
    return f"SELECT {q6('sum(a)')} AS an, {q6('sum(a) / sum(y)')} AS af FROM (WITH w AS ({inner}), {SHIP} SELECT y, (1 - exp(-(0.08 * v1_l1 - 0.05 * v1_l2 - 0.06 * v2_l1 + 0.04 * v2_l2))) * y AS a FROM w JOIN s USING (t) WHERE v1_l1 IS NOT NULL)"


@query(lagged_attribution_sql())
def attr_lagged(spark, sf_dir):
    s = series.ship_daily(spark, sf_dir)
    cb = poly_cb(s).centered(CEN)
    w = cb.series(s, "x", "t").join(s.select("t", "x", "y"), "t")
    return rounded(attribution.attrdl_lagged(w, "x", "y", cb, THETA))


@query()
def attr_sim(spark, sf_dir):
    return attributing(spark, sf_dir, attribution.simulated_interval, nsim=500, seed=1)


# -- seasonality and selection -----------------------------------------------------------------------------
@query(f"WITH {SHIP}, b AS (SELECT regr_slope(y, t) AS m, regr_intercept(y, t) AS a FROM s) SELECT t, {q6('a + m * t')} AS trend, {q6('y - a - m * t')} AS residual FROM s, b")
def decompose_trend(spark, sf_dir):
    return rounded(seasonality.decompose(series.ship_daily(spark, sf_dir), "y", "t", 0).select("t", "trend", "residual"))


def sweep(name: str, source: str, keys: str, cols: list[str]) -> str:
    """CTEs name0, name1, ...: each takes one of cols out of y and of the columns after it; b is the last one's coefficient."""
    ctes = []
    for i, c in enumerate(cols):
        share = lambda r, c=c: f"(sum({r} * {c}) OVER () / sum({c} * {c}) OVER ())"
        out = ", ".join(f"{r} - {c} * {share(r)} AS {r}" for r in [*cols[i + 1 :], "y"])
        ctes.append(f"{name}{i} AS (SELECT {keys}, {out}{f', {share(chr(121))} AS b' if i == len(cols) - 1 else ''} FROM {f'{name}{i - 1}' if i else source})")
    return ", ".join(ctes)


def waves(most: int) -> dict[str, str]:
    return {f"{f}{h}": f"{f}(CAST(t AS DOUBLE) * {2 * math.pi * h / 365.25!r})" for h in range(1, most + 1) for f in ("sin", "cos")}


def season_splines(n: int) -> dict[str, str]:
    inner = [repr(365.25 * i / (n - 2)) for i in range(1, n - 2)]
    return {f"bs{n}_{i}": e for i, e in enumerate(de_boor(PLACE, ["0.0"] * 4 + inner + ["365.25"] * 4, 3)[1:], 1)}


def frame_sql(source: str, keys: str, cols: dict[str, str]) -> str:
    return f"f AS (SELECT {keys}, CAST(y AS DOUBLE) AS y, CAST(1 AS DOUBLE) AS one, CAST(t AS DOUBLE) AS u, " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in cols.items()) + f" FROM {source})"


def decompose_sql(series_sql: str, source: str, keys: str, cols: dict[str, str]) -> str:
    """y = a + b t + seasonal: slope and intercept are what is left of y on t, or on 1, once all others are taken out."""
    last = len(cols) + 1
    ctes = ", ".join(sweep(n, "f", keys, [*cols, *ends]) for n, ends in (("p", ["one", "u"]), ("q", ["u", "one"])))
    shown = "round(CAST({} AS DOUBLE) + 1e-09, 4) + 0.0"
    trend = "q.b + p.b * f.t"
    return f"WITH {series_sql}, {frame_sql(source, keys, cols)}, {ctes} SELECT {keys}, {shown.format(trend)} AS trend, {shown.format(f'f.y - p.y - ({trend})')} AS seasonal, {shown.format('p.y')} AS residual FROM f JOIN p{last} p USING ({keys}) JOIN q{last} q USING ({keys})"


def four_digits(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *((F.round(F.col(c) + F.lit(NUDGE), 4) + F.lit(0.0)).alias(c) for c in ("trend", "seasonal", "residual")))


@query(decompose_sql(REGION, "r", "r_name, t", waves(2)))
def season_decompose(spark, sf_dir):
    return four_digits(seasonality.decompose(series.region_daily(spark, sf_dir), "y", "t"), ["r_name", "t"])


@query(decompose_sql(SHIP, "s", "t", waves(1) | season_splines(4)))
def season_flexible(spark, sf_dir):
    parts = [{"type": "harmonic", "n_harmonics": 1}, {"type": "spline", "n_df": 4}]
    return four_digits(seasonality.decompose(series.ship_daily(spark, sf_dir), "y", "t", method="flexible", components=parts), ["t"])


def select_sql() -> str:
    groups = {"harmonic": {k: list(waves(3))[: 2 * k] for k in (1, 2, 3)}, "spline": {k: list(season_splines(k)) for k in (4, 6, 8)}}
    cols, chains, rows = dict(waves(3)), [], []
    for k in (4, 6, 8):
        cols |= season_splines(k)
    for method, sizes in groups.items():
        for trend in (False, True):
            for k, own in sizes.items():
                n = f"{method[0]}{k}{'t' * trend}_"
                keep = ["one", *["u"] * trend, *own]
                chains.append(sweep(n, "f", "t", keep))
                rows.append(f"SELECT '{method}{k}{'_trend' * trend}' AS config, {len(keep)} AS n_terms, sum(y * y) AS rss FROM {n}{len(keep) - 1}")
    return (
        f"WITH {SHIP}, {frame_sql('s', 't', cols)}, {', '.join(chains)}, a AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(y * y) - sum(y) ** 2 / count(*) AS total FROM f), e AS ({' UNION ALL '.join(rows)}) "
        f"SELECT config, CAST(n_terms AS INTEGER) AS n_terms, {q6('1 - rss / total')} AS r2, {q6('n * ln(rss / n) + 2 * (n_terms + 1)')} AS aic, {q6('n * ln(rss / n) + ln(n) * (n_terms + 1)')} AS bic FROM e, a"
    )


@query(select_sql())
def season_select(spark, sf_dir):
    return rounded(seasonality.compare(series.ship_daily(spark, sf_dir), "y", "t"))


# -- locations ---------------------------------------------------------------------------------------------
SLOPES = f"{REGION}, e AS (SELECT r_name, regr_slope(y, x) AS b, (regr_syy(y, x) - regr_slope(y, x) ** 2 * regr_sxx(y, x)) / (count(x) - 2) / regr_sxx(y, x) AS v FROM r GROUP BY 1)"


def slopes(spark, sf_dir):
    rows = glm.fit_by(series.region_daily(spark, sf_dir), "r_name", "y", ["x"], "gaussian").orderBy("r_name").collect()  # a row per location
    return [r.r_name for r in rows], np.array([r.coef[1] for r in rows]), np.array([r.vcov[3] for r in rows])


@query(f"WITH {SLOPES} SELECT {q6('sum(b / v) / sum(1 / v)')} AS beta, {q6('sqrt(1 / sum(1 / v))')} AS se FROM e")
def meta_fixed_q1(spark, sf_dir):
    _, b, v = slopes(spark, sf_dir)
    fit = meta.mvmeta(b, v, method="fixed")
    return rounded(spark.createDataFrame([(float(fit.beta[0, 0]), float(np.sqrt(fit.vcov[0, 0])))], "beta double, se double"))


@query(f"WITH {SLOPES}, m AS (SELECT sum(b / (v + 0.0001)) / sum(1 / (v + 0.0001)) AS mu FROM e) SELECT r_name, {q6('mu + 0.0001 / (v + 0.0001) * (b - mu)')} AS blup FROM e, m")
def blup_q1(spark, sf_dir):
    """Shrinkage at a given spread between locations, 0.0001."""
    names, b, v = slopes(spark, sf_dir)
    at = meta.mvmeta(b, v + 1e-4, method="fixed")
    at.psi = np.array([[1e-4]])
    est, _ = meta.blup(at, b, v)
    return rounded(spark.createDataFrame([(n, float(e)) for n, e in zip(names, est[:, 0])], "r_name string, blup double"))


@query(f"WITH {REGION}, a AS (SELECT r_name, arg_min(x, struct_pack(f := (x / 150) ** 2 * 3 - (x / 150) * 3.3, x := x)) AS mmt FROM r WHERE x IS NOT NULL GROUP BY 1) SELECT count(*) AS n, {q6('median(mmt)')} AS median_mmt, {q6('avg(mmt)')} AS mean_mmt, {q6('stddev_pop(mmt)')} AS sd_mmt FROM a")
def pooled_mmt(spark, sf_dir):
    """The exposure of least effect per region, from fixed coefficients, pooled."""
    s = series.region_daily(spark, sf_dir).where("x is not null")
    spec = bases.BasisSpec("poly", 2, scale=150.0)
    return rounded(meta.pooled_mmt(predict.find_mmt(s.select("r_name", "x"), "x", spec, [-3.3, 3.0], np.zeros((2, 2)), ["r_name"])))


@query(f"WITH {REGION} SELECT r_name, count(*) AS n_days, {q6('min(x)')} AS x_min, {q6('max(x)')} AS x_max, {q6('avg(x)')} AS x_mean, CAST(sum(y) AS BIGINT) AS total FROM r GROUP BY 1 ORDER BY total DESC, r_name LIMIT 3")
def topk_location(spark, sf_dir):
    """A report of the three busiest locations."""
    from ..sources.tables import city_summary

    return rounded(city_summary(series.region_daily(spark, sf_dir), "r_name", "x", "y").orderBy(F.desc("total"), "r_name").limit(3))


@query(
    f"WITH {REGION}, p AS (SELECT r_name, unnest(range(1, 100)) AS pct, unnest(quantile_cont(x, {[i / 100 for i in range(1, 100)]})) AS v FROM r GROUP BY 1), f AS (SELECT *, v / 500 * -0.5 + (v / 500) ** 2 * 1.5 AS fit FROM p), "
    f"m AS (SELECT r_name, arg_min(v, fit) AS mmt, arg_min(pct, fit) AS best, min(fit) AS low FROM f GROUP BY 1), e AS (SELECT r_name, max(exp(fit - low)) FILTER (pct <= best) AS cold, max(exp(fit - low)) FILTER (pct >= best) AS hot FROM f JOIN m USING (r_name) GROUP BY 1), "
    f"a AS (SELECT r_name, count(*) AS n_days, min(x) AS lo, max(x) AS hi, avg(x) AS mean, sum(y) AS total FROM r GROUP BY 1) "
    f"SELECT r_name, n_days, {q6('lo')} AS x_min, {q6('hi')} AS x_max, {q6('mean')} AS x_mean, CAST(total AS BIGINT) AS total, CAST(best AS INTEGER) AS pct, {q6('mmt')} AS mmt, {q6('cold')} AS rr_cold, {q6('hot')} AS rr_hot FROM a JOIN m USING (r_name) JOIN e USING (r_name)"
)
def location_report(spark, sf_dir):
    """A report per location with its optimum and the greatest risks on both sides of it, from fixed coefficients."""
    s = series.region_daily(spark, sf_dir)
    coefs = series.table(spark, sf_dir, "region").select("r_name", F.array(F.lit(-0.5), F.lit(1.5)).alias("coef"))
    return rounded(meta.location_report(s, "r_name", "x", "y", bases.BasisSpec("poly", 2, scale=500.0), coefs))


@query(f"WITH {REGION} SELECT 'R' || r_regionkey AS code, count(*) AS n, {q6('avg(x)')} AS x FROM r JOIN region USING (r_name) GROUP BY 1 ORDER BY x")
def named_means(spark, sf_dir):
    """Means by the names that a map gives to the locations, in order."""
    from ..sources.tables import with_names

    names = series.table(spark, sf_dir, "region").select("r_name", F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("code"))
    got = with_names(series.region_daily(spark, sf_dir), "r_name", names, "code").groupBy("code").agg(F.count("*").alias("n"), F.avg("x").alias("x"))
    return rounded(got).orderBy("x")


@query(f"WITH {REGION} SELECT DISTINCT r_name, CAST(year(DATE '1995-01-01' + t) AS INTEGER) AS year FROM r ORDER BY 1, 2")
def location_years(spark, sf_dir):
    """The years that each location has, in order."""
    return series.region_daily(spark, sf_dir).select("r_name", F.year("d").alias("year")).dropDuplicates().orderBy("r_name", "year")


@query(f"WITH {REGION}, a AS (SELECT r_name, t, x, last_value(x IGNORE NULLS) OVER p AS x0, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER p AS t0, first_value(x IGNORE NULLS) OVER n AS x1, first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER n AS t1 FROM r WINDOW p AS (PARTITION BY r_name ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY r_name ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT r_name, t, {q6('CASE WHEN t1 = t0 THEN x0 ELSE x0 + (x1 - x0) * (t - t0) / (t1 - t0) END')} AS x FROM a")
def curve_interp(spark, sf_dir):
    from ..functions.curves import interpolate

    return rounded(interpolate(series.region_daily(spark, sf_dir), "t", "x", ["r_name"]).select("r_name", "t", "x"))


@query(f"WITH {REGION}, m AS (SELECT r_name, x AS a, avg(x) OVER (PARTITION BY r_name ORDER BY t ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS b FROM r) SELECT r_name, count(*) AS n, {q6('max(abs(a - b))')} AS max_diff, {q6('avg(abs(a - b))')} AS mean_diff, {q6('sqrt(avg((a - b) ** 2))')} AS rmse, {q6('corr(a, b)')} AS correlation, count(*) FILTER (abs(a - b) < 5) AS n_close FROM m WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def curve_agreement(spark, sf_dir):
    """How a series agrees with its running week's mean."""


    from ..functions.curves import agreement

    w = Window.partitionBy("r_name").orderBy("t").rowsBetween(-6, 0)
    return rounded(agreement(series.region_daily(spark, sf_dir).withColumn("m", F.avg("x").over(w)), "x", "m", ["r_name"], close=5.0))


@query(f"WITH {SHIP} SELECT CAST(i AS DOUBLE) / 20 AS share, {q6('lo + i * (hi - lo) / 20')} AS predvar FROM (SELECT min(x) AS lo, max(x) AS hi FROM s), (SELECT unnest(range(0, 21)) AS i)")
def predict_grid(spark, sf_dir):
    """The default grid of predictions: twenty steps over the exposure's range."""
    lo, hi = series.ship_daily(spark, sf_dir).agg(F.min("x"), F.max("x")).first()
    g = predict.grid(spark, lo, hi).withColumn("share", F.round((F.col("predvar") - lo) / (hi - lo), 2))
    return rounded(g.select("share", "predvar"))


@query(f"WITH {REGION}, m AS (SELECT r_name, x AS a, avg(x) OVER (PARTITION BY r_name ORDER BY t ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS b FROM r) SELECT r_name, count(*) AS n, {q6('max(abs(a - b))')} AS max_diff, {q6('avg(abs(a - b))')} AS mean_diff, {q6('sqrt(avg((a - b) ** 2))')} AS rmse, {q6('corr(a, b)')} AS correlation, count(*) FILTER (abs(a - b) < 2) AS n_close1, count(*) FILTER (abs(a - b) < 5) AS n_close2, count(*) FILTER (abs(a - b) < 20) AS n_close3 FROM m WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def curve_agreement_limits(spark, sf_dir):
    """How a series agrees with the mean of two days, within three limits."""
    from ..functions.curves import agreement

    w = Window.partitionBy("r_name").orderBy("t").rowsBetween(-1, 0)
    return rounded(agreement(series.region_daily(spark, sf_dir).withColumn("m", F.avg("x").over(w)), "x", "m", ["r_name"], close=(2.0, 5.0, 20.0)))


@query(f"WITH {SHIP}, b AS (SELECT regr_slope(y, x) AS m, regr_intercept(y, x) AS a FROM s) SELECT t, {q6('a + m * x')} AS fitted FROM s, b")
def glm_predict(spark, sf_dir):
    s = series.ship_daily(spark, sf_dir)
    return rounded(glm.fit_glm(s, "y", ["x"], "gaussian").predict(s).select("t", "fitted"))


@query(f"WITH {SHIP} SELECT CAST(k AS BIGINT) AS lag, CAST(count(x) AS BIGINT) AS n FROM (SELECT unnest(range(0, max(t) - min(t) + 1, 365)) AS k, min(t) AS lo FROM s) LEFT JOIN s ON s.t = lo + k GROUP BY 1")
def seqlag_years(spark, sf_dir):
    """A lag sequence by years over the series' length, and whether there is an exposure at each."""
    s = series.ship_daily(spark, sf_dir)
    lo, hi = s.agg(F.min("t"), F.max("t")).first()
    at = spark.createDataFrame([(k,) for k in lags.seqlag((0, hi - lo), 365)], "lag long")
    return at.join(s, F.col("t") == F.col("lag") + lo, "left").groupBy("lag").agg(F.count("x").alias("n"))


# -- whole models, tested in tests/ against numpy ------------------------------------------------------------
def flagship_fit(spark, sf_dir):
    """The daily series, kept by the caller's choice, and its model."""
    s = series.ship_daily(spark, sf_dir).cache()
    cb = CrossBasis.fit(s, "x", 21, {"fun": "bs", "degree": 2, "knots": lags.quantiles(s, "x", [0.1, 0.75, 0.9])}, {"fun": "ns"})
    return s, dlnm.fit_dlnm(s, cb, "x", "y", "t", date="d", dfseas=8, dow=True)


@query()
def flagship_effects(spark, sf_dir):
    """y ~ cross-basis + day of the week + spline of the date with 8 df a year, quasi-Poisson; overall risk at the
    percentiles of the exposure."""
    s, m = flagship_fit(spark, sf_dir)
    at, cen = predict.percentile_grid(s, "x"), predict.center_value(s, "x", "median")
    s.unpersist()
    return rounded(predict.crosspred(at, "predvar", m.cb.var, m.coef, m.vcov, cen=cen))


def irls_sql(keys: list[str], cols: list[str], source: str, rounds: int = 7) -> str:
    """CTEs up to `fit` (keys, n, b, a, phi): quasi-Poisson models of y on cols by matrix reweighting, one per key.

    A round sums [X'WX | X'Wz | 1] as a list of rows and eliminates column by column; b is then the middle column and a
    the right part, the inverse. Rounds are written out: the start, then `rounds` of Newton's.
    """
    p = len(cols)
    key = "".join(f"{k}, " for k in keys)
    using = f"JOIN {{}} USING ({', '.join(keys)})" if keys else "CROSS JOIN {}"

    def solved(source: str) -> str:
        cell = lambda i, j: f"sum(w * xs[{min(i, j)}] * xs[{max(i, j)}])"
        rows = ", ".join("[" + ", ".join([*(cell(i, j) for j in range(1, p + 1)), f"sum(w * xs[{i}] * z)", *(f"{float(i == j)!r}::DOUBLE" for j in range(1, p + 1))]) + "]" for i in range(1, p + 1))
        out = f"SELECT {key}count(*) AS n, [{rows}] AS m FROM {source}{f' GROUP BY ALL' if keys else ''}"
        for k in range(1, p + 1):
            row = f"CASE WHEN i = {k} THEN list_transform(m[{k}], lambda v: v / m[{k}][{k}]) ELSE list_transform(range(1, {2 * p + 2}), lambda j: m[i][j] - m[i][{k}] / m[{k}][{k}] * m[{k}][j]) END"
            out = f"SELECT {key}n, list_transform(range(1, {p + 1}), lambda i: {row}) AS m FROM ({out})"
        return f"SELECT {key}n, list_transform(m, lambda r: r[{p + 1}]) AS b, list_transform(m, lambda r: r[{p + 2}:]) AS a FROM ({out})"

    ctes = [f"d AS MATERIALIZED (SELECT {key}CAST(y AS DOUBLE) AS y, CAST([{', '.join(cols)}] AS DOUBLE[]) AS xs FROM {source})"]
    ctes.append(f"b0 AS MATERIALIZED ({solved(f'(SELECT {key}xs, y + 0.1 AS w, ln(y + 0.1) - 0.1 / (y + 0.1) AS z FROM d)')})")
    for i in range(rounds):
        step = f"SELECT {key}xs, exp(e) AS w, e + (y - exp(e)) / exp(e) AS z FROM (SELECT {key}xs, y, list_dot_product(xs, b) AS e FROM d {using.format(f'b{i}')})"
        ctes.append(f"b{i + 1} AS MATERIALIZED ({solved(f'({step})')})")
    phi = f"SELECT {key}sum((y - e) ** 2 / e) / (count(*) - {p}) AS phi FROM (SELECT {key}y, exp(list_dot_product(xs, b)) AS e FROM d {using.format(f'b{rounds}')}){' GROUP BY ALL' if keys else ''}"
    return ", ".join([*ctes, f"fit AS (SELECT {key}n, b, a, phi FROM b{rounds} {using.format(f'({phi}) AS p')})"])


DAYS = ("Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def small_flagship_sql() -> str:
    """Any basis of the same curves gives the same risks: the season's spline is written with truncated powers here."""
    r = de_boor("x", ["lo"] * 3 + ["k10", "k75", "k90"] + ["hi"] * 3, 2)[1:]
    lagged = ", ".join(f"sum(b.r{i}{w}) AS w{i}_{j}" for i in range(len(r)) for j, w in enumerate(("", " * (a.t - b.t) / 21.0")))
    # The percentiles of the days from the first to the last are at equal distances.
    season = lambda n: natural("u", [f"{i / n!r}" for i in range(n)] + ["1.0"])
    days = [f"CAST(dayname(DATE '1995-01-01' + t) = '{d}' AS DOUBLE)" for d in DAYS]
    cols = ["1.0", *(f"w{i}_{j}" for i in range(len(r)) for j in range(2)), *days, *season(7)]
    form = lambda i: f"(r[{i // 2 + 1}] - c[{i // 2 + 1}]) * {'22.0' if i % 2 == 0 else '11.0'}"
    terms = range(2 * len(r))
    fit, var = " + ".join(f"m[{i + 1}] * b[{i + 2}]" for i in terms), " + ".join(f"m[{i + 1}] * m[{j + 1}] * a[{i + 2}][{j + 2}]" for i in terms for j in terms)
    return (
        f"WITH {SHIP}, {KNOTS}, g AS (SELECT t, y, x, {', '.join(f'{e} AS r{i}' for i, e in enumerate(r))} FROM s, k WHERE x IS NOT NULL), "
        f"w0 AS (SELECT a.t, a.y, {lagged} FROM g a JOIN g b ON b.t BETWEEN a.t - 21 AND a.t GROUP BY ALL HAVING count(*) = 22), "
        "w AS (SELECT w0.*, (w0.t - lo) / CAST(hi - lo AS DOUBLE) AS u FROM w0, (SELECT min(t) AS lo, max(t) AS hi FROM s)), "
        f"{irls_sql([], cols, 'w')}, {PCT.replace('g AS', 'g1 AS', 1)}, "
        f"h AS (SELECT pct, p, [{', '.join(r)}] AS r FROM (SELECT pct, p, p AS x FROM g1), k), "
        f"c AS (SELECT [{', '.join(r)}] AS c FROM (SELECT quantile_cont(x, 0.5) AS x FROM s), k), "
        f"q AS (SELECT pct, p, [{', '.join(map(form, terms))}] AS m FROM h, c), "
        f"e AS (SELECT pct, p, {fit} AS fit, sqrt(greatest(phi * ({var}), 0)) AS se FROM q, fit) "
        f"SELECT {interval_sql('CAST(pct AS INTEGER) AS pct, ' + q6('p') + ' AS predvar')} FROM e"
    )


@query(small_flagship_sql())
def flagship_yearly(spark, sf_dir):
    """The flagship with two lag terms and a degree of freedom per year, small enough for SQL: overall risks."""
    s = series.ship_daily(spark, sf_dir).cache()
    cb = CrossBasis.fit(s, "x", 21, {"fun": "bs", "degree": 2, "knots": lags.quantiles(s, "x", [0.1, 0.75, 0.9])}, {"fun": "poly", "degree": 1})
    m = dlnm.fit_dlnm(s, cb, "x", "y", "t", date="d", dfseas=1, dow=True)
    at, cen = predict.percentile_grid(s, "x"), predict.center_value(s, "x", "median")
    s.unpersist()
    return rounded(predict.crosspred(at, "predvar", m.cb.var, m.coef, m.vcov, cen=cen))


@query(f"WITH {REGION}, q AS (SELECT r_name, quantile_cont(x, [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]) AS q FROM r WHERE x IS NOT NULL GROUP BY 1) SELECT r_name, unnest(range(7)) AS i, unnest([round(v + 1e-09, 6) + 0.0 for v in q]) AS v FROM q")
def quantiles_region(spark, sf_dir):
    """Exact quantiles per region by cells, as for regions of any size."""
    got = groups.quantiles_by(series.region_daily(spark, sf_dir), ["r_name"], "x", [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99], held=100)
    return rounded(got.select("r_name", F.posexplode("q").alias("i", "v")).withColumn("i", F.col("i").cast("long")))


@query(f"WITH {REGION}, z AS (SELECT r_name, x, y - t / 1000.0 AS y FROM r) SELECT r_name, CAST(count(x) AS BIGINT) AS n, {q6('regr_intercept(y, x)')} AS intercept, {q6('regr_slope(y, x)')} AS slope FROM z GROUP BY 1")
def fit_blocks_offset(spark, sf_dir):
    """A model with an offset per region, by blocks of rows, as for regions of any size."""
    s = series.region_daily(spark, sf_dir).withColumn("o", F.col("t") / 1000.0)
    got = grouped.fit_blocks(s, "r_name", "y", ["x"], "gaussian", offset="o", t="t")
    return rounded(got.select("r_name", "n", F.get("coef", F.lit(0)).alias("intercept"), F.get("coef", F.lit(1)).alias("slope")))


@query()
def region_seasons(spark, sf_dir):
    """Whole models per region: cross-basis with knots at the region's own exposures, day of the week, seasonality of
    its own years; coefficients of the exposure's basis."""
    s = series.region_daily(spark, sf_dir)
    s = s.withColumn("x", F.coalesce("x", F.avg("x").over(Window.partitionBy("r_name"))))
    cb = CrossBasis.fit(s, "x", 3, {"fun": "bs", "degree": 2, "df_": 4}, {"fun": "poly", "degree": 1})
    got = dlnm.fit_dlnm(s, cb, "x", "y", "t", date="d", dfseas=2, dow=True, by="r_name", knots_at=[0.25, 0.75])
    return rounded(got.select("r_name", "n", "converged", F.posexplode("coef").alias("i", "coef")))


def region_design(spark, sf_dir):
    s = series.region_daily(spark, sf_dir)
    filled = s.withColumn("x", F.coalesce("x", F.avg("x").over(Window.partitionBy("r_name"))))
    cb = CrossBasis.fit(filled, "x", 3, {"fun": "ns", "df_": 3}, {"fun": "poly", "degree": 1})
    w = cb.series(filled, "x", "t", ["r_name"]).join(filled, ["r_name", "t"])
    return cb, w


def region_model_sql() -> str:
    r = natural(scaled("x"), ["0.0", scaled("k1"), scaled("k2"), "1.0"])
    lagged = ", ".join(f"sum(b.r{i}{w}) AS w{i}_{j}" for i in range(len(r)) for j, w in enumerate(("", " * (a.t - b.t) / 3.0")))
    return (
        f"WITH {REGION}, f AS (SELECT r_name, t, y, coalesce(x, avg(x) OVER (PARTITION BY r_name)) AS x FROM r), "
        "k AS (SELECT quantile_cont(x, 1.0 / 3) AS k1, quantile_cont(x, 2.0 / 3) AS k2, min(x) AS lo, max(x) AS hi FROM f), "
        f"g AS (SELECT r_name, t, y, {', '.join(f'{e} AS r{i}' for i, e in enumerate(r))} FROM f, k), "
        f"w AS (SELECT a.r_name, a.t, a.y, {lagged} FROM g a JOIN g b ON a.r_name = b.r_name AND b.t BETWEEN a.t - 3 AND a.t GROUP BY ALL HAVING count(b.r0) = 4), "
        f"{irls_sql(['r_name'], ['1.0', *(f'w{i}_{j}' for i in range(len(r)) for j in range(2))], 'w')} "
        f"SELECT r_name, CAST(i - 1 AS INTEGER) AS i, {q6('b[i]')} AS coef, n, true AS converged FROM fit, (SELECT unnest(range(1, {2 * len(r) + 2})) AS i)"
    )


@query(region_model_sql())
def fit_by_region(spark, sf_dir):
    cb, w = region_design(spark, sf_dir)
    got = glm.fit_by(w, "r_name", "y", cb.names)
    return rounded(got.select("r_name", F.posexplode("coef").alias("i", "coef"), "n", "converged"))


@query()
def reml_meta(spark, sf_dir):
    cb, w = region_design(spark, sf_dir)
    return rounded(meta.multi_location(w, "r_name", "x", "y", cb, []).select("r_name", "converged", "shrinkage", "mmt", "pct"))


@query()
def penalized_gcv(spark, sf_dir):
    s = series.ship_daily(spark, sf_dir)
    cb = CrossBasis.fit(s, "x", 7, {"fun": "bs", "df_": 6}, {"fun": "ns"})
    got = penalized.fit_penalised(cb.series(s, "x", "t").join(s.select("t", "y"), "t"), "y", cb)
    return rounded(got.fit.to_df(spark).withColumn("edf", F.lit(float(got.edf))))
