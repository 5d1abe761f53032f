"""One-dimensional bases as frozen specifications: knots, boundaries and scales are fixed at fit time.

A spec gives Spark columns (NULL in, NULL out) and the same values in numpy for small driver-side grids.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lags import inner_knots, quantiles


@dataclass(frozen=True)
class BasisSpec:
    """fun: lin, poly, strata, thr, bs, ns, ns_trunc or own. cen, if given, is where the basis is 0."""

    fun: str
    degree: int = 1
    knots: tuple[float, ...] = ()
    bounds: tuple[float, float] = (0.0, 1.0)
    scale: float = 1.0
    side: str = "h"
    ref: int = 1
    intercept: bool = False
    cen: float | None = None
    own: Callable[[Column], list[Column]] | None = field(default=None, compare=False)
    own_numpy: Callable | None = field(default=None, compare=False)

    # -- the two evaluations share one description: a list of functions over a small set of operations ----

    def columns(self, x: Column) -> list[Column]:
        x = x.cast("double")
        if self.fun == "own":
            out = self.own(x)
        else:
            terms = self._terms(x, _Spark)
            out = terms if self.fun == "bs" else [F.when(x.isNotNull(), b) for b in terms]  # B-splines of NULL are NULL
        if self.cen is not None:
            at = self._raw(np.array([self.cen]))[0]
            out = [b - F.lit(float(a)) for b, a in zip(out, at)]
        return out

    def numpy(self, x) -> np.ndarray:
        """len(x) rows, a column per term; NaN rows for NaN."""
        x = np.asarray(x, float)
        out = self._raw(x)
        if self.cen is not None:
            out = out - self._raw(np.array([self.cen]))
        out[np.isnan(x)] = np.nan
        return out

    def _raw(self, x: np.ndarray) -> np.ndarray:
        if self.fun == "own":
            return np.asarray(self.own_numpy(x), float).reshape(len(x), -1)
        return np.column_stack([np.broadcast_to(b, x.shape).astype(float) for b in self._terms(x, _Numpy)])

    def _terms(self, x, m):
        one = [m.const(1.0, x)] if self.intercept else []
        if self.fun == "lin":
            return [*one, x]
        if self.fun == "poly":
            return [*one, *(m.power(x / self.scale, d) for d in range(1, self.degree + 1))]
        if self.fun == "strata":
            edges = [-np.inf, *self.knots, np.inf]
            bins = [m.where((m.ge(x, a)) & (m.lt(x, b)), 1.0, 0.0) for a, b in zip(edges, edges[1:])]
            return [*one, *(b for i, b in enumerate(bins, 1) if i != self.ref)]
        if self.fun == "thr":
            high = lambda t: m.positive(x - t)
            low = lambda t: m.positive(t - x)
            if self.side == "h":
                return [*one, *map(high, self.knots)]
            if self.side == "l":
                return [*one, *map(low, self.knots)]
            return [*one, low(self.knots[0]), high(self.knots[-1])]
        if self.fun == "ns":
            return [*one, *self._natural(x, m)]
        if self.fun == "ns_trunc":
            lo, hi = self.bounds
            cube = lambda k: m.power(m.positive(x - k), 3)
            return [*one, x, *((cube(k) - cube(hi) * ((hi - k) and (k - lo) / (hi - lo))) / (hi - lo) ** 2 for k in self.knots)]
        if self.fun == "bs":
            return self._b_spline(x, m)
        raise ValueError(f"no basis {self.fun!r}")

    def _natural(self, x, m):
        """Natural cubic spline on [0, 1]-scaled x: linear beyond the boundary knots."""
        lo, hi = self.bounds
        width = (hi - lo) or 1.0
        u, knots = (x - lo) / width, [0.0, *((k - lo) / width for k in self.knots), 1.0]
        last = knots[-1]
        d = [(m.power(m.positive(u - k), 3) - m.power(m.positive(u - last), 3)) / (last - k) for k in knots[:-1]]
        return [u, *(dk - d[-1] for dk in d[:-1])]

    def _pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """Anchors (pieces) and coefficients (pieces, splines, powers) of clamped B-splines in powers of x - anchor.

        De Boor's recursion runs once per interval between knots, on polynomials in place of numbers. The first and
        last piece lie beyond the bounds and go on along the boundary tangents; piece k > 0 starts at its anchor.
        """
        lo, hi = self.bounds
        hi = hi if hi > lo else lo + 1.0  # of a constant
        p = self.degree
        t = np.array([lo] * (p + 1) + list(self.knots) + [hi] * (p + 1), float)
        edges = np.unique(np.clip(t, lo, hi))
        inner = []
        for start, end in zip(edges, edges[1:]):
            mid = (start + end) / 2
            b = [np.eye(1, p + 1)[0] * (t[i] <= mid < t[i + 1]) for i in range(len(t) - 1)]
            for k in range(1, p + 1):
                up = lambda q: np.concatenate([[0.0], q[:-1]])  # noqa: E731  times x - start
                rise = lambda i: (up(b[i]) + (start - t[i]) * b[i]) / (t[i + k] - t[i]) if t[i + k] > t[i] else 0.0 * b[i]  # noqa: E731, B023
                fall = lambda i: ((t[i + k + 1] - start) * b[i + 1] - up(b[i + 1])) / (t[i + k + 1] - t[i + 1]) if t[i + k + 1] > t[i + 1] else 0.0 * b[i]  # noqa: E731, B023
                b = [rise(i) + fall(i) for i in range(len(b) - 1)]
            inner.append(np.array(b))
        powers = (edges[-1] - edges[-2]) ** np.arange(p + 1)
        tangent = np.zeros((2, *inner[0].shape))
        tangent[0, :, :2], tangent[1, :, 0] = inner[0][:, :2], inner[-1] @ powers
        if p:
            tangent[1, :, 1] = inner[-1][:, 1:] @ (np.arange(1, p + 1) * powers[:-1])
        return np.array([lo, *edges]), np.array([tangent[0], *inner, tangent[1]])

    def _b_spline(self, x, m):
        """The piece that x lies in, and its polynomial there; the same few operations however many knots."""
        anchors, pieces = self._pieces()
        k = m.piece(x, anchors[1:])
        d = x - m.pick(anchors, k)
        out = []
        for spline in np.moveaxis(pieces, 1, 0):
            value = m.pick(spline[:, -1], k)
            for power in range(self.degree - 1, -1, -1):
                value = value * d + m.pick(spline[:, power], k)
            out.append(value)
        return out if self.intercept else out[1:]

    @property
    def size(self) -> int:
        return self.numpy([self.bounds[0]]).shape[1]

    def centered(self, cen: float | None) -> BasisSpec:
        return replace(self, cen=cen)

    def names(self, prefix: str = "b") -> list[str]:
        return [f"{prefix}{i}" for i in range(1, self.size + 1)]


def literals(values) -> Column:
    """An array of doubles as one literal, whatever its length."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


class _Spark:
    const = staticmethod(lambda v, x: F.lit(v))
    power = staticmethod(lambda x, d: F.pow(x, F.lit(float(d))))
    where = staticmethod(lambda c, a, b: F.when(c, F.lit(a)).otherwise(F.lit(b)))
    positive = staticmethod(lambda x: F.greatest(x, F.lit(0.0)))
    piece = staticmethod(lambda x, edges: sum(((x >= F.lit(float(e))).cast("int") for e in edges), F.lit(0)))
    pick = staticmethod(lambda values, k: F.get(literals(values), k))
    ge = staticmethod(lambda x, k: F.lit(True) if np.isneginf(k) else x >= F.lit(float(k)))
    lt = staticmethod(lambda x, k: F.lit(True) if np.isposinf(k) else x < F.lit(float(k)))


class _Numpy:
    const = staticmethod(lambda v, x: np.full(len(x), v))
    power = staticmethod(lambda x, d: x**d)
    where = staticmethod(np.where)
    positive = staticmethod(lambda x: np.maximum(x, 0.0))
    piece = staticmethod(lambda x, edges: np.searchsorted(edges, x, side="right"))
    pick = staticmethod(lambda values, k: np.asarray(values)[k])
    ge = staticmethod(lambda x, k: x >= k)
    lt = staticmethod(lambda x, k: x < k)


def fit_basis(df: DataFrame, x: str, fun: str = "ns", *, df_: int | None = None, degree: int | None = None, knots=None, bounds=None, scale: float | None = None, breaks=None, thr=None, side: str = "h", ref: int = 1, intercept: bool = False, cen: float | None = None, own=None, own_numpy=None) -> BasisSpec:
    """A spec whose data-dependent parts come from at most two aggregates over x (NULL and NaN skipped)."""
    if side not in ("h", "l", "d"):
        raise ValueError("side: 'h', 'l' or 'd'")
    clean = F.nanvl(F.col(x).cast("double"), F.lit(None))
    if bounds is None or (fun == "poly" and scale is None):
        lo, hi, top = df.agg(F.min(clean), F.max(clean), F.max(F.abs(clean))).first()
        bounds = bounds or (float(lo if lo is not None else 0), float(hi if hi is not None else 1))
        scale = scale or (float(top) if top else 1.0)
    at = lambda n: quantiles(df, x, [i / (n + 1) for i in range(1, n + 1)])
    if fun == "bs":
        degree = 3 if degree is None else degree
        knots = at(inner_knots("bs", df_ if df_ is not None else degree + int(intercept), degree, intercept)) if knots is None else knots
    elif fun in ("ns", "ns_trunc"):
        knots = at(inner_knots("ns", 4 if df_ is None else df_, intercept=intercept)) if knots is None else knots
    elif fun == "strata":
        knots = (at(1) if (df_ or 1) == 1 else at(df_ - 1)) if breaks is None else breaks
    elif fun == "thr":
        knots = at(1) if thr is None else [thr] if isinstance(thr, (int, float)) else thr
    return BasisSpec(fun, degree or 1, tuple(sorted(map(float, knots or ()))), tuple(map(float, bounds)), scale or 1.0, side, ref, intercept, cen, own, own_numpy)


def lag_basis(lag, fun: str = "ns", *, knots=None, df_: int | None = None, degree: int = 3, intercept: bool = True, breaks=None, thr=None, side: str = "h", scale: float | None = None) -> BasisSpec:
    """A spec over a lag range; by default natural splines with three log-spaced knots and an intercept."""
    from .lags import logknots, mklag

    lo, hi = mklag(lag)
    if fun in ("ns", "bs", "ns_trunc") and knots is None:
        n = 3 if df_ is None else inner_knots("ns" if fun != "bs" else "bs", df_, degree, intercept)
        knots = logknots((lo, hi), nk=n) if n > 0 and hi > lo else []
    if fun == "strata":
        knots = breaks or []
    if fun == "thr":
        knots = [thr] if isinstance(thr, (int, float)) else thr
    hi_ = float(hi) if hi > lo else float(lo + 1)
    return BasisSpec(fun, degree, tuple(map(float, knots or ())), (float(lo), hi_), scale or float(max(abs(lo), abs(hi)) or 1), side, 1, intercept)


def basis_columns(df: DataFrame, x: str, spec: BasisSpec, prefix: str = "b") -> DataFrame:
    """df with the basis columns <prefix>1, <prefix>2, ..."""
    return df.select("*", *(c.alias(n) for c, n in zip(spec.columns(F.col(x)), spec.names(prefix))))


def basis_report(df: DataFrame, x: str, spec: BasisSpec) -> dict:
    """Rank and condition of a basis, from its Gram matrix, and whether it extrapolates without NaN."""
    from ..operators.glm import gram

    names = spec.names()
    g, _, n, _ = gram(basis_columns(df.select(x), x, spec).na.drop(), names, None)
    lo, hi = spec.bounds
    return {"n": n, "columns": len(names), "rank": int(np.linalg.matrix_rank(g)), "condition": float(np.sqrt(np.linalg.cond(g))), "extrapolates": bool(np.isfinite(spec.numpy([lo - 1, hi + 1])).all())}
