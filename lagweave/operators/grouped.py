"""A model per location, for locations of any size, with seasonal columns from each location's own dates.

Rows are packed into blocks of one location each (at most ROWS rows). A round of reweighting is one pass over the
blocks of all locations that have not converged: tasks add up X'WX, X'Wz and the deviance, the entries are summed by
(location, place) in a shuffle, and locations are solved side by side from p x p numbers each. No task holds a
location's rows, and the driver sees a count. Locations may differ in their number of columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.groups import joined
from ..functions.season import Season, season_columns
from ..functions.shared import settled
from .glm import fit_by, invert, solve, variance, working

ROWS = 4096
#: Rows of a location up to which one task fits it.
HELD = 200_000
STATE = "ends array<double>, beta array<double>, dev double, done boolean, coef array<double>, vcov array<double>, dispersion double, n long, converged boolean"


def blocks(df: DataFrame, by: str, numbers: Sequence, t: str | None) -> DataFrame:
    """(by, m): the numbers of complete rows, packed row by row. t spreads a location's rows evenly over tasks."""
    chunk = F.floor(F.col(t) / ROWS) if t else F.spark_partition_id()
    rows = df.select(F.col(by).alias("_by"), chunk.alias("_c"), *(c.cast("double").alias(f"_{i}") for i, c in enumerate(numbers)))
    rows = rows.repartition("_by", "_c").sortWithinPartitions("_by", "_c")
    width, kind = len(numbers), df.schema[by].dataType.simpleString()

    def pieces(batches):
        for b in batches:
            m = np.column_stack([b.column(i + 2).to_numpy(zero_copy_only=False).astype(float) for i in range(width)])
            fine = ~np.isnan(m).any(1)
            keys = list(zip(b.column("_by").to_pylist(), b.column("_c").to_pylist()))
            i = 0
            for key, run in groupby(keys):
                n = sum(1 for _ in run)
                yield key, b.column("_by").slice(i, 1), m[i : i + n][fine[i : i + n]]
                i += n

    def run(batches):
        for _, parts in groupby(pieces(batches), key=lambda p: p[0]):
            held, size = [], 0
            for _, name, m in parts:
                held.append(m)
                size += len(m)
                while size >= ROWS:
                    whole = np.concatenate(held)
                    yield packed(name, whole[:ROWS])
                    held, size = [whole[ROWS:]], size - ROWS
            if size:
                yield packed(name, np.concatenate(held))

    def packed(name, m):
        return pa.RecordBatch.from_arrays([name, pa.array([np.ascontiguousarray(m).tobytes()], pa.binary())], names=[by, "m"])

    return rows.mapInArrow(run, f"{by} {kind}, m binary")


def pass_over(blocks_: DataFrame, live: DataFrame, by: str, width: int, family: str, season: bool) -> DataFrame:
    """(by, i, v): sums over a location's rows. Places: the upper triangle of X'WX, X'Wz, rows, deviance, Pearson's sum."""
    kind = blocks_.schema[by].dataType.simpleString()

    def sums(m: np.ndarray, ends, beta) -> np.ndarray:
        y, o, x = m[:, 0], m[:, 1], np.column_stack([np.ones(len(m)), m[:, 2 : width - season]])
        if season:
            x = np.column_stack([x, season_columns(ends, m[:, -1])])
        z, w, mu, d = working(family, y, None if beta is None else x @ np.array(beta) + o)
        xw = x * w[:, None]
        g = xw.T @ x
        return np.concatenate([g[np.triu_indices(len(g))], xw.T @ (z - o), [len(m), d.sum(), ((y - mu) ** 2 / variance(family, mu)).sum()]])

    def run(batches):
        rows = ((b.column(by).slice(i, 1), b.column(by)[i].as_py(), m, e, c) for b in batches for i, (m, e, c) in enumerate(zip(*(b.column(k).to_pylist() for k in ("m", "ends", "beta")))))
        for _, group in groupby(rows, key=lambda r: r[1]):
            total, name = 0.0, None
            for name, _, m, ends, beta in group:
                total = total + sums(np.frombuffer(m).reshape(-1, width), ends, beta)
            yield pa.RecordBatch.from_arrays([name.take(pa.array(np.zeros(len(total), np.int64))), pa.array(np.arange(len(total))), pa.array(total)], names=[by, "i", "v"])

    parts = joined(blocks_, live.select(by, "ends", "beta"), [by]).mapInArrow(run, f"{by} {kind}, i long, v double")
    return parts.groupBy(by, "i").agg(F.sum("v").alias("v"))


def solved(state: DataFrame, sums: DataFrame, by: str, columns: int, family: str, form: np.ndarray | None, tol: float) -> DataFrame:
    """The state after a round: coefficients, or the result of a location that has converged or cannot be fitted."""
    names = [c.split()[0] for c in STATE.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        old = left.to_pylist()[0]
        p = columns + (len(old["ends"]) - 1 if old["ends"] is not None else 0)
        flat = np.zeros(p * (p + 1) // 2 + p + 3)
        flat[right.column("i").to_numpy()] = right.column("v").to_numpy()
        n, dev, pearson = int(flat[-3]), flat[-2], flat[-1]
        new = dict(old, n=n, dev=dev)
        if n <= p:
            new |= result(np.full(p, np.nan), np.full((p, p), np.nan), np.nan, False)
        else:
            g = np.zeros((p, p))
            g[np.triu_indices(p)] = flat[: p * (p + 1) // 2]
            g = np.triu(g) + np.triu(g, 1).T
            beta = solve(g, flat[p * (p + 1) // 2 : -3])  # once more where the deviance has settled
            if old["beta"] is not None and abs(old["dev"] - dev) <= tol * (abs(dev) + 0.1):
                s = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
                free = n - int(np.linalg.matrix_rank(g * np.outer(s, s)))
                phi = pearson / max(1, free) if family in ("gaussian", "quasipoisson", "gamma") else 1.0
                new |= result(beta, phi * invert(g), phi, True)
            else:
                new["beta"] = beta.tolist()
        return pa.table({by: left.column(by), **{c: pa.array([new[c]], left.schema.field(c).type) for c in names}})

    def result(beta, v, phi, ok) -> dict:
        if form is not None:
            m = np.column_stack([form, np.zeros((len(form), len(beta) - form.shape[1]))])
            beta, v = m @ beta, m @ v @ m.T
        known = lambda a: [None if math.isnan(c) else c for c in np.ravel(a).tolist()]
        return {"coef": known(beta), "vcov": known(v), "dispersion": known(phi)[0], "converged": ok, "done": True}

    kind = state.schema[by].dataType.simpleString()
    return state.groupBy(by).cogroup(sums.groupBy(by)).applyInArrow(run, f"{by} {kind}, {STATE}")


def fit_blocks(df: DataFrame, by: str, y: str, names: Sequence[str], family: str = "quasipoisson", form: np.ndarray | None = None, *, offset: str | None = None, season: Season | None = None, t: str | None = None, max_iter: int = 30, tol: float = 1e-9) -> DataFrame:
    """(by, coef, vcov, dispersion, n, converged), as fit_by gives them: coefficients of (intercept), names, season.

    t: integer times, once per location. form: a matrix by which coefficients of (intercept) and names are multiplied.
    """
    numbers = [F.col(y), F.col(offset) if offset else F.lit(0.0), *map(F.col, names), *([F.col(season.t)] if season else [])]
    data = settled(blocks(df, by, numbers, t or (season.t if season else None)), "blocks")
    start = season.table(df, [by]) if season else df.select(by).distinct().withColumn("ends", F.lit(None).cast("array<double>"))
    blank = {c: F.lit(None).cast(kind) for c, kind in (x.split() for x in STATE.split(", ")[1:]) if c not in ("done", "converged")}
    state = settled(start.select(by, "ends", *(blank.get(c, F.lit(False)).alias(c) for c in (x.split()[0] for x in STATE.split(", ")[1:]))), "state")
    done = state.where("done")
    for _ in range(max_iter):
        live = state.where("not done")
        state = settled(solved(live, pass_over(data, live, by, len(numbers), family, season is not None), by, len(names) + 1, family, form, tol), "state")
        done = done.union(state.where("done"))
        if not state.where("not done").limit(1).count():
            break
    else:
        left = state.where("not done")
        done = done.union(left)
    return done.select(by, "coef", "vcov", "dispersion", "n", "converged")


def fit_locations(df: DataFrame, by: str, y: str, names: Sequence[str], family: str = "quasipoisson", form: np.ndarray | None = None, *, offset: str | None = None, season: Season | None = None, t: str | None = None, counted: DataFrame | None = None, held: int = HELD) -> DataFrame:
    """fit_by where every location has at most `held` rows, else fit_blocks; the results are the same.

    counted: a table of the same locations and rows that is cheaper to count than df.
    """
    most = (df if counted is None else counted).groupBy(by).count().agg(F.max("count")).first()[0] or 0
    if most <= held:
        return fit_by(df, by, y, names, family, form, offset=offset, season=season)
    return fit_blocks(df, by, y, names, family, form, offset=offset, season=season, t=t)
