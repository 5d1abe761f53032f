"""Exact quantiles per group (location), and bases whose knots and bounds are a group's own, as tables that rows join."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bases import BasisSpec
from .shared import settled

#: Rows up to which a group's values are sorted in one buffer; beyond, distinct values are spread over cells.
HELD = 200_000
#: Cells that a crowded cell is cut into.
FINER = 256


def joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on equal or equally NULL columns, which stay once."""
    other = right.select(*(F.col(c).alias(f"{c}_r") for c in on), *(c for c in right.columns if c not in on))
    return left.join(other, [F.col(c).eqNullSafe(F.col(f"{c}_r")) for c in on], how).drop(*(f"{c}_r" for c in on))


def quantiles_by(df: DataFrame, by: Sequence[str], x: str, probs: Sequence[float] | Column, about: Sequence[Column] = (), held: int = HELD) -> DataFrame:
    """(by, about, n, q): per group the number of values of x that are not NULL or NaN, and their exact quantiles.

    probs: numbers, or an array that may use the aggregates `about` of the group. Linear interpolation between the two
    order statistics beside each; q is NULL without values. Groups of more than `held` rows are not sorted in a buffer:
    their distinct values are counted, spread over cells in order, and only the cells in which quantiles fall are
    looked into; a cell holds at most `held` values, or one value.
    """
    gs = [f"_g{i}" for i in range(len(by))]
    value = F.nanvl(F.col(x).cast("double"), F.lit(None))
    asked = probs if isinstance(probs, Column) else F.array(*(F.lit(float(p)) for p in probs))
    keyed = df.withColumns({g: F.col(b) for g, b in zip(gs, by)} | {"_v": value})
    groups = keyed.groupBy(*gs).agg(*about, F.count("_v").alias("n")).withColumn("_p", asked)
    rows = keyed.select(*gs, "_v").where("_v is not null")
    most = rows.groupBy(*gs).count().agg(F.max("count")).first()[0] or 0
    if most <= held:
        got = rows.groupBy(*gs).agg(F.array_sort(F.collect_list("_v")).alias("_s"))
        at = lambda p: p * (F.col("n") - 1)
        one = lambda p: between(F.get("_s", F.floor(at(p)).cast("int")), F.get("_s", F.ceil(at(p)).cast("int")), at(p))
        out = joined(groups, got, gs, "left").withColumn("q", F.when(F.col("n") > 0, F.transform("_p", one)))
    else:
        out = joined(groups, from_cells(rows, groups, gs, held), gs, "left")
    return out.select(*(F.col(g).alias(b) for g, b in zip(gs, by)), *(c for c in out.columns if c not in (*gs, "_p", "_s", "n", "q")), "n", "q")


def between(low: Column, high: Column, at: Column) -> Column:
    """What lies between two order statistics."""
    return F.when(F.ceil(at) == F.floor(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def from_cells(rows: DataFrame, groups: DataFrame, gs: Sequence[str], held: int) -> DataFrame:
    """(gs, q) of quantiles_by."""
    cells = settled(celled(settled(rows.groupBy(*gs, "_v").agg(F.count("*").alias("_m")), "values"), gs, held), "cells")
    totals = cells.groupBy(*gs, "_c").agg(F.sum("_m").alias("_t"))
    starts = totals.withColumn("_b", F.sum("_t").over(Window.partitionBy(*gs).orderBy("_c")) - F.col("_t"))  # a row per cell
    wanted = groups.where("n > 0").select(*gs, "n", F.posexplode("_p").alias("_i", "_q")).withColumn("_at", F.col("_q") * (F.col("n") - 1))
    near = wanted.withColumn("_k", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))))
    hit = joined(near, starts, gs).where((F.col("_k") >= F.col("_b")) & (F.col("_k") < F.col("_b") + F.col("_t"))).select(*gs, "_i", "_at", "_k", "_c", "_b")
    inside = joined(cells, hit.select(*gs, "_c", "_b").distinct(), [*gs, "_c"])
    upto = F.col("_b") + F.sum("_m").over(Window.partitionBy(*gs, "_c").orderBy("_v"))
    placed = inside.select(*gs, "_c", "_v", upto.alias("_to"), (upto - F.col("_m")).alias("_from"))
    met = joined(hit.drop("_b"), placed, [*gs, "_c"]).where((F.col("_k") >= F.col("_from")) & (F.col("_k") < F.col("_to")))
    each = met.groupBy(*gs, "_i", "_at").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    return each.groupBy(*gs).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", between(F.col("_lo"), F.col("_hi"), F.col("_at")).alias("_q")))), lambda s: s["_q"]).alias("q"))


def celled(counted: DataFrame, gs: Sequence[str], held: int) -> DataFrame:
    """counted (gs, _v, _m) with _c, the cell of each value, an array in the order of the values.

    Crowded cells are cut at equal distances between their ends, again and again, so any spread of values ends in
    cells of at most `held` values.
    """
    rest, done = counted.withColumn("_c", F.array().cast("array<double>")), None
    while True:
        about = rest.groupBy(*gs, "_c").agg(F.count("*").alias("_s"), F.min("_v").alias("_l"), F.max("_v").alias("_h"))
        crowded = (F.col("_s") > held) & (F.col("_h") > F.col("_l"))
        cells = joined(rest, about, [*gs, "_c"])
        fine = cells.where(~crowded).select(*gs, "_v", "_m", "_c")
        done = fine if done is None else done.union(fine)
        if not about.where(crowded).limit(1).count():
            return done
        part = F.least(F.floor((F.col("_v") - F.col("_l")) / ((F.col("_h") - F.col("_l")) / FINER)), F.lit(FINER - 1)).cast("double")
        rest = cells.where(crowded).select(*gs, "_v", "_m", F.concat("_c", F.array(part)).alias("_c"))


def own_knots(df: DataFrame, by: str, x: str, probs: Sequence[float], held: int = HELD) -> DataFrame:
    """(by, knots, lo, hi): the quantiles of x at probs, and its range, per group."""
    got = quantiles_by(df, [by], x, [0.0, *probs, 1.0], held=held)
    return got.select(by, F.slice("q", 2, len(probs)).alias("knots"), F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(len(probs) + 1)).alias("hi"))


def own_basis(df: DataFrame, by: str, x: str, spec: BasisSpec, knots: DataFrame, names: Sequence[str]) -> DataFrame:
    """df with the columns `names`: the basis of x like spec, with each group's knots and bounds from `knots`.

    NULL where x is, and in groups without knots. In Arrow, by runs of rows of one group.
    """
    full = joined(df, knots.select(by, F.col("knots").alias("_knots"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), [by], "left")
    kept, values = df.columns, F.struct("_knots", "_lo", "_hi", F.col(x).cast("double").alias("_x"))

    def run(batches):
        for b in batches:
            s = b.column("_s")
            x_, knots_, lo, hi = s.field("_x").to_numpy(zero_copy_only=False).astype(float), s.field("_knots").to_pylist(), s.field("_lo").to_pylist(), s.field("_hi").to_pylist()
            out, i = np.full((b.num_rows, len(names)), np.nan), 0
            while i < b.num_rows:
                j = i + 1
                while j < b.num_rows and knots_[j] == knots_[i] and lo[j] == lo[i] and hi[j] == hi[i]:
                    j += 1
                if knots_[i] is not None:
                    out[i:j] = replace(spec, knots=tuple(knots_[i]), bounds=(lo[i], hi[i])).numpy(x_[i:j])
                i = j
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(np.ascontiguousarray(c), from_pandas=True) for c in out.T)], names=[*kept, *names])

    kinds = [*df.schema.fields, *(T.StructField(k, T.DoubleType()) for k in names)]
    return full.select(*kept, values.alias("_s")).mapInArrow(run, T.StructType(kinds))
