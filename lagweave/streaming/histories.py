"""Exposure histories of a stream of daily exposures, per location, with late days worked in.

State holds the last exposures of a location, as many as late days and the lag range need. A row (by, t, x) emits
the histories of t and of the later days that it belongs to, so a late day emits those anew; the latest row of a
(by, t) is the right one. CrossBasis.matrix turns the histories into cross-basis columns, without state.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lags import mklag


def histories(stream: DataFrame, by: str, t: str, x: str, lag, lateness: int = 30) -> DataFrame:
    """(by, t, history): history[k] is x at t - (lo + k), NULL where unknown. Days older than lateness, and rows without a day, are dropped."""
    lo, hi = mklag(lag)
    if lo < 0:
        raise ValueError("a stream has no leads")
    kind = stream.schema[by].dataType.simpleString()

    def run(key, frames, state):
        seen = {int(k): v for k, v in json.loads(state.get[0]).items()} if state.exists else {}
        touched = set()
        newest = max(seen, default=None)
        for pdf in frames:
            for day, value in zip(pdf[t], pdf[x]):
                if pd.isna(day):
                    continue
                day = int(day)
                if newest is not None and day < newest - lateness:
                    continue
                newest = day if newest is None else max(newest, day)
                seen[day] = None if pd.isna(value) else float(value)
                touched.add(day)
        again = {d + k for d in touched for k in range(lo, hi + 1)} & seen.keys() | touched
        rows = [(key[0], d, [seen.get(d - k) for k in range(lo, hi + 1)]) for d in sorted(again)]
        if newest is not None:
            seen = {d: v for d, v in seen.items() if d >= newest - lateness - hi}
            state.update((json.dumps(seen),))
        yield pd.DataFrame(rows, columns=[by, t, "history"])

    return stream.select(F.col(by), F.col(t).cast("long").alias(t), F.col(x).cast("double").alias(x)).groupBy(by).applyInPandasWithState(run, f"{by} {kind}, {t} long, history array<double>", "seen string", "append", "NoTimeout")


def daily(stream: DataFrame, by: str, ts: str, value: str, delay: str = "2 days") -> DataFrame:
    """(by, t, y, x): counts and means per day since 1970, each once the watermark has passed it."""
    day = stream.withWatermark(ts, delay).groupBy(by, F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("y"), F.avg(value).alias("x"))
    return day.select(by, F.unix_date(F.col("w.start").cast("date")).alias("t"), "y", "x")
