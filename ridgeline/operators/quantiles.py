"""Exact quantiles of a column of any size, by counts in buckets that narrow to one value."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Values at the shares of the sorted column, between two by their distance; nulls are left out, of none all are null.

    A pass counts each window's values in BUCKETS buckets (partial aggregates, a few thousand rows to the driver) and the bucket of
    a rank is its next window; a window shrinks by that factor, so doubles take six passes at most and no task holds values.
    """
    x = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    all_ = x.agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    if not all_.n:
        return [None] * len(shares)
    places = [s * (all_.n - 1) for s in shares]
    ranks = sorted({k for p in places for k in (math.floor(p), math.ceil(p))})
    windows = {k: (all_.low, all_.high, 0) for k in ranks}  # low, high, how many values lie below
    while any(low < high for low, high, _ in windows.values()):
        open_ = sorted({w for w in windows.values() if w[0] < w[1]})
        spans = F.array(*(F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(i).alias("i")) for i, (low, high, _) in enumerate(open_)))
        inside = x.select("x", F.explode(F.filter(spans, lambda w: (F.col("x") >= w["low"]) & (F.col("x") <= w["high"]))).alias("w"))
        bucket = F.least(F.lit(BUCKETS - 1), F.floor((F.col("x") - F.col("w.low")) / (F.col("w.high") - F.col("w.low")) * BUCKETS))
        counted = inside.groupBy("w.i", bucket.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        for i, window in enumerate(open_):
            before = window[2]
            for r in sorted((r for r in counted if r.i == i), key=lambda r: r.b):
                for k in ranks:
                    if windows[k] == window and before <= k < before + r.n:
                        windows[k] = (r.low, r.high, before)
                before += r.n
    value = {k: w[0] for k, w in windows.items()}
    return [value[math.floor(p)] + (value[math.ceil(p)] - value[math.floor(p)]) * (p - math.floor(p)) for p in places]
