"""Earthquake scenarios over rasters and points; every plan is a projection and, at most, one partial aggregate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import hazard
from ..functions.grid import KM_PER_DEG, Grid, km_per_deg_lng
from .exposure import along, as_stretches


def point_intensity(points: DataFrame, lng: float, lat: float, magnitude: float, depth_km: float) -> DataFrame:
    """points with km, intensity and band of one scenario."""
    km = hazard.distance_km(F.col("lng"), F.col("lat"), F.lit(lng), F.lit(lat))
    return points.withColumn("km", km).withColumn("intensity", hazard.intensity(F.col("km"), F.lit(depth_km), F.lit(magnitude))).withColumn("band", hazard.band(F.col("intensity")))


def raster(dem: DataFrame, grid: Grid, lng: float, lat: float, magnitude: float, depth_km: float) -> DataFrame:
    """r, c, intensity, label: distances take the cosine at the mean of both latitudes."""
    km = hazard.distance_km(grid.lng(F.col("c")), grid.lat(F.col("r")), F.lit(lng), F.lit(lat), mean_latitude=True)
    index = hazard.intensity(km, F.lit(depth_km), F.lit(magnitude))
    return dem.select("r", "c", "elev", index.alias("intensity")).withColumn("label", hazard.band_label(F.col("intensity")))


def bands(spark) -> DataFrame:
    """band, label, least: four rows."""
    return spark.createDataFrame([(n, k, t) for k, (n, t) in enumerate(hazard.BANDS, 1)], "band string, label int, least double")


def area_by_band(labels: DataFrame, grid: Grid, region_cap_m: float | None = None) -> DataFrame:
    """band, cells, area_km2, zero for bands without cells; cells above the cap are outside the region."""
    inside = labels if region_cap_m is None else labels.where(F.col("elev") <= region_cap_m)
    counts = inside.groupBy("label").agg(F.count("*").alias("cells"))
    out = F.broadcast(bands(labels.sparkSession)).join(counts, "label", "left").withColumn("cells", F.coalesce("cells", F.lit(0).cast("bigint")))
    return out.select("band", "cells", F.round(F.col("cells") * F.lit(grid.cell_area_m2) / 1e6, 2).alias("area_km2"))


def radii(scenarios: DataFrame) -> DataFrame:
    """scenario, band, radius_km of each scenario and band."""
    rows = scenarios.crossJoin(F.broadcast(bands(scenarios.sparkSession)))
    return rows.select("scenario", "band", hazard.band_radius_km(F.col("least"), F.col("magnitude"), F.col("depth_km")).alias("radius_km"))


def exposure(points: DataFrame) -> DataFrame:
    """Counts per kind and band, with none and total, of points that have a band; kinds of many points do not collect anywhere."""
    names = [n for n, _ in hazard.BANDS]
    n = lambda cond: F.sum(cond.cast("bigint"))
    return points.groupBy("kind").agg(*(n(F.coalesce(F.col("band") == b, F.lit(False))).alias(b) for b in names), n(F.col("band").isNull()).alias("none"), F.count("*").alias("total"))


def worst_band(samples: DataFrame) -> DataFrame:
    """id, label per line: its worst band over the sample points, 0 if none is in any."""
    return samples.groupBy("id").agg(F.coalesce(F.min(F.when(F.col("label") > 0, F.col("label"))), F.lit(0)).alias("label"))


#: Degrees of the tiles through which scenarios and points find each other.
TILE = 0.25


def in_tiles(points: DataFrame) -> DataFrame:
    at = lambda c: F.floor(F.col(c) / TILE)
    return points.withColumns({"tx": at("lng"), "ty": at("lat")})


def reach(scenarios: DataFrame) -> DataFrame:
    """scenario, s_lng, s_lat, magnitude, depth_km, tx, ty: the tiles that hold any point within the outermost radius.

    A degree of longitude is taken as short as it gets within the radius.  Magnitudes have a bound, and so have the tiles of a scenario.
    """
    km = hazard.band_radius_km(F.lit(hazard.BANDS[-1][1]), F.col("magnitude"), F.col("depth_km")) + 0.1  # it is rounded to 0.1
    d_lat = km / KM_PER_DEG
    d_lng = km / km_per_deg_lng(F.least(F.abs("lat") + d_lat, F.lit(90.0)))
    over = lambda at, d: F.explode(F.sequence(F.floor((F.col(at) - d) / TILE), F.floor((F.col(at) + d) / TILE)))
    near = scenarios.where("magnitude IS NOT NULL AND depth_km IS NOT NULL AND lng IS NOT NULL AND lat IS NOT NULL")
    near = near.select("scenario", F.col("lng").alias("s_lng"), F.col("lat").alias("s_lat"), "magnitude", "depth_km", over("lng", d_lng).alias("tx"), d_lat.alias("d_lat"))
    return near.select("scenario", "s_lng", "s_lat", "magnitude", "depth_km", "tx", F.explode(F.sequence(F.floor((F.col("s_lat") - F.col("d_lat")) / TILE), F.floor((F.col("s_lat") + F.col("d_lat")) / TILE))).alias("ty"))


#: Degrees of longitude from an epicentre within which the distance along a stretch falls, then rises.
CONVEX = 25.0


@F.pandas_udf(IntegerType())
def nearest_sample(lng: pd.Series, lat: pd.Series, dx: pd.Series, dy: pd.Series, n: pd.Series, at_lng: pd.Series, at_lat: pd.Series) -> pd.Series:
    """Which of a stretch's samples 0 to n is nearest to a place, without going through them.

    With A the longitude's difference in radians, the second derivative of the squared distance along a stretch is at least
    C^2 - 4 A C D + D^2 (1 - A^2) of its extents C and D, not negative for 5 A^2 <= 1.  So distances fall, then rise: a sample between
    two that are no nearer is the nearest, and halving finds it.  Stretches farther away than CONVEX are gone through sample by sample.
    """
    x, y, dx, dy = (v.to_numpy(dtype=np.float64) for v in (lng - at_lng, lat - at_lat, dx, dy))
    base, n = lat.to_numpy(dtype=np.float64), n.to_numpy(dtype=np.int64)
    parts = np.maximum(n, 1)

    def km2(k: np.ndarray, on=slice(None)) -> np.ndarray:
        t = k / parts[on]
        shrunk = np.maximum(np.cos(np.radians(base[on] + dy[on] * t)), 0.1)
        return ((x[on] + dx[on] * t) * shrunk) ** 2 + (y[on] + dy[on] * t) ** 2

    flat = np.maximum(np.cos(np.radians(base + dy / 2)), 0.1) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        t = -(x * dx * flat + y * dy) / (dx * dx * flat + dy * dy)
    best = np.rint(np.clip(np.nan_to_num(t), 0, 1) * n).astype(np.int64)
    here = km2(best)
    moved = (best > 0) & (km2(np.maximum(best - 1, 0)) < here) | (best < n) & (km2(np.minimum(best + 1, n)) < here)
    left = np.flatnonzero(moved)
    low, high = np.zeros(len(left), np.int64), n[left]
    while (low < high).any():
        middle = (low + high) // 2
        down = km2(np.minimum(middle + 1, high), left) < km2(middle, left)
        low, high = np.where(down, np.minimum(middle + 1, high), low), np.where(down, high, middle)
    best[left] = low
    for i in np.flatnonzero((n > 1) & (np.maximum(np.abs(x), np.abs(x + dx)) > CONVEX)):
        best[i] = np.argmin(km2(np.arange(n[i] + 1), np.full(n[i] + 1, i)))
    return pd.Series(best.astype(np.int32))


def worst_label(stretches: DataFrame, lng: Column, lat: Column, magnitude: Column, depth_km: Column) -> DataFrame:
    """stretches (lng, lat, dx, dy, n) with label, the worst band of their n + 1 samples: the one of the nearest sample."""
    rows = stretches.withColumn("k", nearest_sample("lng", "lat", "dx", "dy", "n", lng, lat))
    km = hazard.distance_km(along("lng", "dx", F.col("k")), along("lat", "dy", F.col("k")), lng, lat)
    return rows.withColumn("label", hazard.band_label(hazard.intensity(km, depth_km, magnitude))).drop("k")


def labelled_pairs(pairs: DataFrame) -> DataFrame:
    """scenario, kind, id, label of pairs; 0 is no band, and is left out after counting, as a filter here would reckon every intensity again."""
    km = hazard.distance_km(F.col("lng"), F.col("lat"), F.col("s_lng"), F.col("s_lat"))
    label = hazard.band_label(hazard.intensity(km, F.col("depth_km"), F.col("magnitude")))
    return pairs.select("scenario", "kind", "id", label.alias("label"))


def counted(hits: DataFrame, all_of: DataFrame) -> DataFrame:
    """scenario, kind, band, n from hits (scenario, kind, label) of assets and all_of (scenario, kind, total); what is in no band is the difference."""
    n = hits.groupBy("scenario", "kind", "label").agg(F.count(F.lit(1)).alias("n")).where("label > 0")
    some = n.groupBy("scenario", "kind").agg(F.sum("n").alias("hit"))
    none = all_of.join(some, ["scenario", "kind"], "left").withColumn("n", F.col("total") - F.coalesce("hit", F.lit(0))).where("n > 0")
    names = F.array(*(F.lit(b) for b, _ in hazard.BANDS))
    return n.select("scenario", "kind", F.get(names, F.col("label") - 1).alias("band"), "n").union(none.select("scenario", "kind", F.lit("none"), "n"))


def sweep(points: DataFrame, scenarios: DataFrame, lines: bool = False) -> DataFrame:
    """scenario, kind, band, n of many scenarios over points (kind, id, lng, lat), each an asset; with lines, an asset is all points or stretches (dx, dy, n) of its id, in the worst of their bands.

    Scenarios and points meet in the tiles within reach alone, so work is bounded by the pairs within reach, not by all pairs.
    Points without a place, and all points of a scenario without all four numbers, are in no band.
    """
    if lines:
        per_kind = points.select("kind", "id").distinct()
        hits = line_hits(as_stretches(points), reach(scenarios))
    else:
        per_kind = points
        hits = labelled_pairs(in_tiles(points).join(reach(scenarios), ["tx", "ty"]))
    per_kind = per_kind.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    return counted(hits, scenarios.select("scenario").crossJoin(F.broadcast(per_kind)))  # a row for each of the result's


def line_hits(lines: DataFrame, near: DataFrame) -> DataFrame:
    """scenario, kind, id, label of stretches and the scenarios that reach a tile of theirs.

    A line's stretches are brought together first, so that the pairs of a line stay where they are made and are not shuffled.
    """
    s = F.struct("lng", "lat", "dx", "dy", "n")
    own = lines.where("lng IS NOT NULL AND lat IS NOT NULL AND dx IS NOT NULL AND dy IS NOT NULL").groupBy("kind", "id").agg(F.collect_list(s).alias("s"))
    over = lambda at, by: F.explode(F.sequence(F.floor(F.least(F.col(at), F.col(at) + F.col(by)) / TILE), F.floor(F.greatest(F.col(at), F.col(at) + F.col(by)) / TILE)))
    tiled = own.select("kind", "id", F.explode("s").alias("s")).select("kind", "id", "s.*").withColumn("tx", over("lng", "dx")).withColumn("ty", over("lat", "dy"))
    pairs = worst_label(tiled.join(near, ["tx", "ty"]), F.col("s_lng"), F.col("s_lat"), F.col("magnitude"), F.col("depth_km"))
    return pairs.groupBy("scenario", "kind", "id").agg(F.min(F.nullif("label", F.lit(0))).alias("label"))


def planned_sweep(planned: DataFrame, scenarios: DataFrame) -> DataFrame:
    """The same for scenarios that bring assets of their own (scenario, kind, id, lng, lat); one with an empty list has no rows."""
    s = scenarios.select("scenario", F.col("lng").alias("s_lng"), F.col("lat").alias("s_lat"), "magnitude", "depth_km")
    return counted(labelled_pairs(planned.join(s, "scenario")), planned.groupBy("scenario", "kind").agg(F.count(F.lit(1)).alias("total")))


def exposed(assets: DataFrame, lng: float, lat: float, magnitude: float, depth_km: float) -> DataFrame:
    """kind, id, name, band of every asset (kind, id, name, lng, lat, a row a sample, or with dx, dy, n a row a stretch): its worst band, null outside all."""
    label = F.nullif(F.col("label"), F.lit(0))
    rows = worst_label(as_stretches(assets), *map(F.lit, (lng, lat, magnitude, depth_km)))
    worst = rows.groupBy("kind", "id").agg(F.first("name").alias("name"), F.min(label).alias("label"))
    names = F.array(*(F.lit(b) for b, _ in hazard.BANDS))
    return worst.select("kind", "id", "name", F.get(names, F.col("label") - 1).alias("band"))
