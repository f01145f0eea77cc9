"""Whole requests: a hazard with all that its answer holds, as named DataFrames; nothing runs until one of them is used, but for what loops need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hazard
from ..functions.grid import Grid
from . import exposure, flood as water_flow, quake, regions, terrain
from .durable import written

#: Metres from which water counts as deep (fixed value).
DEEP_M = 1.0


def statistics(wet: DataFrame, dem: DataFrame, grid: Grid) -> DataFrame:
    """One row: extents and depths of wet cells (r, c, elev, depth); zeros for none."""
    km2 = lambda n: F.round(n * grid.cell_area_m2 / 1e6, 3)
    n, deep = F.count(F.lit(1)), F.count_if(F.col("depth") >= DEEP_M)
    s = wet.agg(
        n.alias("cells_flooded"), km2(n).alias("area_km2"), F.round(F.coalesce(F.max("depth"), F.lit(0.0)), 2).alias("max_depth_m"), F.round(F.coalesce(F.avg("depth"), F.lit(0.0)), 2).alias("mean_depth_m"),
        km2(deep).alias("deep_area_km2"), F.round(100.0 * n / (grid.nrows * grid.ncols), 2).alias("percent_of_cells"), F.round(F.max(F.col("elev") + F.col("depth")), 3).alias("water_surface_m"),
    )
    return s.withColumn("cell_resolution_m", F.round(F.lit(grid.res_lat * 111.32 * 1000), 3))


def flood(dem: DataFrame, grid: Grid, assets: DataFrame, source: DataFrame, level_m: float, mode: str = "rise", water: DataFrame | None = None, region_cap_m: float | None = None) -> dict[str, DataFrame]:
    """stats, overlay, exposure and affected of water that enters at the source cells (r, c), of a river, a drawn path or a point.

    mode rise: level_m over the river, shared out by flow accumulation, with the water cells (r, c) of its catchment as tributaries.
    mode absolute: water up to level_m above the sea, wherever the source.  assets: samples of exposure.asset_samples; a scenario
    with assets of its own passes those.  Cells above the cap are outside the region.  A flood of nothing gives zeros and no rows.
    """
    if mode not in ("rise", "absolute"):
        raise ValueError("mode is rise or absolute")
    flow = written(terrain.d8_flow(dem), "flow")
    seeds = written(source.select("r", "c").distinct(), "seeds")
    if mode == "absolute":
        plan = terrain.absolute_plan(dem, grid, level_m)
    else:
        none = seeds.limit(0)
        caught = none.withColumn("dist", F.lit(0)) if water is None else terrain.catchment(dem, flow, seeds, grid)
        plan = terrain.inflow_plan(terrain.accumulation(dem, flow, grid), caught, seeds, none if water is None else water, grid, level_m)
    region = None if region_cap_m is None else dem.where(F.col("elev") <= region_cap_m)
    wet = written(water_flow.wet_cells(dem, flow, plan.withColumn("scenario", F.lit(0)), grid, region), "wet")
    hit = written(exposure.affected(assets, wet, grid), "affected")
    overlay = regions.classed_polygons([("flood", wet), ("flood-deep", wet.where(F.col("depth") >= DEEP_M))], grid)
    return {"stats": statistics(wet, dem, grid), "wet": wet, "overlay": overlay, "exposure": exposure.affected_counts(assets, hit), "affected": hit}


def earthquake(dem: DataFrame, grid: Grid, assets: DataFrame, lng: float, lat: float, magnitude: float, depth_km: float, region_cap_m: float | None = None) -> dict[str, DataFrame]:
    """stats, zones, area_km2 and radius_km by band, exposure by kind, and exposed assets of one earthquake."""
    labels = quake.raster(dem, grid, lng, lat, magnitude, depth_km)
    inside = labels if region_cap_m is None else labels.where(F.col("elev") <= region_cap_m)
    area = quake.area_by_band(labels, grid, region_cap_m)
    one = dem.sparkSession.createDataFrame([(0, lng, lat, magnitude, depth_km)], "scenario int, lng double, lat double, magnitude double, depth_km double")
    banded = quake.exposed(assets, lng, lat, magnitude, depth_km)
    zones = regions.classed_polygons([(n, inside.where(F.col("label") == k)) for k, (n, _) in enumerate(hazard.BANDS, 1)], grid)
    return {
        "stats": area.agg(F.round(F.sum("area_km2"), 3).alias("footprint_km2")), "zones": zones, "area_km2": area, "radius_km": quake.radii(one), "exposure": quake.exposure(banded),
        "exposed": banded.where(F.col("band").isNotNull()),
    }


def suitability(dem: DataFrame, grid: Grid, road_vertices: DataFrame | None = None) -> dict[str, DataFrame]:
    """layers and area_km2 of the three classes of land, and the score and class of each cell."""
    near = dem.select("r", "c").limit(0) if road_vertices is None else terrain.near_roads(exposure.with_cell(road_vertices, grid), grid)
    scores = terrain.suitability(dem, near, grid)
    cells = written(scores.select("r", "c", "score", hazard.suitability_class(F.col("score")).alias("class")), "suitability")
    names = ("green", "yellow", "red")
    area = cells.groupBy("class").agg(F.round(F.count(F.lit(1)) * grid.cell_area_m2 / 1e6, 2).alias("area_km2"))
    every = F.broadcast(dem.sparkSession.createDataFrame([(n,) for n in names], "class string"))
    area = every.join(area, "class", "left").select("class", F.coalesce("area_km2", F.lit(0.0)).alias("area_km2"))
    return {"cells": cells, "layers": regions.classed_polygons([(n, cells.where(F.col("class") == n)) for n in names], grid), "area_km2": area}
