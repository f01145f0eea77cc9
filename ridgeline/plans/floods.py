"""Flood simulation queries; the kernel has no SQL, its volume balance is tested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flood, requests, terrain
from ..operators.durable import written
from ..sources import tables as T
from . import hazards, sql, terrains

RISES_M = (1.0, 2.0, 4.0)


def flood_sim(spark: SparkSession, d: str) -> DataFrame:
    """Peak depths of three rises of one river; depth in the plan is proportional to the rise."""
    dem, g, flow, main, c = terrains.caught(spark, d)
    p = written(terrain.inflow_plan(terrain.accumulation(dem, flow, g), c, main, terrains.river(spark, d, g, False), g, 1.0), "plan")
    rises = spark.createDataFrame(list(enumerate(RISES_M)), "scenario int, rise double")
    plans = p.crossJoin(rises).withColumn("d_cell", F.col("d_cell") * F.col("rise"))
    box = rises.select("scenario").crossJoin(terrain.flux_box(p, flow, g))
    return flood.simulate(dem, plans, box).select("scenario", "r", "c", F.round("depth", 3).alias("depth"))


def point_sources(spark: SparkSession, d: str) -> DataFrame:
    """A rise at each scenario's place; every fifth does not rise."""
    return T.scenarios(spark, d).selectExpr("CAST(scenario AS INT) AS scenario", "lng", "lat", "CAST(scenario % 5 AS DOUBLE) AS level_m")


def rounded(plan: DataFrame, *keys: str) -> DataFrame:
    return plan.select(*keys, "r", "c", F.round("d_cell", 6).alias("d_cell"), "start", "n_steps", "window", F.round("volume_m3", 2).alias("volume_m3"))


def flood_absolute_plan(spark: SparkSession, d: str) -> DataFrame:
    return rounded(terrain.absolute_plan(*terrains.raster(spark, d), terrains.LEVEL_M))


def flood_point_plan(spark: SparkSession, d: str) -> DataFrame:
    return rounded(terrain.point_plan(point_sources(spark, d), terrains.raster(spark, d)[1]), "scenario")


def northern(dem: DataFrame, g) -> DataFrame:
    """The region of the mask queries: the northern half."""
    return dem.where(F.col("r") < g.nrows / 2)


def surfaces(wet: DataFrame) -> DataFrame:
    return wet.select("scenario", "r", "c", F.round(F.col("elev") + F.col("depth"), 3).alias("surface"))


def flood_point(spark: SparkSession, d: str) -> DataFrame:
    """Mask and water surface of each point source."""
    dem, g = terrains.raster(spark, d)
    return surfaces(flood.wet_cells(dem, terrain.d8_flow(dem), terrain.point_plan(point_sources(spark, d), g), g, northern(dem, g)))


def flood_river(spark: SparkSession, d: str) -> DataFrame:
    """Mask and water surface of one rise along the main rivers, with their tributaries."""
    dem, g, flow, main, c = terrains.caught(spark, d)
    p = terrain.inflow_plan(terrain.accumulation(dem, flow, g), c, main, terrains.river(spark, d, g, False), g, terrains.RISE_M)
    return surfaces(flood.wet_cells(dem, flow, p.withColumn("scenario", F.lit(0)), g, northern(dem, g)))


def answer_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """section, item, name, value of a request's answer: its figures, one a row."""
    stats = [n for n in parts["stats"].columns if n != "scenario"]
    rows = parts["stats"].select(F.explode(F.array(*(F.struct(F.lit("stats").alias("section"), F.lit("").alias("item"), F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in stats))).alias("x")).select("x.*")
    for section, key in (("area_km2", "band"), ("radius_km", "band"), ("exposure", "kind")):
        if section in parts:
            names = [n for n in parts[section].columns if n not in (key, "scenario")]
            rows = rows.union(parts[section].select(F.explode(F.array(*(F.struct(F.lit(section).alias("section"), F.col(key).alias("item"), F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names))).alias("x")).select("x.*"))
    return rows


def flood_request(spark: SparkSession, d: str) -> DataFrame:
    """A whole request: the river's rise, its statistics, and what of all assets is flooded."""
    dem, g = terrains.raster(spark, d)
    main, water = terrains.river(spark, d, g, True), terrains.river(spark, d, g, False)
    return answer_rows(requests.flood(dem, g, hazards.asset_parts(spark, d), main, terrains.RISE_M, water=water, region_cap_m=hazards.CAP_M))


def quake_request(spark: SparkSession, d: str) -> DataFrame:
    """A whole request: bands' areas and radii, and the bands of all assets."""
    dem, g = terrains.raster(spark, d)
    return answer_rows(requests.earthquake(dem, g, hazards.asset_parts(spark, d), hazards.LNG, hazards.LAT, hazards.MAGNITUDE, hazards.DEPTH, region_cap_m=hazards.CAP_M))


def suitability_request(spark: SparkSession, d: str) -> DataFrame:
    """Areas of the three classes."""
    dem, g = terrains.raster(spark, d)
    return requests.suitability(dem, g, T.road_vertices(spark, d))["area_km2"]




def flood_path(spark: SparkSession, d: str) -> DataFrame:
    """Cells that the paths drawn from each scenario's place to the middle of all cross."""
    s = T.scenarios(spark, d)
    ends = F.array(F.struct("lng", "lat"), F.struct(F.lit(85.31).alias("lng"), F.lit(27.645).alias("lat")))
    return terrain.path_cells(s.select("scenario", ends.alias("path")), terrains.raster(spark, d)[1])


QUERIES = {f.__name__: f for f in (flood_sim, flood_absolute_plan, flood_point_plan, flood_point, flood_river, flood_path, flood_request, quake_request, suitability_request)}
WALK = terrains.LINES[terrains.LINES.index("pairs AS") : terrains.LINES.index(", main AS")]
ORACLES: dict[str, str] = {
    "flood_absolute_plan": f"""WITH {sql.GRID}, i AS (SELECT r, c, {terrains.LEVEL_M}e0 - elev AS d FROM dem WHERE {terrains.LEVEL_M}e0 - elev > 1e-3), t AS (SELECT sum(d) AS v FROM i)
      SELECT r, c, round(d, 6) AS d_cell, 0 AS start, 120 AS n_steps, 40 AS "window", round(v * m2, 2) AS volume_m3 FROM i, t, area""",
    "flood_point_plan": f"""WITH {sql.GRID}, {sql.SCENARIOS} SELECT CAST(scenario AS INT) AS scenario, {sql.row_of('lat')} AS r, {sql.col_of('lng')} AS c, round(scenario % 5 * 2.0e0, 6) AS d_cell, 0 AS start, 120 AS n_steps, 40 AS "window", round(scenario % 5 * 2.0e0 * m2, 2) AS volume_m3
      FROM scenarios, g, area WHERE scenario % 5 > 0""",
    "flood_path": f"""WITH RECURSIVE {sql.GRID}, {sql.SCENARIOS}, ends AS (SELECT scenario AS id, 1 AS pos, lng, lat FROM scenarios UNION ALL SELECT scenario, 2, 85.31e0, 27.645e0 FROM scenarios),
      wet_v AS (SELECT id, pos, {sql.row_of('lat')} AS r, {sql.col_of('lng')} AS c FROM ends, g), {WALK} SELECT id AS scenario, r, c FROM river""",
    "quake_request": f"""WITH {hazards.CELLS.replace(sql.GRID, hazards.ASSETS)}, {sql.BANDS}, {hazards.WORST}, n AS (SELECT {sql.label('i')} AS label, count(*) AS cells FROM labelled WHERE elev <= {hazards.CAP_M}e0 GROUP BY 1),
      a AS (SELECT band, coalesce(cells, 0) AS cells, round(coalesce(cells, 0) * m2 / 1e6, 2) AS area_km2 FROM bands LEFT JOIN n USING (label), area),
      x AS (SELECT band, least * 8.0e0 / power({hazards.MAGNITUDE}e0 / 6.0e0, 2.0e0) AS ratio FROM bands), y AS (SELECT band, ratio, greatest(8.0e0 * power(ratio / 8.0e0, -2.0e0 / 3.0e0) - 8.0e0, 0.0e0) AS slant FROM x),
      banded AS (SELECT * FROM worst), e AS ({hazards.COUNTS})
      SELECT 'stats' AS section, '' AS item, 'footprint_km2' AS name, CAST(round(sum(area_km2), 3) AS DOUBLE) AS value FROM a
      UNION ALL SELECT 'area_km2', band, unnest(['cells', 'area_km2']), unnest([CAST(cells AS DOUBLE), area_km2]) FROM a
      UNION ALL SELECT 'radius_km', band, 'radius_km', round(sqrt(greatest(slant * slant - {hazards.DEPTH}e0 * {hazards.DEPTH}e0, 0.0e0)), 1) FROM y
      UNION ALL SELECT 'exposure', kind, unnest(['high', 'medium_high', 'medium', 'low', 'none', 'total']), unnest([CAST(high AS DOUBLE), medium_high, medium, low, "none", total]) FROM e""",
    "suitability_request": f"""SELECT class, round(count(s.r) * (SELECT m2 FROM (WITH {sql.GRID} SELECT m2 FROM area)) / 1e6, 2) AS area_km2 FROM (VALUES ('green'), ('yellow'), ('red')) k(class) LEFT JOIN ({terrains.ORACLES['suitability']}) s USING (class) GROUP BY class""",
}
