"""Queries that check requests and join their answers with what was asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exposure, quake
from ..sources import tables as T
from . import sql
from .hazards import CELLS, DEPTH, I_POINT, LAT, LEVEL_M, LNG, MAGNITUDE, PLAN, POINTS, WET, labels, plan, points


def quake_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests some of which are out of range: magnitude above 0 to below 10, depth from 0 to below 300, degrees of the globe."""
    s = T.scenarios(spark, d).selectExpr("scenario", "lng * (1 + CAST(scenario % 4 = 3 AS INT) * 2) AS lng", "lat * (1 + CAST(scenario % 6 = 5 AS INT) * 3) AS lat", "scenario * 5e-1 AS magnitude", "IF(scenario % 7 = 6, NULL, scenario * 13e0) AS depth_km")
    return exposure.validate_quake(s)


def planned_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Every planned asset with its verdict; those that the answer does not name are safe."""
    asked = plan(spark, d)
    answer = quake.point_intensity(asked, LNG, LAT, MAGNITUDE, DEPTH).where("band IS NOT NULL").select("id", "band")
    return exposure.planned_verdicts(asked.select("id"), answer)


def client_filters(spark: SparkSession, d: str) -> DataFrame:
    """What a map shows of the buildings: in a band, and with an id that is a number not below 0."""
    b = quake.point_intensity(T.buildings(spark, d), LNG, LAT, MAGNITUDE, DEPTH).withColumn("ref", F.when(F.col("id") % 5 == 0, F.concat(F.lit("w-"), F.col("id").cast("string"))).otherwise((F.col("id") - 10).cast("string")))
    return exposure.shown(b, "ref").select("id", "band")


def flood_shoreline(spark: SparkSession, d: str) -> DataFrame:
    """Wet cells with a dry neighbour among the four around: the class of features that is drawn as the flood's border."""
    dem = T.dem(spark, d)
    return exposure.shoreline(exposure.flooded_at(dem, LEVEL_M), dem)


def unbanded_ids(spark: SparkSession, d: str) -> DataFrame:
    """Buildings of the last answer (a magnitude more) that are in none of this one: their colours are taken back."""
    b = T.buildings(spark, d)
    before, now = (quake.point_intensity(b, LNG, LAT, m, DEPTH).where("band IN ('high', 'medium_high')").select("id") for m in (MAGNITUDE + 1.0, MAGNITUDE))
    return before.join(now, "id", "left_anti")


def flood_surface(spark: SparkSession, d: str) -> DataFrame:
    """Highest water surface, and the size of a cell in metres."""
    dem = T.dem(spark, d)
    wet = exposure.flooded_at(dem, LEVEL_M)
    return wet.agg(F.round(F.max(F.col("elev") + F.col("depth")), 3).alias("water_surface_m")).withColumn("cell_resolution_m", F.round(F.lit(T.dem_grid(dem).res_lat * 111.32 * 1000), 3))


def quake_totals(spark: SparkSession, d: str) -> DataFrame:
    """The headline: square kilometres in any band, and points at risk."""
    area = quake.area_by_band(*labels(spark, d)).agg(F.round(F.sum("area_km2"), 3).alias("footprint_km2"))
    risk = quake.point_intensity(points(spark, d), LNG, LAT, MAGNITUDE, DEPTH).agg(F.count_if(F.col("band").isNotNull()).alias("at_risk"))
    return area.crossJoin(risk)  # one row each


QUERIES = {f.__name__: f for f in (quake_requests, planned_exposure, client_filters, flood_shoreline, unbanded_ids, flood_surface, quake_totals)}

WITH_BAND = lambda rows: f"x AS (SELECT *, {I_POINT} AS i FROM {rows}), y AS (SELECT *, {sql.band('i')} AS band FROM x)"
I_MORE = I_POINT.replace(f"{MAGNITUDE}e0", f"{MAGNITUDE + 1.0}e0")
ORACLES = {
    "quake_requests": f"""WITH {sql.SCENARIOS}, q AS (SELECT scenario, lng * CASE WHEN scenario % 4 = 3 THEN 3 ELSE 1 END AS lng, lat * CASE WHEN scenario % 6 = 5 THEN 4 ELSE 1 END AS lat, scenario * 5e-1 AS m, CASE WHEN scenario % 7 < 6 THEN scenario * 13e0 END AS h FROM scenarios)
      SELECT scenario, coalesce(m > 0 AND m < 10 AND h >= 0 AND h < 300 AND lng BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90, false) AS valid FROM q""",
    "planned_exposure": f"""WITH {PLAN}, {WITH_BAND('points')}
      SELECT id, CASE band WHEN 'high' THEN 'high exposure exposure' WHEN 'medium_high' THEN 'medium-high exposure' WHEN 'medium' THEN 'medium exposure' WHEN 'low' THEN 'low exposure' ELSE 'outside estimated hazard' END AS verdict FROM y""",
    "client_filters": f"WITH {sql.BUILDINGS}, {WITH_BAND('buildings')} SELECT id, band FROM y WHERE band IS NOT NULL AND id % 5 > 0 AND id >= 10",
    "flood_shoreline": f"WITH {sql.DEM}, {WET} SELECT DISTINCT w.r, w.c FROM wet w JOIN dem d ON abs(d.r - w.r) + abs(d.c - w.c) = 1 AND NOT {LEVEL_M}e0 - d.elev > 1e-3",
    "unbanded_ids": f"WITH {sql.BUILDINGS} SELECT id FROM (SELECT id, {I_POINT} AS i, {I_MORE} AS j FROM buildings) WHERE j >= 0.20 AND i < 0.20",
    "flood_surface": f"WITH {sql.GRID}, {WET} SELECT round(max(elev + depth), 3) AS water_surface_m, round(any_value(res_lat) * 111.32e0 * 1000.0e0, 3) AS cell_resolution_m FROM wet, g",
    "quake_totals": f"""WITH {CELLS}, {POINTS}, {sql.BANDS}, n AS (SELECT {sql.label('i')} AS label, count(*) AS cells FROM labelled GROUP BY 1), a AS (SELECT round(coalesce(cells, 0) * m2 / 1e6, 2) AS km2 FROM bands LEFT JOIN n USING (label), area)
      SELECT (SELECT round(sum(km2), 3) FROM a) AS footprint_km2, (SELECT count(*) FROM (SELECT {I_POINT} AS i FROM points) WHERE i >= 0.04) AS at_risk""",
}
