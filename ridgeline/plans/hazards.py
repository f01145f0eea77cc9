"""Grid, earthquake and exposure queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hazard
from ..operators import exposure, quake
from ..sources import tables as T
from . import sql

#: The scenario of the single-scenario queries, and the levels of the flood queries.
LNG, LAT, MAGNITUDE, DEPTH = 85.31, 27.645, 6.5, 10.0
LEVEL_M, CAP_M, STEP = 20.0, 40.0, 0.002


def r6(c):
    return F.round(c, 6)


def dem_scan(spark: SparkSession, d: str) -> DataFrame:
    """All cells of the raster."""
    return T.dem(spark, d)


def points(spark: SparkSession, d: str) -> DataFrame:
    b, f = T.buildings(spark, d), T.facilities(spark, d)
    return b.select(F.lit("buildings").alias("kind"), "id", "lng", "lat").unionByName(f.select(F.lit("facilities").alias("kind"), "id", "lng", "lat"))


def point_to_cell(spark: SparkSession, d: str) -> DataFrame:
    return exposure.with_cell(T.buildings(spark, d), T.dem_grid(T.dem(spark, d))).select("id", "r", "c")


def cell_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Centre and bounds of every cell, its area, and the grid's size."""
    dem = T.dem(spark, d)
    g = T.dem_grid(dem)
    lng, lat = g.lng(F.col("c")), g.lat(F.col("r"))
    return dem.select("r", "c", r6(lng).alias("lng"), r6(lat).alias("lat"), r6(lng - g.res_lng / 2).alias("west"), r6(lat - g.res_lat / 2).alias("south"), r6(F.lit(g.cell_area_m2)).alias("area_m2"), F.lit(g.nrows).alias("nrows"), F.lit(g.ncols).alias("ncols"))


def region_mask(spark: SparkSession, d: str) -> DataFrame:
    return T.dem(spark, d).where(F.col("elev") <= CAP_M).select("r", "c")


def region_clip(spark: SparkSession, d: str) -> DataFrame:
    """The flooded cells at a level that lie in the region."""
    return exposure.flooded_at(T.dem(spark, d), CAP_M + 5).where(F.col("elev") <= CAP_M).select("r", "c")


def quake_intensity(spark: SparkSession, d: str) -> DataFrame:
    return quake.point_intensity(T.buildings(spark, d), LNG, LAT, MAGNITUDE, DEPTH).select("id", r6("intensity").alias("intensity"))


def quake_bands(spark: SparkSession, d: str) -> DataFrame:
    return quake.point_intensity(T.buildings(spark, d), LNG, LAT, MAGNITUDE, DEPTH).select("id", "band")


def labels(spark: SparkSession, d: str):
    dem = T.dem(spark, d)
    g = T.dem_grid(dem)
    return quake.raster(dem, g, LNG, LAT, MAGNITUDE, DEPTH), g


def quake_raster(spark: SparkSession, d: str) -> DataFrame:
    return labels(spark, d)[0].select("r", "c", r6("intensity").alias("intensity"), "label")


def quake_area(spark: SparkSession, d: str) -> DataFrame:
    return quake.area_by_band(*labels(spark, d), region_cap_m=CAP_M)


def quake_radii(spark: SparkSession, d: str) -> DataFrame:
    return quake.radii(T.scenarios(spark, d))


def quake_exposure(spark: SparkSession, d: str) -> DataFrame:
    return quake.exposure(quake.point_intensity(points(spark, d), LNG, LAT, MAGNITUDE, DEPTH))


def scenario_sweep(spark: SparkSession, d: str) -> DataFrame:
    return quake.sweep(points(spark, d), T.scenarios(spark, d))


def road_samples(spark: SparkSession, d: str) -> DataFrame:
    return exposure.densify(T.lines(T.road_vertices(spark, d)), STEP)


def densify(spark: SparkSession, d: str) -> DataFrame:
    """Number of sample points, and their mean place, per road."""
    return road_samples(spark, d).groupBy("id").agg(F.count("*").alias("n"), r6(F.avg("lng")).alias("lng"), r6(F.avg("lat")).alias("lat"))


def road_vertices(spark: SparkSession, d: str) -> DataFrame:
    v = T.road_vertices(spark, d)
    return v.select("id", "pos", r6("lng").alias("lng"), r6("lat").alias("lat"))


def wet(spark: SparkSession, d: str) -> tuple[DataFrame, object]:
    dem = T.dem(spark, d)
    return exposure.flooded_at(dem, LEVEL_M), T.dem_grid(dem)


def road_any_flood(spark: SparkSession, d: str) -> DataFrame:
    cells, g = wet(spark, d)
    return exposure.any_flooded(exposure.with_cell(road_samples(spark, d), g), cells)


def road_worst_band(spark: SparkSession, d: str) -> DataFrame:
    s = quake.point_intensity(road_samples(spark, d), LNG, LAT, MAGNITUDE, DEPTH)
    return quake.worst_band(s.select("id", hazard.band_label(F.col("intensity")).alias("label")))


def flood_absolute(spark: SparkSession, d: str) -> DataFrame:
    return wet(spark, d)[0].select("r", "c", r6("depth").alias("depth"))


def flood_depth(spark: SparkSession, d: str) -> DataFrame:
    """Depth class of each wet cell: deep from 1 m."""
    return wet(spark, d)[0].select("r", "c", F.when(F.col("depth") >= 1.0, "deep").otherwise("shallow").alias("class"))


def flood_stats(spark: SparkSession, d: str) -> DataFrame:
    dem = T.dem(spark, d)
    g = T.dem_grid(dem)
    depth = F.greatest(F.lit(0.0), F.lit(LEVEL_M) - F.col("elev"))
    on = depth > 1e-3
    s = dem.agg(F.count_if(on).alias("cells"), F.max(F.when(on, depth)).alias("deepest"), F.avg(F.when(on, depth)).alias("mean"), F.count_if(depth >= 1.0).alias("deep"), F.count("*").alias("all"))
    return s.select(
        F.col("cells").alias("cells_flooded"),
        F.round(F.col("cells") * g.cell_area_m2 / 1e6, 3).alias("area_km2"),
        F.round("deepest", 2).alias("max_depth_m"),
        F.round("mean", 2).alias("mean_depth_m"),
        F.round(F.col("deep") * g.cell_area_m2 / 1e6, 3).alias("deep_area_km2"),
        F.round(100.0 * F.col("cells") / F.col("all"), 2).alias("percent_of_cells"),
    )


def flood_exposure(spark: SparkSession, d: str) -> DataFrame:
    cells, g = wet(spark, d)
    return exposure.flood_counts(exposure.with_cell(points(spark, d), g), cells)


def asset_parts(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of buildings, some without an id, of roads, and of facilities, some of which have an osm_id only."""
    none = F.lit(None).cast("string")
    b = T.buildings(spark, d).withColumn("pos", F.col("id")).withColumn("id", F.when(F.col("id") % 10 > 0, F.col("id")))
    r = T.lines(T.road_vertices(spark, d)).withColumns({"name": none, "pos": F.col("id")})
    f = T.facilities(spark, d).withColumns({"pos": F.col("id"), "osm_id": F.when(F.col("id") % 8 > 0, F.concat(F.lit("n"), F.col("id").cast("string"))), "id": F.when(F.col("id") % 4 > 0, F.col("id"))})
    return exposure.asset_stretches(b, r, f, sample_step(T.dem_grid(T.dem(spark, d))))


def all_assets(spark: SparkSession, d: str) -> DataFrame:
    """Samples of all assets: their number grows with the roads' segments and with the raster's rows."""
    return exposure.sampled(asset_parts(spark, d)).drop("k")


def sample_step(g) -> float:
    """Two cells of the shorter side."""
    return min(g.res_lng, g.res_lat) * 2


def asset_union(spark: SparkSession, d: str) -> DataFrame:
    """Every sample of every asset."""
    return all_assets(spark, d).select("kind", "id", "name", r6("lng").alias("lng"), r6("lat").alias("lat"))


def flood_affected(spark: SparkSession, d: str) -> DataFrame:
    """Assets of all three kinds that stand in water."""
    cells, g = wet(spark, d)
    return exposure.affected(asset_parts(spark, d), cells, g)


def flood_exposed_assets(spark: SparkSession, d: str) -> DataFrame:
    """Flooded and total of all three kinds."""
    assets = asset_parts(spark, d)
    cells, g = wet(spark, d)
    return exposure.affected_counts(assets, exposure.affected(assets, cells, g))


def quake_exposed(spark: SparkSession, d: str) -> DataFrame:
    """Assets of all three kinds in any band."""
    return quake.exposed(asset_parts(spark, d), LNG, LAT, MAGNITUDE, DEPTH).where("band IS NOT NULL")


def quake_exposed_assets(spark: SparkSession, d: str) -> DataFrame:
    """Counts by band of all three kinds."""
    return quake.exposure(quake.exposed(asset_parts(spark, d), LNG, LAT, MAGNITUDE, DEPTH))


def scenario_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Bands of all scenarios: of each third its own planned assets (none for scenario 0), of the others all three kinds."""
    s = T.scenarios(spark, d)
    own, shared = s.where("scenario % 3 = 0"), s.where("scenario % 3 > 0")
    stamps = exposure.stamp(own.where("scenario > 0").withColumnRenamed("scenario", "id"), 2)
    planned = stamps.select(F.col("id").alias("scenario"), F.when(F.col("i") == 0, "shelter").otherwise("clinic").alias("kind"), F.concat_ws("-", "i", "j").alias("id"), "lng", "lat")
    assets = asset_parts(spark, d)
    points, lines = assets.where("kind <> 'roads'"), assets.where("kind = 'roads'")
    return quake.sweep(points, shared).union(quake.sweep(lines, shared, lines=True)).union(quake.planned_sweep(planned, own))


def plan(spark: SparkSession, d: str) -> DataFrame:
    """Planned assets: one stamp of four at each scenario's place."""
    s = exposure.stamp(T.scenarios(spark, d).withColumnRenamed("scenario", "id"), 2)
    return s.select(F.concat_ws("-", F.lit("plan"), "id", "i", "j").alias("id"), F.lit("planned").alias("kind"), "lng", "lat")


def plan_stamp(spark: SparkSession, d: str) -> DataFrame:
    s = exposure.stamp(T.scenarios(spark, d).withColumnRenamed("scenario", "id"), 3)
    return s.select("id", "i", "j", r6("lng").alias("lng"), r6("lat").alias("lat"))


def planned_assets(spark: SparkSession, d: str) -> DataFrame:
    """Exposure of a scenario whose own assets replace all others."""
    return quake.exposure(quake.point_intensity(plan(spark, d), LNG, LAT, MAGNITUDE, DEPTH))


def planned_verdicts(spark: SparkSession, d: str) -> DataFrame:
    p = quake.point_intensity(plan(spark, d), LNG, LAT, MAGNITUDE, DEPTH)
    return p.select("id", exposure.verdict(F.col("band"), flood=False).alias("verdict"))


def band_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Band of each building from a list with repeated ids, whose last entry counts."""
    b = quake.point_intensity(T.buildings(spark, d), LNG, LAT, MAGNITUDE, DEPTH)
    entries = b.where("id % 2 = 0").select("id", F.lit(1).alias("pos"), "band").unionByName(b.where("id % 4 = 0").select("id", F.lit(2).alias("pos"), F.lit("low").alias("band")))
    return exposure.band_of(b.select("id"), entries)


def exposed_facilities(spark: SparkSession, d: str) -> DataFrame:
    """Facilities in any band, joined by the text of their id."""
    f = T.facilities(spark, d)
    hit = quake.point_intensity(f, LNG, LAT, MAGNITUDE, DEPTH).where("band IN ('high', 'medium_high')").select(F.col("id").cast("string").alias("key"), "band")
    return f.withColumn("key", F.col("id").cast("string")).join(hit, "key").select("id", "name", "type", "band")


def scenario_validate(spark: SparkSession, d: str) -> DataFrame:
    s = T.scenarios(spark, d).selectExpr(
        "scenario", "IF(scenario % 3 = 0, lng, NULL) AS source_lng", "IF(scenario % 4 = 1, 'w-1', NULL) AS river_id", "IF(scenario % 5 = 2, '[]', NULL) AS river_path",
        "scenario * 1e2 - 1e2 AS level_m", "element_at(array('rise', 'absolute', 'other'), scenario % 3 + 1) AS mode")
    return exposure.validate(s)


QUERIES = {f.__name__: f for f in (
    dem_scan, point_to_cell, cell_geometry, region_mask, region_clip, quake_intensity, quake_bands, quake_raster, quake_area, quake_radii, quake_exposure, scenario_sweep,
    densify, road_vertices, road_any_flood, road_worst_band, flood_absolute, flood_depth, flood_stats, flood_exposure, asset_union, flood_affected, flood_exposed_assets, quake_exposed, quake_exposed_assets, scenario_exposure, planned_assets, plan_stamp,
    planned_verdicts, band_by_id, exposed_facilities, scenario_validate)}

I_POINT = sql.intensity(sql.km("lng", "lat", f"{LNG}e0", f"{LAT}e0", "lat"), f"{DEPTH}e0", f"{MAGNITUDE}e0")
I_CELL = sql.intensity(sql.km("x", "y", f"{LNG}e0", f"{LAT}e0", f"(y + {LAT}e0) / 2.0e0"), f"{DEPTH}e0", f"{MAGNITUDE}e0")
CELLS = f"{sql.GRID}, cells AS (SELECT r, c, elev, g.min_lng + (c + 0.5e0) * g.res_lng AS x, g.max_lat - (r + 0.5e0) * g.res_lat AS y FROM dem, g), labelled AS (SELECT r, c, elev, {I_CELL} AS i FROM cells)"
POINTS = f"{sql.BUILDINGS}, {sql.FACILITIES}, points AS (SELECT 'buildings' AS kind, id, lng, lat FROM buildings UNION ALL SELECT 'facilities', id, lng, lat FROM facilities)"
SAMPLES = f"""{sql.ROADS}, {sql.SEGMENTS}, parts AS (SELECT *, greatest(1, CAST(floor(greatest(abs(dx), abs(dy)) / {STEP}e0) AS INT)) AS n FROM segments WHERE dx IS NOT NULL),
samples AS (SELECT id, seg, k, x + dx * k / n AS lng, y + dy * k / n AS lat FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM parts))"""
BANDED = f"SELECT kind, {sql.band('i')} AS band FROM (SELECT kind, {I_POINT} AS i FROM points)"
COUNTS = """SELECT kind, CAST(count(*) FILTER (band = 'high') AS BIGINT) AS high, count(*) FILTER (band = 'medium_high') AS medium_high, count(*) FILTER (band = 'medium') AS medium,
  count(*) FILTER (band = 'low') AS low, count(*) FILTER (band IS NULL) AS "none", count(*) AS total FROM banded GROUP BY kind"""
STAMP = "SELECT s.scenario AS id, i.i, j.j, s.lng + (i.i - {off}) * 60.0e0 / (cos(radians(s.lat)) * 111320.0e0) AS lng, s.lat + (j.j - {off}) * 60.0e0 / 111320.0e0 AS lat FROM scenarios s, range(0, {n}) i(i), range(0, {n}) j(j)"
PLAN = f"{sql.SCENARIOS}, points AS (SELECT 'plan-' || id || '-' || i || '-' || j AS id, 'planned' AS kind, lng, lat FROM ({STAMP.format(n=2, off='0.5e0')}))"
ASSETS = f"""{sql.GRID}, {sql.BUILDINGS}, {sql.FACILITIES}, {sql.ROADS}, {sql.SEGMENTS}, many AS (SELECT id FROM roads GROUP BY id HAVING count(*) = 1),
parts AS (SELECT *, greatest(1, CAST(floor(greatest(abs(dx), abs(dy)) / (least(res_lng, res_lat) * 2)) AS INT)) AS n FROM segments, g WHERE dx IS NOT NULL),
assets AS (SELECT 'buildings' AS kind, CASE WHEN id % 10 > 0 THEN CAST(id AS VARCHAR) ELSE 'buildings:' || id END AS id, name, lng, lat FROM buildings
  UNION ALL SELECT 'roads', CAST(id AS VARCHAR), NULL, x + dx * k / n, y + dy * k / n FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM parts)
  UNION ALL SELECT 'roads', CAST(id AS VARCHAR), NULL, lng, lat FROM roads SEMI JOIN many USING (id)
  UNION ALL SELECT 'facilities', CASE WHEN id % 4 > 0 THEN CAST(id AS VARCHAR) WHEN id % 8 > 0 THEN 'n' || id ELSE 'facilities:' || id END, name, lng, lat FROM facilities)"""
WORST = f"scored AS (SELECT kind, id, any_value(name) AS name, max({I_POINT}) AS i FROM assets GROUP BY kind, id), worst AS (SELECT kind, id, name, {sql.band('i')} AS band FROM scored)"
WET = f"wet AS (SELECT r, c, elev, {LEVEL_M}e0 - elev AS depth FROM dem WHERE {LEVEL_M}e0 - elev > 1e-3)"
ORACLES = {
    "dem_scan": f"WITH {sql.DEM} SELECT * FROM dem",
    "point_to_cell": f"WITH {sql.GRID}, {sql.BUILDINGS} SELECT id, {sql.row_of('lat')} AS r, {sql.col_of('lng')} AS c FROM buildings, g",
    "cell_geometry": f"WITH {CELLS} SELECT r, c, round(x, 6) AS lng, round(y, 6) AS lat, round(x - res_lng / 2, 6) AS west, round(y - res_lat / 2, 6) AS south, round(m2, 6) AS area_m2, nrows, ncols FROM cells, g, area",
    "region_mask": f"WITH {sql.DEM} SELECT r, c FROM dem WHERE elev <= {CAP_M}e0",
    "region_clip": f"WITH {sql.DEM} SELECT r, c FROM dem WHERE {CAP_M + 5}e0 - elev > 1e-3 AND elev <= {CAP_M}e0",
    "quake_intensity": f"WITH {sql.BUILDINGS} SELECT id, round({I_POINT}, 6) AS intensity FROM buildings",
    "quake_bands": f"WITH {sql.BUILDINGS} SELECT id, {sql.band('i')} AS band FROM (SELECT id, {I_POINT} AS i FROM buildings)",
    "quake_raster": f"WITH {CELLS} SELECT r, c, round(i, 6) AS intensity, {sql.label('i')} AS label FROM labelled",
    "quake_area": f"WITH {CELLS}, {sql.BANDS}, n AS (SELECT {sql.label('i')} AS label, count(*) AS cells FROM labelled WHERE elev <= {CAP_M}e0 GROUP BY 1) SELECT band, coalesce(cells, 0) AS cells, round(coalesce(cells, 0) * m2 / 1e6, 2) AS area_km2 FROM bands LEFT JOIN n USING (label), area",
    "quake_radii": f"""WITH {sql.SCENARIOS}, {sql.BANDS}, x AS (SELECT scenario, band, depth_km, least * 8.0e0 / greatest(power(greatest(magnitude, 0.0e0) / 6.0e0, 2.0e0), 1e-9) AS ratio FROM scenarios, bands),
      y AS (SELECT *, greatest(8.0e0 * power(ratio / 8.0e0, -2.0e0 / 3.0e0) - 8.0e0, 0.0e0) AS slant FROM x)
      SELECT scenario, band, CASE WHEN ratio >= 8.0 THEN 0.0e0 ELSE round(sqrt(greatest(slant * slant - depth_km * depth_km, 0.0e0)), 1) END AS radius_km FROM y""",
    "quake_exposure": f"WITH {POINTS}, banded AS ({BANDED}) {COUNTS}",
    "scenario_sweep": f"""WITH {POINTS}, {sql.SCENARIOS}, x AS (SELECT scenario, kind, {sql.intensity(sql.km('p.lng', 'p.lat', 's.lng', 's.lat', 'p.lat'), 'depth_km', 'magnitude')} AS i FROM points p, scenarios s)
      SELECT scenario, kind, coalesce({sql.band('i')}, 'none') AS band, count(*) AS n FROM x GROUP BY ALL""",
    "densify": f"WITH {SAMPLES} SELECT id, count(*) AS n, round(avg(lng), 6) AS lng, round(avg(lat), 6) AS lat FROM samples GROUP BY id",
    "road_vertices": f"WITH {sql.ROADS} SELECT id, pos, round(lng, 6) AS lng, round(lat, 6) AS lat FROM roads",
    "road_any_flood": f"WITH {sql.GRID}, {WET}, {SAMPLES}, placed AS (SELECT id, {sql.row_of('lat')} AS r, {sql.col_of('lng')} AS c FROM samples, g) SELECT DISTINCT id FROM placed SEMI JOIN wet USING (r, c)",
    "road_worst_band": f"WITH {SAMPLES}, x AS (SELECT id, {I_POINT} AS i FROM samples), y AS (SELECT id, {sql.label('i')} AS label FROM x) SELECT id, coalesce(min(label) FILTER (label > 0), 0) AS label FROM y GROUP BY id",
    "flood_absolute": f"WITH {sql.DEM}, {WET} SELECT r, c, round(depth, 6) AS depth FROM wet",
    "flood_depth": f"WITH {sql.DEM}, {WET} SELECT r, c, CASE WHEN depth >= 1.0 THEN 'deep' ELSE 'shallow' END AS class FROM wet",
    "flood_stats": f"""WITH {sql.GRID}, {WET} SELECT count(*) AS cells_flooded, round(count(*) * any_value(m2) / 1e6, 3) AS area_km2, round(max(depth), 2) AS max_depth_m, round(avg(depth), 2) AS mean_depth_m,
      round(count(*) FILTER (depth >= 1.0) * any_value(m2) / 1e6, 3) AS deep_area_km2, round(100.0e0 * count(*) / (SELECT count(*) FROM dem), 2) AS percent_of_cells FROM wet, area""",
    "flood_exposure": f"WITH {sql.GRID}, {WET}, {POINTS}, placed AS (SELECT kind, {sql.row_of('lat')} AS r, {sql.col_of('lng')} AS c FROM points, g) SELECT kind, count(w.r) AS flooded, count(*) AS total FROM placed p LEFT JOIN wet w ON p.r = w.r AND p.c = w.c GROUP BY kind",
    "asset_union": f"WITH {ASSETS} SELECT kind, id, name, round(lng, 6) AS lng, round(lat, 6) AS lat FROM assets",
    "flood_affected": f"WITH {ASSETS}, {WET}, placed AS (SELECT kind, id, name, {sql.row_of('lat')} AS r, {sql.col_of('lng')} AS c FROM assets, g) SELECT DISTINCT kind, id, name FROM placed SEMI JOIN wet USING (r, c)",
    "flood_exposed_assets": f"""WITH {ASSETS}, {WET}, placed AS (SELECT kind, id, {sql.row_of('lat')} AS r, {sql.col_of('lng')} AS c FROM assets, g)
      SELECT kind, count(DISTINCT CASE WHEN w.r IS NOT NULL THEN id END) AS flooded, count(DISTINCT id) AS total FROM placed p LEFT JOIN wet w ON p.r = w.r AND p.c = w.c GROUP BY kind""",
    "quake_exposed": f"WITH {ASSETS}, {WORST} SELECT kind, id, name, band FROM worst WHERE band IS NOT NULL",
    "quake_exposed_assets": f"WITH {ASSETS}, {WORST}, banded AS (SELECT * FROM worst) {COUNTS}",
    "scenario_exposure": f"""WITH {ASSETS}, {sql.SCENARIOS}, own AS (SELECT scenario AS id, lng, lat FROM scenarios WHERE scenario % 3 = 0 AND scenario > 0),
      stamps AS ({STAMP.format(n=2, off='0.5e0').replace('s.scenario', 's.id').replace('FROM scenarios s', 'FROM own s')}),
      pairs AS (SELECT s.scenario, a.kind, a.id, a.lng, a.lat, s.lng AS s_lng, s.lat AS s_lat, depth_km, magnitude FROM assets a, scenarios s WHERE s.scenario % 3 > 0
        UNION ALL SELECT s.scenario, CASE WHEN i = 0 THEN 'shelter' ELSE 'clinic' END, i || '-' || j, a.lng, a.lat, s.lng, s.lat, depth_km, magnitude FROM stamps a JOIN scenarios s ON a.id = s.scenario),
      x AS (SELECT scenario, kind, id, max({sql.intensity(sql.km('lng', 'lat', 's_lng', 's_lat', 'lat'), 'depth_km', 'magnitude')}) AS i FROM pairs GROUP BY scenario, kind, id)
      SELECT scenario, kind, coalesce({sql.band('i')}, 'none') AS band, count(*) AS n FROM x GROUP BY ALL""",
    "planned_assets": f"WITH {PLAN}, banded AS ({BANDED}) {COUNTS}",
    "plan_stamp": f"WITH {sql.SCENARIOS} SELECT id, i, j, round(lng, 6) AS lng, round(lat, 6) AS lat FROM ({STAMP.format(n=3, off='1.0e0')})",
    "planned_verdicts": f"""WITH {PLAN}, x AS (SELECT id, {I_POINT} AS i FROM points), y AS (SELECT id, {sql.band('i')} AS band FROM x)
      SELECT id, CASE band WHEN 'high' THEN 'high exposure exposure' WHEN 'medium_high' THEN 'medium-high exposure' WHEN 'medium' THEN 'medium exposure' WHEN 'low' THEN 'low exposure' ELSE 'outside estimated hazard' END AS verdict FROM y""",
    "band_by_id": f"WITH {sql.BUILDINGS} SELECT id, CASE WHEN id % 4 = 0 THEN 'low' WHEN id % 2 = 0 THEN {sql.band('i')} END AS band FROM (SELECT id, {I_POINT} AS i FROM buildings)",
    "exposed_facilities": f"WITH {sql.FACILITIES}, x AS (SELECT id, name, type, {I_POINT} AS i FROM facilities) SELECT id, name, type, {sql.band('i')} AS band FROM x WHERE i >= 0.20",
    "scenario_validate": """SELECT n_nationkey AS scenario, (CAST(n_nationkey % 3 = 0 AS INT) + CAST(n_nationkey % 4 = 1 AS INT) + CAST(n_nationkey % 5 = 2 AS INT) = 1)
      AND n_nationkey * 1e2 - 1e2 > -20 AND n_nationkey * 1e2 - 1e2 < 5000 AND n_nationkey % 3 < 2 AS valid FROM nation""",
}
