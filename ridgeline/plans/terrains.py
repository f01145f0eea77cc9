"""Flow, flood and suitability queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hazard
from ..operators import blocks, exposure, terrain
from ..operators.durable import written
from ..operators.quantiles import quantiles
from ..sources import tables as T
from . import sql

LEVEL_M, RISE_M = 20.0, 2.0
PERCENTS = (5, 50, 90, 95)


def raster(spark: SparkSession, d: str):
    dem = T.dem(spark, d)
    return dem, T.dem_grid(dem)


def flows(dem: DataFrame) -> DataFrame:
    """The flow of every cell, written once and read by all that follow it."""
    return written(terrain.d8_flow(dem), "flow")


def river_lines(spark: SparkSession, d: str, main: bool) -> DataFrame:
    ways = T.waterways(spark, d)
    return T.lines(ways.where("main") if main else ways)


def river(spark: SparkSession, d: str, grid, main: bool) -> DataFrame:
    return terrain.line_cells(river_lines(spark, d, main), grid)


def d8_flow(spark: SparkSession, d: str) -> DataFrame:
    return terrain.d8_flow(T.dem(spark, d)).select("r", "c", "code")


def flow_accumulation(spark: SparkSession, d: str) -> DataFrame:
    dem, g = raster(spark, d)
    return terrain.accumulation(dem, flows(dem), g)


def caught(spark: SparkSession, d: str):
    dem, g = raster(spark, d)
    flow = flows(dem)
    main = written(river(spark, d, g, True), "main")
    return dem, g, flow, main, terrain.catchment(dem, flow, main, g)


def catchment(spark: SparkSession, d: str) -> DataFrame:
    return caught(spark, d)[4]


def tributaries(spark: SparkSession, d: str) -> DataFrame:
    """Water cells that flow into the main rivers and are not theirs."""
    _, g, _, main, c = caught(spark, d)
    return c.join(river(spark, d, g, False), ["r", "c"], "left_semi").join(main, ["r", "c"], "left_anti").select("r", "c", "dist")


def river_seeds(spark: SparkSession, d: str) -> DataFrame:
    return terrain.polyline_cells(river_lines(spark, d, True), raster(spark, d)[1])


def water_seeds(spark: SparkSession, d: str) -> DataFrame:
    return river(spark, d, raster(spark, d)[1], False)


def wet(spark: SparkSession, d: str, level: float = LEVEL_M) -> DataFrame:
    return exposure.flooded_at(T.dem(spark, d), level)


def dilate8(spark: SparkSession, d: str) -> DataFrame:
    return terrain.dilate8(wet(spark, d, 3.0), raster(spark, d)[1])


def flux_domain(spark: SparkSession, d: str) -> DataFrame:
    dem, g = raster(spark, d)
    return terrain.flux_box(wet(spark, d, 1.5), terrain.d8_flow(dem), g)


def inflow_plan(spark: SparkSession, d: str) -> DataFrame:
    dem, g, flow, main, c = caught(spark, d)
    p = terrain.inflow_plan(terrain.accumulation(dem, flow, g), c, main, river(spark, d, g, False), g, RISE_M)
    return p.select("r", "c", "tributary", F.round("d_cell", 6).alias("d_cell"), "start", "n_steps", "window", F.round("volume_m3", 2).alias("volume_m3"))


def hydrograph(spark: SparkSession, d: str) -> DataFrame:
    """Share of the water that each step releases, for each scenario's window."""
    s = T.scenarios(spark, d).selectExpr("scenario", "CAST(scenario * 2 AS INT) AS start", "CAST(5 + scenario AS INT) AS window")
    s = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("t"))
    return s.select("scenario", "t", F.round(hazard.release(F.col("t"), F.col("start"), F.col("window")), 6).alias("share"))


def flux_step(spark: SparkSession, d: str) -> DataFrame:
    cells = T.dem(spark, d).withColumn("depth", F.greatest(F.lit(0.0), F.lit(LEVEL_M) - F.col("elev")))
    return terrain.flux_step(cells).select("r", "c", F.round("depth", 6).alias("depth"))


def flood_timing(spark: SparkSession, d: str) -> DataFrame:
    """Hours and peak discharge of each scenario's plan of so many steps and volume."""
    g = raster(spark, d)[1]
    dt = g.res_lat * 111.32 * 1000 / (0.8 * terrain.STEPS)
    s = T.scenarios(spark, d).selectExpr("scenario", "CAST(120 + scenario * 10 AS INT) AS n_steps", "1e4 * (scenario + 1) AS volume")
    window = F.greatest(F.lit(5), F.floor(F.col("n_steps") / 3))
    return s.select("scenario", F.round(F.col("n_steps") * dt / 3600.0, 2).alias("sim_hours"), F.round(F.col("volume") * (3.0 / window) * 0.5 / dt, 1).alias("peak_discharge_m3s"))


def dem_percentiles(spark: SparkSession, d: str) -> DataFrame:
    found = quantiles(T.dem(spark, d), "elev", [q / 100 for q in PERCENTS])
    return spark.createDataFrame([found], ", ".join(f"p{q} double" for q in PERCENTS)).select(*(F.round(f"p{q}", 6).alias(f"p{q}") for q in PERCENTS))


def slope(spark: SparkSession, d: str) -> DataFrame:
    return terrain.gradient(*raster(spark, d)).select("r", "c", F.round("grad", 6).alias("grad"))


def near(spark: SparkSession, d: str, g) -> DataFrame:
    return terrain.near_roads(exposure.with_cell(T.road_vertices(spark, d), g), g)


def road_near(spark: SparkSession, d: str) -> DataFrame:
    return near(spark, d, raster(spark, d)[1])


def suitability(spark: SparkSession, d: str) -> DataFrame:
    dem, g = raster(spark, d)
    s = terrain.suitability(dem, near(spark, d, g), g)
    return s.select("r", "c", F.round("score", 6).alias("score"), hazard.suitability_class(F.col("score")).alias("class"))


def d8_flow_blocks(spark: SparkSession, d: str) -> DataFrame:
    """d8_flow from blocks of cells."""
    return blocks.d8_flow(T.dem(spark, d))


def slope_blocks(spark: SparkSession, d: str) -> DataFrame:
    """slope from blocks of cells."""
    return blocks.gradient(*raster(spark, d)).select("r", "c", F.round("grad", 6).alias("grad"))


def dilate8_blocks(spark: SparkSession, d: str) -> DataFrame:
    """dilate8 from blocks of cells."""
    return blocks.dilate8(T.dem(spark, d), wet(spark, d, 3.0))


QUERIES = {f.__name__: f for f in (
    d8_flow_blocks, slope_blocks, dilate8_blocks, d8_flow, flow_accumulation, catchment, tributaries, river_seeds, water_seeds, dilate8, flux_domain, inflow_plan, hydrograph, flux_step, flood_timing, dem_percentiles, slope, road_near, suitability)}

NEAR8 = "near8 AS (SELECT * FROM (VALUES (0, -1, -1), (1, -1, 0), (2, -1, 1), (3, 0, -1), (4, 0, 1), (5, 1, -1), (6, 1, 0), (7, 1, 1)) t(code, dr, dc))"
FLOW = f"""{NEAR8}, flow AS (
  SELECT r, c, code, nr, nc FROM (
    SELECT a.r, a.c, n.code, b.r AS nr, b.c AS nc, row_number() OVER (PARTITION BY a.r, a.c ORDER BY a.elev - b.elev DESC, n.code) AS k
    FROM dem a, near8 n, dem b WHERE b.r = a.r + n.dr AND b.c = a.c + n.dc AND a.elev > b.elev) WHERE k = 1
)"""
ACC = """up AS (SELECT r AS sr, c AS sc, r, c FROM dem UNION ALL SELECT up.sr, up.sc, f.nr, f.nc FROM up JOIN flow f ON up.r = f.r AND up.c = f.c),
acc AS (SELECT r, c, count(*) AS acc FROM up GROUP BY r, c)"""
LINES = f"""{sql.ROADS}, wet_v AS (SELECT id, pos, {sql.row_of('lat')} AS r, {sql.col_of('lng')} AS c FROM roads, g WHERE id % 97 = 0),
pairs AS (SELECT * FROM (SELECT id, pos, r, c, lead(r) OVER w AS r1, lead(c) OVER w AS c1 FROM wet_v WINDOW w AS (PARTITION BY id ORDER BY pos)) WHERE r1 IS NOT NULL),
walk AS (
  SELECT id, pos, r, c, r1, c1, abs(r1 - r) AS n, abs(c1 - c) AS m, CASE WHEN r1 >= r THEN 1 ELSE -1 END AS sr, CASE WHEN c1 >= c THEN 1 ELSE -1 END AS sc, abs(r1 - r) - abs(c1 - c) AS e FROM pairs
  UNION ALL
  SELECT id, pos, CASE WHEN 2 * e > -m AND (r + sr - r1) * sr <= 0 THEN r + sr ELSE r END, CASE WHEN 2 * e < n AND (c + sc - c1) * sc <= 0 THEN c + sc ELSE c END,
    r1, c1, n, m, sr, sc, e - CASE WHEN 2 * e > -m THEN m ELSE 0 END + CASE WHEN 2 * e < n THEN m ELSE 0 END FROM walk WHERE NOT (r = r1 AND c = c1)
), river AS (SELECT DISTINCT id, r, c FROM walk), main AS (SELECT DISTINCT r, c FROM river WHERE id % 194 = 0), water AS (SELECT DISTINCT r, c FROM river)"""
CATCH = """caught AS (
  SELECT r, c, 0 AS dist FROM main
  UNION ALL
  SELECT f.r, f.c, k.dist + 1 FROM caught k JOIN flow f ON f.nr = k.r AND f.nc = k.c WHERE NOT EXISTS (SELECT 1 FROM main m WHERE m.r = f.r AND m.c = f.c)
)"""
TRIB = "trib AS (SELECT k.r, k.c, k.dist FROM caught k SEMI JOIN water w ON k.r = w.r AND k.c = w.c WHERE k.dist > 0)"
GRAD = """grad AS (SELECT r, c, elev, sqrt(gx * gx + gy * gy) AS grad FROM (
  SELECT r, c, elev,
    (coalesce(lead(elev) OVER x, elev) - coalesce(lag(elev) OVER x, elev)) / (mx * CASE WHEN lead(elev) OVER x IS NULL OR lag(elev) OVER x IS NULL THEN 1.0e0 ELSE 2.0e0 END) AS gx,
    (coalesce(lead(elev) OVER y, elev) - coalesce(lag(elev) OVER y, elev)) / (my * CASE WHEN lead(elev) OVER y IS NULL OR lag(elev) OVER y IS NULL THEN 1.0e0 ELSE 2.0e0 END) AS gy
  FROM dem, (SELECT res_lng * (111.32e0 * greatest(cos(radians((min_lat + max_lat) / 2.0e0)), 0.1e0)) * 1000.0e0 AS mx, res_lat * 111.32e0 * 1000.0e0 AS my FROM g)
  WINDOW x AS (PARTITION BY r ORDER BY c), y AS (PARTITION BY c ORDER BY r)))"""
NEAR = f"""{sql.ROADS}, road_v AS (SELECT DISTINCT {sql.row_of('lat')} AS r, {sql.col_of('lng')} AS c FROM roads, g),
box AS (SELECT DISTINCT r + i AS r, c + j AS c FROM road_v, range(-2, 3) a(i), range(-2, 3) b(j)),
near AS (SELECT DISTINCT r + i AS r, c + j AS c FROM box, range(-2, 3) a(i), range(-2, 3) b(j), g WHERE abs(i) + abs(j) <= 2 AND r + i BETWEEN 0 AND nrows - 1 AND c + j BETWEEN 0 AND ncols - 1)"""
ORACLES = {
    "d8_flow": f"WITH {sql.DEM}, {FLOW} SELECT r, c, code FROM flow",
    "flow_accumulation": f"WITH RECURSIVE {sql.DEM}, {FLOW}, {ACC} SELECT * FROM acc",
    "catchment": f"WITH RECURSIVE {sql.GRID}, {FLOW}, {LINES}, {CATCH} SELECT * FROM caught",
    "tributaries": f"WITH RECURSIVE {sql.GRID}, {FLOW}, {LINES}, {CATCH}, {TRIB} SELECT * FROM trib",
    "river_seeds": f"WITH RECURSIVE {sql.GRID}, {LINES} SELECT * FROM river WHERE id % 194 = 0",
    "water_seeds": f"WITH RECURSIVE {sql.GRID}, {LINES} SELECT * FROM water",
    "dilate8": f"WITH {sql.GRID} SELECT DISTINCT CAST(r + i AS INT) AS r, CAST(c + j AS INT) AS c FROM dem, g, range(-1, 2) a(i), range(-1, 2) b(j) WHERE 3.0e0 - elev > 1e-3 AND r + i BETWEEN 0 AND nrows - 1 AND c + j BETWEEN 0 AND ncols - 1",
    "flux_domain": f"""WITH {sql.GRID}, {FLOW}, i AS (SELECT r, c FROM dem WHERE 1.5e0 - elev > 1e-3),
      d AS (SELECT r, c FROM i UNION ALL SELECT nr, nc FROM flow SEMI JOIN i USING (r, c) UNION ALL SELECT f.r, f.c FROM flow f SEMI JOIN i ON f.nr = i.r AND f.nc = i.c)
      SELECT greatest(0, min(r) - 12) AS r0, least(any_value(nrows) - 1, max(r) + 12) AS r1, greatest(0, min(c) - 12) AS c0, least(any_value(ncols) - 1, max(c) + 12) AS c1 FROM d, g""",
    "inflow_plan": f"""WITH RECURSIVE {sql.GRID}, {FLOW}, {ACC}, {LINES}, {CATCH}, {TRIB},
      cells AS (SELECT r, c, 0 AS dist, false AS tributary FROM main UNION ALL SELECT r, c, dist, true FROM trib),
      weighted AS (SELECT *, acc * CASE WHEN tributary THEN 0.5e0 ELSE 1.0e0 END AS weight FROM cells JOIN acc USING (r, c)),
      t AS (SELECT sum(weight) AS total, count(*) FILTER (NOT tributary) AS a, count(*) FILTER (tributary) AS b FROM weighted),
      p AS (SELECT total, CAST(greatest(120, least(700, a * 3)) AS INT) AS n_steps, {RISE_M}e0 * m2 * 2 * (a + b * 0.5e0) AS volume_m3, m2 FROM t, area),
      q AS (SELECT *, greatest(5, n_steps // 3) AS wdw FROM p)
      SELECT r, c, tributary, round(weight / total * volume_m3 / m2, 6) AS d_cell, CAST(greatest(0, least(n_steps - wdw, dist * 3)) AS INT) AS start, n_steps, wdw AS "window", round(volume_m3, 2) AS volume_m3 FROM weighted, q""",
    "hydrograph": """SELECT scenario, t, round(CASE WHEN t >= s AND t < s + w THEN 3.0e0 / w * (2.0e0 * ((t - s) / w) - 2.0e0 * ((t - s) / w) * ((t - s) / w)) ELSE 0.0e0 END, 6) AS share
      FROM (SELECT n_nationkey AS scenario, n_nationkey * 2 AS s, CAST(5 + n_nationkey AS DOUBLE) AS w, CAST(unnest(range(0, 100)) AS INT) AS t FROM nation)""",
    "flux_step": f"""WITH {sql.DEM}, {NEAR8}, a AS (SELECT r, c, elev, greatest(0.0e0, {LEVEL_M}e0 - elev) AS depth FROM dem),
      f AS (SELECT a.r, a.c, b.r AS nr, b.c AS nc, a.depth, least(0.22e0 * (a.elev + a.depth - (b.elev + b.depth)), a.depth / 8.0e0) AS flux FROM a, near8 n, a b WHERE b.r = a.r + n.dr AND b.c = a.c + n.dc AND a.depth > 0 AND a.elev + a.depth > b.elev + b.depth),
      t AS (SELECT r, c, sum(flux) AS total, least(1.0e0, max(depth) / greatest(sum(flux), 1e-6)) AS scale FROM f GROUP BY r, c),
      gain AS (SELECT nr AS r, nc AS c, sum(flux * scale) AS gain FROM f JOIN t USING (r, c) GROUP BY nr, nc)
      SELECT a.r, a.c, round(depth - coalesce(total * scale, 0) + coalesce(gain, 0), 6) AS depth FROM a LEFT JOIN t USING (r, c) LEFT JOIN gain USING (r, c)""",
    "flood_timing": f"""WITH {sql.GRID}, s AS (SELECT n_nationkey AS scenario, 120 + n_nationkey * 10 AS n, 1e4 * (n_nationkey + 1) AS volume, res_lat * 111.32e0 * 1000 / (0.8e0 * 3) AS dt FROM nation, g)
      SELECT scenario, round(n * dt / 3600.0e0, 2) AS sim_hours, round(volume * (3.0e0 / greatest(5, n // 3)) * 0.5e0 / dt, 1) AS peak_discharge_m3s FROM s""",
    "dem_percentiles": f"WITH {sql.DEM} SELECT round(quantile_cont(elev, 0.05), 6) AS p5, round(quantile_cont(elev, 0.5), 6) AS p50, round(quantile_cont(elev, 0.9), 6) AS p90, round(quantile_cont(elev, 0.95), 6) AS p95 FROM dem",
    "slope": f"WITH {sql.GRID}, {GRAD} SELECT r, c, round(grad, 6) AS grad FROM grad",
    "road_near": f"WITH {sql.GRID}, {NEAR} SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM near",
    "suitability": f"""WITH {sql.GRID}, {GRAD}, {NEAR}, p AS (SELECT quantile_cont(elev, 0.05) AS e5, quantile_cont(elev, 0.95) AS e95, quantile_cont(least(grad, 60.0e0), 0.9) AS g90 FROM grad),
      s AS (SELECT x.r, x.c, greatest(0.0e0, least(1.0e0, 0.52e0 * greatest(0.0e0, least(1.0e0, (elev - e5) / greatest(e95 - e5, 1.0e0))) + 0.38e0 * (1.0e0 - greatest(0.0e0, least(1.0e0, grad / greatest(g90, 1.0e0)))) + CASE WHEN n.r IS NULL THEN 0.0e0 ELSE 0.10e0 END)) AS score
        FROM grad x LEFT JOIN near n ON n.r = x.r AND n.c = x.c, p)
      SELECT r, c, round(score, 6) AS score, CASE WHEN score >= 0.60 THEN 'green' WHEN score <= 0.42 THEN 'red' ELSE 'yellow' END AS class FROM s""",
}
ORACLES |= {f"{name}_blocks": ORACLES[name] for name in ("d8_flow", "slope", "dilate8")}
