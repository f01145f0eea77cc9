"""Tile queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import buildings as B
from ..functions import tiles as M
from ..operators import tiles as O
from ..operators.durable import written
from ..sources import tables as T
from . import sql
from .buildings import MY, footprint
from .terrains import raster

ZOOMS, REPROJECT_ZOOM = (13, 14), 11
R9 = lambda c: F.round(c, 9)


def bilinear_sample(spark: SparkSession, d: str) -> DataFrame:
    """Elevation at each building, some of which lie beyond the centres of the border cells."""
    dem, g = raster(spark, d)
    return O.sample(T.buildings(spark, d).select("id", "lng", "lat"), dem, g).select("id", F.round("elev", 6).alias("elev"))


def zoomed(spark: SparkSession, d: str) -> DataFrame:
    """One tile a scenario and zoom from 5 to 16."""
    s = T.scenarios(spark, d).withColumn("z", F.explode(F.sequence(F.lit(5), F.lit(16))))
    return s.select("scenario", "z", M.tile_x(F.col("lng") + (F.col("scenario") % 3 - 1) * 0.3, F.col("z")).alias("x"), M.tile_y(F.col("lat"), F.col("z")).alias("y"))


def tile_bounds(spark: SparkSession, d: str) -> DataFrame:
    return zoomed(spark, d).select("scenario", "z", *map(R9, O.bounds(F.col("z"), F.col("x"), F.col("y")))).toDF("scenario", "z", "west", "south", "east", "north")


def tile_coverage(spark: SparkSession, d: str) -> DataFrame:
    return O.covered(zoomed(spark, d), raster(spark, d)[1])


def tile_cover(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of zooms 12 to 14 over a box of 0.05 degrees at each scenario."""
    s = T.scenarios(spark, d).select("scenario", F.col("lng").alias("west"), F.col("lat").alias("south"), (F.col("lng") + 5e-2).alias("east"), (F.col("lat") + 5e-2).alias("north"))
    return O.cover(s, F.explode(F.array(F.lit(12), F.lit(13), F.lit(14)))).select("scenario", "z", "x", "y")


def footprint_rings(spark: SparkSession, d: str) -> DataFrame:
    """Every third footprint has a yard, a hole of half its size, which runs as the outer ring does until it is turned."""
    f = T.buildings(spark, d).select("id", "lng", "lat", F.when(F.col("id") % 4 > 0, F.col("type")).otherwise("").alias("name"))
    # A file of buildings may be one task's, and rings are all reckoned where they are read: dealt out in a number that adaptive execution leaves as it is.
    f = f.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").withColumn("ring", footprint())
    hole = B.square(F.col("lng"), F.col("lat"), (10.0 + F.col("id") % 13) / 2.0, F.when(F.col("id") % 2 == 0, 0.0).otherwise(45.0))
    f = f.withColumn("rings", F.when(F.col("id") % 3 == 0, F.array("ring", hole)).otherwise(F.array("ring")))
    f = f.select("id", "rings", "name", M.mercator_x(F.col("lng")).alias("cx"), M.mercator_y(F.col("lat")).alias("cy"), (3.0 + F.col("id") % 5).alias("height"), B.tint(F.col("id").cast("string")).alias("color"))
    return O.tile_rings(f, ZOOMS)


def ring_area(spark: SparkSession, d: str) -> DataFrame:
    """Twice the area of each footprint in tile units; collapsed ones are absent."""
    return footprint_rings(spark, d).select("z", "x", "y", "id", "area2")


def ring_moves(spark: SparkSession, d: str) -> DataFrame:
    return footprint_rings(spark, d).select("z", "id", F.posexplode("moves").alias("ring", "moves")).select("z", "id", "ring", F.posexplode("moves").alias("pos", "m")).select("z", "id", "ring", "pos", "m.dx", "m.dy")


def tile_values(spark: SparkSession, d: str) -> DataFrame:
    """Distinct heights and names of each tile."""
    return footprint_rings(spark, d).groupBy("z", "x", "y").agg(F.countDistinct("height").alias("heights"), F.countDistinct(F.when(F.col("name") != "", F.col("name"))).alias("names"))


def building_tile_mvt(spark: SparkSession, d: str) -> DataFrame:
    return O.vector_tiles(footprint_rings(spark, d))


def terrain_tile_png(spark: SparkSession, d: str) -> DataFrame:
    """The tiles of zoom 11 over the grid's extent."""
    dem, g = raster(spark, d)
    box = spark.createDataFrame([(g.min_lng, g.min_lat, g.max_lng, g.max_lat)], "west double, south double, east double, north double")
    return O.terrain_tiles(O.cover(box, F.lit(REPROJECT_ZOOM)).select("z", "x", "y"), dem, g)


def dem_reproject(spark: SparkSession, d: str) -> DataFrame:
    """The grid again from its own terrain tiles: centres of cells, bilinear between Mercator pixels."""
    dem, g = raster(spark, d)
    pixels = O.mosaic(written(terrain_tile_png(spark, d), "tiles"))
    cells = dem.select("r", "c", g.lng(F.col("c")).alias("lng"), g.lat(F.col("r")).alias("lat"))
    return O.reproject(pixels, cells, REPROJECT_ZOOM).select("r", "c", F.round("elev", 3).alias("elev"))


QUERIES = {f.__name__: f for f in (bilinear_sample, tile_bounds, tile_coverage, tile_cover, ring_area, ring_moves, tile_values, building_tile_mvt, terrain_tile_png, dem_reproject)}

CORNERS = "(VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(i, j)"


def bilinear(points: str) -> str:
    """CTEs f, s: elevation by point (key, lng, lat) between the four cells around."""
    return f"""f AS (SELECT p.*, (g.max_lat - lat) / g.res_lat - 0.5e0 AS y, (lng - g.min_lng) / g.res_lng - 0.5e0 AS x, g.nrows, g.ncols FROM {points} p, g),
      s AS (SELECT f.key, sum(CASE i WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END * CASE j WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END * elev) AS elev
        FROM f, {CORNERS}, dem WHERE dem.r = greatest(0, least(nrows - 1, CAST(floor(y) AS INT) + i)) AND dem.c = greatest(0, least(ncols - 1, CAST(floor(x) AS INT) + j)) GROUP BY f.key)"""


TX = "CAST(floor((lng + 180.0e0) / 360.0e0 * power(2.0e0, z)) AS INT)"
TY = f"CAST(floor({MY} * power(2.0e0, z)) AS INT)"
LNG = lambda x: f"(({x}) / power(2.0e0, z) * 360.0e0 - 180.0e0)"
LAT = lambda y: f"degrees(atan((exp(pi() * (1.0e0 - 2.0e0 * ({y}) / power(2.0e0, z))) - exp(-pi() * (1.0e0 - 2.0e0 * ({y}) / power(2.0e0, z)))) / 2.0e0))"
ZOOMED = f"""{sql.SCENARIOS}, zs AS (SELECT scenario, lng + (scenario % 3 - 1) * 0.3e0 AS lng, lat, unnest(range(5, 17)) AS z FROM scenarios), zoomed AS (SELECT scenario, CAST(z AS INT) AS z, {TX} AS x, {TY} AS y FROM zs)"""
RINGS = f"""{sql.BUILDINGS}, k00 AS (SELECT *, CAST(unnest(CASE WHEN id % 3 = 0 THEN [0, 1] ELSE [0] END) AS INT) AS ring FROM buildings),
k0 AS (SELECT *, CAST(unnest(range(0, 5)) AS INT) AS pos, (1e1 + id % 13) / (2.0e0 + 2 * ring) * sqrt(2.0e0) AS radius, CASE WHEN id % 2 = 0 THEN 0.0e0 ELSE radians(45.0e0) END + pi() / 4.0e0 AS base FROM k00),
p0 AS (SELECT id, ring, unnest([13, 14]) AS z, lng AS b_lng, lat AS b_lat, pos, lng + cos(base + (pos % 4) * pi() / 2.0e0) * radius / (cos(radians(lat)) * 111320.0e0) AS plng, lat + sin(base + (pos % 4) * pi() / 2.0e0) * radius / 111320.0e0 AS plat FROM k0),
p1 AS (SELECT id, ring, z, pos, plng, plat, CAST(floor((b_lng + 180.0e0) / 360.0e0 * power(2.0e0, z)) AS INT) AS x, CAST(floor({MY.replace('lat', 'b_lat')} * power(2.0e0, z)) AS INT) AS y FROM p0),
p2 AS (SELECT id, ring, z, x, y, pos, CAST(round_even(((plng + 180.0e0) / 360.0e0 * power(2.0e0, z) - x) * 4096, 0) AS BIGINT) AS qx, CAST(round_even(({MY.replace('lat', 'plat')} * power(2.0e0, z) - y) * 4096, 0) AS BIGINT) AS qy FROM p1),
p3 AS (SELECT *, lag(qx) OVER w AS lx, lag(qy) OVER w AS ly, first(qx) OVER w AS fx, first(qy) OVER w AS fy FROM p2 WINDOW w AS (PARTITION BY id, z, ring ORDER BY pos)),
p4 AS (SELECT *, row_number() OVER (PARTITION BY id, z, ring ORDER BY pos) AS k, count(*) OVER (PARTITION BY id, z, ring) AS n FROM p3 WHERE lx IS NULL OR qx <> lx OR qy <> ly),
p5 AS (SELECT id, ring, z, x, y, k, qx, qy, count(*) OVER (PARTITION BY id, z, ring) AS n FROM p4 WHERE n = 1 OR k < n OR qx <> fx OR qy <> fy),
p6 AS (SELECT *, coalesce(lead(qx) OVER w, first(qx) OVER w) AS nx, coalesce(lead(qy) OVER w, first(qy) OVER w) AS ny FROM p5 WINDOW w AS (PARTITION BY id, z, ring ORDER BY k)),
turned AS (SELECT id, ring, z, x, y, CAST(sum(qx * ny - nx * qy) AS BIGINT) AS a FROM p6 GROUP BY ALL HAVING count(*) >= 3 AND sum(qx * ny - nx * qy) <> 0),
areas AS (SELECT id, z, x, y, a FROM turned WHERE ring = 0)"""
ORACLES = {
    "bilinear_sample": f"WITH {sql.GRID}, {sql.BUILDINGS}, pt AS (SELECT id AS key, lng, lat FROM buildings), {bilinear('pt')} SELECT key AS id, round(elev, 6) AS elev FROM s",
    "tile_bounds": f"WITH {ZOOMED} SELECT scenario, z, round({LNG('x')}, 9) AS west, round({LAT('y + 1')}, 9) AS south, round({LNG('x + 1')}, 9) AS east, round({LAT('y')}, 9) AS north FROM zoomed",
    "tile_coverage": f"""WITH {sql.GRID}, {ZOOMED} SELECT scenario, z, x, y, z BETWEEN 7 AND 15 AND {LNG('x + 1')} > min_lng - (max_lng - min_lng) / 2 AND {LNG('x')} < max_lng + (max_lng - min_lng) / 2
      AND {LAT('y')} > min_lat - (max_lat - min_lat) / 2 AND {LAT('y + 1')} < max_lat + (max_lat - min_lat) / 2 AS served FROM zoomed, g""",
    "tile_cover": f"""WITH {sql.SCENARIOS}, zs AS (SELECT scenario, lng, lat, CAST(unnest([12, 13, 14]) AS INT) AS z FROM scenarios), nw AS (SELECT scenario, z, {TX} AS x0, {TY.replace('lat', '(lat + 5e-2)')} AS y0, {TX.replace('lng', '(lng + 5e-2)')} AS x1, {TY} AS y1 FROM zs)
      SELECT scenario, z, x, CAST(unnest(range(y0, y1 + 1)) AS INT) AS y FROM (SELECT scenario, z, CAST(unnest(range(x0, x1 + 1)) AS INT) AS x, y0, y1 FROM nw)""",
    "ring_area": f"WITH {RINGS} SELECT CAST(z AS INT) AS z, x, y, id, abs(a) AS area2 FROM areas",
    "ring_moves": f"""WITH {RINGS}, o AS (SELECT p5.*, CASE WHEN (t.a > 0) = (ring = 0) THEN k ELSE -k END AS o FROM p5 JOIN turned t USING (id, z, ring) SEMI JOIN areas USING (id, z))
      SELECT CAST(z AS INT) AS z, id, ring, CAST(row_number() OVER (PARTITION BY id, z, ring ORDER BY o) - 1 AS INT) AS pos, qx - coalesce(lag(qx) OVER w, 0) AS dx, qy - coalesce(lag(qy) OVER w, 0) AS dy FROM o WINDOW w AS (PARTITION BY id, z ORDER BY ring, o)""",
    "tile_values": f"WITH {RINGS} SELECT CAST(z AS INT) AS z, x, y, count(DISTINCT id % 5) AS heights, count(DISTINCT CASE WHEN id % 4 > 0 THEN type END) AS names FROM areas JOIN buildings USING (id) GROUP BY ALL",
}
