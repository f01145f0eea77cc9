"""Queries over files that are first written from the star-schema tables: map files and rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import durable
from ..operators import elements as E
from ..sources import pbf, rasters
from ..sources import tables as T
from . import layers, sql

#: Vertices of a way that a file numbers apart, and the share of the nodes that is left out of it.
PER_WAY, LOST = 64, 41


def map_file(spark: SparkSession, d: str) -> DataFrame:
    """The elements of orders as a map file, read back: ways of all, tagged nodes for every fifth; some nodes of ways are not in the file."""
    rows = layers.elements(spark, d).select("id", F.map_filter("tags", lambda k, v: v.isNotNull() & (v != "")).alias("tags"), "path", "lon", "lat")
    ref = lambda p: F.col("id") * PER_WAY + p
    ways = rows.select(F.lit("way").alias("kind"), "id", "tags", F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"), F.transform("path", lambda v, i: ref(i)).alias("refs"))
    vertex = rows.select(F.lit("node").alias("kind"), "id", F.posexplode("path").alias("pos", "v")).where(ref(F.col("pos")) % LOST > 0)
    none = F.lit(None)
    nodes = vertex.select("kind", ref(F.col("pos")).alias("id"), none.cast("map<string,string>").alias("tags"), "v.lng", "v.lat", none.cast("array<bigint>").alias("refs"))
    alone = rows.where("lon IS NOT NULL").select(F.lit("node").alias("kind"), (-F.col("id") - 1).alias("id"), "tags", "lon", "lat", none.cast("array<bigint>").alias("refs"))
    folder = durable.folder(spark, "map-file")
    pbf.write(ways.union(nodes).union(alone), folder)
    return pbf.read_elements(pbf.listed(spark, folder))


def pbf_elements(spark: SparkSession, d: str) -> DataFrame:
    e = map_file(spark, d)
    first = F.get("path", F.lit(0))
    return e.select("kind", "id", F.size("tags").alias("tags"), F.col("tags")["amenity"].alias("amenity"), F.size("path").alias("vertices"), "whole", F.round(F.coalesce("lon", first["lng"]), 6).alias("lng"), F.round(F.coalesce("lat", first["lat"]), 6).alias("lat"))


def pbf_roads(spark: SparkSession, d: str) -> DataFrame:
    """Roads of the file whose nodes are all there, before simplification."""
    e = map_file(spark, d).where("kind = 'way' AND whole")
    kept = e.where(F.col("tags")["highway"].isin(*E.ROADS) & (F.size("path") >= 2) & E.overlaps(F.col("path"), layers.BOUNDS))
    return kept.select("id", F.col("tags")["highway"].alias("type"), F.coalesce(F.col("tags")["name:en"], F.col("tags")["name"]).alias("name"), F.size("path").alias("vertices"))


def raster_file(spark: SparkSession, d: str) -> DataFrame:
    """The raster from files of 16 rows each; some cells have no elevation, or one that means none."""
    dem = T.dem(spark, d)
    g = T.dem_grid(dem)
    folder = durable.folder(spark, "raster")
    odd = F.when((F.col("r") + F.col("c")) % 17 == 0, F.lit(-32768.0)).otherwise(F.col("elev"))
    rasters.write(dem.where("(r * 3 + c) % 19 > 0").withColumn("elev", odd), g, folder, rows=16)
    return rasters.read(spark, folder)[0]


QUERIES = {f.__name__: f for f in (pbf_elements, pbf_roads, raster_file)}

VERTICES = f"""{sql.ROADS}, v AS (SELECT id, pos, lng, lat, (id * {PER_WAY} + pos - 1) % {LOST} > 0 AS kept FROM roads),
p AS (SELECT id, count(*) FILTER (kept) AS vertices, bool_and(kept) AS whole, arg_min(lng, pos) FILTER (kept) AS lng, arg_min(lat, pos) FILTER (kept) AS lat, min(lng) AS west, min(lat) AS south, max(lng) AS east, max(lat) AS north FROM v GROUP BY id)"""
ELEMENTS = layers.ELEMENTS.replace(sql.ROADS, VERTICES)
TAGS = "CAST((name IS NOT NULL)::INT + (building IS NOT NULL)::INT + (amenity IS NOT NULL)::INT + (highway IS NOT NULL)::INT + (name_en IS NOT NULL)::INT + (height IS NOT NULL)::INT AS INT)"
ORACLES = {
    "pbf_elements": f"""WITH {ELEMENTS} SELECT 'way' AS kind, el.id, {TAGS} AS tags, amenity, CAST(vertices AS INT) AS vertices, whole, round(p.lng, 6) AS lng, round(p.lat, 6) AS lat FROM el JOIN p USING (id)
      UNION ALL SELECT 'node', -id - 1, {TAGS}, amenity, 0, true, round(x0, 6), round(y0, 6) FROM el WHERE id % 5 = 0 AND {TAGS} > 0""",
    "pbf_roads": f"WITH {ELEMENTS} SELECT id, highway AS type, coalesce(name_en, name) AS name, CAST(vertices AS INT) AS vertices FROM el JOIN p USING (id) WHERE whole AND highway IN ('primary', 'residential') AND vertices >= 2 AND {layers.INSIDE.replace('west', 'p.west').replace('east', 'p.east').replace('south', 'p.south').replace('north', 'p.north')}",
    "raster_file": f"WITH {sql.GRID} SELECT CAST(i AS INT) AS r, CAST(j AS INT) AS c, CASE WHEN (i * 3 + j) % 19 > 0 AND (i + j) % 17 > 0 THEN CAST(CAST(elev AS FLOAT) AS DOUBLE) END AS elev FROM g, range(nrows) x(i), range(ncols) y(j) LEFT JOIN dem ON r = i AND c = j",
}
