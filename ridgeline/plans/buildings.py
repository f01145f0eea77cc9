"""Building, tile and table-preparation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import buildings as B
from ..functions import tiles
from ..operators.quantiles import quantiles
from ..sources import tables as T
from . import sql

#: Inputs of the parsers, chosen by the key.
TAGS = ("4", "12.5 m", ".", "250", "about 7.25m", "", "1.2.3", "none")


def tagged(spark: SparkSession, d: str) -> DataFrame:
    values = F.array(*map(F.lit, TAGS))
    return T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.element_at(values, (F.col("p_partkey") % 8).cast("int") + 1).alias("height"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).alias("levels"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_type")).alias("type"))


def parse_number(spark: SparkSession, d: str) -> DataFrame:
    return tagged(spark, d).select("id", B.parse_number(F.col("height")).alias("number"))


def building_height(spark: SparkSession, d: str) -> DataFrame:
    return tagged(spark, d).select("id", B.height(F.col("height"), F.col("levels"), F.col("type")).alias("height_m"))


def block_tint(spark: SparkSession, d: str) -> DataFrame:
    return T.buildings(spark, d).select("id", B.tint(F.col("id").cast("string")).alias("tint"))


def footprint() -> Column:
    return B.square(F.col("lng"), F.col("lat"), 10.0 + F.col("id") % 13, F.when(F.col("id") % 2 == 0, 0.0).otherwise(45.0))


def footprints(spark: SparkSession, d: str) -> DataFrame:
    return T.buildings(spark, d).select("id", "lng", "lat", footprint().alias("ring"))


def footprint_area(spark: SparkSession, d: str) -> DataFrame:
    """Areas of synthetic footprints, from 40 square metres, with metres per degree alike on both axes."""
    return footprints(spark, d).select("id", F.round(B.ring_area_m2(F.col("ring")), 3).alias("area_m2")).where("area_m2 >= 40")


def footprint_topk(spark: SparkSession, d: str) -> DataFrame:
    """The largest 50 footprints (a top-k report); of equal ones the lower id."""
    return footprint_area(spark, d).orderBy(F.desc("area_m2"), "id").limit(50)


def synthetic_footprint(spark: SparkSession, d: str) -> DataFrame:
    """Corners of each footprint."""
    return footprints(spark, d).select("id", F.posexplode("ring").alias("pos", "p")).select("id", "pos", F.round("p.lng", 7).alias("lng"), F.round("p.lat", 7).alias("lat"))


def tile_math(spark: SparkSession, d: str) -> DataFrame:
    b = T.buildings(spark, d)
    return b.select("id", F.round(tiles.mercator_x(F.col("lng")), 9).alias("mx"), F.round(tiles.mercator_y(F.col("lat")), 9).alias("my"))


def building_tile_assign(spark: SparkSession, d: str) -> DataFrame:
    """Buildings per tile of zoom 13 to 15: each is in one tile of a zoom."""
    z = T.buildings(spark, d).select("lng", "lat", F.explode(F.array(F.lit(13), F.lit(14), F.lit(15))).alias("z"))
    return z.groupBy("z", tiles.tile_x(F.col("lng"), F.col("z")).alias("x"), tiles.tile_y(F.col("lat"), F.col("z")).alias("y")).agg(F.count("*").alias("n"))


def zigzag(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "part").select("p_partkey", tiles.zigzag(F.col("p_partkey") - 100).alias("z"))


def terrarium_encode(spark: SparkSession, d: str) -> DataFrame:
    red, green, blue = tiles.terrarium(F.col("elev"))
    return T.dem(spark, d).select("r", "c", red.alias("red"), green.alias("green"), blue.alias("blue"))


def terrarium_decode(spark: SparkSession, d: str) -> DataFrame:
    """Within a 256th of a metre of what was encoded."""
    e = terrarium_encode(spark, d)
    return e.select("r", "c", tiles.from_terrarium(F.col("red"), F.col("green"), F.col("blue")).alias("elev"))


def facility_priority(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("type") == "hospital", 0).when(F.col("type") == "fire_station", 1).when(F.col("type") == "police", 2).when(F.col("type") == "clinic", 3).when(F.col("type") == "shelter", 4).otherwise(5)
    return T.facilities(spark, d).select("id", "type", rank.alias("priority"))


def osm_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Of elements with one id, the one with most vertices; of equal ones the first. Here: parts of an order's road by returned flag."""
    parts = T.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("seq")).agg(F.count("*").alias("size"))
    return parts.groupBy("id").agg(F.min(F.struct((-F.col("size")).alias("less"), "seq")).alias("best")).select("id", F.col("best.seq").alias("seq"), (-F.col("best.less")).alias("size"))


def feature_bounds(spark: SparkSession, d: str) -> DataFrame:
    r6 = lambda c: F.round(c, 6)
    return T.road_vertices(spark, d).groupBy("id").agg(r6(F.min("lng")).alias("west"), r6(F.min("lat")).alias("south"), r6(F.max("lng")).alias("east"), r6(F.max("lat")).alias("north"))


def water_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """First and last vertex and segments of each waterway."""
    v = T.waterways(spark, d).groupBy("id").agg(F.min_by(F.struct("lng", "lat"), "pos").alias("a"), F.max_by(F.struct("lng", "lat"), "pos").alias("b"), (F.count("*") - 1).alias("segments"))
    r6 = lambda c: F.round(c, 6)
    return v.select("id", "segments", r6("a.lng").alias("a_lng"), r6("a.lat").alias("a_lat"), r6("b.lng").alias("b_lng"), r6("b.lat").alias("b_lat"))


def dem_fill(spark: SparkSession, d: str) -> DataFrame:
    """Missing elevations (every 17th cell here) become the median of the others."""
    holes = T.dem(spark, d).withColumn("elev", F.when((F.col("r") * 40 + F.col("c")) % 17 > 0, F.col("elev")))
    (median,) = quantiles(holes, "elev", [0.5])
    return holes.select("r", "c", F.round(F.coalesce("elev", F.lit(median)), 6).alias("elev"))


QUERIES = {f.__name__: f for f in (
    parse_number, building_height, block_tint, footprint_area, footprint_topk, synthetic_footprint, tile_math, building_tile_assign, zigzag, terrarium_encode, terrarium_decode, facility_priority, osm_dedupe,
    feature_bounds, water_endpoints, dem_fill)}

TAGGED = f"""tagged AS (SELECT p_partkey AS id, ({list(TAGS)})[CAST(p_partkey % 8 AS INT) + 1] AS height, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) END AS levels,
  CASE WHEN p_partkey % 5 > 0 THEN lower(p_type) ELSE '' END AS type FROM part),
num AS (SELECT *, try_cast(regexp_extract(regexp_extract(height, '[0-9.]+'), '^([0-9]+\\.?[0-9]*|\\.[0-9]+)') AS DOUBLE) AS h, try_cast(levels AS DOUBLE) AS lv FROM tagged)"""
STOREYS = "CASE " + " ".join(f"WHEN regexp_matches(type, '{p}') THEN {n}" for p, n in B.STOREYS) + " ELSE 2 END"
HASH = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(CAST(id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda h, x: (xor(h, x) * 16777619) & 4294967295)"
RING = f"""{sql.BUILDINGS}, k AS (SELECT *, CAST(unnest(range(0, 5)) AS INT) AS pos, (1e1 + id % 13) / 2.0e0 * sqrt(2.0e0) AS radius, CASE WHEN id % 2 = 0 THEN 0.0e0 ELSE radians(45.0e0) END + pi() / 4.0e0 AS base FROM buildings),
ring AS (SELECT id, pos, lng + cos(base + (pos % 4) * pi() / 2.0e0) * radius / (cos(radians(lat)) * 111320.0e0) AS x, lat + sin(base + (pos % 4) * pi() / 2.0e0) * radius / 111320.0e0 AS y FROM k),
areas AS (SELECT id, round(abs(sum(cross_)) / 2.0e0 * 111320.0e0 * 111320.0e0, 3) AS area_m2 FROM (SELECT id, x * lead(y) OVER w - lead(x) OVER w * y AS cross_ FROM ring WINDOW w AS (PARTITION BY id ORDER BY pos)) GROUP BY id)"""
MY = "(1.0e0 - ln(tan(radians(lat)) + 1.0e0 / cos(radians(lat))) / pi()) / 2.0e0"
TERRARIUM = f"WITH {sql.DEM}, v AS (SELECT r, c, elev + 32768.0e0 AS v FROM dem), e AS (SELECT r, c, CAST(floor(v) AS INT) >> 8 AS red, CAST(floor(v) AS INT) & 255 AS green, CAST(floor((v - floor(v)) * 256.0e0) AS INT) AS blue FROM v)"
ORACLES = {
    "parse_number": f"WITH {TAGGED} SELECT id, h AS number FROM num",
    "building_height": f"""WITH {TAGGED}, m AS (SELECT id, CASE WHEN h BETWEEN 2 AND 200 THEN h WHEN lv >= 1 THEN lv * 3.2e0 ELSE {STOREYS} * 3.2e0 END AS m FROM num)
      SELECT id, floor(least(60.0e0, greatest(3.0e0, m)) * 2.0e0 + 0.5e0) / 2.0e0 AS height_m FROM m""",
    "block_tint": f"WITH {sql.BUILDINGS} SELECT id, ({list(B.TINTS)})[CAST({HASH} % 5 AS INT) + 1] AS tint FROM buildings",
    "synthetic_footprint": f"WITH {RING} SELECT id, pos, round(x, 7) AS lng, round(y, 7) AS lat FROM ring",
    "tile_math": f"WITH {sql.BUILDINGS} SELECT id, round((lng + 180.0e0) / 360.0e0, 9) AS mx, round({MY}, 9) AS my FROM buildings",
    "building_tile_assign": f"WITH {sql.BUILDINGS}, z AS (SELECT *, unnest([13, 14, 15]) AS z FROM buildings) SELECT z, CAST(floor((lng + 180.0e0) / 360.0e0 * power(2.0e0, z)) AS INT) AS x, CAST(floor({MY} * power(2.0e0, z)) AS INT) AS y, count(*) AS n FROM z GROUP BY ALL",
    "zigzag": "SELECT p_partkey, CASE WHEN p_partkey >= 100 THEN 2 * (p_partkey - 100) ELSE -2 * (p_partkey - 100) - 1 END AS z FROM part",
    "terrarium_encode": f"{TERRARIUM} SELECT r, c, red, green, blue FROM e",
    "terrarium_decode": f"{TERRARIUM} SELECT r, c, red * 256.0e0 + green + blue / 256.0e0 - 32768.0e0 AS elev FROM e",
    "facility_priority": f"WITH {sql.FACILITIES} SELECT id, type, CAST(coalesce(list_position(['hospital', 'fire_station', 'police', 'clinic', 'shelter'], type) - 1, 5) AS INT) AS priority FROM facilities",
    "osm_dedupe": "SELECT id, seq, size FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY size DESC, seq) AS k FROM (SELECT l_orderkey AS id, l_returnflag AS seq, count(*) AS size FROM lineitem GROUP BY ALL)) WHERE k = 1",
    "feature_bounds": f"WITH {sql.ROADS} SELECT id, round(min(lng), 6) AS west, round(min(lat), 6) AS south, round(max(lng), 6) AS east, round(max(lat), 6) AS north FROM roads GROUP BY id",
    "water_endpoints": f"WITH {sql.ROADS} SELECT id, count(*) - 1 AS segments, round(arg_min(lng, pos), 6) AS a_lng, round(arg_min(lat, pos), 6) AS a_lat, round(arg_max(lng, pos), 6) AS b_lng, round(arg_max(lat, pos), 6) AS b_lat FROM roads WHERE id % 97 = 0 GROUP BY id",
    "dem_fill": f"WITH {sql.DEM}, h AS (SELECT r, c, CASE WHEN (r * 40 + c) % 17 > 0 THEN elev END AS elev FROM dem) SELECT r, c, round(coalesce(elev, (SELECT quantile_cont(elev, 0.5) FROM h)), 6) AS elev FROM h",
}
ORACLES |= {
    "footprint_area": f"WITH {RING} SELECT id, area_m2 FROM areas WHERE area_m2 >= 40",
    "footprint_topk": f"WITH {RING} SELECT id, area_m2 FROM areas WHERE area_m2 >= 40 ORDER BY area_m2 DESC, id LIMIT 50",
}
