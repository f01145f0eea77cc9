"""Layer, river, building-point and element queries, over features made from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import buildings as B
from ..operators import elements as E
from ..operators import ranks as R
from ..sources import layers as L
from ..sources import tables as T
from . import sql

#: Names of waterways by number: spellings, generic words, accents, other scripts and none.
NAMES = ("Bagmati River", "bagmati nadi", "Bagmatee", "Bishnumati Khola", "Bishnumatti", "Seti Gandaki", "Seti", "Kali Khola", "Manohara (east)", "Mánohara", "मनोहरा", "", "Dhobi Khola", "Dobhi River")
WATERWAYS = ("river", "stream", "canal", "river")


def pick(values: tuple, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)


def feature(properties: Column, kind: str | Column, coordinates: Column) -> Column:
    """Feature text; null properties are left out."""
    shape = F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), shape.alias("geometry")))


def city_rows(spark: SparkSession, d: str) -> DataFrame:
    """folder, json: a city a region; every other one gives no id of its own."""
    r = T.read(spark, d, "region")
    own = F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("id-"), F.col("r_regionkey").cast("string")))
    return r.select(F.concat(F.lit("city-"), F.col("r_regionkey").cast("string")).alias("folder"), F.to_json(F.struct(own.alias("id"), F.col("r_name").alias("name"), (F.col("r_regionkey") + 8).alias("zoom"))).alias("json"))


def city_catalog(spark: SparkSession, d: str) -> DataFrame:
    return L.cities(city_rows(spark, d))


def city_meta(spark: SparkSession, d: str) -> DataFrame:
    return L.city(city_rows(spark, d), "city-3")


def city_dem(spark: SparkSession, d: str) -> DataFrame:
    """The elevation of one city: here bands of ten rows are cities."""
    return T.dem(spark, d).withColumn("city_id", F.concat(F.lit("city-"), (F.floor(F.col("r") / 10) % 5).cast("string"))).where("city_id = 'city-2'").select("r", "c", "elev")


def in_city(id_: Column) -> Column:
    return F.concat(F.lit("city-"), (id_ % 5).cast("string"))


def water(spark: SparkSession, d: str) -> DataFrame:
    """city_id, kind, seq, json of the waterways; some have an id, some an OSM id, some neither."""
    lines = T.lines(T.waterways(spark, d)).withColumn("n", F.expr("id DIV 97"))
    tags = F.struct(
        F.when(F.col("n") % 3 == 0, F.concat(F.lit("w-"), F.col("id").cast("string"))).alias("id"), F.when(F.col("n") % 3 == 1, F.col("id")).alias("osm_id"),
        F.when(pick(NAMES, F.col("n")) != "", pick(NAMES, F.col("n"))).alias("name"), F.when(F.col("n") % 2 == 0, pick(WATERWAYS, F.col("n"))).alias("type"), pick(WATERWAYS, F.col("n")).alias("waterway"),
    )
    pts = F.transform("path", lambda p: F.array(p["lng"], p["lat"]))
    return lines.select(F.lit("city-0").alias("city_id"), F.lit("water").alias("kind"), F.col("n").alias("seq"), feature(tags, "LineString", pts).alias("json"))


def facility_layer(spark: SparkSession, d: str) -> DataFrame:
    f = T.facilities(spark, d)
    return f.select(in_city(F.col("id")).alias("city_id"), F.lit("facilities").alias("kind"), F.col("id").alias("seq"), feature(F.struct("id", "name", "type"), "Point", F.array("lng", "lat")).alias("json"))


def building_layer(spark: SparkSession, d: str) -> DataFrame:
    """Buildings as points (every third), squares with a centroid property, and L-shaped rings without."""
    b = T.buildings(spark, d)
    x, y, s = F.col("lng"), F.col("lat"), F.lit(1e-4)
    at = lambda dx, dy: F.array(x + s * dx, y + s * dy)
    ell = F.array(F.array(at(0, 0), at(3, 0), at(3, 1), at(1, 1), at(1, 4), at(0, 4), at(0, 0)))
    box = F.array(F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1), at(-1, -1)))
    k = F.col("id") % 3
    text = F.when(k == 0, feature(F.struct("id", "name"), "Point", F.array(x, y))).when(k == 1, feature(F.struct("id", "name", F.array(x, y).alias("centroid")), "Polygon", box)).otherwise(feature(F.struct("id", "name"), "Polygon", ell))
    return b.select(in_city(F.col("id")).alias("city_id"), F.lit("buildings").alias("kind"), F.col("id").alias("seq"), text.alias("json"))


def layer_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = L.parsed(L.layer(facility_layer(spark, d).union(building_layer(spark, d)), "city-1", "buildings"))
    return rows.select(F.col("properties")["id"].cast("bigint").alias("id"), F.col("properties")["name"].alias("name"), F.col("geometry.type").alias("geometry"), F.aggregate(L.paths(F.col("geometry")), F.lit(0), lambda n, p: n + F.size(p)).alias("vertices"))


def layer_geojson(spark: SparkSession, d: str) -> DataFrame:
    """Feature text with six decimals, as a layer file holds it."""
    point = F.format_string('{"type":"Feature","properties":{"id":%d,"type":"%s"},"geometry":{"type":"Point","coordinates":[%.6f,%.6f]}}', "id", "type", "lng", "lat")
    return T.facilities(spark, d).select("id", point.alias("json"))


def building_points(spark: SparkSession, d: str) -> DataFrame:
    rows = L.parsed(building_layer(spark, d)).select("seq", L.exposure_point(F.col("geometry"), F.col("properties")).alias("p"))
    return rows.select(F.col("seq").alias("id"), F.round("p.lng", 7).alias("lng"), F.round("p.lat", 7).alias("lat"))


def ring_centroid(spark: SparkSession, d: str) -> DataFrame:
    rows = L.parsed(building_layer(spark, d)).select("seq", F.get(L.rings(F.col("geometry")), F.lit(0)).alias("ring")).where("ring IS NOT NULL")
    c = L.ring_centroid(F.col("ring"))
    return rows.select(F.col("seq").alias("id"), F.round(c["lng"], 7).alias("lng"), F.round(c["lat"], 7).alias("lat"))


def river_list(spark: SparkSession, d: str) -> DataFrame:
    return L.rivers(water(spark, d)).select("seq", "id", "name", "type")


def river_lookup(spark: SparkSession, d: str) -> DataFrame:
    """References by id, OSM id, name in another case, and unknown ones; some with spaces around."""
    refs = T.read(spark, d, "nation").select(F.concat(F.lit(" "), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("w-"), (F.col("n_nationkey") * 97).cast("string"))).when(F.col("n_nationkey") % 3 == 1, (F.col("n_nationkey") * 97).cast("string")).otherwise(F.upper(pick(NAMES, F.col("n_nationkey"))))).alias("ref")).distinct()
    return L.lookup(water(spark, d), refs)


def name_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """The number of each building's name, and of its type, among all that there are."""
    b = T.buildings(spark, d).select("id", "name", "type")
    names, types = R.dense_codes(b, "name"), R.dense_codes(b, "type")
    return b.join(names, "name").withColumnRenamed("code", "name_code").join(types, "type").select("id", "name", "name_code", "type", "code")


def csr_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each road's vertices begin when roads lie in a row by id."""
    n = T.road_vertices(spark, d).groupBy("id").agg(F.count("*").alias("n"))
    return R.offsets(n, "id", "n")


def elements(spark: SparkSession, d: str) -> DataFrame:
    """Map elements of orders: id, tags, geometry array (of 1 to 7 vertices), lat, lon and center of some."""
    v = T.lines(T.road_vertices(spark, d)).withColumn("n", F.size("path"))
    k = F.col("id") % 4
    tags = F.map_from_arrays(
        F.array(*map(F.lit, ("name", "building", "amenity", "highway", "name:en", "height"))),
        F.array(F.when(F.col("id") % 3 > 0, F.concat(F.lit("n"), F.col("id").cast("string"))), F.when(k == 0, F.lit("yes")), F.when(k == 1, pick(("hospital", "post_hospital", "clinic", "cafe", "police"), F.col("id"))), F.when(k == 2, pick(("primary", "footway", "residential", "track"), F.expr("id DIV 4"))), F.when(F.col("id") % 6 == 0, F.concat(F.lit("e"), F.col("id").cast("string"))), F.when(F.col("id") % 10 == 0, F.lit("12")).otherwise(F.lit(""))),
    )
    first = F.get("path", F.lit(0))
    return v.select("id", tags.alias("tags"), "path", F.when(F.col("id") % 5 == 0, first["lng"]).alias("lon"), F.when(F.col("id") % 5 == 0, first["lat"]).alias("lat"), F.when(F.col("id") % 5 == 1, first).alias("center"))


def to_features(spark: SparkSession, d: str) -> DataFrame:
    f = E.to_features(elements(spark, d), ("height",))
    return f.select("id", "kind", F.col("properties")["name"].alias("name"), F.col("properties")["type"].alias("type"), F.col("properties")["height"].alias("height"), F.size("ring").alias("vertices"))


def element_points(spark: SparkSession, d: str) -> DataFrame:
    return E.centroids(elements(spark, d)).select("id", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


#: West, south, east, north of the bounds that the element filters take.
BOUNDS = (85.2, 27.58, 85.4, 27.7)


def osm_buildings(spark: SparkSession, d: str) -> DataFrame:
    return E.building_rings(elements(spark, d), BOUNDS, 40.0).select("id", F.round("area_m2", 1).alias("area_m2"))


def osm_roads(spark: SparkSession, d: str) -> DataFrame:
    r = E.roads(elements(spark, d), BOUNDS, 1e-5)
    return r.select("id", "type", "name", F.posexplode("line").alias("pos", "p")).select("id", "type", "name", "pos", "p.lng", "p.lat")


def osm_facilities(spark: SparkSession, d: str) -> DataFrame:
    """The first 500 by id (the cap is the feature): points, and ways at the middle of their bounds."""
    f = E.facilities(elements(spark, d), BOUNDS)
    return f.orderBy("key").limit(500).select("key", "type", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


def bbox_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each scenario's box of 0.1 degrees in 3 x 3 parts."""
    s = T.scenarios(spark, d)
    return E.chunks(s.select("scenario", F.col("lng").alias("w"), F.col("lat").alias("s"), (F.col("lng") + 0.1).alias("e"), (F.col("lat") + 0.1).alias("n")), 3)


QUERIES = {f.__name__: f for f in (
    city_catalog, city_meta, city_dem, layer_scan, layer_geojson, building_points, ring_centroid, river_list, river_lookup, name_dictionary, csr_offsets, to_features, element_points, osm_buildings, osm_roads,
    osm_facilities, bbox_chunks)}

CITIES = "cities AS (SELECT 'city-' || r_regionkey AS folder, CASE WHEN r_regionkey % 2 = 0 THEN 'id-' || r_regionkey ELSE 'city-' || r_regionkey END AS id, r_name AS name, CAST(r_regionkey + 8 AS INT) AS zoom FROM region)"
WATER = f"""{sql.ROADS}, w AS (SELECT id, id // 97 AS n, count(*) AS vertices FROM roads WHERE id % 97 = 0 GROUP BY id),
water AS (SELECT n AS seq, CASE WHEN n % 3 = 0 THEN 'w-' || id END AS own_id, CASE WHEN n % 3 = 1 THEN CAST(id AS VARCHAR) END AS osm_id, nullif(({list(NAMES)})[CAST(n % {len(NAMES)} AS INT) + 1], '') AS name, ({list(WATERWAYS)})[CAST(n % 4 AS INT) + 1] AS type FROM w)"""
AT = lambda dx, dy: f"round(lng + 1e-4 * {dx}, 7) AS lng, round(lat + 1e-4 * {dy}, 7) AS lat"
ELEMENTS = f"""{sql.ROADS}, el AS (
  SELECT id, count(*) AS n, arg_min(lng, pos) AS x0, arg_min(lat, pos) AS y0, min(lng) AS west, min(lat) AS south, max(lng) AS east, max(lat) AS north,
    CASE WHEN id % 3 > 0 THEN 'n' || id END AS name, CASE WHEN id % 4 = 0 THEN 'yes' END AS building, CASE WHEN id % 4 = 1 THEN (['hospital', 'post_hospital', 'clinic', 'cafe', 'police'])[CAST(id % 5 AS INT) + 1] END AS amenity,
    CASE WHEN id % 4 = 2 THEN (['primary', 'footway', 'residential', 'track'])[CAST(id // 4 % 4 AS INT) + 1] END AS highway, CASE WHEN id % 6 = 0 THEN 'e' || id END AS name_en, CASE WHEN id % 10 = 0 THEN '12' END AS height
  FROM roads GROUP BY id)"""
INSIDE = "west <= {2}e0 AND east >= {0}e0 AND south <= {3}e0 AND north >= {1}e0".format(*BOUNDS)
ORACLES = {
    "city_catalog": f"WITH {CITIES} SELECT id, name, zoom FROM cities ORDER BY folder",
    "city_meta": f"WITH {CITIES} SELECT id, name, zoom FROM cities WHERE folder = 'city-3'",
    "city_dem": f"WITH {sql.DEM} SELECT * FROM dem WHERE r // 10 % 5 = 2",
    "layer_scan": f"WITH {sql.BUILDINGS} SELECT id, name, CASE WHEN id % 3 = 0 THEN 'Point' ELSE 'Polygon' END AS geometry, CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 7 END AS vertices FROM buildings WHERE id % 5 = 1",
    "layer_geojson": f"""WITH {sql.FACILITIES} SELECT id, printf('{{"type":"Feature","properties":{{"id":%d,"type":"%s"}},"geometry":{{"type":"Point","coordinates":[%.6f,%.6f]}}}}', id, type, lng, lat) AS json FROM facilities""",
    "building_points": f"WITH {sql.BUILDINGS} SELECT id, {AT(0, 0)} FROM buildings WHERE id % 3 < 2 UNION ALL SELECT id, {AT(0.5, 2.5)} FROM buildings WHERE id % 3 = 2",
    "ring_centroid": f"WITH {sql.BUILDINGS} SELECT id, {AT(-0.2, -0.2)} FROM buildings WHERE id % 3 = 1 UNION ALL SELECT id, {AT('8e0 / 7', '10e0 / 7')} FROM buildings WHERE id % 3 = 2",
    "river_list": f"WITH {WATER} SELECT seq, coalesce(own_id, osm_id, 'water:' || seq) AS id, name, type FROM water",
    "river_lookup": f"""WITH {WATER}, refs AS (SELECT DISTINCT ' ' || CASE WHEN n_nationkey % 3 = 0 THEN 'w-' || n_nationkey * 97 WHEN n_nationkey % 3 = 1 THEN CAST(n_nationkey * 97 AS VARCHAR) ELSE upper(({list(NAMES)})[CAST(n_nationkey % {len(NAMES)} AS INT) + 1]) END AS ref FROM nation)
      SELECT ref, min(seq) AS seq FROM refs LEFT JOIN water ON trim(ref) IN (own_id, osm_id) OR lower(trim(ref)) = lower(name) GROUP BY ref""",
    "name_dictionary": f"WITH {sql.BUILDINGS} SELECT id, name, dense_rank() OVER (ORDER BY name) - 1 AS name_code, type, dense_rank() OVER (ORDER BY type) - 1 AS code FROM buildings",
    "csr_offsets": f"WITH {sql.ROADS}, n AS (SELECT id, count(*) AS n FROM roads GROUP BY id) SELECT id, n, CAST(sum(n) OVER (ORDER BY id) - n AS BIGINT) AS start FROM n",
    "to_features": f"WITH {ELEMENTS} SELECT id, CASE WHEN n = 2 THEN 'LineString' ELSE 'Polygon' END AS kind, name, coalesce(building, amenity, highway) AS type, height, CAST(CASE WHEN n = 2 THEN 2 ELSE n + 1 END AS INT) AS vertices FROM el WHERE n = 2 OR n >= 4",
    "element_points": f"WITH {ELEMENTS} SELECT id, round(x0, 6) AS lng, round(y0, 6) AS lat FROM el WHERE id % 5 < 2",
    "osm_buildings": f"""WITH {ELEMENTS}, ring AS (SELECT id, pos, lng, lat FROM roads UNION ALL SELECT id, 1000, x0, y0 FROM el),
      area AS (SELECT id, abs(sum(x)) / 2.0e0 * 111320.0e0 * 111320.0e0 AS a FROM (SELECT id, lng * lead(lat) OVER w - lead(lng) OVER w * lat AS x FROM ring WINDOW w AS (PARTITION BY id ORDER BY pos)) GROUP BY id)
      SELECT id, round(a, 1) AS area_m2 FROM el JOIN area USING (id) WHERE building IS NOT NULL AND n >= 4 AND {INSIDE} AND a >= 40""",
    "osm_facilities": f"""WITH {ELEMENTS}, f AS (SELECT CASE WHEN id % 5 = 0 THEN 'n' ELSE 'w' END || id AS key, amenity AS type, CASE WHEN id % 5 = 0 THEN x0 ELSE (west + east) / 2e0 END AS lng, CASE WHEN id % 5 = 0 THEN y0 ELSE (south + north) / 2e0 END AS lat FROM el WHERE amenity IN ('hospital', 'clinic', 'police'))
      SELECT key, type, round(lng, 6) AS lng, round(lat, 6) AS lat FROM f WHERE lng BETWEEN {BOUNDS[0]}e0 AND {BOUNDS[2]}e0 AND lat BETWEEN {BOUNDS[1]}e0 AND {BOUNDS[3]}e0 ORDER BY key LIMIT 500""",
    "bbox_chunks": f"WITH {sql.SCENARIOS}, i AS (SELECT unnest(range(0, 3)) AS i), j AS (SELECT unnest(range(0, 3)) AS j) SELECT scenario, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(lng + 1e-1 * i / 3e0, 9) AS w, round(lat + 1e-1 * j / 3e0, 9) AS s, round(lng + 1e-1 * (i + 1) / 3e0, 9) AS e, round(lat + 1e-1 * (j + 1) / 3e0, 9) AS n FROM scenarios, i, j",
}
