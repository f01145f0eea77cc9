"""Map layers: cities, GeoJSON features and their geometry, read from JSON text and written as JSON text.

A feature is a row of text, so a layer of any size is read and written in parallel; a FeatureCollection in one file is exploded
into such rows by ``read_collection``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("buildings", "roads", "facilities", "water", "rim")
FEATURE = "type string, properties map<string, string>, geometry struct<type: string, coordinates: string>"


def cities(rows: DataFrame) -> DataFrame:
    """id, name, zoom of city records (folder, json); the folder's name stands for a missing id; sorted by folder."""
    c = rows.select("folder", F.from_json("json", "id string, name string, zoom int").alias("c"))
    return c.select("folder", F.coalesce("c.id", "folder").alias("id"), "c.name", "c.zoom").orderBy("folder").drop("folder")


def city(rows: DataFrame, city_id: str) -> DataFrame:
    """The city's record; an unknown id fails."""
    found = cities(rows.where(F.col("folder") == city_id))
    if not found.limit(1).count():
        raise LookupError(f"unknown city: {city_id}")
    return found


def layer(features: DataFrame, city_id: str, kind: str) -> DataFrame:
    """The features (city_id, kind, seq, json) of one layer; an unknown kind and an absent layer fail in different ways."""
    if kind not in KINDS:
        raise ValueError(f"unknown layer kind: {kind}")
    found = features.where((F.col("city_id") == city_id) & (F.col("kind") == kind))
    if not found.limit(1).count():
        raise LookupError(f"{city_id} has no {kind} layer")
    return found


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """seq, json of the features of FeatureCollection files."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "features array<string>").alias("x"))
    return whole.select(F.posexplode("x.features").alias("seq", "json"))


def write_features(features: DataFrame, path: str) -> None:
    """One feature a line, gzipped, in as many files as there are partitions."""
    features.select("json").write.text(path, compression="gzip")


def parsed(features: DataFrame) -> DataFrame:
    """The rows with properties (a map of text) and geometry (type, coordinates as text)."""
    return features.withColumn("f", F.from_json("json", FEATURE)).select(*[c for c in features.columns if c != "json"], "f.properties", "f.geometry")


def paths(geometry: Column) -> Column:
    """Coordinates as an array of vertex lists: lines, rings, the parts of many lines, or one list of a point."""
    kind, text = geometry["type"], geometry["coordinates"]
    read = lambda ddl: F.from_json(text, ddl)
    return (
        F.when(kind == "Point", F.array(F.array(read("array<double>"))))
        .when(kind == "LineString", F.array(read("array<array<double>>")))
        .when(kind.isin("MultiLineString", "Polygon"), read("array<array<array<double>>>"))
        .when(kind == "MultiPolygon", F.flatten(read("array<array<array<array<double>>>>")))
    )


def rings(geometry: Column) -> Column:
    """Rings of a polygon, or of the first part of many; null for others."""
    read = lambda ddl: F.from_json(geometry["coordinates"], ddl)
    return F.when(geometry["type"] == "Polygon", read("array<array<array<double>>>")).when(geometry["type"] == "MultiPolygon", F.get(read("array<array<array<array<double>>>>"), F.lit(0)))


def ring_centroid(ring: Column) -> Column:
    """Mean of the vertices, the closing one included, as (lng, lat)."""
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[k]) / F.size(ring)
    return F.struct(mean(0).alias("lng"), mean(1).alias("lat"))


def interior_point(ring: Column) -> Column:
    """A point inside a ring: the middle of the widest stretch of a horizontal line between two heights of vertices."""
    ys = F.transform(ring, lambda p: p[1])
    middle = (F.array_min(ys) + F.array_max(ys)) / 2.0
    y = (F.array_max(F.filter(ys, lambda v: v <= middle)) + F.array_min(F.filter(ys, lambda v: v > middle))) / 2.0
    edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def at(y: Column) -> Column:
        cut = F.filter(edges, lambda e: (e["a"][1] <= y) != (e["b"][1] <= y))
        xs = F.array_sort(F.transform(cut, lambda e: e["a"][0] + (y - e["a"][1]) * (e["b"][0] - e["a"][0]) / (e["b"][1] - e["a"][1])))
        spans = F.filter(F.transform(xs, lambda x, i: F.struct((F.get(xs, i + 1) - x).alias("width"), (-x).alias("left"), i.alias("i"))), lambda s: s["i"] % 2 == 0)
        widest = F.array_max(spans)
        return F.struct((-widest["left"] + widest["width"] / 2.0).alias("lng"), y.alias("lat"))

    return F.get(F.transform(F.array(y), at), F.lit(0))


def exposure_point(geometry: Column, properties: Column) -> Column:
    """(lng, lat) at which a building is judged: a polygon's centroid property, else a point inside it; a point itself."""
    given = F.from_json(properties["centroid"], "array<double>")
    pair = lambda a: F.struct(a[0].alias("lng"), a[1].alias("lat"))
    outer = F.get(rings(geometry), F.lit(0))
    return F.when((geometry["type"] == "Polygon") & (F.size(given) == 2), pair(given)).when(outer.isNotNull(), interior_point(outer)).otherwise(pair(F.from_json(geometry["coordinates"], "array<double>")))


def rivers(features: DataFrame) -> DataFrame:
    """seq, id, name, type, geometry of the line and area features of a water layer; ids and types by the first tag given."""
    p = lambda k: F.when(F.col("properties")[k] != "", F.col("properties")[k])
    rows = parsed(features).where(F.col("geometry.type").isin("LineString", "MultiLineString", "Polygon"))
    return rows.select("seq", F.coalesce(p("id"), p("osm_id"), F.concat(F.lit("water:"), F.col("seq").cast("string"))).alias("id"), p("name").alias("name"), F.coalesce(p("type"), p("waterway"), p("natural")).alias("type"), p("id").alias("own_id"), p("osm_id").alias("osm_id"), "geometry")


def lookup(features: DataFrame, refs: DataFrame) -> DataFrame:
    """ref, seq of the first river whose id, OSM id or name (in any case) a ref gives; a left join, so unknown refs have null."""
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("key"))
    r = rivers(features).select("seq", F.explode(F.array(key("id", F.col("own_id")), key("id", F.col("osm_id")), key("name", F.lower("name")))).alias("k")).select("seq", "k.*").where("key IS NOT NULL")
    first = r.groupBy("kind", "key").agg(F.min("seq").alias("seq"))
    wanted = refs.select("ref", F.explode(F.array(key("id", F.trim("ref")), key("name", F.lower(F.trim("ref"))))).alias("k")).select("ref", "k.*")
    return wanted.join(first, ["kind", "key"], "left").groupBy("ref").agg(F.min("seq").alias("seq"))
