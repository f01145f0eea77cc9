"""Map elements (id, tags, path, lon, lat, center) as features, buildings, roads and facilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buildings import ring_area_m2
from .regions import simplify_lines

#: Road classes and facility kinds that are kept (fixed values).
ROADS = ("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "unclassified", "service")
FACILITIES = "^(hospital|clinic|fire_station|police|shelter|school)$"
Bounds = tuple[float, float, float, float]


def closed(path: Column) -> Column:
    return F.concat(path, F.slice(path, 1, 1))


def to_features(elements: DataFrame, extra: tuple[str, ...] = (), keep_lines: bool = False) -> DataFrame:
    """id, kind, properties, ring: two vertices make a line, four or more a closed ring (or a line), others drop out.

    Properties without a value, or with an empty one, are left out; the type is the first of the tags building, amenity, highway.
    """
    tag = lambda k: F.when(F.col("tags")[k] != "", F.col("tags")[k])
    names = ("name", "type", *extra)
    values = (tag("name"), F.coalesce(tag("building"), tag("amenity"), tag("highway")), *map(tag, extra))
    properties = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*values)), lambda k, v: v.isNotNull())
    line = (F.size("path") == 2) | F.lit(keep_lines)
    rows = elements.where((F.size("path") == 2) | (F.size("path") >= 4))
    return rows.select("id", F.when(line, "LineString").otherwise("Polygon").alias("kind"), properties.alias("properties"), F.when(line, F.col("path")).otherwise(closed(F.col("path"))).alias("ring"))


def centroids(elements: DataFrame) -> DataFrame:
    """id, lng, lat: a node's own place, else the center given with a way; elements with neither drop out."""
    rows = elements.select("id", F.coalesce("lon", "center.lng").alias("lng"), F.coalesce("lat", "center.lat").alias("lat"))
    return rows.where("lng IS NOT NULL AND lat IS NOT NULL")


def box(path: Column) -> tuple[Column, Column, Column, Column]:
    """West, south, east, north."""
    xs, ys = F.transform(path, lambda p: p["lng"]), F.transform(path, lambda p: p["lat"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def overlaps(path: Column, bounds: Bounds) -> Column:
    west, south, east, north = box(path)
    return (west <= bounds[2]) & (east >= bounds[0]) & (south <= bounds[3]) & (north >= bounds[1])


def building_rings(elements: DataFrame, bounds: Bounds, least_m2: float) -> DataFrame:
    """id, ring, area_m2 of building ways whose box overlaps the bounds, of so many square metres or more."""
    rows = elements.where(F.col("tags")["building"].isNotNull() & (F.size("path") >= 4) & overlaps(F.col("path"), bounds))
    rows = rows.select("id", "tags", closed(F.col("path")).alias("ring")).withColumn("area_m2", ring_area_m2(F.col("ring")))
    return rows.where(F.col("area_m2") >= least_m2)


def roads(elements: DataFrame, bounds: Bounds, tolerance: float) -> DataFrame:
    """id, type, name (English first), line of the road classes kept, simplified, with five decimals."""
    tags = F.col("tags")
    rows = elements.where(tags["highway"].isin(*ROADS) & (F.size("path") >= 2) & overlaps(F.col("path"), bounds))
    lines = simplify_lines(rows, tolerance).select("id", F.col("path").alias("line"))
    return rows.select("id", tags["highway"].alias("type"), F.coalesce(tags["name:en"], tags["name"]).alias("name")).join(lines, "id")


def facilities(elements: DataFrame, bounds: Bounds) -> DataFrame:
    """key (n or w before the id), type, lng, lat of the kinds kept inside the bounds; a way stands at the middle of its box."""
    rows = elements.where(F.col("tags")["amenity"].rlike(FACILITIES))
    west, south, east, north = box(F.col("path"))
    node = F.col("lon").isNotNull()
    rows = rows.select(F.concat(F.when(node, "n").otherwise("w"), F.col("id").cast("string")).alias("key"), F.col("tags")["amenity"].alias("type"), F.when(node, F.col("lon")).otherwise((west + east) / 2.0).alias("lng"), F.when(node, F.col("lat")).otherwise((south + north) / 2.0).alias("lat"))
    return rows.where(F.col("lng").between(bounds[0], bounds[2]) & F.col("lat").between(bounds[1], bounds[3]))


def chunks(boxes: DataFrame, k: int) -> DataFrame:
    """k x k parts of each box (w, s, e, n), numbered from the south-west."""
    numbers = F.sequence(F.lit(0), F.lit(k - 1))
    rows = boxes.withColumn("i", F.explode(numbers)).withColumn("j", F.explode(numbers))
    cut = lambda a, b, n: F.round(F.col(a) + (F.col(b) - F.col(a)) * n / k, 9)
    keys = [c for c in boxes.columns if c not in "wsen"]
    return rows.select(*keys, "i", "j", cut("w", "e", F.col("i")).alias("w"), cut("s", "n", F.col("j")).alias("s"), cut("w", "e", F.col("i") + 1).alias("e"), cut("s", "n", F.col("j") + 1).alias("n"))
