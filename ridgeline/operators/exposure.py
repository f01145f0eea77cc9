"""Assets, densified lines and their exposure to a flooded extent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid
from .wetness import wet_stretches


def with_cell(points: DataFrame, grid: Grid) -> DataFrame:
    return points.withColumn("r", grid.row(F.col("lat"))).withColumn("c", grid.col(F.col("lng")))


def stretches(lines: DataFrame, step: float) -> DataFrame:
    """id, seg, lng, lat, dx, dy, n: each segment of path, to be looked at in n = max(1, floor(max(|dx|, |dy|) / step)) parts."""
    a, b = F.col("path")[F.col("seg")], F.col("path")[F.col("seg") + 1]
    seg = lines.where("size(path) > 1").select("id", "path", F.explode(F.sequence(F.lit(0), F.size("path") - 2)).alias("seg"))
    seg = seg.select("id", "seg", a["lng"].alias("lng"), a["lat"].alias("lat"), (b["lng"] - a["lng"]).alias("dx"), (b["lat"] - a["lat"]).alias("dy"))
    return seg.withColumn("n", F.greatest(F.lit(1), F.floor(F.greatest(F.abs("dx"), F.abs("dy")) / F.lit(step)).cast("int")))


def along(at: str, by: str, k: Column) -> Column:
    """Coordinate of sample k of a stretch; one of no parts is its point."""
    return F.col(at) + F.col(by) * k / F.greatest(F.col("n"), F.lit(1))


def sampled(rows: DataFrame) -> DataFrame:
    """rows with k, lng and lat of each of the n + 1 samples of a stretch, both ends included."""
    kept = [c for c in rows.columns if c not in ("lng", "lat", "dx", "dy", "n")]
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k")).select(*kept, "k", along("lng", "dx", F.col("k")).alias("lng"), along("lat", "dy", F.col("k")).alias("lat"))


def densify(lines: DataFrame, step: float) -> DataFrame:
    """id, seg, k, lng, lat: each segment of path in n parts, both ends included."""
    return sampled(stretches(lines, step))


def as_stretches(assets: DataFrame) -> DataFrame:
    """Assets with dx, dy, n; points are stretches of no length."""
    return assets if "n" in assets.columns else assets.withColumns({"dx": F.lit(0.0), "dy": F.lit(0.0), "n": F.lit(0)})


def flooded_at(dem: DataFrame, level_m: float) -> DataFrame:
    """r, c, depth of cells that water standing at a level covers by over a millimetre."""
    return dem.withColumn("depth", F.greatest(F.lit(0.0), F.lit(level_m) - F.col("elev"))).where("depth > 1e-3").select("r", "c", "elev", "depth")


def any_flooded(samples: DataFrame, wet: DataFrame) -> DataFrame:
    """id of each asset with a sample point in a wet cell: a semi join on the cell, so cells with many samples copy nothing."""
    return samples.join(wet.select("r", "c"), ["r", "c"], "left_semi").select("id").distinct()


def flood_counts(points: DataFrame, wet: DataFrame) -> DataFrame:
    """kind, flooded, total."""
    marked = points.join(wet.select("r", "c").withColumn("wet", F.lit(1)), ["r", "c"], "left")
    return marked.groupBy("kind").agg(F.count("wet").alias("flooded"), F.count("*").alias("total"))


def asset_id(kind: str, *ids: str) -> Column:
    """Text of the first id that is given; without one, kind:position."""
    return F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in ids), F.concat(F.lit(f"{kind}:"), F.col("pos").cast("string")))


def asset_stretches(buildings: DataFrame, roads: DataFrame, facilities: DataFrame, step: float) -> DataFrame:
    """kind, id (text), name, lng, lat, dx, dy, n: the stretches along which each asset is looked at; their number does not depend on the step.

    Buildings and facilities (id, pos, name, lng, lat; facilities may have osm_id too) are one point each.  Roads (id, pos,
    name, path) have a stretch a segment; a road of one vertex is that point, one without any is left out.  Empty names are null.
    """

    def part(df: DataFrame, kind: str) -> DataFrame:
        ids = [c for c in ("id", "osm_id") if c in df.columns]
        return df.select(F.lit(kind).alias("kind"), asset_id(kind, *ids).alias("id"), F.nullif(F.col("name"), F.lit("")).alias("name"), *(c for c in ("lng", "lat", "path") if c in df.columns))

    lines = part(roads, "roads")
    named = F.struct("id", "name").alias("id")
    on_road = stretches(lines.select(named, "path"), step).drop("seg").unionByName(as_stretches(lines.where("size(path) = 1").select(named, F.col("path")[0]["lng"].alias("lng"), F.col("path")[0]["lat"].alias("lat"))))
    points = as_stretches(part(buildings, "buildings").unionByName(part(facilities, "facilities")))
    return points.unionByName(on_road.select(F.lit("roads").alias("kind"), "id.id", "id.name", "lng", "lat", "dx", "dy", "n"))


def asset_samples(buildings: DataFrame, roads: DataFrame, facilities: DataFrame, step: float) -> DataFrame:
    """kind, id (text), name, lng, lat: the points at which each asset is looked at, along the stretches of asset_stretches."""
    return sampled(asset_stretches(buildings, roads, facilities, step)).drop("k")


def totals(samples: DataFrame) -> DataFrame:
    """kind, total: assets, not samples."""
    return samples.select("kind", "id").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("total"))


def affected(samples: DataFrame, wet: DataFrame, grid: Grid) -> DataFrame:
    """kind, id, name of every asset (a row a sample, or with dx, dy, n a row a stretch) with a sample in a wet cell, once each."""
    return wet_stretches(as_stretches(samples).select("kind", "id", "name", "lng", "lat", "dx", "dy", "n"), wet, grid).groupBy("kind", "id").agg(F.first("name").alias("name"))


def affected_counts(samples: DataFrame, hit: DataFrame) -> DataFrame:
    """kind, flooded, total."""
    n = hit.groupBy("kind").agg(F.count(F.lit(1)).alias("flooded"))
    return totals(samples).join(n, "kind", "left").select("kind", F.coalesce("flooded", F.lit(0)).alias("flooded"), "total")


def stamp(points: DataFrame, n: int, spacing_m: float = 60.0) -> DataFrame:
    """id, i, j, lng, lat: an n by n square of planned assets around each point."""
    off, m_lng = (n - 1) / 2.0, F.cos(F.radians("lat")) * 111320.0
    grid = points.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"))
    return grid.select("id", "i", "j", (F.col("lng") + (F.col("i") - off) * spacing_m / m_lng).alias("lng"), (F.col("lat") + (F.col("j") - off) * spacing_m / 111320.0).alias("lat"))


#: What an asset's card says of its band (fixed values).
BADGES = {"high": "high exposure", "medium_high": "medium-high", "medium": "medium", "low": "low", "flooded": "flooded"}


def verdict(band: Column, flood: bool) -> Column:
    """Text for a planned asset; band is null for one outside the hazard."""
    if flood:
        return F.when(band.isNull(), "outside estimated hazard").otherwise("inside the estimated flood extent")
    text = F.when(band.isNull(), "outside estimated hazard")
    for name, badge in BADGES.items():
        text = text.when(band == name, f"{badge} exposure")
    return text.otherwise("ok exposure")


def band_of(ids: DataFrame, entries: DataFrame) -> DataFrame:
    """ids with the band of the last entry (by pos) for the id, null without one."""
    last = entries.groupBy("id").agg(F.max_by("band", "pos").alias("band"))
    return ids.join(last, "id", "left")


def validate(requests: DataFrame) -> DataFrame:
    """scenario, valid: exactly one origin, and numbers in range; an empty river_path counts as an origin."""
    given = sum((F.col(c).isNotNull().cast("int") for c in ("source_lng", "river_id", "river_path")), F.lit(0))
    ok = (given == 1) & (F.col("level_m") > -20) & (F.col("level_m") < 5000) & F.col("mode").isin("rise", "absolute")
    return requests.select("scenario", F.coalesce(ok, F.lit(False)).alias("valid"))


def validate_quake(requests: DataFrame) -> DataFrame:
    """scenario, valid: magnitude, depth and both degrees given and in range."""
    ok = (F.col("magnitude") > 0) & (F.col("magnitude") < 10) & (F.col("depth_km") >= 0) & (F.col("depth_km") < 300) & F.col("lng").between(-180.0, 180.0) & F.col("lat").between(-90.0, 90.0)
    return requests.select("scenario", F.coalesce(ok, F.lit(False)).alias("valid"))


def planned_verdicts(planned: DataFrame, answer: DataFrame) -> DataFrame:
    """id, verdict of every planned asset; answer has id and band of those that are exposed."""
    return planned.join(answer, "id", "left").select("id", verdict(F.col("band"), flood=False).alias("verdict"))


def shown(assets: DataFrame, ref: str) -> DataFrame:
    """The assets in a band whose reference is a number that is not negative."""
    return assets.where(F.col("band").isNotNull() & (F.col(ref).try_cast("bigint") >= 0))


def shoreline(wet: DataFrame, dem: DataFrame) -> DataFrame:
    """r, c of wet cells that have a dry cell of the raster above, below or beside them."""
    sides = F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))))
    beside = wet.select("r", "c", F.explode(sides).alias("s")).select("r", "c", (F.col("r") + F.col("s.i")).alias("nr"), (F.col("c") + F.col("s.j")).alias("nc"))
    at = lambda df: df.select(F.col("r").alias("nr"), F.col("c").alias("nc"))
    return beside.join(at(wet), ["nr", "nc"], "left_anti").join(at(dem), ["nr", "nc"], "left_semi").select("r", "c").distinct()
