"""Region queries: masks, components, outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exposure, quake, regions
from ..operators import outlines as O
from ..sources import tables as T
from . import hazards, sql

CAP_M = 15.0
#: Below it lies the valley of the rim queries.
RIM_M = 28.0


def raster(spark: SparkSession, d: str):
    dem = T.dem(spark, d)
    return dem, T.dem_grid(dem)


def mask(spark: SparkSession, d: str):
    dem, g = raster(spark, d)
    return dem.where(F.col("elev") <= CAP_M).select("r", "c"), g


def downsample_mask(spark: SparkSession, d: str) -> DataFrame:
    """The mask at most 16 cells long on its longer side."""
    return regions.downsample(*mask(spark, d), most=16)[0]


def components(spark: SparkSession, d: str) -> DataFrame:
    return regions.labelled(*mask(spark, d))


def clean_mask(spark: SparkSession, d: str) -> DataFrame:
    return regions.clean(*mask(spark, d))


def mask_runs(spark: SparkSession, d: str) -> DataFrame:
    return regions.mask_runs(mask(spark, d)[0])


def mask_polygons(spark: SparkSession, d: str) -> DataFrame:
    return regions.mask_polygons(*mask(spark, d))


def valley_rim(spark: SparkSession, d: str) -> DataFrame:
    """The largest body below RIM_M, and whether it is an enclosed valley."""
    return O.valley(*raster(spark, d), cap_m=RIM_M)[0]


def valley_ring(spark: SparkSession, d: str) -> DataFrame:
    """The vertices of that body's shell, in order."""
    dem, g = raster(spark, d)
    r6 = lambda c: F.round(c, 6).alias(c)
    return O.placed(O.valley(dem, g, cap_m=RIM_M)[1], g).select("pos", "x", "y", r6("lng"), r6("lat"))


def valley_line(spark: SparkSession, d: str) -> DataFrame:
    """The simplified rim."""
    return O.valley_line(*raster(spark, d), cap_m=RIM_M)


def mask_rings(spark: SparkSession, d: str) -> DataFrame:
    """Shells and holes of every body of the mask at full resolution, with their signed areas in cells."""
    m, g = mask(spark, d)
    return O.ring_areas(O.ringed(regions.labelled_runs(m, g), g))


def quake_zones(spark: SparkSession, d: str) -> DataFrame:
    """Polygons of each band inside the region."""
    dem, g = raster(spark, d)
    zones = quake.raster(dem, g, hazards.LNG, hazards.LAT, hazards.MAGNITUDE, hazards.DEPTH).where(F.col("elev") <= hazards.CAP_M)
    return regions.classed_polygons([(n, zones.where(F.col("label") == k)) for k, n in ((1, "high"), (2, "medium_high"), (3, "medium"), (4, "low"))], g)


def flood_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Polygons of the flood and of its deep core."""
    dem, g = raster(spark, d)
    wet = exposure.flooded_at(dem, hazards.LEVEL_M)
    return regions.classed_polygons([("flood", wet), ("flood-deep", wet.where("depth >= 1.0"))], g)


def ring_nesting(spark: SparkSession, d: str) -> DataFrame:
    """Which ring of the mask's bodies encloses which."""
    m, g = mask(spark, d)
    return O.nested(O.ringed(regions.labelled_runs(m, g), g))


QUERIES = {f.__name__: f for f in (downsample_mask, components, clean_mask, mask_runs, mask_polygons, mask_rings, ring_nesting, valley_rim, valley_ring, valley_line, quake_zones, flood_overlay)}

MASK = f"{sql.GRID}, mask AS (SELECT r, c FROM dem WHERE elev <= {CAP_M}e0)"


def labelled(name: str, cells: str) -> str:
    """Least-cell labels of 4-connected cells, by propagation."""
    return f"""{name}_n AS (SELECT r, c, CAST(r AS BIGINT) * ncols + c AS node FROM {cells}, g),
    {name}_e AS (SELECT a.node AS a, b.node AS b FROM {name}_n a JOIN {name}_n b ON abs(a.r - b.r) + abs(a.c - b.c) = 1),
    {name}_p AS (SELECT node AS start, node FROM {name}_n UNION SELECT p.start, e.b FROM {name}_p p JOIN {name}_e e ON e.a = p.node),
    {name} AS (SELECT n.r, n.c, min(p.start) AS label FROM {name}_p p JOIN {name}_n n ON n.node = p.node GROUP BY n.r, n.c)"""


def rings(cells: str) -> str:
    """side: the unit sides of labelled cells with the cell on the right; follow: the side after each, leftmost first where there are two.

    e numbers a side by its start and direction as the library numbers upright ones, level ones following after all of those.
    """
    of = "SELECT label, x, y, dx, dy, CASE WHEN dy <> 0 THEN (CAST(least(y, y + dy) AS BIGINT) * (ncols + 1) + x) * 2 + CAST(dy = -1 AS INT) ELSE 1000000000 + (CAST(y AS BIGINT) * (ncols + 1) + x) * 2 + CAST(dx = 1 AS INT) END AS e FROM"
    parts = " UNION ALL ".join(
        f"SELECT a.label, a.c + {x} AS x, a.r + {y} AS y, {dx} AS dx, {dy} AS dy FROM {cells} a LEFT JOIN {cells} b ON b.r = a.r + {nr} AND b.c = a.c + {nc} WHERE b.r IS NULL"
        for x, y, dx, dy, nr, nc in ((0, 0, 1, 0, -1, 0), (1, 0, 0, 1, 0, 1), (1, 1, -1, 0, 1, 0), (0, 1, 0, -1, 0, -1))
    )
    turn = "CASE WHEN n.dx = s.dy AND n.dy = -s.dx THEN 0 WHEN n.dx = s.dx AND n.dy = s.dy THEN 1 ELSE 2 END"  # left, on, right
    return f"""side AS MATERIALIZED ({of} ({parts}), g),
      follow AS MATERIALIZED (SELECT s.e, arg_min(n.e, {turn}) AS nxt FROM side s JOIN side n ON n.label = s.label AND n.x = s.x + s.dx AND n.y = s.y + s.dy GROUP BY s.e)"""


VALLEY = f"""WITH RECURSIVE {sql.GRID}, mask AS (SELECT r, c FROM dem WHERE elev < {RIM_M}e0), {labelled('found', 'mask')},
      b AS MATERIALIZED (SELECT label, count(*) AS cells FROM found GROUP BY label ORDER BY cells DESC, label LIMIT 1), body AS (SELECT found.* FROM found SEMI JOIN b USING (label)), {rings('body')},
      walk AS (SELECT min(e) AS e, 0 AS k FROM side UNION ALL SELECT nxt, k + 1 FROM walk JOIN follow USING (e) WHERE nxt > (SELECT min(e) FROM side)),
      upright AS (SELECT s.x, s.y, s.dy, row_number() OVER (ORDER BY k) - 1 AS rank, lead(s.dy, 1, -1) OVER (ORDER BY k) <> 0 AS straight FROM walk JOIN side s USING (e)),
      kept AS (SELECT x, y, dy, straight, row_number() OVER (ORDER BY rank) - 1 AS rank FROM upright WHERE dy <> 0),
      corners AS (SELECT 2 * rank AS pos, x, y FROM kept UNION ALL SELECT 2 * rank + 1, x, y + dy FROM kept WHERE NOT straight)"""

RINGED = f"""WITH RECURSIVE {MASK}, {labelled('found', 'mask')}, {rings('found')},
      reach AS (SELECT start, e FROM (SELECT e AS start, e FROM side) UNION SELECT reach.start, nxt FROM reach JOIN follow ON reach.e = follow.e),
      ring AS MATERIALIZED (SELECT e, min(start) AS ring FROM reach GROUP BY e)"""
ORACLES = {
    "downsample_mask": f"WITH {MASK}, f AS (SELECT greatest(1, CAST(ceil(greatest(nrows, ncols) / 16e0) AS INT)) AS k FROM g) SELECT DISTINCT CAST(r // k AS INT) AS r, CAST(c // k AS INT) AS c FROM mask, f",
    "components": f"WITH RECURSIVE {MASK}, {labelled('found', 'mask')} SELECT r, c, label FROM found",
    "clean_mask": f"""WITH RECURSIVE {MASK}, {labelled('found', 'mask')}, kept AS (SELECT r, c FROM found WHERE label IN (SELECT label FROM found GROUP BY label HAVING count(*) >= 4)),
      rest AS (SELECT r, c FROM dem ANTI JOIN kept USING (r, c)), {labelled('hole', 'rest')},
      small AS (SELECT label FROM hole, g GROUP BY label HAVING count(*) < 8 AND NOT bool_or(r = 0 OR c = 0 OR r = nrows - 1 OR c = ncols - 1))
      SELECT r, c FROM kept UNION ALL SELECT r, c FROM hole WHERE label IN (SELECT label FROM small)""",
    "mask_runs": f"WITH {MASK} SELECT r, min(c) AS c0, max(c) AS c1 FROM (SELECT r, c, c - row_number() OVER (PARTITION BY r ORDER BY c) AS k FROM mask) GROUP BY r, k",
    "ring_nesting": f"""{RINGED}, up AS (SELECT label, ring, e, x, least(y, y + dy) AS r, dy FROM side JOIN ring USING (e) WHERE dy <> 0),
      shape AS (SELECT ring, any_value(label) AS label, sum(dy * x) > 0 AS shell FROM up GROUP BY ring),
      within AS (SELECT a.ring, b.ring AS outer_ring FROM up a JOIN up b ON a.e = a.ring AND b.r = a.r AND b.x < a.x AND b.ring <> a.ring GROUP BY a.ring, b.ring HAVING count(*) % 2 = 1),
      deep AS (SELECT s.ring, count(w.ring) AS depth FROM shape s LEFT JOIN within w USING (ring) GROUP BY s.ring),
      parent AS (SELECT w.ring, arg_max(outer_ring, d.depth) AS parent FROM within w JOIN deep d ON d.ring = w.outer_ring GROUP BY w.ring)
      SELECT ring, label, shell, parent, CAST(depth AS INT) AS depth FROM shape JOIN deep USING (ring) LEFT JOIN parent USING (ring)""",
    "mask_rings": f"""{RINGED} SELECT label, ring, count(*) FILTER (corner) AS vertices, CAST(sum(CASE WHEN dy = 1 THEN x WHEN dy = -1 THEN -x ELSE 0 END) AS BIGINT) AS area, sum(CASE WHEN dy = 1 THEN x WHEN dy = -1 THEN -x ELSE 0 END) > 0 AS shell
      FROM (SELECT s.label, s.e, s.x, s.dy, s.dy <> 0 OR n.dy <> 0 AS corner FROM side s JOIN follow f ON s.e = f.e JOIN side n ON n.e = f.nxt) JOIN ring USING (e) GROUP BY label, ring""",
    "valley_rim": f"""{VALLEY}
      SELECT label, cells, count(*) AS vertices, count(*) FILTER (least(x * res_lng, (ncols - x) * res_lng) <= eps OR least(y * res_lat, (nrows - y) * res_lat) <= eps) AS on_border,
        NOT bool_or(x IN (0, ncols) AND y IN (0, nrows)) AND count(*) FILTER (least(x * res_lng, (ncols - x) * res_lng) <= eps OR least(y * res_lat, (nrows - y) * res_lat) <= eps) <= 0.35 * count(*) AS ok
      FROM (SELECT x, y FROM corners UNION ALL SELECT x, y FROM corners WHERE pos = 0), b, g, (SELECT greatest(res_lng, res_lat) / 2 AS eps FROM g) GROUP BY label, cells""",
    "valley_ring": f"""{VALLEY}
      SELECT pos, x, y, round(min_lng + x * res_lng, 6) AS lng, round(max_lat - y * res_lat, 6) AS lat FROM corners, g""",
}
