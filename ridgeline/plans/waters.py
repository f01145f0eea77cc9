"""Waterway queries.  Matched letters are no matter for SQL: it gets the like pairs of the few test names as constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import waters as W
from ..sources import tables as T
from . import sql
from .layers import NAMES, WATERWAYS, pick


def lines(spark: SparkSession, d: str) -> DataFrame:
    """id, name, waterway, parts: the waterways; names and kinds by number, some of them absent."""
    n = F.expr("id DIV 97")
    name = F.when(pick(NAMES, n) != "", pick(NAMES, n))
    return T.lines(T.waterways(spark, d)).select("id", name.alias("name"), F.when(n % 5 > 0, pick(WATERWAYS, n)).alias("waterway"), F.array("path").alias("parts"))


def water_stems(spark: SparkSession, d: str) -> DataFrame:
    return W.stems(lines(spark, d).where("name IS NOT NULL"))


def water_like(spark: SparkSession, d: str) -> DataFrame:
    return W.like_stems(W.stems(lines(spark, d)))


def water_snap(spark: SparkSession, d: str) -> DataFrame:
    """Waterways in components by shared ends alone."""
    rows = lines(spark, d)
    labels = W.connected(W.snapped(W.ends(rows))).where("node % 2 = 0")
    labels = labels.select((F.col("node") / 2).cast("bigint").alias("id"), "label")
    return labels.join(W.shuffled(labels.groupBy("label").agg(F.min("id").alias("component"))), "label").select("id", "component")


def water_gap(spark: SparkSession, d: str) -> DataFrame:
    """Waterways in components by shared ends, and by like names within 20 km."""
    return W.grouped(lines(spark, d))[0].select("id", "component")


def water_merge(spark: SparkSession, d: str) -> DataFrame:
    return W.merged(lines(spark, d))


def water_geometry(spark: SparkSession, d: str) -> DataFrame:
    """The vertices of each merged river, part by part."""
    g = W.geometry(lines(spark, d))
    return g.select("id", "name", "type", "kind", "part", F.posexplode("path").alias("pos", "p")).select("id", "name", "type", "kind", "part", "pos", F.round("p.lng", 6).alias("lng"), F.round("p.lat", 6).alias("lat"))


QUERIES = {f.__name__: f for f in (water_stems, water_like, water_snap, water_gap, water_merge, water_geometry)}


#: The pairs among the stems of NAMES that are alike, worked out by hand: one has 20 of 21 letters in both; no other two reach 0.85, and none begins another.
LIKE = (("bishnumati", "bishnumatti"),)
CLUSTER = "CASE stem WHEN 'bishnumatti' THEN 'bishnumati' ELSE stem END"


def values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows) + ")"


FOLDED = "trim(regexp_replace(trim(lower(regexp_replace(strip_accents(name), '[^\\x00-\\x7F]', '', 'g'))), '\\(.*?\\)', ' ', 'g'))"
for _a, _b in W.SOUNDS:
    FOLDED = f"replace({FOLDED}, '{_a}', '{_b}')"
WORDS = f"list_filter(regexp_split_to_array({FOLDED}, '\\s+'), lambda w: w <> '')"
OWN = f"list_filter({WORDS}, lambda w: NOT list_contains({sorted(W.GENERIC)}, w))"
STEM = f"CASE WHEN NOT regexp_matches(lower(name), '[a-z]') THEN lower(trim(name)) ELSE array_to_string(CASE WHEN len({OWN}) > 0 THEN {OWN} ELSE {WORDS} END, ' ') END"
LINES = f"""{sql.ROADS}, l0 AS (SELECT id, nullif(({list(NAMES)})[CAST(id // 97 % {len(NAMES)} AS INT) + 1], '') AS name, CASE WHEN id // 97 % 5 > 0 THEN ({list(WATERWAYS)})[CAST(id // 97 % 4 AS INT) + 1] END AS waterway,
    count(*) - 1 AS segs, arg_min(lng, pos) AS x1, arg_min(lat, pos) AS y1, arg_max(lng, pos) AS x2, arg_max(lat, pos) AS y2 FROM roads WHERE id % 97 = 0 GROUP BY id),
l AS (SELECT *, CASE WHEN name IS NOT NULL THEN {STEM} END AS stem, coalesce(waterway, 'river') AS kind FROM l0),
e AS (SELECT id, stem, x1 AS x, y1 AS y FROM l UNION SELECT id, stem, x2, y2 FROM l),
e2 AS (SELECT e.*, {CLUSTER} AS cluster, round_even(x / {W.SNAP!r}, 0) AS gx, round_even(y / {W.SNAP!r}, 0) AS gy FROM e),
snap AS (SELECT DISTINCT a.id AS a, b.id AS b FROM e2 a JOIN e2 b ON abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1),
near AS (SELECT a, b FROM snap UNION SELECT a.id, b.id FROM e2 a JOIN e2 b USING (cluster) WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) * 111320.0e0 <= 20000.0e0)"""
REACH = lambda name, links: f"{name}_r AS (SELECT id AS a, id AS b FROM l UNION SELECT r.a, k.b FROM {name}_r r JOIN {links} k ON r.b = k.a), {name} AS (SELECT a AS id, min(b) AS component FROM {name}_r GROUP BY a)"
MERGED = f"""WITH RECURSIVE {LINES}, {REACH('comp', 'near')}, m AS (SELECT l.*, component, CASE WHEN kind = 'canal' THEN 'canal' ELSE 'water' END AS family FROM l JOIN comp USING (id)),
      here AS (SELECT DISTINCT component, stem FROM m WHERE stem IS NOT NULL),
      pair AS (SELECT h.component, a, b FROM {values([*LIKE, *((b, a) for a, b in LIKE)])} k(a, b) JOIN here h ON h.stem = a JOIN here i ON i.stem = b AND i.component = h.component),
      gr AS (SELECT component, stem AS a, stem AS b FROM here UNION SELECT gr.component, gr.a, pair.b FROM gr JOIN pair ON pair.component = gr.component AND gr.b = pair.a), grp AS (SELECT component, a AS stem, min(b) AS grp FROM gr GROUP BY ALL),
      named AS (SELECT m.*, grp FROM m JOIN grp USING (component, stem)),
      main AS (SELECT component, arg_max(grp, (segs, -least)) AS main FROM (SELECT component, grp, sum(segs) AS segs, min(id) AS least FROM named GROUP BY ALL) GROUP BY component),
      fam AS (SELECT DISTINCT component, grp, family FROM named),
      others AS (SELECT m.*, CASE WHEN f.grp IS NULL THEN '#' || m.id ELSE f.grp END AS grp FROM m LEFT JOIN main ON main.component = m.component LEFT JOIN fam f ON f.component = m.component AND f.grp = main AND f.family = m.family WHERE m.stem IS NULL),
      best AS (SELECT stem, trim(arg_max(name, (segs, -id))) AS shown FROM named GROUP BY stem),
      everything AS (SELECT a.*, shown FROM (SELECT * FROM named UNION ALL BY NAME SELECT * FROM others) a LEFT JOIN best USING (stem)),
      kinds AS (SELECT component, grp, family, arg_max(kind, (segs, -least)) AS type FROM (SELECT component, grp, family, kind, sum(segs) AS segs, min(id) AS least FROM everything GROUP BY ALL) GROUP BY ALL),
      o AS (SELECT component, grp, family, arg_max(id, (segs, -id)) AS id, arg_max(shown, (segs, -id)) FILTER (WHERE stem IS NOT NULL) AS name, count(*) AS members, count(*) AS parts, CAST(sum(segs) AS BIGINT) AS segs FROM everything GROUP BY ALL)"""
ORACLES = {
    "water_stems": f"WITH {LINES} SELECT DISTINCT name, stem FROM l WHERE name IS NOT NULL",
    "water_like": f"WITH {LINES}, s AS (SELECT DISTINCT stem FROM l) SELECT a, b FROM {values(LIKE)} k(a, b) WHERE a IN (SELECT stem FROM s) AND b IN (SELECT stem FROM s)",
    "water_snap": f"WITH RECURSIVE {LINES}, {REACH('comp', 'snap')} SELECT * FROM comp",
    "water_gap": f"WITH RECURSIVE {LINES}, {REACH('comp', 'near')} SELECT * FROM comp",
    "water_merge": f"""{MERGED} SELECT id, name, type, members, parts, segs FROM o JOIN kinds USING (component, grp, family)""",
    "water_geometry": f"""{MERGED} SELECT o.id, o.name, type, CASE WHEN parts = 1 THEN 'LineString' ELSE 'MultiLineString' END AS kind, part, CAST(pos - 1 AS INT) AS pos, round(lng, 6) AS lng, round(lat, 6) AS lat
      FROM o JOIN kinds USING (component, grp, family) JOIN (SELECT id AS member, component, grp, family, row_number() OVER (PARTITION BY component, grp, family ORDER BY id) - 1 AS part FROM everything) USING (component, grp, family) JOIN roads ON roads.id = member""",
}
