"""Tables of sources.tables as common table expressions in DuckDB's dialect."""

DEM = "dem AS (SELECT CAST(p_partkey // 40 AS INT) AS r, CAST(p_partkey % 40 AS INT) AS c, CAST(p_size AS DOUBLE) + ((p_partkey * 37) % 101) * 1e-2 AS elev FROM part)"
GRID = DEM + """, g AS (
  SELECT max(r) + 1 AS nrows, max(c) + 1 AS ncols, 85.15e0 AS min_lng, 27.54e0 AS min_lat, 0.32e0 / (max(c) + 1) AS res_lng, 0.21e0 / (max(r) + 1) AS res_lat,
    27.54e0 + (max(r) + 1) * (0.21e0 / (max(r) + 1)) AS max_lat, 85.15e0 + (max(c) + 1) * (0.32e0 / (max(c) + 1)) AS max_lng FROM dem
), area AS (
  SELECT res_lng * (111.32e0 * greatest(cos(radians((min_lat + max_lat) / 2.0e0)), 0.1e0)) * 1000.0e0 * res_lat * 111.32e0 * 1000.0e0 AS m2 FROM g
)"""
BUILDINGS = "buildings AS (SELECT c_custkey AS id, c_name AS name, 8.515e1 + ((c_custkey * 7919) % 3200) / 1e4 AS lng, 2.754e1 + ((c_custkey * 104729) % 2100) / 1e4 AS lat, c_mktsegment AS type, c_acctbal AS acctbal FROM customer)"
FACILITIES = "facilities AS (SELECT s_suppkey AS id, s_name AS name, 8.515e1 + ((s_suppkey * 7919) % 3200) / 1e4 AS lng, 2.754e1 + ((s_suppkey * 104729) % 2100) / 1e4 AS lat, (['hospital', 'clinic', 'fire_station', 'police', 'shelter', 'school'])[CAST(s_suppkey % 6 AS INT) + 1] AS type FROM supplier)"
ROADS = """roads AS (
  SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS pos,
    8.515e1 + ((l_orderkey * 7919) % 3000) / 1e4 + (l_partkey % 200) / 1e4 AS lng, 2.754e1 + ((l_orderkey * 104729) % 1900) / 1e4 + (l_suppkey % 200) / 1e4 AS lat FROM lineitem
)"""
SCENARIOS = "scenarios AS (SELECT n_nationkey AS scenario, 8.516e1 + n_nationkey * 1.2e-2 AS lng, 2.755e1 + (n_nationkey * 7 % 25) * 7.6e-3 AS lat, 5e0 + (n_nationkey % 8) * 4e-1 AS magnitude, 1e1 AS depth_km FROM nation)"
BANDS = "bands AS (SELECT * FROM (VALUES ('high', 1, 0.32e0), ('medium_high', 2, 0.20e0), ('medium', 3, 0.10e0), ('low', 4, 0.04e0)) t(band, label, least))"
SEGMENTS = """segments AS (
  SELECT id, pos - 1 AS seg, lng AS x, lat AS y, lead(lng) OVER w - lng AS dx, lead(lat) OVER w - lat AS dy FROM roads WINDOW w AS (PARTITION BY id ORDER BY pos)
)"""


def row_of(lat: str) -> str:
    return f"greatest(0, least(g.nrows - 1, CAST(trunc((g.max_lat - {lat}) / g.res_lat) AS INT)))"


def col_of(lng: str) -> str:
    return f"greatest(0, least(g.ncols - 1, CAST(trunc(({lng} - g.min_lng) / g.res_lng) AS INT)))"


def km(lng: str, lat: str, at_lng: str, at_lat: str, cos_lat: str) -> str:
    return f"sqrt(power(({lng} - {at_lng}) * (111.32e0 * greatest(cos(radians({cos_lat})), 0.1e0)), 2) + power(({lat} - {at_lat}) * 111.32e0, 2))"


def intensity(distance: str, depth: str, magnitude: str) -> str:
    return f"least(1.0e0, power(greatest({magnitude}, 0.0e0) / 6.0e0, 2.0e0) * power(8.0e0 / (8.0e0 + sqrt({distance} * {distance} + {depth} * {depth})), 1.5e0))"


def band(index: str) -> str:
    return f"CASE WHEN {index} >= 0.32 THEN 'high' WHEN {index} >= 0.20 THEN 'medium_high' WHEN {index} >= 0.10 THEN 'medium' WHEN {index} >= 0.04 THEN 'low' END"


def label(index: str) -> str:
    return f"CASE WHEN {index} >= 0.32 THEN 1 WHEN {index} >= 0.20 THEN 2 WHEN {index} >= 0.10 THEN 3 WHEN {index} >= 0.04 THEN 4 ELSE 0 END"
