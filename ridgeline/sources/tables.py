"""Spatial tables derived from the star-schema tables by integer arithmetic, the same in any SQL engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import Grid, grid_of

EXTENT = (85.15, 27.54, 0.32, 0.21)
FACILITY_TYPES = ("hospital", "clinic", "fire_station", "police", "shelter", "school")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r, c, elev: 40 columns, one cell a part."""
    return read(spark, sf_dir, "part").selectExpr("CAST(p_partkey DIV 40 AS INT) AS r", "CAST(p_partkey % 40 AS INT) AS c", "CAST(p_size AS DOUBLE) + ((p_partkey * 37) % 101) * 1e-2 AS elev")


def dem_grid(cells: DataFrame) -> Grid:
    return grid_of(cells, *EXTENT)


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name", "8.515e1 + ((c_custkey * 7919) % 3200) / 1e4 AS lng", "2.754e1 + ((c_custkey * 104729) % 2100) / 1e4 AS lat", "c_mktsegment AS type", "c_acctbal AS acctbal")


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ", ".join(f"'{t}'" for t in FACILITY_TYPES)
    return read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "8.515e1 + ((s_suppkey * 7919) % 3200) / 1e4 AS lng", "2.754e1 + ((s_suppkey * 104729) % 2100) / 1e4 AS lat", f"element_at(array({kinds}), CAST(s_suppkey % 6 AS INT) + 1) AS type")


ROAD_LNG = "8.515e1 + ((l_orderkey * 7919) % 3000) / 1e4 + (l_partkey % 200) / 1e4"
ROAD_LAT = "2.754e1 + ((l_orderkey * 104729) % 1900) / 1e4 + (l_suppkey % 200) / 1e4"


def road_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, pos, lng, lat: one polyline an order; pos orders its vertices by a full key, so ties are alike points."""
    v = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    v = v.withColumn("pos", F.expr("CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT)"))
    return v.selectExpr("l_orderkey AS id", "pos", f"{ROAD_LNG} AS lng", f"{ROAD_LAT} AS lat")  # places are made from keys after the shuffle, which does not carry them


def waterways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, pos, lng, lat, main: the polylines of every 97th order; main ones are those that a flood scenario takes for its rivers."""
    return road_vertices(spark, sf_dir).where("id % 97 = 0").withColumn("main", F.expr("id % 194 = 0"))


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").selectExpr("n_nationkey AS scenario", "8.516e1 + n_nationkey * 1.2e-2 AS lng", "2.755e1 + (n_nationkey * 7 % 25) * 7.6e-3 AS lat", "5e0 + (n_nationkey % 8) * 4e-1 AS magnitude", "1e1 AS depth_km")


def lines(vertices: DataFrame) -> DataFrame:
    """id, path array<struct<lng, lat>> from vertices; a line is bounded by its own length."""
    return vertices.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lng", "lat"))), lambda v: F.struct(v["lng"].alias("lng"), v["lat"].alias("lat"))).alias("path"))
