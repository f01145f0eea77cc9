"""Masks as cells: downsampling, components, cleaning, runs and outlines."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.grid import Grid
from .durable import written
from .graph import components, shuffled

#: The least component that stays, the least hole that stays open, and cells of a display mask's longer side (fixed values).
KEEP, HOLE, DISPLAY = 4, 8, 96


def downsample(mask: DataFrame, grid: Grid, most: int = DISPLAY) -> tuple[DataFrame, int]:
    """r, c of coarse cells that hold a cell of the mask, and the factor."""
    k = max(1, -(-max(grid.nrows, grid.ncols) // most))
    return mask.select(F.floor(F.col("r") / k).cast("int").alias("r"), F.floor(F.col("c") / k).cast("int").alias("c")).distinct(), k


def coarse(grid: Grid, k: int) -> Grid:
    return Grid(-(-grid.nrows // k), -(-grid.ncols // k), grid.min_lng, grid.max_lat - -(-grid.nrows // k) * k * grid.res_lat, grid.res_lng * k, grid.res_lat * k)


def labelled(mask: DataFrame, grid: Grid) -> DataFrame:
    """r, c, label: the 4-connected component of each cell, by its least cell number."""
    return labelled_runs(mask, grid).select("r", F.explode(F.sequence("c0", "c1")).alias("c"), "label")


def labelled_runs(mask: DataFrame, grid: Grid) -> DataFrame:
    """label, r, c0, c1: the maximal level runs of a mask, each with the least cell number of its 4-connected body.

    Cells are first joined to runs, so the graph has one node a run, and runs of neighbouring rows are linked where they overlap: each run looks
    up the rows below by its cells, an equi-join.
    """
    runs = mask_runs(mask).select("r", "c0", "c1", (F.col("r").cast("bigint") * grid.ncols + F.col("c0")).alias("node"))
    runs = written(runs, "runs")
    cells = runs.select("node", "r", F.explode(F.sequence("c0", "c1")).alias("c"))
    below = cells.select(F.col("node").alias("b"), (F.col("r") - 1).alias("r"), "c")
    links = cells.join(shuffled(below), ["r", "c"]).select(F.col("node").alias("a"), "b").distinct()
    labels = components(links, runs.select("node"))
    return runs.join(shuffled(labels), "node").select("label", "r", "c0", "c1")


def mask_runs(mask: DataFrame) -> DataFrame:
    """r, c0, c1: maximal horizontal runs (gaps and islands, per row)."""
    m = mask.select("r", "c").distinct().withColumn("island", F.col("c") - F.row_number().over(W.partitionBy("r").orderBy("c")))
    return m.groupBy("r", "island").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).drop("island")


def clean(mask: DataFrame, grid: Grid, keep: int = KEEP, hole: int = HOLE) -> DataFrame:
    """r, c: components under keep cells go, then enclosed holes under hole cells are filled."""
    found = labelled(mask, grid)
    large = found.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= keep).select("label")
    kept = written(found.join(large, "label", "left_semi").select("r", "c"), "kept")
    spark = mask.sparkSession
    every = spark.range(grid.nrows).select(F.col("id").cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(grid.ncols - 1))).alias("c"))
    holes = labelled(every.join(kept, ["r", "c"], "left_anti"), grid)
    edge = (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == grid.nrows - 1) | (F.col("c") == grid.ncols - 1)
    small = holes.groupBy("label").agg(F.count("*").alias("n"), F.max(edge).alias("open")).where((F.col("n") < hole) & ~F.col("open")).select("label")
    return kept.union(holes.join(small, "label", "left_semi").select("r", "c"))


def outline(cells: set[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Closed rings of (row, column) corners: sides that no two cells share, chained with the cells on the right."""
    ways: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in cells:
        for beyond, a, b in (((r - 1, c), (r, c), (r, c + 1)), ((r, c + 1), (r, c + 1), (r + 1, c + 1)), ((r + 1, c), (r + 1, c + 1), (r + 1, c)), ((r, c - 1), (r + 1, c), (r, c))):
            if beyond not in cells:
                ways.setdefault(a, []).append(b)
    rings = []
    while ways:
        start = min(ways)
        ring, at, came = [start], start, None
        while True:
            options = ways[at]
            if came is not None and len(options) > 1:  # at a corner that two cells touch, turn right
                turn = (came[1], -came[0])
                options.sort(key=lambda b: (b[0] - at[0], b[1] - at[1]) != turn)
            to = options.pop(0)
            if not options:
                del ways[at]
            came = (to[0] - at[0], to[1] - at[1])
            ring.append(to)
            at = to
            if at == start:
                break
        rings.append(ring)
    return rings


def simplified(path: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas-Peucker with a stack; the ends stay."""
    keep, stack = {0, len(path) - 1}, [(0, len(path) - 1)]
    while stack:
        a, b = stack.pop()
        (x0, y0), (x1, y1) = path[a][:2], path[b][:2]
        dx, dy = x1 - x0, y1 - y0
        length = (dx * dx + dy * dy) ** 0.5
        far, at = tolerance, -1
        for k in range(a + 1, b):
            x, y = path[k][:2]
            d = abs(dx * (y - y0) - dy * (x - x0)) / length if length else ((x - x0) ** 2 + (y - y0) ** 2) ** 0.5
            if d > far:
                far, at = d, k
        if at >= 0:
            keep.add(at)
            stack += [(a, at), (at, b)]
    return [path[k] for k in sorted(keep)]


def polygons(mask: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """keys, label, cells, rings, geometry (GeoJSON) of each component of a display mask; keys tell masks apart.

    A display mask has at most DISPLAY cells a side, so a component is a bounded group whatever the raster.
    """
    found = mask.select(*keys, "r", "c", "label")
    schema = ", ".join([f"{k} {dict(mask.dtypes)[k]}" for k in keys] + ["label bigint", "cells bigint", "rings int", "geometry string"])

    def draw(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rings = outline(set(zip(part["r"].tolist(), part["c"].tolist(), strict=True)))
        rings.sort(key=lambda ring: (min(ring), -len(ring)))
        placed = [[(round(grid.min_lng + c * grid.res_lng, 7), round(grid.max_lat - r * grid.res_lat, 7)) for r, c in simplified(ring, 0.5)] for ring in rings]
        return pd.DataFrame([[*key, len(part), len(placed), json.dumps({"type": "Polygon", "coordinates": placed})]], columns=[*keys, "label", "cells", "rings", "geometry"])

    return found.groupBy(*keys, "label").applyInPandas(draw, schema)


def mask_polygons(mask: DataFrame, grid: Grid) -> DataFrame:
    """Polygons of a mask: downsampled, cleaned, and outlined; never a source of areas."""
    small, k = downsample(mask, grid)
    g = coarse(grid, k)
    return polygons(labelled(clean(small, g), g).withColumn("mask", F.lit("mask")), g, ["mask"])


def classed_polygons(masks: list[tuple[str, DataFrame]], grid: Grid) -> DataFrame:
    """Polygons of several masks in one pass: they are stacked with empty rows between, which leaves components and holes as they are."""
    factors = [downsample(m, grid) for _, m in masks]
    k = factors[0][1]
    g = coarse(grid, k)
    step = g.nrows + 2
    stack = None
    for i, (small, _) in enumerate(factors):
        part = small.select((F.col("r") + i * step).alias("r"), "c")
        stack = part if stack is None else stack.unionByName(part)
    tall = replace(g, nrows=step * len(masks))
    found = labelled(clean(stack, tall), tall)
    names = F.array(*(F.lit(n) for n, _ in masks))
    found = found.select(F.get(names, F.floor(F.col("r") / step).cast("int")).alias("class"), (F.col("r") % step).alias("r"), "c", "label")
    return polygons(found, g, ["class"])


def simplify_lines(lines: DataFrame, tolerance: float) -> DataFrame:
    """id, n, path: each path by Douglas-Peucker, rounded to five decimals."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            paths = [[{"lng": round(x, 5), "lat": round(y, 5)} for x, y in simplified([(v["lng"], v["lat"]) for v in p], tolerance)] for p in b["path"]]
            yield pd.DataFrame({"id": b["id"], "n": [len(p) for p in paths], "path": paths})

    return lines.select("id", "path").mapInPandas(run, "id bigint, n int, path array<struct<lng: double, lat: double>>")


