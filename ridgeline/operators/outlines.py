"""Outlines of masks as rings of any length: sides matched along grid lines, order by pointer doubling, simplification in levels.

A run of cells has two upright sides, the left one walked up and the right one down, so a shell turns clockwise and a hole the
other way.  Between two upright sides a ring either goes straight on or along a grid line, and the ends of upright sides
on a line, in the order of columns, pair up to those stretches.  No task holds a ring or a body.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.grid import Grid
from .durable import written
from .graph import chains, cycles, shuffled
from .regions import labelled_runs, simplified

#: Vertices between two kept ones up to which one task simplifies the stretch.
STRETCH = 20_000


def sides(runs: DataFrame, grid: Grid) -> DataFrame:
    """label, side, up, x, y0, y1: two upright sides of each run (label, r, c0, c1), walked from line y0 to line y1."""
    width = grid.ncols + 1
    both = F.array(F.struct(F.lit(True).alias("up"), F.col("c0").alias("x")), F.struct(F.lit(False).alias("up"), (F.col("c1") + 1).alias("x")))
    s = runs.select("label", "r", F.explode(both).alias("s")).select("label", "r", "s.up", "s.x")
    side = (F.col("r").cast("bigint") * width + F.col("x")) * 2 + F.col("up").cast("bigint")
    down = (~F.col("up")).cast("int")
    return s.select("label", side.alias("side"), "up", "x", (F.col("r") + 1 - down).alias("y0"), (F.col("r") + down).alias("y1"))


def successors(of: DataFrame) -> DataFrame:
    """side, next: the upright side that follows each.

    Two ends at one place are one side that ends and one that begins, which follow each other, or a corner that
    two cells of the body touch.  There rings part: they turn left, so that a shell does not run into its hole.
    """
    ends = F.array(F.struct(F.lit(False).alias("ends"), F.col("y0").alias("y")), F.struct(F.lit(True).alias("ends"), F.col("y1").alias("y")))
    event = of.select("label", "side", "up", "x", F.explode(ends).alias("e")).select("label", "side", "up", "x", "e.ends", "e.y")
    place = event.groupBy("label", "y", "x").agg(F.max(F.when(F.col("ends"), F.col("side"))).alias("done"), F.max(F.when(~F.col("ends"), F.col("side"))).alias("begun"), F.sort_array(F.collect_list(F.struct((~F.col("up")).alias("down"), "side", "ends"))).alias("at"))  # two at most
    place = written(place, "ring-places")
    straight = place.where("done IS NOT NULL AND begun IS NOT NULL").select(F.col("done").alias("side"), F.col("begun").alias("next"))
    turns = place.where("done IS NULL OR begun IS NULL").select("label", "y", "x", F.posexplode("at").alias("i", "at"))
    nth = F.row_number().over(W.partitionBy("label", "y").orderBy("x", "i"))
    turns = turns.withColumn("stretch", F.floor((nth - 1) / 2))
    along = turns.groupBy("label", "y", "stretch").agg(F.max(F.when(F.col("at.ends"), F.col("at.side"))).alias("side"), F.max(F.when(~F.col("at.ends"), F.col("at.side"))).alias("next"))
    return straight.select("side", "next", F.lit(True).alias("straight")).union(along.select("side", "next", F.lit(False)))


def ringed(runs: DataFrame, grid: Grid) -> DataFrame:
    """label, side, up, x, y0, y1, straight, ring, rank of the upright sides of runs (label, r, c0, c1) of 4-connected bodies.

    A ring is known by its least side, the one of rank 0: of the topmost row, and in that leftmost.  No runs, no rows.
    """
    of = written(sides(runs, grid), "sides")
    links = written(successors(of), "ring-links")
    ranks = cycles(links.select(F.col("side").alias("node"), "next")).withColumnRenamed("node", "side")
    return written(of.join(shuffled(links.select("side", "straight")), "side").join(shuffled(ranks), "side"), "rings")


def ring_vertices(rings: DataFrame) -> DataFrame:
    """label, ring, pos, x, y: the corners of each ring in order, one at every row an upright stretch passes, none within a level one."""
    start, end = F.struct(F.lit(0).alias("k"), F.col("y0").alias("y")), F.struct(F.lit(1).alias("k"), F.col("y1").alias("y"))
    each = rings.select("label", "ring", "rank", "x", F.explode(F.when(F.col("straight"), F.array(start)).otherwise(F.array(start, end))).alias("v"))
    return each.select("label", "ring", (F.col("rank") * 2 + F.col("v.k")).alias("pos"), "x", F.col("v.y").alias("y"))


def ring_areas(rings: DataFrame) -> DataFrame:
    """label, ring, vertices, area, shell: the area in cells is what lies left of sides walked down, less what lies left of those walked up; a hole's is negative."""
    x = F.col("x").cast("bigint")
    out = rings.groupBy("label", "ring").agg(F.sum(F.when(F.col("straight"), 1).otherwise(2)).alias("vertices"), F.sum(F.when(F.col("up"), -x).otherwise(x)).alias("area"))
    return out.withColumn("shell", F.col("area") > 0)


def closed(vertices: DataFrame) -> DataFrame:
    """ring, pos, x, y with each ring's first vertex again at its end."""
    v = vertices.select("ring", "pos", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    ends = v.groupBy("ring").agg(F.min(F.struct("pos", "x", "y")).alias("first"), F.max("pos").alias("last"))
    return v.unionByName(ends.select("ring", (F.col("last") + 1).alias("pos"), "first.x", "first.y"))


def simplify(path: DataFrame, tolerance: float, stretch: int = STRETCH) -> DataFrame:
    """ring, pos, x, y: each path by Douglas-Peucker; its ends stay, and of equally far vertices the first is kept.

    A round finds the farthest vertex of every long stretch by a partial aggregate and cuts there.  Stretches of at most
    `stretch` inner vertices leave the rounds and are finished one by one, each in one task.
    """
    path = written(path.select("ring", "pos", "x", "y"), "paths")
    ends = written(path.groupBy("ring").agg(F.min(F.struct("pos", "x", "y")).alias("a"), F.max(F.struct("pos", "x", "y")).alias("b")), "path-ends")
    kept = ends.select("ring", "a.pos", "a.x", "a.y").union(ends.where("a.pos < b.pos").select("ring", "b.pos", "b.x", "b.y"))
    rest = written(path.join(ends, "ring").where("pos > a.pos AND pos < b.pos"), "stretches")
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    length = F.sqrt(dx * dx + dy * dy)
    px, py = F.col("x") - F.col("a.x"), F.col("y") - F.col("a.y")
    away = F.when(length > 0, F.abs(dx * py - dy * px) / F.when(length > 0, length)).otherwise(F.sqrt(px * px + py * py))
    short = []
    while True:
        count = written(rest.groupBy("ring", F.col("a.pos").alias("from")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(away.alias("d"), (-F.col("pos")).alias("back"), "x", "y")).alias("far")), "farthest")
        at = rest.withColumn("from", F.col("a.pos"))
        short.append(at.join(count.where(F.col("n") <= stretch).select("ring", "from"), ["ring", "from"], "left_semi"))
        cut = count.where((F.col("n") > stretch) & (F.col("far.d") > tolerance)).select("ring", "from", F.struct((-F.col("far.back")).alias("pos"), "far.x", "far.y").alias("m"))
        if not cut.limit(1).count():
            break
        kept = kept.union(cut.select("ring", "m.pos", "m.x", "m.y"))
        both = at.join(cut, ["ring", "from"]).where(F.col("pos") != F.col("m.pos"))
        before = F.col("pos") < F.col("m.pos")
        rest = written(both.select("ring", "pos", "x", "y", F.when(before, F.col("a")).otherwise(F.col("m")).alias("a"), F.when(before, F.col("m")).otherwise(F.col("b")).alias("b")), "stretches")

    def finish(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        first = part.iloc[0]
        points = [(first.ax, first.ay), *zip(part["x"], part["y"], strict=True), (first.bx, first.by)]
        keep = simplified([(x, y, i) for i, (x, y) in enumerate(points)], tolerance)[1:-1]
        return part.iloc[[i - 1 for _, _, i in keep]][["ring", "pos", "x", "y"]]

    for s in short:
        flat = s.select("ring", "from", "pos", "x", "y", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))
        kept = kept.union(flat.groupBy("ring", "from").applyInPandas(finish, "ring bigint, pos bigint, x double, y double"))
    return kept


def valley(dem: DataFrame, grid: Grid, cap_m: float) -> tuple[DataFrame, DataFrame]:
    """The verdict on the largest body strictly below the cap, and the vertices of its shell.

    Verdict: label, cells, vertices, on_border, ok.  The body is no enclosed valley if its shell has a corner of the grid, or if
    over 35 % of the vertices, the first one counted again as the last, lie within half a cell's longer side of the border.
    Vertices: ring, pos, x, y, grid lines from the west and north.  Ties between bodies go to the lower label; no body, no rows.
    """
    runs = written(labelled_runs(dem.where(F.col("elev") < cap_m), grid), "bodies")
    first = runs.groupBy("label").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("cells")).orderBy(F.desc("cells"), "label").limit(1)
    first = written(first, "body")
    rings = ringed(runs.join(F.broadcast(first.select("label")), "label"), grid)
    shell = F.broadcast(ring_areas(rings).where("shell").select("ring"))  # one row
    vertices = written(ring_vertices(rings).join(shell, "ring", "left_semi"), "shell")
    eps = max(grid.res_lng, grid.res_lat) / 2
    near = lambda at, n, res: F.least(at * res, (n - at) * res) <= eps
    on_border = near(F.col("x"), grid.ncols, grid.res_lng) | near(F.col("y"), grid.nrows, grid.res_lat)
    corner = F.col("x").isin(0, grid.ncols) & F.col("y").isin(0, grid.nrows)
    again = vertices.unionByName(vertices.where("pos = 0"))
    counts = again.groupBy("label").agg(F.count(F.lit(1)).alias("vertices"), F.count_if(on_border).alias("on_border"), F.max(corner).alias("corner"))
    ok = ~F.col("corner") & (F.col("on_border") <= 0.35 * F.col("vertices"))
    return first.join(F.broadcast(counts), "label").select("label", "cells", "vertices", "on_border", ok.alias("ok")), vertices.select("ring", "pos", "x", "y")


def placed(vertices: DataFrame, grid: Grid) -> DataFrame:
    """Grid lines as degrees."""
    return vertices.withColumns({"lng": F.lit(grid.min_lng) + F.col("x") * F.lit(grid.res_lng), "lat": F.lit(grid.max_lat) - F.col("y") * F.lit(grid.res_lat)})


def valley_line(dem: DataFrame, grid: Grid, cap_m: float) -> DataFrame:
    """pos, lng, lat of an enclosed valley's rim, closed, simplified at four cells; without such a valley no rows."""
    verdict, vertices = valley(dem, grid, cap_m)
    line = placed(closed(vertices), grid).select("ring", "pos", F.col("lng").alias("x"), F.col("lat").alias("y"))
    found = verdict.where("ok").limit(1).count()
    return simplify(line.where(F.lit(bool(found))), 4 * max(grid.res_lng, grid.res_lat)).select("pos", F.col("x").alias("lng"), F.col("y").alias("lat"))


def nested(rings: DataFrame) -> DataFrame:
    """ring, label, shell, parent, depth: the ring that directly encloses each, null for none, and how many enclose it.

    Left of a shell's first side is a gap; the side before it in its row ends the run before the gap.  If that side is a hole's, the shell lies
    in that hole; if it is a shell's, both lie in the same hole or in none, and the question passes on to it.  A hole
    lies in its body's shell.  Both chains are followed by pointer doubling.
    """
    shape = written(ring_areas(rings).select("ring", "label", "shell"), "ring-shapes")
    row = W.partitionBy(F.least("y0", "y1")).orderBy("x")
    before = rings.withColumn("near", F.lag("ring").over(row)).where("rank = 0").select("ring", "near")
    shells = shape.where("shell").join(shuffled(before), "ring").select("ring", "near")
    holes = shape.where("NOT shell")
    asked = written(shells, "ring-parents")
    while asked.join(shuffled(shells.select(F.col("ring").alias("near"))), "near", "left_semi").limit(1).count():
        on = asked.select(F.col("ring").alias("near"), F.col("near").alias("then"), F.lit(True).alias("on"))
        asked = written(asked.join(shuffled(on), "near", "left").select("ring", F.when(F.col("on"), F.col("then")).otherwise(F.col("near")).alias("near")), "ring-parents")
    outer = shape.where("shell").select("label", F.col("ring").alias("parent"))
    parents = asked.select("ring", F.col("near").alias("parent")).union(holes.join(shuffled(outer), "label").select("ring", "parent"))
    parents = written(parents, "ring-parents")
    depth = chains(parents.select(F.col("ring").alias("node"), F.col("parent").alias("up")))
    return shape.join(shuffled(parents), "ring").join(shuffled(depth.select(F.col("node").alias("ring"), F.col("depth").cast("int").alias("depth"))), "ring")
