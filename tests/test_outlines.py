"""Rings, simplification and drawn polygons against plain versions."""

import json
import random

import pytest

from compare import DATA
from ridgeline.functions.grid import Grid
from ridgeline.operators import outlines, regions
from ridgeline.plans import QUERIES, areas

GRID = Grid(12, 14, 85.0, 27.0, 0.5, 0.25)


def plain_rings(cells: set) -> list[list[tuple]]:
    """Unit sides with the cell on the right, chained; where two leave a corner, the left one is taken."""
    ways: dict = {}
    for r, c in cells:
        for beyond, a, b in (((r - 1, c), (c, r), (c + 1, r)), ((r, c + 1), (c + 1, r), (c + 1, r + 1)), ((r + 1, c), (c + 1, r + 1), (c, r + 1)), ((r, c - 1), (c, r + 1), (c, r))):
            if beyond not in cells:
                ways.setdefault(a, []).append(b)
    out = []
    while ways:
        a = min(ways)
        ring, came = [], None
        while a in ways:
            left = (came[1], -came[0]) if came else None
            b = min(ways[a], key=lambda b: (b[0] - a[0], b[1] - a[1]) != left)
            ways[a].remove(b)
            if not ways[a]:
                del ways[a]
            ring.append(a)
            came, a = (b[0] - a[0], b[1] - a[1]), b
        out.append(ring)
    return out


def area(ring: list[tuple]) -> float:
    return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def bodies(cells: set) -> list[set]:
    left, out = set(cells), []
    while left:
        body, todo = set(), [min(left)]
        while todo:
            r, c = todo.pop()
            if (r, c) in left:
                left.remove((r, c))
                body.add((r, c))
                todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
        out.append(body)
    return out


SHAPES = {
    "none": set(), "one": {(3, 4)}, "all": {(r, c) for r in range(12) for c in range(14)},
    "pinch": {(1, 1), (1, 2), (2, 1), (2, 3), (3, 2), (3, 3), (3, 1), (1, 3)} - {(2, 2)} | {(5, 5), (6, 6), (5, 7), (6, 5)},
    "diagonal": {(1, 1), (2, 2), (1, 3), (3, 3), (4, 2)},
    "nested": {(r, c) for r in range(9) for c in range(9) if max(abs(r - 4), abs(c - 4)) % 2 == 0},
    "touching hole": {(0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (2, 1), (2, 0), (2, 2)} - {(2, 2)} | {(2, 3), (1, 3)},
    "random": {(r, c) for r in range(12) for c in range(14) if random.Random(r * 31 + c).random() < 0.6},
}


def runs_of(spark, cells: set):
    return regions.labelled_runs(spark.createDataFrame(sorted(cells), "r int, c int"), GRID)


@pytest.mark.parametrize("shape", SHAPES)
def test_rings_against_a_walk(spark, shape):
    cells = SHAPES[shape]
    rings = outlines.ringed(runs_of(spark, cells), GRID)
    got: dict = {}
    for v in sorted(outlines.ring_vertices(rings).collect()):
        got.setdefault(v.ring, []).append((v.x, v.y))
    want = [r for b in bodies(cells) for r in plain_rings(b)]
    assert sorted(area(r) for r in want) == sorted(area(r) for r in got.values())
    assert sorted(r.area for r in outlines.ring_areas(rings).collect()) == sorted(area(r) for r in want)
    assert sum(area(r) for r in got.values()) == len(cells)
    upright = lambda ring: {p for a, p, b in zip(ring[-1:] + ring[:-1], ring, ring[1:] + ring[:1], strict=True) if a[0] == p[0] or p[0] == b[0]}
    assert sorted(map(sorted, (upright(r) for r in want))) == sorted(map(sorted, (set(r) for r in got.values())))
    for ring in got.values():
        assert all(a[0] == b[0] or a[1] == b[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def inside(point: tuple, ring: list[tuple]) -> bool:
    """The middle of a cell, by the upright sides of its row to its left."""
    x, y = point
    return sum(1 for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True) if x0 == x1 and min(y0, y1) < y < max(y0, y1) and x0 < x) % 2 == 1


@pytest.mark.parametrize("shape", ["nested", "random", "touching hole", "none"])
def test_nesting(spark, shape):
    rings = outlines.ringed(runs_of(spark, SHAPES[shape]), GRID)
    paths: dict = {}
    for v in sorted(outlines.ring_vertices(rings).collect()):
        paths.setdefault(v.ring, []).append((v.x, v.y))
    starts = {k: (p[0][0] + 0.5, p[0][1] - 0.5) if area(p) > 0 else (p[0][0] + 0.5, p[0][1] + 0.5) for k, p in paths.items()}
    got = {r.ring: (r.parent, r.depth) for r in outlines.nested(rings).collect()}
    assert got.keys() == paths.keys()
    for k, at in starts.items():
        around = [o for o in paths if o != k and inside(at, paths[o])]
        assert got[k][1] == len(around)
        assert got[k][0] == (max(around, key=lambda o: got[o][1]) if around else None)


@pytest.mark.parametrize("stretch", [10**6, 40])
def test_simplified_in_levels(spark, stretch):
    rng = random.Random(5)
    paths = {1: [(float(i), rng.gauss(0, 1)) for i in range(300)], 2: [(float(k % 20), float(k // 20)) for k in range(60)] + [(0.0, 0.0)], 3: [(0.0, 0.0), (1.0, 1.0)], 4: [(5.0, 5.0)], 5: [(float(i), 0.0) for i in range(50)]}
    df = spark.createDataFrame([(k, i, x, y) for k, p in paths.items() for i, (x, y) in enumerate(p)], "ring bigint, pos bigint, x double, y double")
    got: dict = {}
    for r in sorted(outlines.simplify(df, 1.5, stretch).collect()):
        got.setdefault(r.ring, []).append((r.x, r.y))
    assert got == {k: regions.simplified(p, 1.5) for k, p in paths.items()}


def test_no_valley(spark):
    """All below the cap: the shell has the grid's corners.  None below it: no verdict, no line."""
    dem = spark.createDataFrame([(r, c, float(r)) for r in range(12) for c in range(14)], "r int, c int, elev double")
    assert [r.ok for r in outlines.valley(dem, GRID, 100.0)[0].collect()] == [False]
    assert outlines.valley_line(dem, GRID, 100.0).count() == 0 and outlines.valley(dem, GRID, -1.0)[0].count() == 0 and outlines.valley_line(dem, GRID, -1.0).count() == 0


def test_valley_line_against_plain(spark):
    d = str(DATA / "sf0.01")
    dem, g = areas.raster(spark, d)
    verdict, vertices = outlines.valley(dem, g, areas.RIM_M)
    assert verdict.first().ok
    ring = [(g.min_lng + v.x * g.res_lng, g.max_lat - v.y * g.res_lat) for v in sorted(vertices.collect(), key=lambda v: v.pos)]
    want = regions.simplified([*ring, ring[0]], 4 * max(g.res_lng, g.res_lat))
    got = [(v.lng, v.lat) for v in sorted(QUERIES["valley_line"](spark, d).collect())]
    assert len(got) == len(want) > 4 and all(a == pytest.approx(b) for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("query", ["mask_polygons", "quake_zones", "flood_overlay"])
def test_polygons_cover_their_cells(spark, query):
    """A side moves by half a cell at most, so a polygon's area is that of its cells, give or take half the length of its border."""
    d = str(DATA / "sf0.01")
    dem, g = areas.raster(spark, d)
    k = max(1, -(-max(g.nrows, g.ncols) // regions.DISPLAY))
    cell = g.res_lng * k * g.res_lat * k
    rows = QUERIES[query](spark, d).collect()
    assert rows
    for r in rows:
        rings = json.loads(r.geometry)["coordinates"]
        signed = [abs(area([tuple(p) for p in ring[:-1]])) for ring in rings]
        covered = max(signed) * 2 - sum(signed)
        length = sum(abs(a[0] - b[0]) / g.res_lng / k + abs(a[1] - b[1]) / g.res_lat / k for ring in rings for a, b in zip(ring, ring[1:], strict=False))
        assert all(ring[0] == ring[-1] for ring in rings)
        assert abs(covered / cell - r.cells) <= length / 2 + 1e-6
