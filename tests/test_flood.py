"""Laws of the flood kernel, and its step against the joins of terrain.flux_step."""

import numpy as np
import pytest

from ridgeline.operators import flood, terrain


def test_volume_is_kept():
    rng = np.random.default_rng(3)
    elev, depth = rng.random((12, 12)).astype(np.float32), rng.random((12, 12)).astype(np.float32)
    for _ in range(20):
        after = flood.flux(elev, depth)
        assert after.sum() == pytest.approx(depth.sum(), rel=1e-4) and after.min() >= -1e-6
        depth = after


def test_step_equals_joins(spark):
    rng = np.random.default_rng(4)
    elev, depth = rng.random((7, 5)) * 3, np.maximum(0, rng.random((7, 5)) - 0.4)
    rows = [(r, c, float(elev[r, c]), float(depth[r, c])) for r in range(7) for c in range(5)]
    got = terrain.flux_step(spark.createDataFrame(rows, "r int, c int, elev double, depth double")).collect()
    expected = flood.flux(elev.astype(np.float32), depth.astype(np.float32))
    assert all(abs(x.depth - expected[x.r, x.c]) < 1e-5 for x in got) and len(got) == 35


def test_more_rise_floods_more_and_dry_stays_dry(spark):
    dem = spark.createDataFrame([(r, c, float(10 - r)) for r in range(10) for c in range(10)], "r int, c int, elev double")
    plan = spark.createDataFrame([(s, 5, 5, d, 0, 60, 20) for s, d in ((0, 2.0), (1, 20.0))], "scenario int, r int, c int, d_cell double, start int, n_steps int, window int")
    box = spark.createDataFrame([(s, 0, 9, 0, 9) for s in (0, 1, 2)], "scenario int, r0 int, r1 int, c0 int, c1 int")
    wet = {}
    for x in flood.simulate(dem, plan, box).collect():
        wet.setdefault(x.scenario, set()).add((x.r, x.c))
    assert len(wet[1]) >= len(wet[0]) > 0 and 2 not in wet
    assert all(r >= 3 for r, _ in wet[0])


def ramp(spark, n: int = 40):
    rng = np.random.default_rng(7)
    elev = np.add.outer(np.arange(n) * -0.3, np.abs(np.arange(n) - n / 2) * 0.2) + rng.random((n, n))
    dem = spark.createDataFrame([(r, c, float(elev[r, c])) for r in range(n) for c in range(n)], "r int, c int, elev double")
    plan = spark.createDataFrame([(s, 5 + s, 20, 6.0 + s, 3 * s, 30, 10) for s in (0, 1)], "scenario int, r int, c int, d_cell double, start int, n_steps int, window int")
    box = spark.createDataFrame([(0, 0, n - 1, 0, n - 1), (1, 2, n - 3, 1, n - 2)], "scenario int, r0 int, r1 int, c0 int, c1 int")
    return elev, dem, plan, box


def test_tiles_give_what_one_box_gives(spark):
    _, dem, plan, box = ramp(spark)
    rows = lambda df: {(x.scenario, x.r, x.c): x.depth for x in df.collect()}
    whole = rows(flood.simulate(dem, plan, box))
    for tile, steps in ((16, 3), (7, 1), (16, 11)):
        assert rows(flood.simulate(dem, plan, box, tile, steps)) == whole
    assert len(whole) > 100


def test_simulation_against_plain_loops(spark):
    """Cell by cell and step by step, in double precision."""
    n = 24
    elev, dem, plan, box = ramp(spark, n)
    got = {(x.r, x.c): x.depth for x in flood.simulate(dem, plan, box).where("scenario = 0").collect()}
    cells = [(r, c) for r in range(n) for c in range(n)]
    depth, peak = dict.fromkeys(cells, 0.0), dict.fromkeys(cells, 0.0)
    for t in range(30):
        if t < 10:
            depth[5, 20] += 6.0 * 3 / 10 * (2 * t / 10 - 2 * (t / 10) ** 2)
        moved = dict.fromkeys(cells, 0.0)
        for r, c in cells:
            out = {}
            for x, y in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j):
                if (x, y) in depth and (head := elev[r, c] + depth[r, c] - elev[x, y] - depth[x, y]) > 0:
                    out[x, y] = min(0.22 * head, depth[r, c] / 8)
            scale = min(1.0, depth[r, c] / max(sum(out.values()), 1e-6))
            for k, v in out.items():
                moved[k] += v * scale
                moved[r, c] -= v * scale
        depth = {k: depth[k] + moved[k] for k in cells}
        peak = {k: max(peak[k], depth[k]) for k in cells}
    wet = {k: v for k, v in peak.items() if v > 2e-3}
    assert wet and all(abs(got.get(k, 0.0) - v) < 1e-3 for k, v in wet.items())


def test_requests_give_what_the_simulation_gives(spark):
    """The river entry's mask, and a request's statistics and flooded assets, from the peak depths of the same rise."""
    from compare import DATA
    from ridgeline.operators import exposure
    from ridgeline.plans import QUERIES, floods, hazards, terrains

    d = str(DATA / "sf0.001")
    dem, g = terrains.raster(spark, d)
    elev = {(x.r, x.c): x.elev for x in dem.collect()}
    rise = floods.RISES_M.index(terrains.RISE_M)
    peak = {(x.r, x.c): x.depth for x in QUERIES["flood_sim"](spark, d).where(f"scenario = {rise}").collect()}
    river = {(x.r, x.c): x.surface for x in QUERIES["flood_river"](spark, d).collect()}
    assert river == {k: pytest.approx(elev[k] + v, abs=2e-3) for k, v in peak.items() if k[0] < g.nrows / 2} and river
    got = {(x.section, x.item, x.name): x.value for x in QUERIES["flood_request"](spark, d).collect()}
    wet = {k: v for k, v in peak.items() if elev[k] <= hazards.CAP_M}
    assert got["stats", "", "cells_flooded"] == len(wet) and got["stats", "", "max_depth_m"] == pytest.approx(max(wet.values()), abs=6e-3)
    samples = exposure.with_cell(hazards.all_assets(spark, d), g).select("kind", "id", "r", "c").distinct().collect()
    for kind in ("buildings", "roads", "facilities"):
        assert got["exposure", kind, "flooded"] == len({x.id for x in samples if x.kind == kind and (x.r, x.c) in wet})
        assert got["exposure", kind, "total"] == len({x.id for x in samples if x.kind == kind})


def test_a_flood_of_nothing(spark):
    from ridgeline.functions.grid import Grid
    from ridgeline.operators import requests

    dem = spark.createDataFrame([(r, c, 10.0) for r in range(5) for c in range(5)], "r int, c int, elev double")
    assets = spark.createDataFrame([("roads", "1", "n", 85.02, 27.02)], "kind string, id string, name string, lng double, lat double")
    source = spark.createDataFrame([(2, 2)], "r int, c int")
    for mode, level in (("rise", 0.0), ("absolute", 5.0)):
        got = requests.flood(dem, Grid(5, 5, 85.0, 27.0, 0.01, 0.01), assets, source, level, mode)
        assert got["stats"].first().cells_flooded == 0 and got["overlay"].count() == 0 and got["affected"].count() == 0
        assert [tuple(r) for r in got["exposure"].collect()] == [("roads", 0, 1)]
    with pytest.raises(ValueError):
        requests.flood(dem, Grid(5, 5, 85.0, 27.0, 0.01, 0.01), assets, source, 1.0, "fall")
