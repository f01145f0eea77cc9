"""Assets by stretches against all samples along them."""

import numpy as np
from ridgeline.operators import exposure, quake


def rows(spark, seed=4):
    """Stretches near and far of an epicentre, some across it, some of no length or place, one over half the globe."""
    rng = np.random.default_rng(seed)
    a, d = rng.normal([85.3, 27.6], [0.8, 0.5], (300, 2)), rng.normal(0, 1, (300, 2)) * rng.choice([0.01, 0.3, 2.0], (300, 1))
    made = [("roads", f"r{i % 120}", "n", float(x), float(y), float(u), float(v), int(rng.integers(1, 400))) for i, ((x, y), (u, v)) in enumerate(zip(a, d, strict=True))]
    made += [("buildings", "p", None, 85.3, 27.6, 0.0, 0.0, 0), ("buildings", "lost", None, None, 27.6, None, 0.0, 1), ("roads", "globe", None, -40.0, -80.0, 170.0, 140.0, 3000)]
    return spark.createDataFrame(made, "kind string, id string, name string, lng double, lat double, dx double, dy double, n int")


def test_bands_of_stretches_are_those_of_samples(spark):
    parts = rows(spark)
    for scenario in ((85.31, 27.645, 6.5, 10.0), (85.0, 27.0, 9.5, 0.0), (86.0, 28.0, 40.0, 5.0)):
        found, want = (sorted(map(tuple, quake.exposed(p, *scenario).collect()), key=repr) for p in (parts, exposure.sampled(parts)))
        assert found == want and len({r[3] for r in found}) > 1
    s = spark.createDataFrame([(1, 85.31, 27.645, 6.5, 10.0), (2, 86.9, 28.3, 7.5, 1.0), (3, None, 1.0, 6.0, 1.0)], "scenario int, lng double, lat double, magnitude double, depth_km double")
    a, b = (sorted(map(tuple, quake.sweep(p, s, lines=True).collect())) for p in (parts, exposure.sampled(parts).drop("k")))
    assert a == b


def test_a_stretch_of_many_samples(spark):
    """Two hundred million samples, which only a search gets through; the nearest one alone is in the highest band."""
    one = spark.createDataFrame([("roads", "1", "n", 80.0, 27.0, 10.0, 1.0, 200_000_000)], "kind string, id string, name string, lng double, lat double, dx double, dy double, n int")
    assert quake.exposed(one, 85.3, 27.53, 8.0, 0.0).first().band == "high"


def test_cells_of_lines_are_made_by_many_tasks(spark):
    """Lines of a few bytes with many cells are dealt out; in one task they took memory for all of them."""
    from pyspark.sql import functions as F
    from ridgeline.functions.grid import Grid
    from ridgeline.operators import terrain

    made = [(i, [{"lng": 0.5, "lat": 999.5}, {"lng": 3.5, "lat": float(i)}, {"lng": 0.5, "lat": 999.5}]) for i in range(40)]
    lines = spark.createDataFrame(made, "id bigint, path array<struct<lng: double, lat: double>>").coalesce(1)
    cells = terrain.walked(lines, Grid(1000, 4, 0.0, 0.0, 1.0, 1.0))
    assert cells.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert cells.distinct().count() == terrain.polyline_cells(lines, Grid(1000, 4, 0.0, 0.0, 1.0, 1.0)).count()


def test_wet_assets_of_stretches_are_those_of_samples(spark, monkeypatch):
    """Tiles of 7 by 16 cells; lines across them, beyond the raster, along wet cells, of one sample, and without a place."""
    from pyspark.sql import functions as F
    from ridgeline.functions.grid import Grid
    from ridgeline.operators import wetness

    monkeypatch.setattr(wetness, "CELLS", 112)
    monkeypatch.setattr(wetness, "COLUMNS", 16)
    monkeypatch.setattr(wetness, "TOGETHER", 50)
    grid, rng = Grid(60, 50, 84.0, 26.5, 0.05, 0.04), np.random.default_rng(8)
    for share in (0.0, 0.01, 0.2):
        wet = spark.createDataFrame([(int(r), int(c)) for r, c in np.argwhere(rng.random((60, 50)) < share)] + [(32, 49)], "r int, c int")
        parts = rows(spark, 5)
        want = exposure.with_cell(exposure.sampled(parts), grid).join(wet, ["r", "c"], "left_semi").groupBy("kind", "id").agg(F.first("name").alias("name"))
        for asked in (parts, exposure.sampled(parts).drop("k")):
            found = sorted(map(tuple, exposure.affected(asked, wet, grid).collect()))
            assert found == sorted(map(tuple, want.collect())) and ("buildings", "lost", None) in found
    assert exposure.affected(parts, wet.limit(0), grid).count() == 0


def test_a_wet_cell_among_many_samples(spark):
    """Two hundred million samples beside water, of which some two touch it: going through them took minutes and gigabytes."""
    from ridgeline.functions.grid import Grid

    grid = Grid(1_000_000, 4, 80.0, 20.0, 1.0, 1e-5)
    one = spark.createDataFrame([("roads", "1", "n", 80.5, 21.0, 2.0, 8.0, 200_000_000), ("roads", "2", "n", 82.5, 21.0, 0.5, 8.0, 200_000_000)], "kind string, id string, name string, lng double, lat double, dx double, dy double, n int")
    wet = spark.createDataFrame([(500_000, c) for c in (0, 1)] + [(400_000 + k, 3) for k in range(5)], "r int, c int")
    assert [r.id for r in exposure.affected(one, wet, grid).collect()] == ["1"]


def test_line_cells_are_those_of_the_paths_and_not_made_segment_by_segment(spark):
    from ridgeline.functions.grid import Grid
    from ridgeline.operators import terrain

    rng = np.random.default_rng(5)
    for rows, columns, block in ((300, 7, 16), (5, 90, 4096), (40, 40, 7)):
        grid = Grid(rows, columns, 0.0, 0.0, 1.0, 1.0)
        paths = [[(float(x), float(y)) for x, y in zip(rng.uniform(-2, columns + 2, n), rng.uniform(-2, rows + 2, n), strict=True)] for n in rng.integers(0, 6, 12)]
        paths += [[(3.5, 2.5), (3.5, 2.5)], [(0.5, 0.5), (0.5, rows - 0.5)], [(None, 1.5), (2.5, None)], None]
        lines = spark.createDataFrame(list(enumerate(paths)), "id bigint, path array<struct<lng: double, lat: double>>")
        want = {(x.r, x.c) for x in terrain.polyline_cells(lines, grid).collect()}
        found = [(x.r, x.c) for x in terrain.line_cells(lines, grid, block).collect()]
        assert len(found) == len(set(found)) and set(found) == want
    # 20,000 segments down all of 20,000 rows would make 400 million cells.
    lines = spark.range(20_000).selectExpr("id", "array(struct(0.5D AS lng, 0.5D AS lat), struct(2.5D AS lng, 19999.5D AS lat)) AS path")
    assert terrain.line_cells(lines, Grid(20_000, 3, 0.0, 0.0, 1.0, 1.0)).count() == 20_000
