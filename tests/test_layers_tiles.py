"""Tiles and layers without SQL, against plain readers and rules."""

import difflib
import gzip
import json
import math
import struct

import numpy as np
import pytest

from compare import DATA
from ridgeline.functions.images import pixels_of
from ridgeline.operators import elements, tiles, waters
from ridgeline.plans import layers as P
from ridgeline.plans import tiles as Q
from ridgeline.sources import layers as L
from ridgeline.sources import tables as T

SF = str(DATA / "sf0.001")


def fields(data: bytes):
    """(number, value) of a protobuf message."""
    at = 0

    def number():
        nonlocal at
        n = shift = 0
        while True:
            x = data[at]
            at += 1
            n |= (x & 127) << shift
            shift += 7
            if x < 128:
                return n

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        elif tag & 7 == 1:
            yield tag >> 3, struct.unpack("<d", data[at : at + 8])[0]
            at += 8
        else:
            n = number()
            yield tag >> 3, data[at : at + n]
            at += n


def numbers(data: bytes) -> list[int]:
    return [v for _, v in fields(b"".join(b"\x08" + bytes(g) for g in split(data)))]


def split(data: bytes):
    one = []
    for x in data:
        one.append(x)
        if x < 128:
            yield one
            one = []


def test_vector_tile_gives_back_its_footprints(spark):
    rings = Q.footprint_rings(spark, SF).where("z = 14").collect()
    got = {(r.z, r.x, r.y): r for r in Q.building_tile_mvt(spark, SF).where("z = 14").collect()}
    assert sum(t.features for t in got.values()) == len(rings)
    seen, holes = {}, 0
    for (_, x, y), t in got.items():
        ((n, layer),) = fields(gzip.decompress(t.mvt))
        assert n == 3
        parts = list(fields(layer))
        keys = [v.decode() for k, v in parts if k == 3]
        values = [next(fields(v))[1] for k, v in parts if k == 4]
        assert [v for k, v in parts if k == 15] == [2] and [v for k, v in parts if k == 5] == [4096]
        for f in (dict(fields(v)) for k, v in parts if k == 2):
            tags = numbers(f[2])
            props = {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2], strict=True)}
            drawn = rings_of(numbers(f[4]))
            for k, ring in enumerate(drawn):
                area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
                assert (area > 0) == (k == 0) and area
            holes += len(drawn) - 1
            seen[f[1]] = (x, y, drawn, props["height"], props["color"].decode(), props.get("name", b"").decode())
    for r in rings:
        at, drawn = [0, 0], []
        for ring in r.moves:
            drawn.append([])
            for m in ring:
                at = [at[0] + m.dx, at[1] + m.dy]
                drawn[-1].append(tuple(at))
        assert seen[r.id] == (r.x, r.y, drawn, r.height, r.color, r.name)
    assert holes > 20


def rings_of(commands: list[int]) -> list[list[tuple[int, int]]]:
    """Places that the pen of a polygon goes through, ring by ring."""
    out, at, x, y = [], 0, 0, 0
    while at < len(commands):
        kind, count = commands[at] & 7, commands[at] >> 3
        at += 1
        if kind == 1:
            out.append([])
        if kind == 7:
            continue
        for _ in range(count):
            dx, dy = ((v >> 1) ^ -(v & 1) for v in commands[at : at + 2])
            x, y, at = x + dx, y + dy, at + 2
            out[-1].append((x, y))
    return out


def square(x: float, y: float, half: float, back: bool = False) -> list[dict]:
    ring = [(x - half, y - half), (x + half, y - half), (x + half, y + half), (x - half, y + half), (x - half, y - half)]
    return [{"lng": a, "lat": b} for a, b in (ring[::-1] if back else ring)]


def test_rings_that_collapse(spark):
    """A hole of no size drops alone; an outer ring of none takes its holes along; both windings come out alike."""
    from ridgeline.functions import tiles as M

    shapes = [(1, [square(10.0, 10.0, 1.0), square(10.0, 10.0, 0.5)]), (2, [square(10.0, 10.0, 1.0, True), square(10.0, 10.0, 0.5, True), square(10.0, 10.0, 1e-9)]), (3, [square(10.0, 10.0, 1e-9), square(10.0, 10.0, 0.5)]), (4, [[]]), (5, [])]
    df = spark.createDataFrame([(k, 10.0, 10.0, r, 3.0, "c", "") for k, r in shapes], "id bigint, lng double, lat double, rings array<array<struct<lng: double, lat: double>>>, height double, color string, name string")
    df = df.withColumns({"cx": M.mercator_x(df.lng), "cy": M.mercator_y(df.lat)})
    got = {r.id: [len(m) for m in r.moves] for r in tiles.tile_rings(df, (5,)).collect()}
    assert got == {1: [4, 4], 2: [4, 4]}


def test_terrain_tiles_hold_the_samples(spark):


    dem = {(r.r, r.c): r.elev for r in T.dem(spark, SF).collect()}
    g = T.dem_grid(T.dem(spark, SF))
    rows = Q.terrain_tile_png(spark, SF).collect()
    assert rows
    for t in rows[:2]:
        rgb = pixels_of(t.png)
        assert rgb.shape == (256, 256, 3)
        for py, px in ((0, 0), (17, 200), (255, 255), (128, 3)):
            lng = (t.x + (px + 0.5) / 256) / 2**t.z * 360 - 180
            lat = math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (t.y + (py + 0.5) / 256) / 2**t.z))))
            y, x = (g.max_lat - lat) / g.res_lat - 0.5, (lng - g.min_lng) / g.res_lng - 0.5
            r, c = math.floor(y), math.floor(x)
            at = lambda i, j: dem[min(max(i, 0), g.nrows - 1), min(max(j, 0), g.ncols - 1)]
            want = (at(r, c) * (1 - x + c) + at(r, c + 1) * (x - c)) * (1 - y + r) + (at(r + 1, c) * (1 - x + c) + at(r + 1, c + 1) * (x - c)) * (y - r)
            red, green, blue = map(int, rgb[py, px])
            assert abs(red * 256 + green + blue / 256 - 32768 - want) <= 1 / 256


def test_reprojected_grid_is_near_the_grid(spark):
    """Twice sampled, a cell lies within the range of the cells around it, and far cells keep their order of height."""
    dem = {(r.r, r.c): r.elev for r in T.dem(spark, SF).collect()}
    got = {(r.r, r.c): r.elev for r in Q.dem_reproject(spark, SF).collect()}
    assert got.keys() == dem.keys()
    for (r, c), e in got.items():
        around = [v for (i, j), v in dem.items() if abs(i - r) <= 1 and abs(j - c) <= 1]
        assert e is not None and min(around) - 0.01 <= e <= max(around) + 0.01


def test_roads_are_simplified(spark):
    """Every vertex that was left out lies within the tolerance of the line that stays."""
    rows = P.elements(spark, SF)
    tolerance = 5e-3
    kept = {r.id: [(p.lng, p.lat) for p in r.line] for r in elements.roads(rows, P.BOUNDS, tolerance).collect()}
    paths = {r.id: [(p.lng, p.lat) for p in r.path] for r in rows.collect()}
    assert kept and sum(map(len, kept.values())) < sum(len(paths[k]) for k in kept)

    def off(p, a, b):
        (x, y), (x0, y0), (x1, y1) = p, a, b
        n = math.hypot(x1 - x0, y1 - y0)
        return abs((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) / n if n else math.hypot(x - x0, y - y0)

    for k, line in kept.items():
        near = lambda p, q: math.hypot(p[0] - q[0], p[1] - q[1]) < 1e-5
        assert near(line[0], paths[k][0]) and near(line[-1], paths[k][-1])
        for p in paths[k]:
            assert min(off(p, a, b) for a, b in zip(line, line[1:], strict=False)) <= tolerance + 2e-5


def test_layers_that_are_not_there(spark):
    f = P.facility_layer(spark, SF)
    with pytest.raises(ValueError):
        L.layer(f, "city-1", "trees")
    with pytest.raises(LookupError):
        L.layer(f, "city-1", "rim")
    with pytest.raises(LookupError):
        L.city(P.city_rows(spark, SF), "city-99")


def test_files_of_features(spark, tmp_path):
    f = P.facility_layer(spark, SF)
    L.write_features(f, str(tmp_path / "lines"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "lines")).collect()]
    assert len(lines) == f.count() and all(x["geometry"]["type"] == "Point" for x in lines)
    (tmp_path / "whole.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": lines}))
    again = L.parsed(L.read_collection(spark, str(tmp_path / "whole.geojson")))
    assert {r.properties["id"] for r in again.collect()} == {str(x["properties"]["id"]) for x in lines}


def test_many_part_geometries(spark):
    shapes = [
        {"type": "MultiPolygon", "coordinates": [[[[0, 0], [4, 0], [4, 1], [1, 1], [1, 4], [0, 4], [0, 0]]], [[[9, 9], [10, 9], [10, 10], [9, 9]]]]},
        {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3], [4, 4]]]}, {"type": "Point", "coordinates": [5, 6]}, None,
    ]
    rows = L.parsed(spark.createDataFrame([(k, json.dumps({"type": "Feature", "properties": None, "geometry": s})) for k, s in enumerate(shapes)], "seq int, json string"))
    got = {r.seq: r for r in rows.select("seq", L.paths(rows.geometry).alias("paths"), L.exposure_point(rows.geometry, rows.properties).alias("p")).collect()}
    assert [len(p) for p in got[0].paths] == [7, 4] and [len(p) for p in got[1].paths] == [2, 3] and got[2].paths == [[[5.0, 6.0]]] and got[3].paths is None
    x, y = got[0].p
    assert (0 < x < 4 and 0 < y < 1) or (0 < x < 1 and 0 < y < 4)
    assert tuple(got[2].p) == (5.0, 6.0)


def test_like_stems_against_all_pairs(spark):
    import random
    from itertools import combinations

    rng = random.Random(2)
    base = ["bagmati", "bisnumati", "seti gandak", "manohara", "abcd", "ab", "a", "dobi"]
    known = sorted({"".join(c for c in b if rng.random() > 0.08) + rng.choice(("", "", "i", "a", " x")) for b in base for _ in range(12)} - {""})
    got = {(r.a, r.b) for r in waters.like_stems(spark.createDataFrame([(s, s) for s in known], "name string, stem string")).collect()}
    like = lambda a, b: a.startswith(b) or b.startswith(a) or (min(len(a), len(b)) >= 4 and difflib.SequenceMatcher(None, a, b).ratio() >= 0.85)
    assert got == {(a, b) for a, b in combinations(known, 2) if like(a, b)}
    assert len(got) > 30


def test_stems_of_odd_names(spark):
    names = ["  Bagmati  River ", "Khola", "Chhahare (x) khola", "M\u00e1nohara", "\u092e\u0928\u094b\u0939\u0930\u093e", "", "   ", None, "12 34", "(a)", "Ghat\tPhewa", "\u00c9", "river river"]
    got = {r.name: r.stem for r in waters.stems(spark.createDataFrame([(n,) for n in names + names], "name string")).collect()}
    assert got == {
        "  Bagmati  River ": "bagmati", "Khola": "kola", "Chhahare (x) khola": "chahare", "M\u00e1nohara": "manohara", "\u092e\u0928\u094b\u0939\u0930\u093e": "\u092e\u0928\u094b\u0939\u0930\u093e", "": None, "   ": None, None: None,
        "12 34": "12 34", "(a)": "(a)", "Ghat\tPhewa": "gat fewa", "\u00c9": "\u00e9", "river river": "river river",
    }


@pytest.mark.parametrize("at_once", [10**9, 50, 0])
def test_near_ends_against_all_pairs(spark, at_once, monkeypatch):
    """Cells that hold a pair of near ends, however far they are cut; some ends lie as far apart as the limit."""
    monkeypatch.setattr(waters, "DEEPEST", 4)
    rng = np.random.default_rng(4)
    xy = np.concatenate([rng.random((150, 2)) * 0.9, [[0.0, 0.5], [waters.NEAR_M / 111320.0, 0.5], [5.0, 5.0]]])
    cluster = ["a" if k % 3 else "b" for k in range(len(xy))]
    ends = spark.createDataFrame([(c, float(x), float(y)) for c, (x, y) in zip(cluster, xy, strict=True)] * 2, "cluster string, lng double, lat double").distinct()
    want = set()
    cell = np.floor(xy / waters.SIDE).astype(int)
    for i in range(len(xy)):
        for j in range(len(xy)):
            step = tuple(cell[j] - cell[i])
            if cluster[i] == cluster[j] and step > (0, 0) and max(map(abs, step)) <= 2 and math.hypot(*(xy[i] - xy[j])) * 111320.0 <= waters.NEAR_M:
                want.add((cluster[i], *cell[i].tolist(), *cell[j].tolist()))
    got = [tuple(r) for r in waters.near_cells(ends, at_once).collect()]
    assert sorted(got) == sorted(want)


def test_pack_is_made_anew_when_its_source_grows(spark, tmp_path):
    from ridgeline.sources.packs import packed

    made = []

    def make(df):
        made.append(1)
        return df.select("id")

    source, pack = str(tmp_path / "source"), f"file://{tmp_path}/pack"
    spark.range(10).write.parquet(source)
    read = lambda version=1: packed(spark, spark.read.parquet(source), pack, make, version).count()
    assert [read(), read(), len(made)] == [10, 10, 1]
    spark.range(5).write.mode("append").parquet(source)
    assert [read(), read(2), len(made)] == [15, 15, 3]


def test_features_of_a_batch_are_those_made_one_by_one():
    """Holes, large and negative steps, no name, and ids that are left out."""
    import numpy as np
    import pyarrow as pa
    from ridgeline.functions.messages import Message, packed, zigzag
    from ridgeline.operators import tiles as O

    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        rings = [[{"dx": int(x), "dy": int(y)} for x, y in rng.integers(-(10 ** int(rng.integers(1, 9))), 10**3, (int(n), 2))] for n in rng.integers(3, 9, int(rng.integers(1, 4)))]
        rows.append({"id": (None, -4, 0, 2**40 + k)[k % 4], "height": k * 5, "color": 2**14 + k, "name": None if k % 3 == 0 else 300 + k, "moves": rings})
    kind = pa.schema([("id", pa.int64()), ("height", pa.int64()), ("color", pa.int64()), ("name", pa.int64()), ("moves", pa.list_(pa.list_(pa.struct([("dx", pa.int64()), ("dy", pa.int64())]))))])
    want = []
    for row in rows:
        pen = []
        for ring in row["moves"]:
            steps = zigzag([v for m in ring for v in (m["dx"], m["dy"])]).tolist()
            pen += [9, *steps[:2], (len(ring) - 1) << 3 | 2, *steps[2:], 15]
        own = Message() if row["id"] is None or row["id"] < 0 else Message().number(1, row["id"])
        tags = [0, row["height"], 1, row["color"], *([] if row["name"] is None else [2, row["name"]])]
        want.append(own.data(2, packed(tags)).number(3, 3).data(4, packed(pen)).bytes())
    batch = pa.RecordBatch.from_pylist(rows, schema=kind)
    assert O.features(batch).to_pylist() == want and O.features(batch.slice(7, 20)).to_pylist() == want[7:27] and len(O.features(batch.slice(0, 0))) == 0


def test_rings_are_made_by_many_tasks(spark):
    """Buildings in one small file were all one task's."""
    from pyspark.sql import functions as F

    assert Q.footprint_rings(spark, SF).select(F.spark_partition_id().alias("p")).distinct().count() > 4
