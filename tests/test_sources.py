"""Map files, rasters, images and numbers in an order, against plain readers and loops."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import images, messages
from ridgeline.functions.grid import Grid
from ridgeline.functions.messages import Message
from ridgeline.operators import blocks, quake, ranks, terrain
from ridgeline.sources import pbf, rasters, tables


def test_numbers_come_back():
    rng = np.random.default_rng(1)
    v = np.concatenate([np.array([0, 1, 127, 128, 2**63, 2**64 - 1], np.uint64), rng.integers(0, 2**63, 500, dtype=np.uint64) >> rng.integers(0, 63, 500, dtype=np.uint64)])
    assert (messages.unpacked(messages.packed(v)) == v).all() and messages.packed([300]) == b"\xac\x02" and len(messages.unpacked(b"")) == 0
    s = np.concatenate([rng.integers(-(2**62), 2**62, 100), [0, -1, 1, -(2**63), 2**63 - 1]])
    assert (messages.unzigzag(messages.zigzag(s)) == s).all() and messages.zigzag([0, -1, 1, -2]).tolist() == [0, 1, 2, 3]


def test_messages_end_where_they_should():
    data = Message().number(1, 5).text(2, "ab").real(3, 1.5).bytes()
    assert [(k, v if k == 1 else bytes(v)) for k, v in messages.fields(data)] == [(1, 5), (2, b"ab"), (3, struct.pack("<d", 1.5))]
    with pytest.raises(ValueError):
        list(messages.fields(Message().text(2, "abc").bytes()[:-1]))


def filtered(pixels: np.ndarray, kinds: list[int]) -> bytes:
    """Rows of bytes with their filters applied one byte after the other."""
    h, w, n = pixels.shape
    flat = pixels.reshape(h, w * n).astype(int)
    out = bytearray()
    for r in range(h):
        out.append(kinds[r])
        for i in range(w * n):
            left = flat[r, i - n] if i >= n else 0
            up = flat[r - 1, i] if r else 0
            corner = flat[r - 1, i - n] if r and i >= n else 0
            p = left + up - corner
            nearest = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            out.append((flat[r, i] - (0, left, up, (left + up) // 2, nearest)[kinds[r]]) % 256)
    return bytes(out)


def file_of(pixels: np.ndarray, kind: int, kinds: list[int], extra: bytes = b"", cut: int = 50) -> bytes:
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    h, w = pixels.shape[:2]
    body = zlib.compress(filtered(pixels, kinds))
    return images.SIGNATURE + part(b"IHDR", struct.pack(">II5B", w, h, 8, kind, 0, 0, 0)) + extra + b"".join(part(b"IDAT", body[i : i + cut]) for i in range(0, len(body), cut)) + part(b"IEND", b"")


@pytest.mark.parametrize(("kind", "n"), [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_images_of_every_filter(kind, n):
    pixels = np.random.default_rng(kind).integers(0, 256, (11, 9, n), dtype=np.uint8)
    for kinds in ([0] * 11, [1] * 11, [2] * 11, [3] * 11, [4] * 11, [k % 5 for k in range(11)]):
        got = images.image_of(file_of(pixels, kind, kinds))
        assert (got[:, :, :3] == (pixels[:, :, :3] if n > 2 else pixels[:, :, :1])).all()
        assert (got[:, :, 3] == (pixels[:, :, -1] if kind in (4, 6) else 255)).all()


def test_images_with_palettes_and_without_reason():
    index = np.random.default_rng(1).integers(0, 3, (4, 5, 1), dtype=np.uint8)
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", 0)
    table = np.array([[1, 2, 3], [4, 5, 6], [7, 8, 9]], np.uint8)
    got = images.image_of(file_of(index, 3, [4] * 4, part(b"PLTE", table.tobytes()) + part(b"tRNS", b"\x00\x80")))
    assert (got[:, :, :3] == table[index[:, :, 0]]).all() and set(got[:, :, 3].ravel().tolist()) <= {0, 128, 255}
    rgb = np.random.default_rng(1).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (images.pixels_of(images.png(rgb)) == rgb).all()
    for bad in (b"no image", file_of(index, 5, [0] * 4)):
        with pytest.raises(ValueError):
            images.image_of(bad)


def test_terrain_tiles_from_files(spark, tmp_path):
    pixels = np.zeros((2, 3, 4), np.uint8)
    pixels[:, :, :3] = [[[128, 10, 128], [128, 0, 0], [0, 0, 0]], [[255, 255, 255], [127, 255, 0], [131, 232, 0]]]
    pixels[:, :, 3] = [[255, 0, 255], [255, 255, 255]]
    (tmp_path / "3" / "1").mkdir(parents=True)
    (tmp_path / "3" / "1" / "2.png").write_bytes(file_of(pixels, 6, [4, 3]))
    got = {(r.z, r.x, r.y, r.py, r.px): r.elev for r in rasters.read_tiles(spark, str(tmp_path)).collect()}
    assert got == {(3, 1, 2, 0, 0): 10.5, (3, 1, 2, 0, 1): None, (3, 1, 2, 0, 2): None, (3, 1, 2, 1, 0): None, (3, 1, 2, 1, 1): -1.0, (3, 1, 2, 1, 2): 1000.0}


@pytest.mark.parametrize("rows", [None, 1, 4])
def test_rasters_come_back(spark, tmp_path, rows):
    grid = Grid(7, 5, 85.0, 27.0, 0.1, 0.2)
    cells = [(r, c, 1.5 * r - c) for r in range(7) for c in range(5) if (r, c) != (3, 3)]
    assert rasters.write(spark.createDataFrame(cells, "r int, c int, elev double"), grid, str(tmp_path), rows) == (1 if rows is None else -(-7 // rows))
    got, meta = rasters.read(spark, str(tmp_path))
    assert {(r.r, r.c): r.elev for r in got.collect()} == {(r, c): e for r, c, e in cells} | {(3, 3): None}
    assert meta == {"min_lng": 85.0, "min_lat": 27.0, "res_lng": 0.1, "res_lat": 0.2}


def blob(body: bytes, plain: bool) -> bytes:
    packed = Message().data(1, body) if plain else Message().number(2, len(body)).data(3, zlib.compress(body))
    header = Message().text(1, "OSMData").number(3, len(packed.bytes())).bytes()
    return struct.pack(">I", len(header)) + header + packed.bytes()


def test_map_files_of_others(spark, tmp_path):
    """Plain blocks, single nodes, an origin and a unit of their own, relations, ways without nodes, and a block of another kind."""
    words = Message()
    for w in ("", "amenity", "clinic", "highway", "primary"):
        words.text(1, w)
    z = lambda *v: messages.packed(messages.zigzag(np.diff(np.array(v), prepend=0)))
    one = lambda v: int(messages.zigzag([v])[0])
    node = Message().number(1, one(7)).data(2, messages.packed([1])).data(3, messages.packed([2])).number(8, one(100)).number(9, one(-200))
    way = lambda id_, *refs: Message().number(1, id_).data(2, messages.packed([3])).data(3, messages.packed([4])).data(8, z(*refs))
    dense = Message().data(1, z(1, 2, -3)).data(8, z(10, 20, 30)).data(9, z(1, 2, 3))
    group = Message().data(1, node).data(2, dense).data(3, way(50, 1, 2, -3)).data(3, way(51, 2, 99)).data(3, way(52)).data(4, b"\x08\x01")
    body = Message().data(1, words).data(2, group).number(17, 1000).number(19, 27 * 10**9).number(20, (1 << 64) - 85 * 10**9).bytes()
    other = pbf.framed("OSMHeader", Message().text(4, "OsmSchema-V0.6").bytes())
    (tmp_path / "a.osm.pbf").write_bytes(other + blob(body, True) + pbf.framed("Else", b"x"))
    got = {(r.kind, r.id): r for r in pbf.read_elements(pbf.listed(spark, str(tmp_path))).collect()}
    assert set(got) == {("node", 7), ("way", 50), ("way", 51), ("way", 52)}
    assert got["node", 7].tags == {"amenity": "clinic"} and got["node", 7].lat == pytest.approx(27.0001) and got["node", 7].lon == pytest.approx(-85.0002)
    assert [(p.lng, p.lat) for p in got["way", 50].path] == [pytest.approx((-85 + i * 1e-6, 27 + i * 1e-5)) for i in (1, 2, 3)]
    assert [got["way", k].whole for k in (50, 51, 52)] == [True, False, True] and len(got["way", 51].path) == 1 and got["way", 52].path == []
    (tmp_path / "b.pbf").write_bytes(b"\xff" * 100)
    with pytest.raises(Exception, match="no map file"):
        pbf.read_raw(pbf.listed(spark, str(tmp_path))).count()


def test_map_files_without_elements(spark, tmp_path):
    assert pbf.write(spark.createDataFrame([], pbf.ELEMENT), str(tmp_path)) == 0
    assert pbf.read_elements(pbf.listed(spark, str(tmp_path))).count() == 0


def test_blocks_that_would_be_too_long(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pbf, "BLOCK_BYTES", 300)
    import pandas as pd

    part = pd.DataFrame([("node", k, {"name": str(k) * 40}, 1.0, 2.0, None) for k in range(20)], columns=["kind", "id", "tags", "lon", "lat", "refs"])
    bodies = list(pbf.blocks_of(part))
    assert len(bodies) > 1 and [e[1] for b in bodies for e in pbf.elements_of(b)] == list(range(20))


def test_codes_and_offsets(spark):
    rows = [(i, f"n{i * 7919 % 1000:04d}" if i % 11 else None, i % 5 if i % 7 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, name string, size int").repartition(7)
    names = sorted({n for _, n, _ in rows if n})
    assert {(r.name, r.code) for r in ranks.dense_codes(df, "name").collect()} == {(n, k) for k, n in enumerate(names)}
    want, total = {}, 0
    for i, _, s in rows:
        want[i], total = total, total + (s or 0)
    assert {r.id: r.start for r in ranks.offsets(df, "id", "size").collect()} == want
    assert ranks.dense_codes(df.limit(0), "name").count() == 0 and ranks.offsets(df.limit(0), "id", "size").count() == 0


def walk(a: tuple, b: tuple) -> set:
    """Cell by cell: an error decides at each step whether a row, a column or both are taken; no step passes the end."""
    n, m = abs(b[0] - a[0]), abs(b[1] - a[1])
    down, right = (1 if b[0] >= a[0] else -1), (1 if b[1] >= a[1] else -1)
    r, c, off, out = *a, n - m, {a}
    while (r, c) != b:
        row, col = 2 * off > -m, 2 * off < n
        off += (m if col else 0) - (m if row else 0)
        r = r + down if row and r != b[0] else r
        c = c + right if col and c != b[1] else c
        out.add((r, c))
    return out


def test_cells_of_polylines(spark):
    grid = Grid(40, 40, 0.0, 0.0, 1.0, 1.0)
    ends = [((20, 20), (20 + i, 20 + j)) for i in range(-19, 20, 1) for j in range(-19, 20, 1)]
    place = lambda p: {"lng": p[1] + 0.5, "lat": 40 - p[0] - 0.5}
    df = spark.createDataFrame([(k, [place(a), place(b)]) for k, (a, b) in enumerate(ends)], "id bigint, path array<struct<lng: double, lat: double>>")
    got: dict = {}
    for x in terrain.polyline_cells(df, grid).collect():
        got.setdefault(x.id, set()).add((x.r, x.c))
    assert got == {k: walk(a, b) for k, (a, b) in enumerate(ends)}


def test_a_long_segment(spark):
    grid = Grid(3, 1_000_000, 0.0, 0.0, 1e-4, 1.0)
    df = spark.createDataFrame([(1, [{"lng": 0.00005, "lat": 2.5}, {"lng": 99.99995, "lat": 0.5}])], "id bigint, path array<struct<lng: double, lat: double>>")
    assert terrain.polyline_cells(df, grid).count() == 1_000_002


def test_sweep_against_all_pairs(spark):
    """Scenarios far and near, weak and strong, without a number, at the pole; points anywhere, some without a place."""
    rng = np.random.default_rng(8)
    points = [(f"k{i % 2}", str(i), float(x), float(y)) for i, (x, y) in enumerate(rng.random((400, 2)) * [8, 6] + [82, 25])] + [("k0", "x", None, 1.0), ("k1", "pole", 10.0, 89.9)]
    scenarios = [(0, 85.0, 27.0, 6.5, 10.0), (1, 0.0, 0.0, 9.0, 0.0), (2, 84.0, 28.0, 0.5, 5.0), (3, 86.0, 29.0, 8.9, 40.0), (4, None, 1.0, 5.0, 1.0), (5, 10.0, 89.5, 9.5, 10.0), (6, 85.3, 27.6, 9.99, 0.0)]
    p = spark.createDataFrame(points, "kind string, id string, lng double, lat double")
    s = spark.createDataFrame(scenarios, "scenario int, lng double, lat double, magnitude double, depth_km double")
    want: dict = {}
    for row in scenarios:
        for r in quake.point_intensity(p, *row[1:]).groupBy("kind", "band").count().collect() if row[1] is not None else [type("R", (), {"kind": k, "band": None, "count": 201}) for k in ("k0", "k1")]:
            want[row[0], r.kind, r.band or "none"] = r["count"] if not isinstance(r, type) else r.count
    got = {(r.scenario, r.kind, r.band): r.n for r in quake.sweep(p, s).collect()}
    assert got == want and any(k[2] == "high" for k in got) and got[1, "k0", "none"] == 201
    lines = p.withColumn("id", F.concat(F.lit("line"), (F.col("id").try_cast("int") % 20).cast("string"))).where("id IS NOT NULL")
    by_line = {(r.scenario, r.kind, r.band): r.n for r in quake.sweep(lines, s, lines=True).collect()}
    one = quake.exposed(lines.withColumn("name", F.lit("n")), *scenarios[0][1:])
    assert {(0, r.kind, r.band or "none"): r["count"] for r in one.groupBy("kind", "band").count().collect()} == {k: v for k, v in by_line.items() if k[0] == 0}


@pytest.mark.parametrize("side", [4, 7, 128])
def test_blocks_give_what_cells_give(spark, side):
    """Blocks that end within the raster, cells that are missing, plains and a mask on the borders."""
    rng = np.random.default_rng(6)
    grid = Grid(17, 13, 85.0, 27.0, 0.01, 0.02)
    elev = rng.integers(0, 6, (17, 13)).astype(float).tolist()
    whole = spark.createDataFrame([(r, c, elev[r][c]) for r in range(17) for c in range(13)], "r int, c int, elev double")
    holed = whole.where("NOT (r BETWEEN 5 AND 8 AND c BETWEEN 3 AND 7) AND r * 13 + c NOT IN (0, 16, 220)")
    got = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert got(blocks.d8_flow(holed, side), "r", "c", "code") == got(terrain.d8_flow(holed), "r", "c", "code")
    want = {(r, c): g for r, c, g in got(terrain.gradient(whole, grid), "r", "c", "grad")}
    assert {(r, c): pytest.approx(g) for r, c, g in got(blocks.gradient(whole, grid, side), "r", "c", "grad")} == want
    mask = spark.createDataFrame([(0, 0), (3, 6), (4, 7), (16, 12), (9, 0), (9, 0)], "r int, c int")
    assert got(blocks.dilate8(whole, mask, side), "r", "c") == got(terrain.dilate8(mask, grid), "r", "c")
    assert blocks.d8_flow(whole.limit(0), side).count() == blocks.gradient(whole.limit(0), grid, side).count() == 0


def test_roads_are_shuffled_by_their_keys_alone(spark):
    plan = tables.lines(tables.road_vertices(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "7919" in plan and "7919" not in plan[plan.index("Exchange") :]
