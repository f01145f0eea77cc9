"""Stretches against the wet cells of a raster, without going through their samples.

Rows and columns of a stretch's samples only rise or only fall along it, rounding included.  So the samples between two lie in the box of
the cells of both, and if summed areas count no wet cell in it, none of them is wet.  Else the middle sample is looked at, and both halves
likewise.  Cells and stretches meet in tiles of a bounded number of cells, each of which is read once a share of the stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid

#: Cells of a tile, and columns of one at most; bits of one of Spark's bitmaps.
CELLS, COLUMNS, BITS = 1 << 20, 1024, 1 << 15
#: Shares into which a tile's stretches are dealt, and parts of stretches that are looked at together.
SHARES, TOGETHER = 32, 1 << 16
STRETCH = ("lng", "lat", "dx", "dy", "n")


def along(at: np.ndarray, by: np.ndarray, k: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """exposure.along over arrays, in the same order of operations."""
    return at + by * k / parts


def clamped(v: np.ndarray, count: int) -> np.ndarray:
    """Grid.row and Grid.col over arrays: truncated, then clamped; a place that is not known is in the last."""
    return np.clip(np.trunc(np.where(np.isnan(v), count - 1, v)), 0, count - 1).astype(np.int64)


def summed(wet: np.ndarray) -> np.ndarray:
    """Wet cells above and left of each corner of a mask."""
    sums = np.zeros((wet.shape[0] + 1, wet.shape[1] + 1), np.int32)
    np.cumsum(np.cumsum(wet, 0, dtype=np.int32), 1, out=sums[1:, 1:])
    return sums


def meets(wet: np.ndarray, sums: np.ndarray, top: int, left: int, grid: Grid, lng: np.ndarray, lat: np.ndarray, dx: np.ndarray, dy: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which stretches have a sample in a wet cell of a tile (a mask of cells and its summed areas), whose first cell is top, left."""
    height, width = wet.shape
    parts = np.maximum(n, 1)

    def cell(i: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = clamped((grid.max_lat - along(lat[i], dy[i], k, parts[i])) / grid.res_lat, grid.nrows)
        c = clamped((along(lng[i], dx[i], k, parts[i]) - grid.min_lng) / grid.res_lng, grid.ncols)
        return r - top, c - left

    hit = np.zeros(len(n), bool)
    stack = [(np.arange(len(n)), np.zeros(len(n), np.int64), n.astype(np.int64))]
    while stack:
        i, a, b = stack.pop()
        if len(i) > TOGETHER:
            stack.append((i[TOGETHER:], a[TOGETHER:], b[TOGETHER:]))
            i, a, b = i[:TOGETHER], a[:TOGETHER], b[:TOGETHER]
        on = ~hit[i]
        i, a, b = i[on], a[on], b[on]
        (r0, c0), (r1, c1) = cell(i, a), cell(i, b)
        r0, r1 = np.clip(np.minimum(r0, r1), 0, height), np.clip(np.maximum(r0, r1) + 1, 0, height)
        c0, c1 = np.clip(np.minimum(c0, c1), 0, width), np.clip(np.maximum(c0, c1) + 1, 0, width)
        on = sums[r1, c1] - sums[r0, c1] - sums[r1, c0] + sums[r0, c0] > 0
        i, a, b = i[on], a[on], b[on]
        middle = (a + b) // 2
        r, c = cell(i, middle)
        inside = (r >= 0) & (r < height) & (c >= 0) & (c < width)
        found = inside & wet[np.where(inside, r, 0), np.where(inside, c, 0)]
        hit[i[found]] = True
        i, a, b, middle = (v[~found] for v in (i, a, b, middle))
        before, after = a < middle, middle < b
        if before.any() or after.any():
            stack.append((np.concatenate([i[before], i[after]]), np.concatenate([a[before], middle[after] + 1]), np.concatenate([middle[before] - 1, b[after]])))
    return hit


def wet_stretches(stretches: DataFrame, wet: DataFrame, grid: Grid) -> DataFrame:
    """The rows of stretches (lng, lat, dx, dy, n and more columns, which are kept) with a sample in a wet cell (r, c), once for each tile where one is.

    A task holds the mask of one tile and a batch of stretches, however many there are.
    """
    columns = min(grid.ncols, COLUMNS)
    height, across = max(1, CELLS // columns), -(-grid.ncols // columns)
    at = (F.col("r") % height) * columns + F.col("c") % columns
    tile = lambda r, c: (F.floor(r / height) * across + F.floor(c / columns)).cast("bigint")
    masks = wet.select(tile(F.col("r"), F.col("c")).alias("tile"), at.cast("bigint").alias("at")).groupBy("tile", F.floor(F.col("at") / BITS).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("at") % BITS).alias("bits"))
    masks = masks.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))

    kept = [f for f in stretches.schema.fields if f.name not in STRETCH]
    own = [F.col(f.name).alias(f"own{k}") for k, f in enumerate(kept)]
    names, ddl = [f"own{k}" for k in range(len(kept))], "".join(f"own{k} {f.dataType.simpleString()}, " for k, f in enumerate(kept))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each stretch once for every tile between those of its ends; as expressions of Spark's, the ends would be reckoned many times over."""
        for batch in batches:
            lng, lat, dx, dy, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in STRETCH)
            parts = np.maximum(n, 1)
            r0, r1 = np.sort([clamped((grid.max_lat - along(lat, dy, k, parts)) / grid.res_lat, grid.nrows) // height for k in (np.zeros_like(n), n)], 0)
            c0, c1 = np.sort([clamped((along(lng, dx, k, parts) - grid.min_lng) / grid.res_lng, grid.ncols) // columns for k in (np.zeros_like(n), n)], 0)
            wide, many = c1 - c0 + 1, (r1 - r0 + 1) * (c1 - c0 + 1)
            ends = np.cumsum(many)
            for x in range(0, int(many.sum()), TOGETHER):
                k = np.arange(x, min(x + TOGETHER, ends[-1]))
                i = np.searchsorted(ends, k, side="right")
                k -= ends[i] - many[i]
                tiles = (r0[i] + k // wide[i]) * across + c0[i] + k % wide[i]
                rows = batch.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(tiles)], names=[*rows.schema.names, "tile"])

    dealt = stretches.where("n IS NOT NULL").select(*own, *STRETCH).mapInArrow(deal, f"{ddl}lng double, lat double, dx double, dy double, n int, tile bigint")
    dealt = dealt.withColumn("share", F.pmod(F.xxhash64("lng", "lat", "dx", "dy"), F.lit(SHARES)).cast("int"))
    rows = dealt.unionByName(masks, allowMissingColumns=True).repartition("tile", "share").sortWithinPartitions("tile", F.col("part").asc_nulls_last())

    def mask(bits: dict[int, bytes]) -> np.ndarray:
        whole = np.zeros(-(-height * columns // BITS) * BITS, bool)
        for part, b in bits.items():
            whole[part * BITS : (part + 1) * BITS] = np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")
        return whole[: height * columns].reshape(height, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits, cells, sums = None, {}, None, None
        for batch in batches:
            tiles = batch.column("tile").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], tiles[1:] != tiles[:-1], [True]])) if len(tiles) else np.empty(0, np.int64)
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if tiles[low] != now:
                    now, bits, cells = tiles[low], {}, None
                piece = batch.slice(low, high - low)
                lines = piece.column("part").is_null()
                of_mask = piece.filter(pc.invert(lines))
                bits |= dict(zip(of_mask.column("part").to_pylist(), of_mask.column("bits").to_pylist(), strict=True))
                piece = piece.filter(lines)
                if piece.num_rows and bits:
                    if cells is None:
                        cells = mask(bits)
                        sums = summed(cells)
                    lng, lat, dx, dy = (piece.column(c).to_numpy(zero_copy_only=False) for c in STRETCH[:4])
                    on = meets(cells, sums, int(now) // across * height, int(now) % across * columns, grid, lng, lat, dx, dy, piece.column("n").to_numpy())
                    yield piece.filter(pa.array(on)).select(names)

    return rows.mapInArrow(run, ddl.rstrip(", ")).toDF(*(f.name for f in kept))
