"""Rasters as square blocks of cells: a stencil reads a block and the margin that its neighbours send, not eight copies of every cell.

Cells are dealt to blocks once; after that only strips along the borders of blocks are shuffled beside them.  A block is a
row of bounded size whatever the raster; what is missing from a block or lies outside the raster is NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import KM_PER_DEG, Grid
from .terrain import NEIGHBOURS

#: Cells of a block's side.
SIDE = 128


def blocks(cells: DataFrame, columns: list[str], side: int = SIDE) -> DataFrame:
    """br, bc, data: the columns of cells (r, c, ...) as doubles, column by column, of every block that has a cell; of repeated cells one counts."""

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        data = np.full((len(columns), side, side), np.nan)
        for k, name in enumerate(columns):
            data[k, part["r"] % side, part["c"] % side] = part[name]
        return pd.DataFrame([[*key, data.tobytes()]], columns=["br", "bc", "data"])

    dealt = cells.select(F.floor(F.col("r") / side).cast("int").alias("br"), F.floor(F.col("c") / side).cast("int").alias("bc"), "r", "c", *(F.col(x).cast("double").alias(x) for x in columns))
    return dealt.groupBy("br", "bc").applyInPandas(pack, "br int, bc int, data binary")


def span(step: int, side: int, halo: int) -> tuple[slice, slice]:
    """Of one axis, what a block sends to the block a step on, and where that puts it within its margin."""
    if step > 0:
        return slice(side - halo, side), slice(0, halo)
    if step < 0:
        return slice(0, halo), slice(side + halo, side + 2 * halo)
    return slice(0, side), slice(halo, side + halo)


def stencil(rows: DataFrame, fn: Callable[[np.ndarray], dict[str, np.ndarray]], ddl: str, n_columns: int = 1, side: int = SIDE, halo: int = 1) -> DataFrame:
    """r, c and the columns of ddl, from fn on each block (columns, side + 2 halo, side + 2 halo).

    fn gives an array of side by side for each column, and `keep`, which cells give a row.
    """

    def strips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for br, bc, data in zip(b["br"], b["bc"], b["data"], strict=True):
                a = np.frombuffer(data).reshape(n_columns, side, side)
                sent = [(br + dr, bc + dc, dr, dc, a[:, span(dr, side, halo)[0], span(dc, side, halo)[0]].tobytes()) for dr, dc in NEIGHBOURS]
                yield pd.DataFrame(sent, columns=["br", "bc", "dr", "dc", "strip"])

    def run(key: tuple, own: pd.DataFrame, margin: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame({n: [] for n in names})
        a = np.full((n_columns, side + 2 * halo, side + 2 * halo), np.nan)
        a[:, halo:-halo, halo:-halo] = np.frombuffer(own["data"].iloc[0]).reshape(n_columns, side, side)
        for dr, dc, data in zip(margin["dr"], margin["dc"], margin["strip"], strict=True):
            at = a[:, span(dr, side, halo)[1], span(dc, side, halo)[1]]
            at[:] = np.frombuffer(data).reshape(at.shape)
        out = fn(a)
        r, c = np.nonzero(out.pop("keep"))
        return pd.DataFrame({"r": r + key[0] * side, "c": c + key[1] * side, **{n: v[r, c] for n, v in out.items()}})[names]

    names = ["r", "c", *(x.split()[0] for x in ddl.split(", "))]
    sent = rows.mapInPandas(strips, "br int, bc int, dr int, dc int, strip binary")
    return rows.groupBy("br", "bc").cogroup(sent.groupBy("br", "bc")).applyInPandas(run, f"r int, c int, {ddl}")


def beside(a: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """The neighbours of all cells of a block with a margin of one."""
    return a[1 + dr : a.shape[0] - 1 + dr, 1 + dc : a.shape[1] - 1 + dc]


def d8_flow(dem: DataFrame, side: int = SIDE) -> DataFrame:
    """r, c, code of the neighbour with the largest drop, of equal ones the first; only cells that have a drop."""

    def flow(a: np.ndarray) -> dict[str, np.ndarray]:
        drops = np.stack([beside(a[0], 0, 0) - beside(a[0], *step) for step in NEIGHBOURS])
        drops = np.where(np.isnan(drops), -np.inf, drops)
        code = drops.argmax(axis=0)
        return {"code": code.astype(np.int32), "keep": drops.max(axis=0) > 0}

    return stencil(blocks(dem, ["elev"], side), flow, "code int", side=side)


def gradient(dem: DataFrame, grid: Grid, side: int = SIDE) -> DataFrame:
    """r, c, grad: central differences in metres, one-sided at the border and beside missing cells."""
    metres = (grid.res_lat * KM_PER_DEG * 1000.0, grid.res_lng * grid.km_per_deg_lng(grid.mid_lat) * 1000.0)

    def slope(a: np.ndarray) -> dict[str, np.ndarray]:
        here, total = beside(a[0], 0, 0), 0.0
        for (dr, dc), step in zip(((1, 0), (0, 1)), metres, strict=True):
            after, before = beside(a[0], dr, dc), beside(a[0], -dr, -dc)
            lacks = np.isnan(after).astype(int) + np.isnan(before)
            rise = np.where(np.isnan(after), here, after) - np.where(np.isnan(before), here, before)
            total = total + np.where(lacks == 2, 0.0, rise / (step * np.where(lacks == 1, 1.0, 2.0))) ** 2
        return {"grad": np.sqrt(total), "keep": ~np.isnan(here)}

    return stencil(blocks(dem, ["elev"], side), slope, "grad double", side=side)


def dilate8(dem: DataFrame, mask: DataFrame, side: int = SIDE) -> DataFrame:
    """r, c of the raster's cells in the mask or beside one of it."""
    cells = dem.select("r", "c", F.lit(1.0).alias("there")).join(mask.select("r", "c", F.lit(1.0).alias("on")).distinct(), ["r", "c"], "left")

    def grown(a: np.ndarray) -> dict[str, np.ndarray]:
        on = ~np.isnan(a[1])
        any_ = beside(on, 0, 0).copy()
        for step in NEIGHBOURS:
            any_ |= beside(on, *step)
        return {"on": beside(on, 0, 0), "keep": any_ & ~np.isnan(beside(a[0], 0, 0))}

    return stencil(blocks(cells, ["there", "on"], side), grown, "on boolean", 2, side).select("r", "c")
