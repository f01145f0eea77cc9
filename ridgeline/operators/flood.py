"""The time-stepped flood, in tiles.

Hundreds of steps would each be a shuffle as joins (``terrain.flux_step`` is one, for checks).  So a raster is cut into tiles that a
task steps on its own: in a step a cell depends on cells at most two away, so with a margin of 2 k cells a tile's own cells are exact
for k steps.  After k steps depths and peaks are written, and margins are dealt anew.  A box of one tile needs no margin and one round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid
from .durable import written
from .graph import shuffled
from .terrain import FLUX, NEIGHBOURS, WET


def shifted(a: np.ndarray, dr: int, dc: int, fill: float) -> np.ndarray:
    """a[r + dr, c + dc], and fill outside."""
    n, m = a.shape
    padded = np.full((n + 2, m + 2), fill, a.dtype)
    padded[1:-1, 1:-1] = a
    return padded[1 + dr : 1 + dr + n, 1 + dc : 1 + dc + m]


def flux(elev: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Depths after one step; what leaves a cell arrives at its neighbours, and borders are walls."""
    surface, eighth, out = elev + depth, depth / np.float32(8), []
    for dr, dc in NEIGHBOURS:
        head = surface - shifted(surface, dr, dc, np.inf)
        out.append(np.where(head > 0, np.minimum(np.float32(FLUX) * head, eighth), np.float32(0)))
    total = sum(out)
    scale = np.minimum(np.float32(1), depth / np.maximum(total, np.float32(1e-6)))
    new = depth - total * scale
    for (dr, dc), f in zip(NEIGHBOURS, out, strict=True):
        new = new + shifted(f * scale, -dr, -dc, 0.0)
    return new


def peaks(elev: np.ndarray, inflow: np.ndarray, start: np.ndarray, n_steps: int, window: int, first: int = 0, depth: np.ndarray | None = None, peak: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Depth after the steps from first to n_steps, and the highest depth: release, then flux, then the envelope, in every step."""
    depth = np.zeros_like(elev) if depth is None else depth
    peak = depth if peak is None else peak
    for t in range(first, n_steps):
        u = (t - start) / np.float32(window)
        depth = depth + np.where((u >= 0) & (u < 1), inflow * np.float32(3.0 / window) * (2 * u - 2 * u * u), np.float32(0))
        depth = flux(elev, depth)
        peak = np.maximum(peak, depth)
    return depth, peak


#: Cells of a side of a tile, and steps between two dealings of margins.
TILE, STEPS = 1024, 64
STATE = "scenario int, r int, c int, elev double, d_cell double, start int, n_steps int, window int, depth float, peak float"


def simulate(dem: DataFrame, plan: DataFrame, box: DataFrame, tile: int = TILE, steps: int = STEPS) -> DataFrame:
    """scenario, r, c, elev, depth of the cells that get wet: peak depth of each scenario's plan inside its box.

    dem: r, c, elev.  plan: scenario, r, c, d_cell, start, n_steps, window.  box: scenario, r0, r1, c0, c1.  A scenario
    without inflow is dry and gives no rows; cells missing from dem are walls.  A group is at most (tile + 4 steps) squared cells.
    """
    size = box.join(plan.groupBy("scenario").agg(F.max("n_steps").alias("n"), F.max("window").alias("w")), "scenario")
    # Each scenario has its rows of tiles, and an equi-join on them finds its cells.
    bands = size.select("scenario", "r0", "r1", "c0", "c1", "n", "w", F.explode(F.sequence(F.floor(F.col("r0") / tile), F.floor(F.col("r1") / tile))).alias("band"))
    cells = dem.select("r", "c", "elev").withColumn("band", F.floor(F.col("r") / tile)).join(bands, "band").where("r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1")
    cells = cells.join(shuffled(plan.select("scenario", "r", "c", "d_cell", "start")), ["scenario", "r", "c"], "left")
    zero = F.lit(0.0).cast("float")
    state = cells.select("scenario", (F.col("r") - F.col("r0")).cast("int").alias("r"), (F.col("c") - F.col("c0")).cast("int").alias("c"), F.col("elev").cast("double").alias("elev"), F.coalesce("d_cell", F.lit(0.0)).alias("d_cell"), F.coalesce("start", F.lit(0)).alias("start"), F.col("n").alias("n_steps"), F.col("w").alias("window"), zero.alias("depth"), zero.alias("peak"))
    most = size.agg(F.max(F.greatest(F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0"))).alias("side"), F.max("n").alias("n")).first()
    if most.n is None:
        return dem.sparkSession.createDataFrame([], "scenario int, r int, c int, elev double, depth double")
    one = most.side < tile
    rounds = [(0, most.n)] if one else [(t, t + steps) for t in range(0, most.n, steps)]
    for first, last in rounds:
        state = stepped(state, tile, 0 if one else 2 * steps, first, last)
        state = state if one else written(state, "flood")
    out = state.where(F.col("peak") > WET).join(box.select("scenario", "r0", "c0"), "scenario")
    return out.select("scenario", (F.col("r") + F.col("r0")).cast("int").alias("r"), (F.col("c") + F.col("c0")).cast("int").alias("c"), "elev", F.col("peak").cast("double").alias("depth"))


def stepped(state: DataFrame, tile: int, margin: int, first: int, last: int) -> DataFrame:
    """The state after the steps from first to last, each scenario to its own end."""
    spans = lambda v: F.sequence(F.floor((F.col(v) - margin) / tile), F.floor((F.col(v) + margin) / tile))
    dealt = state.withColumn("tr", F.explode(spans("r"))).withColumn("tc", F.explode(spans("c")))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, tr, tc = key
        own = ((part["r"] // tile == tr) & (part["c"] // tile == tc)).to_numpy()
        if not own.any():
            return part.head(0).drop(columns=["tr", "tc"])
        r, c = part["r"].to_numpy() - part["r"].min(), part["c"].to_numpy() - part["c"].min()
        grid = lambda name, fill: (a := np.full((r.max() + 1, c.max() + 1), np.float32(fill)), a.__setitem__((r, c), part[name]))[0]
        n, window = int(part["n_steps"].iloc[0]), int(part["window"].iloc[0])
        depth, peak = peaks(grid("elev", 1e9), grid("d_cell", 0), grid("start", 0), min(last, n), window, first, grid("depth", 0), grid("peak", 0))
        part = part.assign(depth=depth[r, c], peak=peak[r, c])
        return part[own].drop(columns=["tr", "tc"])

    return dealt.groupBy("scenario", "tr", "tc").applyInPandas(run, STATE)


def boxes(plans: DataFrame, flow: DataFrame, grid: Grid, margin: int = 12) -> DataFrame:
    """scenario, r0, r1, c0, c1: the inflow cells of each plan, what they flow to and what flows to them by one step, and a margin."""
    i = plans.select("scenario", "r", "c")
    down = i.join(shuffled(flow), ["r", "c"]).select("scenario", F.col("nr").alias("r"), F.col("nc").alias("c"))
    up = i.join(shuffled(flow.select(F.col("nr").alias("r"), F.col("nc").alias("c"), F.col("r").alias("ur"), F.col("c").alias("uc"))), ["r", "c"]).select("scenario", F.col("ur").alias("r"), F.col("uc").alias("c"))
    lo, hi = (lambda v: F.greatest(F.lit(0), F.min(v) - margin)), (lambda v, n: F.least(F.lit(n - 1), F.max(v) + margin))
    return i.union(down).union(up).groupBy("scenario").agg(lo("r").alias("r0"), hi("r", grid.nrows).alias("r1"), lo("c").alias("c0"), hi("c", grid.ncols).alias("c1"))


def wet_cells(dem: DataFrame, flow: DataFrame, plans: DataFrame, grid: Grid, region: DataFrame | None = None) -> DataFrame:
    """scenario, r, c, elev, depth of what each plan floods, within the region's cells (r, c) if there is one."""
    flow, plans = written(flow, "flow"), written(plans, "plans")
    wet = simulate(dem, plans, written(boxes(plans, flow, grid), "boxes"))
    return wet if region is None else wet.join(shuffled(region.select("r", "c")), ["r", "c"], "left_semi").select("scenario", "r", "c", "elev", "depth")
