"""Rasters in files: elevation bands as npz with a georeference beside them, and terrain tiles as PNG.

Files are read by Spark's own binary reader, from any store that Spark knows; a file is a row, of 2 GB at most.  A raster
larger than a file is a folder of bands of rows.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import Grid
from ..functions.images import image_of
from .files import saved

#: Elevations farther from zero mean that there is none (fixed value), and cells that a task holds at one time.
BEYOND_M, CELLS = 12_000.0, 1 << 20
BAND = re.compile(r"dem(?:-(\d+))?\.npz$")


def write(dem: DataFrame, grid: Grid, folder: str, rows: int | None = None) -> int:
    """Write a raster (r, c, elev) as dem.npz, or as dem-<first row>.npz of so many rows each, and dem.meta.json; gives the number of files.

    Each band is a task's group and file; cells without elevation are NaN.
    """

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        row0, height = key[0] * (rows or grid.nrows), rows or grid.nrows
        elev = np.full((min(height, grid.nrows - row0), grid.ncols), np.nan, np.float32)
        elev[part["r"] - row0, part["c"]] = part["elev"]
        body = io.BytesIO()
        np.savez_compressed(body, elev=elev)
        with saved(f"{folder}/dem.npz" if rows is None else f"{folder}/dem-{row0:09d}.npz") as out:
            out.write(body.getvalue())
        return pd.DataFrame({"n": [1]})

    with saved(f"{folder}/dem.meta.json") as out:
        out.write(json.dumps({"min_lng": grid.min_lng, "min_lat": grid.min_lat, "res_lng": grid.res_lng, "res_lat": grid.res_lat}).encode())
    banded = dem.select(F.floor(F.col("r") / (rows or grid.nrows)).cast("int").alias("band"), "r", "c", "elev")
    return banded.groupBy("band").applyInPandas(pack, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, float]]:
    """r, c, elev of a folder's bands, and its georeference; cells that are NaN or beyond any height on earth are null."""
    meta = json.loads("".join(r.value for r in spark.read.text(f"{folder}/dem.meta.json").collect()))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "dem*.npz").load(folder).select("path", "content")

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                found = BAND.search(name)
                if found:
                    elev = np.load(io.BytesIO(content))["elev"]
                    row0, ncols = int(found[1] or 0), elev.shape[1]
                    step = max(1, CELLS // max(ncols, 1))
                    for k in range(0, len(elev), step):
                        part = elev[k : k + step].astype(np.float64)
                        r, c = np.indices(part.shape)
                        yield pd.DataFrame({"r": (r.ravel() + row0 + k).astype(np.int32), "c": c.ravel().astype(np.int32), "elev": part.ravel()})

    rows = files.mapInPandas(cells, "r int, c int, elev double")
    return rows.withColumn("elev", F.when(~F.isnan("elev") & (F.abs("elev") <= BEYOND_M), F.col("elev"))), meta


def read_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """z, x, y, py, px, elev of terrain tiles laid out as z/x/y.png; a pixel that is clear, or beyond any height, is null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(folder).select("path", "content")

    def pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                z, x, y = map(int, re.search(r"(\d+)/(\d+)/(\d+)\.png$", name).groups())
                image = image_of(content).astype(np.float64)
                elev = image[:, :, 0] * 256 + image[:, :, 1] + image[:, :, 2] / 256 - 32768
                py, px = np.indices(elev.shape)
                elev[image[:, :, 3] == 0] = np.nan
                yield pd.DataFrame({"z": z, "x": x, "y": y, "py": py.ravel(), "px": px.ravel(), "elev": elev.ravel()})

    rows = files.mapInPandas(pixels, "z int, x int, y int, py int, px int, elev double")
    return rows.withColumn("elev", F.when(~F.isnan("elev") & (F.abs("elev") <= BEYOND_M), F.col("elev")))
