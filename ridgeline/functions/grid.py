"""Arithmetic of a regular elevation grid; row 0 is north."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kilometres per degree of latitude, and metres per degree as the map tools take it (fixed values).
KM_PER_DEG = 111.32
M_PER_DEG = 111320.0


@dataclass(frozen=True)
class Grid:
    """Georeference of one raster: five numbers, whatever its size."""

    nrows: int
    ncols: int
    min_lng: float
    min_lat: float
    res_lng: float
    res_lat: float

    @property
    def max_lng(self) -> float:
        return self.min_lng + self.ncols * self.res_lng

    @property
    def max_lat(self) -> float:
        return self.min_lat + self.nrows * self.res_lat

    @property
    def mid_lat(self) -> float:
        return (self.min_lat + self.max_lat) / 2.0

    def km_per_deg_lng(self, lat: float) -> float:
        return KM_PER_DEG * max(math.cos(math.radians(lat)), 0.1)

    @property
    def cell_area_m2(self) -> float:
        """One area for all cells, at the middle latitude."""
        return self.res_lng * self.km_per_deg_lng(self.mid_lat) * 1000.0 * self.res_lat * KM_PER_DEG * 1000.0

    def row(self, lat: Column) -> Column:
        """Truncated toward zero, then clamped: points outside snap to the border."""
        return F.greatest(F.lit(0), F.least(F.lit(self.nrows - 1), ((F.lit(self.max_lat) - lat) / F.lit(self.res_lat)).cast("int")))

    def col(self, lng: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(self.ncols - 1), ((lng - F.lit(self.min_lng)) / F.lit(self.res_lng)).cast("int")))

    def lng(self, c: Column) -> Column:
        """Of cell centres."""
        return F.lit(self.min_lng) + (c + F.lit(0.5)) * F.lit(self.res_lng)

    def lat(self, r: Column) -> Column:
        return F.lit(self.max_lat) - (r + F.lit(0.5)) * F.lit(self.res_lat)


def grid_of(dem: DataFrame, min_lng: float, min_lat: float, width: float, height: float) -> Grid:
    """The grid of cells (r, c) over a fixed extent; one small aggregate."""
    n = dem.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()
    nrows, ncols = (n.r or 0) + 1, (n.c or 0) + 1
    return Grid(nrows, ncols, min_lng, min_lat, width / ncols, height / nrows)


def km_per_deg_lng(lat: Column) -> Column:
    return F.lit(KM_PER_DEG) * F.greatest(F.cos(F.radians(lat)), F.lit(0.1))
