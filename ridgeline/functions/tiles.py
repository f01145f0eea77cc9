"""Slippy tiles, Web Mercator and encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latitude at which the Mercator square ends (a fixed value).
MERCATOR_LAT = 85.05112878


def tile_x(lng: Column, z: Column) -> Column:
    return F.floor((lng + 180.0) / 360.0 * F.pow(F.lit(2.0), z)).cast("int")


def tile_y(lat: Column, z: Column) -> Column:
    return F.floor(mercator_y(lat) * F.pow(F.lit(2.0), z)).cast("int")


def mercator_x(lng: Column) -> Column:
    return (lng + 180.0) / 360.0


def mercator_y(lat: Column) -> Column:
    rad = F.radians(F.least(F.lit(MERCATOR_LAT), F.greatest(F.lit(-MERCATOR_LAT), lat)))
    return (1.0 - F.log(F.tan(rad) + 1.0 / F.cos(rad)) / F.pi()) / 2.0


def tile_lng(x: Column, z: Column) -> Column:
    """West border of a tile column."""
    return x / F.pow(F.lit(2.0), z) * 360.0 - 180.0


def tile_lat(y: Column, z: Column) -> Column:
    """North border of a tile row; y may have a fraction."""
    return F.degrees(F.atan(F.sinh(F.pi() * (1.0 - 2.0 * y / F.pow(F.lit(2.0), z)))))


def zigzag(n: Column) -> Column:
    n = n.cast("bigint")
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def terrarium(elev: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of an elevation."""
    v = F.least(F.lit(65535.0), F.greatest(F.lit(0.0), elev + 32768.0))
    whole = F.floor(v).cast("int")
    return F.shiftright(whole, 8), whole.bitwiseAND(F.lit(255)), F.floor((v - whole) * 256.0).cast("int").bitwiseAND(F.lit(255))


def from_terrarium(r: Column, g: Column, b: Column) -> Column:
    """Elevation; beyond 12,000 m either way it is no data."""
    e = r * 256.0 + g + b / 256.0 - 32768.0
    return F.when(F.abs(e) <= 12000.0, e)
