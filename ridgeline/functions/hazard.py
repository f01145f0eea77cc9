"""Earthquake intensity, bands and radii; flood release; suitability classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grid import KM_PER_DEG, km_per_deg_lng

#: Bands from worst to least with their lowest intensity, and the constants of the attenuation (fixed values).
BANDS = (("high", 0.32), ("medium_high", 0.20), ("medium", 0.10), ("low", 0.04))
REFERENCE_MAGNITUDE, REFERENCE_KM, DECAY, MAGNITUDE_POWER = 6.0, 8.0, 1.5, 2.0


def magnitude_factor(magnitude: Column) -> Column:
    return F.pow(F.greatest(magnitude, F.lit(0.0)) / REFERENCE_MAGNITUDE, F.lit(MAGNITUDE_POWER))


def intensity(km: Column, depth_km: Column, magnitude: Column) -> Column:
    """At most 1; null without a distance, a depth or a magnitude."""
    depth = F.when(depth_km < 0, F.lit(0.0)).otherwise(depth_km)
    slant = F.sqrt(km * km + depth * depth)
    felt = F.when(magnitude.isNotNull(), magnitude_factor(magnitude)) * F.pow(F.lit(REFERENCE_KM) / (F.lit(REFERENCE_KM) + slant), F.lit(DECAY))
    return F.when(felt > 1.0, F.lit(1.0)).otherwise(felt)


def band(index: Column) -> Column:
    """Name of the first band that the intensity reaches; null below all."""
    out = F.when(index >= BANDS[0][1], BANDS[0][0])
    for name, least in BANDS[1:]:
        out = out.when(index >= least, name)
    return out


def band_label(index: Column) -> Column:
    """1 = high to 4 = low, 0 = none."""
    out = F.when(index >= BANDS[0][1], 1)
    for k, (_, least) in enumerate(BANDS[1:], 2):
        out = out.when(index >= least, k)
    return out.otherwise(0)


def band_radius_km(least: Column, magnitude: Column, depth_km: Column) -> Column:
    """Where intensity falls to a threshold; 0 if it never reaches it."""
    ratio = least * REFERENCE_KM / F.greatest(magnitude_factor(magnitude), F.lit(1e-9))
    slant = F.greatest(REFERENCE_KM * F.pow(ratio / REFERENCE_KM, F.lit(-2.0 / 3.0)) - REFERENCE_KM, F.lit(0.0))
    depth = F.greatest(depth_km, F.lit(0.0))
    r = F.sqrt(F.greatest(slant * slant - depth * depth, F.lit(0.0)))
    return F.when(ratio >= REFERENCE_KM, F.lit(0.0)).otherwise(F.round(r, 1))


def distance_km(lng: Column, lat: Column, at_lng: Column, at_lat: Column, mean_latitude: bool = False) -> Column:
    """Local flat distance; the cosine is at the point's latitude, or at the mean of both (rasters)."""
    dx = (lng - at_lng) * km_per_deg_lng((lat + at_lat) / 2.0 if mean_latitude else lat)
    dy = (lat - at_lat) * KM_PER_DEG
    return F.sqrt(dx * dx + dy * dy)


def release(t: Column, start: Column, window: Column) -> Column:
    """Share of a cell's water that flows in at step t: a parabola over window steps from start."""
    u = (t - start) / window
    return F.when((t >= start) & (t < start + window), 3.0 / window * (2.0 * u - 2.0 * u * u)).otherwise(F.lit(0.0))


def suitability_class(score: Column) -> Column:
    return F.when(score >= 0.60, "green").when(score <= 0.42, "red").otherwise("yellow")
