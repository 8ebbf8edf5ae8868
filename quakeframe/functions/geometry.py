"""Spherical geometry and value transforms as Column expressions (degrees in, kilometres out)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088


def unit_xyz(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lon), F.radians(lat)
    return F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)


def chord(p: tuple[Column, Column, Column], q: tuple[Column, Column, Column]) -> Column:
    x, y, z = (u - v for u, v in zip(p, q, strict=True))
    return F.sqrt(x * x + y * y + z * z)


def chord_to_km(c: Column) -> Column:
    return F.asin(F.least(F.greatest(c / 2, F.lit(0.0)), F.lit(1.0))) * (2 * EARTH_RADIUS_KM)


def km_to_chord(km: float) -> float:
    """The chord of a great-circle radius; half way round the earth at most."""
    if not math.isfinite(km) or km < 0:
        raise ValueError("a radius must be finite and not negative")
    return 2 * math.sin(min(km / EARTH_RADIUS_KM, math.pi) / 2)


def great_circle_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return chord_to_km(chord(unit_xyz(lon1, lat1), unit_xyz(lon2, lat2)))


def azimuthal_equidistant(lon: Column, lat: Column, center_lon: float, center_lat: float) -> tuple[Column, Column]:
    """x, y in km from the centre: true distance and direction from it; the scale at the centre is one."""
    phi0, phi = math.radians(center_lat), F.radians(lat)
    delta = F.radians(F.pmod(lon - center_lon + 180, F.lit(360.0)) - 180)
    east = F.cos(phi) * F.sin(delta)
    north = math.cos(phi0) * F.sin(phi) - math.sin(phi0) * F.cos(phi) * F.cos(delta)
    up = math.sin(phi0) * F.sin(phi) + math.cos(phi0) * F.cos(phi) * F.cos(delta)
    sine = F.sqrt(east * east + north * north)
    k = F.when(sine < 1e-12, F.lit(1.0)).otherwise(F.atan2(sine, up) / sine)
    return east * k * EARTH_RADIUS_KM, north * k * EARTH_RADIUS_KM


def forward_transform(value: Column, transform: str = "identity") -> Column:
    if transform == "identity":
        return value
    if transform != "log":
        raise ValueError("transform must be 'identity' or 'log'")
    return F.when(value <= 0, F.raise_error(F.lit("the log transform needs values greater than zero"))).otherwise(F.ln(value))


def inverse_transform(value: Column, transform: str = "identity") -> Column:
    return F.exp(value) if transform == "log" else value
