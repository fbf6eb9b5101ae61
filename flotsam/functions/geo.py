"""Boxes, distances, projections and drift as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CURRENT_SHARE, KM_PER_DEGREE, METRES_PER_DEGREE, WIND_SHARE


def box(lon_min: Column, lat_min: Column, lon_max: Column, lat_max: Column) -> Column:
    return F.struct(lon_min.alias("lon_min"), lat_min.alias("lat_min"), lon_max.alias("lon_max"), lat_max.alias("lat_max"))


def expand_box(b: Column, degrees: float | Column) -> Column:
    return box(b["lon_min"] - degrees, b["lat_min"] - degrees, b["lon_max"] + degrees, b["lat_max"] + degrees)


def parse_box(text: Column) -> Column:
    """``lon,lat,lon,lat`` as a box; null unless it is four numbers."""
    parts = F.split(text, ",", -1)
    numbers = F.transform(parts, lambda p: F.try_cast(F.trim(p), "double") if hasattr(F, "try_cast") else F.trim(p).try_cast("double"))
    ok = (F.size(parts) == 4) & F.forall(numbers, lambda x: x.isNotNull())
    return F.when(ok, box(*(F.get(numbers, F.lit(k)) for k in range(4))))


def pixel_to_map(row: Column, col: Column, transform: Column | None = None) -> tuple[Column, Column]:
    """Map coordinates of a place in pixels under six affine numbers; ten-metre pixels at the origin without any."""
    a, b, c, d, e, f = (F.get(transform, F.lit(k)) if transform is not None else F.lit(v) for k, v in enumerate((10.0, 0.0, 0.0, 0.0, -10.0, 0.0)))
    return a * col + b * row + c, d * col + e * row + f


def equirect_km(lon: Column, lat: Column, lon2: Column, lat2: Column) -> Column:
    """Flat-earth distance with the cosine at the first point."""
    x = (lon - lon2) * KM_PER_DEGREE * F.cos(F.radians(lat))
    y = (lat - lat2) * KM_PER_DEGREE
    return F.sqrt(x * x + y * y)


def drift_per_hour(lat: Column, u: Column, v: Column, u_wind: Column, v_wind: Column) -> tuple[Column, Column]:
    """Degrees of longitude and latitude an hour under current and wind in metres a second."""
    east, north = CURRENT_SHARE * u + WIND_SHARE * u_wind, CURRENT_SHARE * v + WIND_SHARE * v_wind
    return east / (METRES_PER_DEGREE * F.cos(F.radians(lat)) + 1e-10) * 3600, north / METRES_PER_DEGREE * 3600


def wrap_lon(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def clamp_lat(lat: Column) -> Column:
    return F.least(F.greatest(lat, F.lit(-85.0)), F.lit(85.0))


def utm_to_lonlat(x: Column, y: Column, zone: Column, north: Column | bool = True) -> tuple[Column, Column]:
    """Longitude and latitude (WGS 84) of UTM coordinates, by the inverse series of the transverse Mercator projection."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    ep2 = e2 / (1 - e2)
    y = F.when(F.lit(north) if isinstance(north, bool) else north, y).otherwise(y - 1e7)
    mu = y / k0 / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    phi = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    c, t = ep2 * cos * cos, tan * tan
    n = a / F.sqrt(1 - e2 * sin * sin)
    r = a * (1 - e2) / F.pow(1 - e2 * sin * sin, F.lit(1.5))
    d = (x - 500000.0) / (n * k0)
    lat = phi - n * tan / r * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * F.pow(d, F.lit(4)) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * F.pow(d, F.lit(6)) / 720)
    lon = (d - (1 + 2 * t + c) * F.pow(d, F.lit(3)) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * F.pow(d, F.lit(5)) / 120) / cos
    return F.degrees(lon) + (zone * 6 - 183), F.degrees(lat)
